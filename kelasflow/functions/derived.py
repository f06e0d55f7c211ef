"""Derived display columns the reference computes in the browser (U01-U16),
as built-in column expressions so they stay inside whole-stage codegen."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values taken from the reference UI.
STATUS_GRADED, STATUS_SUBMITTED, STATUS_PENDING = "Graded", "Submitted", "Pending"
GRADE_BANDS = [  # (lower bound, label), checked top-down
    (90, "Sangat Baik (90-100)"),
    (80, "Baik (80-89)"),
    (70, "Cukup (70-79)"),
    (None, "Kurang (<70)"),
]
MISSING_TEXT = "-"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def initials(name) -> Column:
    """First character of every space-separated word, upper-cased
    (empty words from doubled spaces contribute nothing)."""
    return F.upper(F.array_join(F.transform(F.split(_c(name), " "), lambda w: F.substring(w, 1, 1)), ""))


def subject_list(mapel) -> Column:
    """Comma-separated subjects as an array, untrimmed; NULL -> ['']."""
    return F.split(F.coalesce(_c(mapel), F.lit("")), ",")


def submission_rate(submitted, students) -> Column:
    """0 with no students, else round(100 * submitted / students) half
    up; may exceed 100."""
    return (F.when(F.coalesce(_c(students), F.lit(0)) == 0, F.lit(0))
            .otherwise(F.round(F.coalesce(_c(submitted), F.lit(0)) / _c(students) * 100))).cast("int")


def days_left(deadline, now: dt.datetime) -> Column:
    """ceil((deadline - now) / 1 day), negative once past.

    Date arithmetic only (whole days to ``now``'s date minus the part of
    that day already gone), so the result does not depend on the session
    time zone or on daylight-saving changes."""
    gone = (now - dt.datetime(now.year, now.month, now.day)).total_seconds() / 86400
    return F.ceil(F.datediff(_c(deadline), F.lit(now.date())) - F.lit(gone)).cast("int")


def grade_status(nilai, file_kumpul, ui_rule: bool = False) -> Column:
    """Graded / Submitted / Pending.  Server rule: any grade (even 0) is
    graded; ``ui_rule=True`` reproduces the page, where grade 0 is falsy."""
    graded = _c(nilai).isNotNull() & ((_c(nilai) != 0) if ui_rule else F.lit(True))
    return (F.when(graded, STATUS_GRADED)
            .when(F.coalesce(_c(file_kumpul), F.lit("")) != "", STATUS_SUBMITTED)
            .otherwise(STATUS_PENDING))


def grade_text(nilai, ui_rule: bool = False) -> Column:
    """``<grade>/100`` or ``-``."""
    graded = _c(nilai).isNotNull() & ((_c(nilai) != 0) if ui_rule else F.lit(True))
    return F.when(graded, F.concat(_c(nilai).cast("string"), F.lit("/100"))).otherwise(MISSING_TEXT)


def or_dash(c) -> Column:
    """NULL or empty text shown as ``-``."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(MISSING_TEXT))


def grade_band(nilai) -> Column:
    """Grade band label (NULL grade -> NULL)."""
    expr = None
    for lo, label in GRADE_BANDS:
        cond = _c(nilai) >= lo if lo is not None else _c(nilai).isNotNull()
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def absolute_link(path, base_url: str) -> Column:
    """Keep links starting with ``http``; prefix the rest with the base."""
    return F.when(_c(path).startswith("http"), _c(path)).otherwise(F.concat(F.lit(base_url), _c(path)))


def display_date(c) -> Column:
    """Id-ID short date ``d/M/yyyy``."""
    return F.date_format(_c(c), "d/M/yyyy")


def label_or_email(kelas, email) -> Column:
    """U16: class name, else e-mail (empty text counts as missing)."""
    return F.coalesce(F.nullif(_c(kelas), F.lit("")), _c(email))
