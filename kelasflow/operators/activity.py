"""Admin dashboard: counts, verifications, activity log, sign-up growth."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelasflow.sources.catalog import Tables

STUDENT_AND_TEACHER = ("siswa", "guru")


def ntz(value: dt.date | dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (midnight for a date)."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.expr(f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'")


def on_day(col: str, day: dt.date) -> Column:
    """``DATE(col) = day`` written as a half-open range so the scan can prune."""
    return (F.col(col) >= ntz(day)) & (F.col(col) < ntz(day + dt.timedelta(days=1)))


def admin_counts(t: Tables, as_of: dt.date) -> DataFrame:
    """One row: students, teachers, courses (any author) and log rows on ``as_of``.

    Each table is scanned once; the two single-value counts are scalar
    subqueries of the user aggregate, not joins.
    """
    n_courses = t.courses.agg(F.count(F.lit(1))).scalar()
    n_today = t.activity_logs.where(on_day("created_at", as_of)).agg(F.count(F.lit(1))).scalar()
    return t.users.agg(F.count_if(F.col("role") == "siswa").alias("total_siswa"),
                       F.count_if(F.col("role") == "guru").alias("total_guru"),
                       n_courses.alias("total_mapel"),
                       n_today.alias("aktivitas_hari_ini"))


def pending_verifications(t: Tables, ordered: bool = False) -> DataFrame:
    """Pending requests with the requester's name and role (``ordered``:
    latest request first, id as tie-break)."""
    v = t.verifications.where(F.col("status") == "pending")
    u = t.users.select(F.col("id").alias("user_id"), "name", "role")
    out = v.join(u, "user_id").select("id", "name", "role", "requested_at")
    return out.orderBy(F.col("requested_at").desc(), F.col("id").desc()) if ordered else out


def recent_activity(t: Tables, k: int = 5) -> DataFrame:
    """The ``k`` latest log rows that have a user (ties broken by log id).

    One join with a top-k on top: every task keeps its own latest ``k`` joined
    rows, and only those meet.  Only the columns shown are read from the log.
    """
    order = [F.col("created_at").desc(), F.col("id").desc()]
    u = t.users.select(F.col("id").alias("user_id"), "name")
    logs = t.activity_logs.select("id", "user_id", "action", "created_at")
    return logs.join(u, "user_id").orderBy(*order).limit(k).select("action", "name", "created_at")


def monthly_signups(t: Tables, by_year: bool = False) -> DataFrame:
    """Sign-ups of students and teachers per role and calendar month.

    As coded, months of different years are merged; ``by_year=True`` keeps
    the year as its own key.
    """
    u = t.users.where(F.col("role").isin(*STUDENT_AND_TEACHER))
    keys = [F.col("role"), F.month("created_at").alias("bulan")]
    if by_year:
        keys.insert(1, F.year("created_at").alias("tahun"))
    return u.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))


def monthly_signups_dense(t: Tables) -> DataFrame:
    """12 month slots per role, zero-filled (the dashboard chart series)."""
    grid = (t.spark.range(1, 13).select(F.col("id").cast("int").alias("bulan"))
            .select("bulan", F.explode(F.array(*[F.lit(r) for r in STUDENT_AND_TEACHER])).alias("role")))
    counts = monthly_signups(t).where(F.col("bulan").isNotNull())
    return (grid.join(F.broadcast(counts), ["role", "bulan"], "left")
            .select("role", "bulan", F.coalesce("total", F.lit(0)).alias("total")))


def program_distribution(t: Tables, by: str = "role") -> DataFrame:
    """Student count per role (as coded) or per programme (``by='jurusan'``)."""
    if by == "jurusan":
        return t.siswa_details.groupBy("jurusan").agg(F.count(F.lit(1)).alias("total"))
    return t.users.where(F.col("role") == "siswa").groupBy("role").agg(F.count(F.lit(1)).alias("total"))


def program_share(t: Tables) -> DataFrame:
    """Per programme: count and rounded share of all detail rows in percent
    (total is a scalar subquery, not a global window)."""
    total = t.siswa_details.agg(F.count(F.lit(1))).scalar()
    return (program_distribution(t, "jurusan")
            .select("jurusan", "total", F.round(F.col("total") / total * 100).cast("int").alias("persen")))


def daily_usage(t: Tables, days: int = 7) -> DataFrame:
    """Log rows per calendar day for the latest ``days`` days that have rows
    (no gap filling)."""
    return (t.activity_logs.groupBy(F.to_date("created_at").alias("tanggal"))
            .agg(F.count(F.lit(1)).alias("total"))
            .orderBy(F.col("tanggal").desc()).limit(days))


def latest_verification(t: Tables) -> DataFrame:
    """Per user: latest verification status (by request time, then id) and
    whether they may sign in (admins always; others only if approved).

    ``max_by`` over (requested_at, id) is a mergeable aggregate: partial
    results are combined map-side, so one user with very many requests does
    not end up sorted in a single task.
    """
    latest = (t.verifications.groupBy("user_id")
              .agg(F.max_by("status", F.struct("requested_at", "id")).alias("latest_status")))
    u = t.users.select(F.col("id").alias("user_id"), "role")
    return (u.join(latest, "user_id", "left")
            .select("user_id", "role",
                    F.when(F.col("role") != "admin", F.col("latest_status")).alias("latest_status"),
                    ((F.col("role") == "admin") |
                     F.coalesce(F.col("latest_status") == "approved", F.lit(False))).alias("login_eligible")))
