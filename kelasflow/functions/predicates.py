"""Search and filter predicates (keyword LIKE over several columns, optional filters)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_pattern(keyword: str) -> str:
    """``%kw%`` with the keyword's own ``%``/``_`` left as wildcards (as the
    reference passes user input straight into LIKE)."""
    return f"%{keyword}%"


def ilike_any(cols, keyword: str) -> Column:
    """True when any column matches ``%keyword%`` case-insensitively.

    NULL columns count as no match (``NULL LIKE p`` is NULL, i.e. false in a
    WHERE), so the result is never NULL.
    """
    pat = contains_pattern(keyword)
    return reduce(lambda a, b: a | b,
                  [F.coalesce(F.col(c).ilike(pat), F.lit(False)) for c in cols])


def all_of(conds) -> Column:
    """AND of a run-time list of predicates; the empty list means no filter."""
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def optional_contains(filters: dict) -> Column:
    """``col ILIKE %value%`` for every filter whose value is non-empty, AND-ed."""
    return all_of([F.coalesce(F.col(c).ilike(contains_pattern(v)), F.lit(False))
                   for c, v in filters.items() if v])


def keyed(df: DataFrame, col: str, keys: DataFrame | None, key_col: str | None = None) -> DataFrame:
    """Restrict ``df`` to rows whose ``col`` is in the key frame (a left semi
    join, so a set of keys of any size works the same way); None = all rows."""
    if keys is None:
        return df
    k = keys.select(F.col(key_col or keys.columns[0]).alias("_k"))
    return df.join(k, F.col(col) == F.col("_k"), "left_semi")


def contains_ci(col: str, keyword: str) -> Column:
    """Plain case-insensitive substring test (no wildcards), NULL -> false."""
    return F.coalesce(F.lower(F.col(col)).contains(keyword.lower()), F.lit(False))
