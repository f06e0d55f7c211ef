"""Aggregate expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_list(col: str, sep: str = ", ", distinct: bool = False) -> Column:
    """GROUP_CONCAT with a defined order: values sorted, NULLs skipped, NULL
    when the group has no value.

    ``distinct`` de-duplicates inside the collected array rather than with a
    DISTINCT aggregate, which would add a shuffle on (group, value); the lists
    here are class names of one parent, so they are short.
    """
    arr = F.collect_list(col)
    if distinct:
        arr = F.array_distinct(arr)
    arr = F.array_sort(arr)
    return F.when(F.size(arr) > 0, F.array_join(arr, sep))


def sorted_array(col: str) -> Column:
    """All non-NULL values of the group as a sorted array (empty when none)."""
    return F.array_sort(F.collect_list(col))
