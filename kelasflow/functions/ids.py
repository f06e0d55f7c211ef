"""Consecutive id assignment without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelasflow.functions.shared import materialize


def assign_ids(df: DataFrame, order_cols: list[str], start: Column, name: str = "id") -> DataFrame:
    """Add ``name`` = ``start`` + 1-based rank of each row under ``order_cols``.

    ``order_cols`` must be a total order (unique per row).  The rows are
    range-partitioned and sorted once, each takes its partition and its place
    there from that one evaluation, and the result is written to the shared
    folder: ranks and counts are read from the same frame, so neither a
    second evaluation nor the number of partitions can change them.  Only
    one row per partition is summed into offsets.
    """
    ranged = materialize(place_rows(df, order_cols), "ids")
    return ordered_ids(ranged, start, name)


def place_rows(df: DataFrame, order_cols: list[str], among: Column | None = None) -> DataFrame:
    """``df`` in ranges of ``order_cols``, each row with its partition and its
    place there (``_m``).  With ``among`` the rows where it holds come first
    in their partition: their places count only them.  To be written before
    :func:`ordered_ids` reads it."""
    first = [] if among is None else [F.coalesce(among, F.lit(False)).desc()]
    place = F.monotonically_increasing_id()         # partition in the upper 31 bits, place in the lower 33
    return df.repartitionByRange(*order_cols).sortWithinPartitions(*first, *order_cols).withColumn("_m", place)


def ordered_ids(placed: DataFrame, start: Column, name: str = "id") -> DataFrame:
    """Add ``name`` = ``start`` + 1-based rank to written rows of :func:`place_rows`
    (all of them, or those that were placed first)."""
    ranged = (placed.withColumn("_p", F.shiftright("_m", 33))
              .withColumn("_r", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_p")
            .withColumn(name, (start + F.col("_off") + F.col("_r")).cast("bigint"))
            .drop("_m", "_p", "_r", "_off"))


def next_id(df: DataFrame, col: str = "id") -> Column:
    """Scalar subquery: current maximum of ``col`` (0 for an empty table)."""
    return F.coalesce(df.agg(F.max(col)).scalar(), F.lit(0)).cast("bigint")
