"""Joins whose output is larger than both inputs: both sides repeat the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelasflow.functions.shared import materialize

CELL_ROWS = 1 << 20         # output rows of a key that one task is to make, about
LIST_ROWS = 1 << 9          # rows of the right side of a key that one list of pairs to leave out is about


def expand(left: DataFrame, right: DataFrame, key: str, left_keys: DataFrame | None = None,
           right_keys: DataFrame | None = None) -> DataFrame:
    """Inner join of ``left`` and ``right`` on ``key`` with heavy keys split by what they put out.

    Skew handling at run time sees the bytes that a join reads; here a key
    with few bytes on either side may make most of the output.  So each key's
    output is known first, the product of its rows on the two sides, and a
    key above ``CELL_ROWS`` is cut into parts: the rows of its larger side are
    dealt over them by hash and those of its smaller side go to all.  Keys
    below that are joined as ever.  Copies of the smaller side are at most as
    many as output rows.

    ``left_keys`` and ``right_keys`` are cheaper frames with the column
    ``key`` to count rows from (stored tables, say); they decide cost only.
    Null keys join nothing.  Rows that are equal in every column go to one
    part.  There are at most output / CELL_ROWS heavy keys.
    """
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    made = F.col("_kf_l") * F.col("_kf_r")
    heavy = (rows(left if left_keys is None else left_keys, "_kf_l")
             .join(rows(right if right_keys is None else right_keys, "_kf_r"), key).where(made > CELL_ROWS)
             .select(key, F.ceil(made / CELL_ROWS).alias("_kf_parts"),
                     (F.col("_kf_l") >= F.col("_kf_r")).alias("_kf_cut_left")))

    def laid_out(side: DataFrame, is_cut: Column) -> DataFrame:
        one = F.array(F.pmod(F.xxhash64(*side.columns), F.col("_kf_parts")))
        each = F.sequence(F.lit(0).cast("bigint"), F.col("_kf_parts") - 1)
        part = (F.when(F.col("_kf_parts").isNull(), F.array(F.lit(0).cast("bigint")))
                .when(is_cut, one).otherwise(each))
        return side.join(heavy, key, "left").select(*side.columns, F.explode(part).alias("_kf_part"))

    return (laid_out(left, F.col("_kf_cut_left")).join(laid_out(right, ~F.col("_kf_cut_left")), [key, "_kf_part"])
            .drop("_kf_part"))


def expand_without(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, pairs: DataFrame,
                   left_keys: DataFrame | None = None, right_keys: DataFrame | None = None) -> DataFrame:
    """``expand(left, right, key)`` without the rows whose (``left_id``, ``right_id``) is in ``pairs``.

    ``pairs`` (left_id, key, right_id) is far smaller than the output and names
    only right ids of their key.  An anti join would shuffle every row of the
    output; here each left row brings the list of the right ids that it must
    not meet, and the output is filtered where it is made.  A key of many
    right rows is cut into slices of about ``LIST_ROWS`` of them by the hash of
    ``right_id``, so no list is longer than a slice; the left rows go to all
    slices of their key and are dealt over parts of about ``CELL_ROWS`` output
    rows.  Null ids are in no pair.
    """
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    one = F.lit(1).cast("bigint")
    grid = materialize(
        rows(left if left_keys is None else left_keys, "_kf_l")
        .join(rows(right if right_keys is None else right_keys, "_kf_r"), key)
        .select(key, F.ceil(F.col("_kf_r") / LIST_ROWS).alias("_kf_slices"),
                F.ceil(F.col("_kf_l") * F.least("_kf_r", F.lit(LIST_ROWS)) / CELL_ROWS).alias("_kf_parts"))
        .where("_kf_slices > 1 OR _kf_parts > 1"), "grid")
    slices, parts = F.coalesce("_kf_slices", one), F.coalesce("_kf_parts", one)
    own_slice = F.pmod(F.xxhash64(right_id), slices).alias("_kf_slice")

    def each(n: Column, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias(name)

    lists = (pairs.join(grid, key, "left").select(left_id, key, right_id, own_slice)
             .groupBy(left_id, key, "_kf_slice").agg(F.collect_set(right_id).alias("_kf_out")))
    lefts = (left.join(grid, key, "left")
             .select(*left.columns, F.pmod(F.xxhash64(*left.columns), parts).alias("_kf_part"), each(slices, "_kf_slice"))
             .join(lists, [left_id, key, "_kf_slice"], "left"))
    rights = right.join(grid, key, "left").select(*right.columns, own_slice, each(parts, "_kf_part"))
    met = F.coalesce(F.array_contains("_kf_out", F.col(f"_kf_r.{right_id}")), F.lit(False))
    return (lefts.join(rights.alias("_kf_r"), [key, "_kf_slice", "_kf_part"]).where(~met)
            .drop("_kf_slice", "_kf_part", "_kf_out"))
