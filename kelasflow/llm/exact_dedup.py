"""Exact duplicates: grouping by a 128-bit content hash with a byte comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelasflow.llm.common import ascii_lower, materialize, text_of


def content_hash(text: Column) -> Column:
    """128-bit hash of the normalised text."""
    return F.unhex(F.md5(text.cast("binary")))


def _keys(docs: DataFrame, id_col: str, norm: Column, hash_of: Callable[[Column], Column], *more: Column) -> DataFrame:
    """Id and content hash of every row, written once: no text leaves its task."""
    return materialize(docs.select(F.col(id_col).alias("_id"), hash_of(norm).alias("_h"), *more), "content-hashes")


def _shared_ids(keys: DataFrame) -> DataFrame:
    """Ids of the rows whose hash another row has, too.  Hashes and ids are
    written, so that their sizes are known to the plans that read them and a
    hash of very many rows is joined, not gathered."""
    shared = materialize(keys.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "shared-hashes")
    return materialize(keys.join(shared, "_h", "left_semi").select("_id").distinct(), "shared-ids")


def _with_ids(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_id"]), how)


def _equal_texts(rows: DataFrame, keep: str) -> DataFrame:
    """(_h, _sha, keep_id, group_size) of rows (_id, _h, _norm) grouped by hash
    *and* text: Spark compares the bytes of rows whose hashes agree, and a
    collision gives two groups.  Copies are folded inside each input split
    first, so a text of a third of all rows is shuffled once per split."""
    stay = {"min": F.min, "max": F.max}[keep]
    return (rows.groupBy("_h", "_norm").agg(stay("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .select("_h", F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"), "keep_id", "group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                normalise: Callable[[Column], Column] = ascii_lower,
                hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Decision for every row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the stable id that stays in a group, the smallest or the
    largest.  Null text is empty text.  Rows that repeat an id with the same
    text count in ``group_size`` and share one decision (kept, if theirs is
    the id that stays).  A null id loses against any id; a group of null ids
    alone keeps them.  An empty table gives no rows; other columns are not
    read, so their names cannot clash.

    Rows are grouped by the hash with their ids alone; texts go on to the
    comparison of bytes only where two rows or more share a hash.  The
    decision goes back by hash and digest; a group as large as a third of
    the rows is split by Spark's skew join.
    """
    norm = normalise(text_of(text_col))
    keys = _keys(docs, id_col, norm, hash_of, F.sha2(norm.cast("binary"), 256).alias("_sha"))
    doubtful = _with_ids(docs, id_col, _shared_ids(keys), "left_semi").select(
        F.col(id_col).alias("_id"), norm.alias("_norm"))
    groups = _equal_texts(doubtful.select("_id", "_norm", hash_of(F.col("_norm")).alias("_h")), keep)
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("_id")).otherwise(F.col("keep_id"))
    return keys.join(groups, ["_h", "_sha"], "left").select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                          normalise: Callable[[Column], Column] = ascii_lower) -> DataFrame:
    """``docs`` with all its columns, one row per distinct normalised text.

    Of rows that repeat the id that stays, one is left.  Rows whose hash no
    other row has pass as they are; only the others are shuffled.
    """
    norm = normalise(text_of(text_col))
    ids = _shared_ids(_keys(docs, id_col, norm, content_hash))

    def key(h: Column, sha: Column, i: Column) -> Column:
        return F.concat(F.hex(h), sha, F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("")))

    doubtful = _with_ids(docs, id_col, ids, "left_semi")
    rows = doubtful.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
    kept = _equal_texts(rows.select("_id", "_norm", content_hash(F.col("_norm")).alias("_h")), keep).select(
        key(F.col("_h"), F.col("_sha"), F.col("keep_id")).alias("_kf_key"))
    keyed = doubtful.withColumn("_kf_key", key(content_hash(norm), F.sha2(norm.cast("binary"), 256), F.col(id_col)))
    # the semi join and the removal of repeated rows share one exchange, on the key
    chosen = keyed.join(kept, "_kf_key", "left_semi").dropDuplicates(["_kf_key"]).select(*docs.columns)
    return _with_ids(docs, id_col, ids, "left_anti").select(*docs.columns).unionByName(chosen)
