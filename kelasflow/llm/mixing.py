"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelasflow.functions.ids import assign_ids
from kelasflow.llm.common import materialize, text_of

WEIGHTS = (5, 2, 1)         # given to the sources in code-point order, null last, repeating
SHARE = 1.5                 # words of the mix against words of the corpus
MAX_COPIES = 2              # a target stops at this many times its source
GROUP_ROWS = 4096           # documents rounded one after another; also the fan-in of the tree
WORD = r"[^\x20\x09-\x0D]+"


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source") -> DataFrame:
    """id, source and size (words of the text) of every row."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size and target, one row per source.

    The mix has ``share`` times the words of the corpus, shared by weight;
    what a source would get beyond ``max_copies`` times its size is shared
    again among the others, until none is above (or all stop there).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = materialize(assign_ids(per.withColumn("_null", F.col("source").isNull()), ["_null", "source"],
                                    F.lit(0), "_rank"), "mix-sources")
    place = F.pmod(F.col("_rank") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("w"),
                           (F.col("source_size") * float(max_copies)).alias("most"))
    # A source stops where level * weight passes its limit.  Each pass takes out
    # all that stop at the level reached so far; only sums come back.
    wanted = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("most") <= F.lit(level) * F.col("w")
        stopped, left = ranked.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)),
                                   F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if not left:
            break
        higher = (wanted - stopped) / left
        if higher <= level:
            break
        level = higher
    return ranked.select("source", "source_size", F.least("most", F.lit(level) * F.col("w")).alias("target"))


def _coin(*parts: object) -> float:
    """A number in [0, 1) drawn from the parts; the same in every run."""
    digest = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2.0 ** 64


def round_group(rows: Iterator[tuple], seed: int) -> Iterator[tuple[object, float, bool]]:
    """Pivotal rounding of (key, size, p) in the order given.

    The undecided document meets the next one; words move from one to the
    other, in a direction drawn so that neither's expected probability
    changes, until one of them is 0 or 1.  The sum of size * p never changes.
    Yields (key, p, decided); one document at most stays undecided.
    """
    held = None
    for key, size, p in rows:
        if p <= 0.0 or p >= 1.0 or size <= 0:
            yield key, float(p >= 1.0), True
            continue
        if held is None:
            held = (key, size, p)
            continue
        hk, hs, hp = held
        up = min((1.0 - hp) * hs, p * size)         # words that the held one can win
        down = min(hp * hs, (1.0 - p) * size)       # words that it can lose
        words = up if _coin(seed, hk, key) * (up + down) < down else -down
        held_to, p_to = hp + words / hs, p - words / size
        # whichever ran out is exactly 0 or 1
        first = (1.0 - hp) * hs <= p * size if words > 0 else hp * hs <= (1.0 - p) * size
        if first:
            yield hk, 1.0 if words > 0 else 0.0, True
            held = (key, size, min(max(p_to, 0.0), 1.0))
        else:
            yield key, 0.0 if words > 0 else 1.0, True
            held = (hk, hs, min(max(held_to, 0.0), 1.0))
        if held[2] <= 0.0 or held[2] >= 1.0:
            yield held[0], held[2], True
            held = None
    if held is not None:
        yield held[0], held[2], False


def _round_level(rows: DataFrame, seed: int) -> DataFrame:
    """Round within every (source, bucket); adds ``decided``."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what stays undecided at the end is small
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        done = {k: (p, ok) for k, p, ok in round_group(
            ((i, s, p) for i, s, p in zip(pdf["key"], pdf["size"], pdf["p"])), seed)}
        pdf["p"] = [done[k][0] for k in pdf["key"]]
        pdf["decided"] = [done[k][1] for k in pdf["key"]]
        return pdf

    schema = "key string, source string, size long, p double, bucket long, decided boolean"
    return (rows.select("key", "source", "size", "p", "bucket")
            .groupBy(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_s"), "bucket")
            .applyInPandas(work, schema))


def rounded_copies(fractions: DataFrame, seed: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """key and copy (0 or 1) for every row of (key, source, size, p), keys distinct.

    A reduction tree: documents are dealt by a hash of their key into groups
    of about ``group_rows`` and rounded there; one undecided document per
    group goes on to the next level, where groups of the same source meet.
    The number of groups follows the number of rows, so no source, however
    large, meets in one task.  At the root one document per source is left,
    decided by a coin of its own probability.
    """
    level = 0
    n = fractions.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-n // group_rows))
    rows = fractions.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(buckets)))
    done = []
    while True:
        out = materialize(_round_level(rows, seed + level), "mix-level")
        done.append(out.where("decided"))
        rest = out.where(~F.col("decided"))
        if buckets == 1:
            break
        buckets = -(-buckets // group_rows)
        rows = rest.withColumn("bucket", F.pmod(F.col("bucket"), F.lit(buckets)))
        level += 1
    coin = F.pmod(F.xxhash64("key", F.lit(seed), F.lit("root")), F.lit(1 << 52)) / float(1 << 52)
    done.append(rest.withColumn("p", F.when(coin < F.col("p"), 1.0).otherwise(0.0)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("key", F.col("p").cast("long").alias("copy"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES,
             seed: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """id, source, size, source_size, target, copies and taken for every document.

    A document's expected copies are target / source_size: the whole part is
    given to each, the rest by pivotal rounding, which keeps the words of a
    source at its target but for less than one document, a small one.  A
    document has at most ``max_copies`` copies.  Null texts have size 0 and
    are never taken; sources of size 0 have target 0; a null source is a
    source of its own, the last.  Rows that repeat an id are one document
    per (id, source, size); each of its rows is returned with the same
    decision.  Ties of size go by id.  An empty table gives no rows; other
    columns are not read.
    """
    sizes = materialize(document_sizes(docs, id_col, text_col, source_col), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, max_copies), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a ratio within rounding error of a whole number is that number
    ratio = F.when(F.abs(ratio - F.round(ratio)) < 1e-12, F.round(ratio)).otherwise(ratio)
    rates = targets.select("*", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"))
    # rows of a source carry its rate; the sources are few beside the documents, a skewed one is split
    key = F.concat_ws("\x1f", F.coalesce(F.col("id").cast("string"), F.lit("\x00")), F.col("size").cast("string"))
    rows = sizes.withColumn("key", F.concat_ws("\x1f", key, F.coalesce("source", F.lit("\x00"))))
    rated = rows.join(rates, rows["source"].eqNullSafe(rates["source"])).drop(rates["source"])
    units = rated.where("p > 0 AND size > 0").select("key", "source", "size", "p").dropDuplicates(["key"])
    chosen = rounded_copies(units, seed, group_rows)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("copy", F.lit(0))).otherwise(F.lit(0))
    return (rated.join(chosen, "key", "left")
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                    copies.cast("long").alias("copies"))
            .withColumn("taken", F.col("copies") * F.col("size")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **options) -> DataFrame:
    """The mix itself: every taken document once per copy, with ``copy_no``
    from 1, its size, its source's size and target added.  Documents that
    are not taken go.  Rows that repeat an id with the same source and size
    are taken each."""
    plan = mix_plan(docs, id_col, text_col, source_col, **options)
    added = plan.select(
        F.col(id_col).alias("_kf_id"), F.col(source_col).alias("_kf_source"), F.col("size").alias("_kf_size"),
        F.col("source_size").alias("_kf_source_size"), F.col("target").alias("_kf_target"),
        F.col("copies").alias("_kf_copies")).where("_kf_copies > 0").dropDuplicates(["_kf_id", "_kf_source", "_kf_size"])
    sized = docs.withColumn("_kf_words", F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"))
    joined = sized.join(added, sized[id_col].eqNullSafe(added["_kf_id"])
                        & sized[source_col].cast("string").eqNullSafe(added["_kf_source"])
                        & (sized["_kf_words"] == added["_kf_size"]))
    names = {"copy_no": F.explode(F.sequence(F.lit(1), F.col("_kf_copies").cast("int"))), "size": F.col("_kf_size"),
             "source_size": F.col("_kf_source_size"), "target": F.col("_kf_target")}
    return joined.select(*[F.col(c) for c in docs.columns if c not in names],
                         *[c.alias(n) for n, c in names.items()])
