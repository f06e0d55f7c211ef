"""How far the sources of a language stand apart, priced over hash-consed segment trees.

The counts of a (language, source) group over its language's term numbers form
the leaves of a segment tree.  Trees are cut into blocks of ``BLOCK``
consecutive numbers; inside a block equal count subtrees of all its groups are
one node, and the trees of two groups are walked together from their roots:
equal pairs of nodes are merged with their multiplicity, so each is priced
once, and a pair of all-zero subtrees ends the walk.  Block sums are added by
Spark.  A task holds one block of at most ``2 * TILE`` groups, whatever the
vocabulary, the number of sources or the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelasflow.functions.ids import assign_ids
from kelasflow.llm.common import materialize
from kelasflow.llm.text import chunks
from kelasflow.llm.word_codes import encode, runs

# [^\x00-\x40\x5B-\x60\x7B-\x7F]+ after lower-casing A-Z: a-z and the bytes of longer code points.
TERM = (np.arange(256) >= 97) & (np.arange(256) <= 122) | (np.arange(256) >= 128)
MIN_DOCS = 10               # documents of a language that a kept term is in
TOP_TERMS = 10
SCALE = 1_000_000_000
COUNT_BYTES = 4 << 20       # text counted at once in a task
LEVELS = 12
BLOCK = 1 << LEVELS         # term numbers per tree
TILE = 32                   # groups whose trees meet in one task
WALK = 128                  # pairs of trees walked at once


# ------------------------------------------------------------------ term counts
def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        n_sources = max(1, len(source.dictionary))
        group = (lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_sources
                 + source.indices.to_numpy(zero_copy_only=False))
        for c in chunks(batch.column(2), COUNT_BYTES):
            start, end, doc = runs(c, c.low, TERM)
            if not len(start):
                continue
            code, terms = encode(c.low, TERM, start, end)
            pairs, n = np.unique(doc * len(terms) + code, return_counts=True)      # (document, term)
            key = group[c.first + pairs // len(terms)] * len(terms) + pairs % len(terms)
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            g, t = key[first] // len(terms), key[first] % len(terms)
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(g // n_sources)), source.dictionary.take(pa.array(g % n_sources)),
                 terms.take(pa.array(t)).cast(pa.large_string()).cast(pa.string()),
                 pa.array(np.add.reduceat(n, first)), pa.array(np.diff(np.append(first, len(key))))],
                ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs): counted per run of documents
    in each task, then added, so no key gathers the rows of a hot source."""
    parts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = parts.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 per language, under ``lang`` and ``order``."""
    rows = materialize(assign_ids(df, ["lang", *order], F.lit(-1), name="_row"), "numbered")
    first = rows.groupBy("lang").agg(F.min("_row").alias("_first"))
    return rows.join(first, "lang").withColumn(name, F.col("_row") - F.col("_first")).drop("_row", "_first")


# ---------------------------------------------------------------------- pricing
def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return F.call_function("div", top, (total + 2 * terms).cast("decimal(19,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two probabilities, exact in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _probability(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    if len(count) and int(count.max()) + 2 > (1 << 63) // SCALE - 1:        # beyond 64 bits
        return np.array([SCALE * (int(c) + 2) // (int(n) + 2 * terms) + 1 for c, n in zip(count, total)], np.int64)
    return SCALE * (count + 2) // (total + 2 * terms) + 1


def price_pairs(leaves: np.ndarray, totals: np.ndarray, pairs: np.ndarray, terms: int) -> np.ndarray:
    """Sum of the divergences over all leaves for pairs of rows of ``leaves``.

    ``leaves`` holds one tree's counts per row (a power of two of them),
    ``totals`` each group's words, ``pairs`` two row numbers per row.
    """
    values, below = np.unique(np.append(leaves.ravel(), 0), return_inverse=True)
    shape = leaves.shape
    node = below[:-1].reshape(shape)            # 0 is the count 0, and on every level the all-zero subtree
    levels = []
    while node.shape[1] > 1:
        size = int(node.max()) + 1
        key, number = np.unique(np.append((node[:, 0::2] * size + node[:, 1::2]).ravel(), 0), return_inverse=True)
        levels.append((key // size, key % size, size))
        node = number[:-1].reshape(len(node), -1)
    zero = np.zeros(len(pairs), np.int64)       # leaves that are zero in both trees
    pair, u, v = np.arange(len(pairs)), node[pairs[:, 0], 0], node[pairs[:, 1], 0]
    times = np.ones(len(pairs), np.int64)
    for height in range(len(levels), 0, -1):
        left, right, size = levels[height - 1]
        live = (u != 0) | (v != 0)
        np.add.at(zero, pair[~live], times[~live] << height)
        pair, u, v, times = pair[live], u[live], v[live], times[live]
        key = np.concatenate([(pair * size + left[u]) * size + left[v], (pair * size + right[u]) * size + right[v]])
        key, where = np.unique(key, return_inverse=True)
        times = np.bincount(where, np.concatenate([times, times]), len(key)).astype(np.int64)
        pair, u, v = key // (size * size), key // size % size, key % size
    a, b = totals[pairs[:, 0]], totals[pairs[:, 1]]
    p, q = _probability(values[u], a[pair], terms), _probability(values[v], b[pair], terms)
    out = np.zeros(len(pairs), np.int64)
    np.add.at(out, pair, (p - q) ** 2 // (p + q) * times)
    none = np.zeros(len(pairs), np.int64)
    p, q = _probability(none, a, terms), _probability(none, b, terms)
    return out + zero * ((p - q) ** 2 // (p + q))


def _price_block(block: pa.Table) -> pa.Table:
    first = block.slice(0, 1).to_pylist()[0]
    tile_a, tile_b, terms = first["a"], first["b"], first["terms"]
    rows = tile_a if first["ta"] == first["tb"] else tile_a + tile_b
    place = {m["group"]: i for i, m in enumerate(rows)}
    totals = np.array([m["total"] for m in rows], np.int64)
    leaves = np.zeros((len(rows), BLOCK), np.int64)
    for g, numbers in zip(block.column("group").to_pylist(), block.column("counts")):
        at = numbers.values
        leaves[place[g], at.field("id").to_numpy()] = at.field("n").to_numpy()
    if first["ta"] == first["tb"]:
        i, j = np.triu_indices(len(rows), 1)
    else:
        i, j = np.divmod(np.arange(len(tile_a) * len(tile_b)), len(tile_b))
        j = j + len(tile_a)
    pairs = np.stack([i, j], 1)
    value = [price_pairs(leaves, totals, pairs[k:k + WALK], terms) for k in range(0, len(pairs), WALK)]
    value = np.concatenate(value) if value else np.zeros(0, np.int64)
    covered = min(BLOCK, terms - first["block"] * BLOCK)
    none = np.zeros(len(pairs), np.int64)
    p, q = (_probability(none, totals[pairs[:, k]], terms) for k in (0, 1))
    value = value - (BLOCK - covered) * ((p - q) ** 2 // (p + q))         # numbers past the vocabulary
    group = np.array([m["group"] for m in rows], np.int64)
    return pa.table({"lang": pa.array([first["lang"]] * len(pairs), pa.string()), "a": group[pairs[:, 0]],
                     "b": group[pairs[:, 1]], "value": value, "ids": np.full(len(pairs), covered, np.int64)})


def _pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value, ids): sums over the blocks in which a or b, or a
    group beside them, has a term; ``ids`` is how many numbers they cover."""
    tiles = groups.groupBy("lang", F.expr(f"`group` div {TILE}").alias("tile")).agg(
        F.array_sort(F.collect_list(F.struct("group", "total"))).alias("rows"))         # at most TILE
    last = groups.groupBy("lang").agg(F.expr(f"max(`group`) div {TILE}").alias("last"))
    blocks = (counts.groupBy("lang", "group", F.expr(f"id div {BLOCK}").alias("block"))
              .agg(F.collect_list(F.struct((F.col("id") % BLOCK).cast("int").alias("id"), "n")).alias("counts"),
                   F.first("terms").alias("terms")))                                    # at most BLOCK
    own = F.expr(f"`group` div {TILE}")
    met = (blocks.join(last, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
           .select("lang", "block", "terms", "group", "counts",
                   F.least(own, "other").alias("ta"), F.greatest(own, "other").alias("tb")))
    for side in ("a", "b"):
        met = met.join(tiles.select("lang", F.col("tile").alias(f"t{side}"), F.col("rows").alias(side)),
                       ["lang", f"t{side}"])
    priced = met.groupBy("lang", "block", "ta", "tb").applyInArrow(
        _price_block, "lang string, a long, b long, value long, ids long")
    return priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("ids").alias("ids"))


# --------------------------------------------------------------------- the audit
def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Every source against the others of its language, and the terms that set it apart.

    ``docs`` has lang, source and text; other columns are not read, so their
    names cannot clash.  Null counts as the empty string in each of the three.
    Terms are runs of letters (A-Z lower-cased, everything beyond ASCII a
    letter); a language keeps those in at least ``min_docs`` of its rows (a
    repeated row counts again).  Returns lang, source, part, item, value,
    rank: part ``pair`` has one row per other source (0 where the language
    keeps no term), part ``term`` the ``top`` kept terms more probable in the
    group than in its language.  Equal values rank by item.  A group without
    terms, of empty texts alone say, is there with count 0; an empty table
    gives no rows.
    """
    counts = materialize(term_counts(docs), "term-counts")
    known = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = (counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
            .where(F.col("docs") >= min_docs).select("lang", "term", "lang_n", (-F.col("lang_n")).alias("_rare")))
    kept = _numbered(kept, ["_rare", "term"], "id").drop("_rare")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    used = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "id", "n", "lang_n")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    groups = (_numbered(known, ["source"], "group").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
              .select("lang", "source", "group", F.coalesce("total", zero).alias("total"),
                      F.coalesce("terms", zero).alias("terms"), F.coalesce("lang_total", zero).alias("lang_total")))
    groups = materialize(groups, "groups")
    used = materialize(used.join(groups, ["lang", "source"]), "kept-counts")

    sums = _pair_sums(used.select("lang", "group", "id", "n", "terms"), groups.select("lang", "group", "total"))
    both = (sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value", "ids")))
    one = groups.select("lang", "source", F.col("group").alias("a"), F.col("total").alias("_na"), "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("group").alias("b"), F.col("total").alias("_nb"))
    absent = divergence(probability(F.lit(0), F.col("_na"), F.col("terms")),
                        probability(F.lit(0), F.col("_nb"), F.col("terms")))
    rest = F.col("terms") - F.coalesce("ids", zero)         # numbers of blocks that neither group has
    pairs = (one.join(other, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.when(F.col("terms") == 0, zero).otherwise(
                         F.coalesce("value", zero) + F.when(rest > 0, rest * absent).otherwise(zero)).alias("value")))
    p = probability(F.col("n"), F.col("total"), F.col("terms"))
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    own = (used.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
           .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                   divergence(F.col("p"), F.col("q")).alias("value")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (pairs.withColumn("rank", F.row_number().over(by_value))
            .unionByName(own.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)))
