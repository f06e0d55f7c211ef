"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelasflow.llm import text as T
from kelasflow.llm import tiles
from kelasflow.llm.common import materialize, text_of
from kelasflow.llm.components import components

SHINGLE = 5
KEYS = 3                    # least hashes per document that bring copies together first
BLOCK = 512                 # members of a tile compared at once; larger tiles are cut into blocks
BLOCK_ELEMENTS = 1 << 21    # shingles of a block's sets together, about: long sets make blocks of fewer
COUNTERS = 18               # bits: counters that order shingles by how often they occur
BLOOM_BITS = 23
_GOLDEN = 0x9E3779B97F4A7C15


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def _sets(col: pa.Array) -> Iterator[np.ndarray]:
    for c in T.chunks(col):
        yield from T.shingle_sets(c, SHINGLE)


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64) if len(values) else np.zeros(0, np.int64), pa.int64())


def _profile(docs: DataFrame) -> DataFrame:
    """One scan: per row its set's size, digest and least hashes; and per task
    how many shingles fall on each of the 2**COUNTERS counters."""
    salts = [np.uint64((_GOLDEN * (2 * k + 1)) & ((1 << 64) - 1)) for k in range(KEYS)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTERS, np.int64)
        names = ["id", "n", "digest", "keys", "counter", "count"]
        for b in batches:
            n, digest, keys = [], [], []
            for c in T.chunks(_column(b, "text")):
                sets = T.shingle_sets(c, SHINGLE)
                tops = (np.concatenate(sets) >> np.uint64(64 - COUNTERS)).astype(np.int64)
                counters += np.bincount(tops, minlength=1 << COUNTERS)
                for s in sets:
                    n.append(len(s))
                    # two sums over differently mixed elements and the size: 128 bits and more for the set
                    digest.append(np.array([T.mix(s).sum(dtype=np.uint64), T.mix(s ^ salts[0]).sum(dtype=np.uint64),
                                            len(s)], np.uint64).tobytes())
                    keys.append([int(T.mix(T.mix(s ^ x).min()[None] + np.uint64(k))[0].view(np.int64))
                                 for k, x in enumerate(salts)] if len(s) else [])
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [_column(b, "id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names=names)
        at = np.flatnonzero(counters)
        m = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
             pa.nulls(m, pa.list_(pa.int64())), pa.array(at.astype(np.int32)), pa.array(counters[at])], names=names)

    return docs.mapInArrow(work, "id long, n long, digest binary, keys array<long>, counter int, count long")


class Bloom:
    """A filter of fixed size over numbers: never refuses one of them, lets few
    others pass.  It decides what is worth sending on, never the result: an
    exact join follows wherever it is used."""

    def __init__(self, rows: DataFrame, col: str = "id"):
        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.unique(np.concatenate(Bloom.places(b.column(0))))
                word, start = np.unique(at >> 6, return_index=True)
                ones = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), start) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(word), _longs(ones)], names=["w", "b"])

        words = (rows.select(col).mapInArrow(bits, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b"))
                 .toPandas())       # at most 2**BLOOM_BITS / 64 rows
        table = np.zeros((1 << BLOOM_BITS) // 64, np.uint64)
        table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
        self.shared = rows.sparkSession.sparkContext.broadcast(table)

    @staticmethod
    def places(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h = T.mix(values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        low = np.uint64((1 << BLOOM_BITS) - 1)
        return (h & low).astype(np.int64), ((h >> np.uint64(32)) & low).astype(np.int64)

    def test(self, values: pa.Array) -> np.ndarray:
        """Which of the values may be held; called in tasks."""
        good = np.ones(len(values), bool)
        for p in Bloom.places(values):
            good &= (self.shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0
        return good


def _sieved(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with the given ids, few others left over before the join."""
    bloom = Bloom(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bloom.test(_column(b, "id"))))
    return docs.mapInArrow(work, "id long, text string")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], load) -> Iterator[tuple[dict, list]]:
    """Runs of equal ``keys`` in sorted batches; ``load`` turns a batch into
    one object per row.  Only the open run is carried from batch to batch."""
    held: list = []
    held_key, held_cols = None, None
    for b in batches:
        if not b.num_rows:
            continue
        items = load(b)
        cols = [_column(b, k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = first != held_key
        at = np.flatnonzero(new)
        if held and not new[0]:
            stop = at[0] if len(at) else b.num_rows
            held.extend(items[:stop])
            if not len(at):
                continue
        if held:
            yield held_cols, held
        for s, e in zip(at[:-1], at[1:]):
            yield dict(zip(keys, (c[s] for c in cols))), items[s:e]
        s = at[-1]
        held, held_key = list(items[s:]), tuple(c[s] for c in cols)
        held_cols = dict(zip(keys, held_key))
    if held:
        yield held_cols, held


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a = pa.array([x for x, _ in rows], pa.int64())
    return pa.RecordBatch.from_arrays([a, pa.array([y for _, y in rows], pa.int64())], names=["a", "b"])


def _copies(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar pairs among documents that share a least hash, verified.

    Gathers what is plainly alike, so that the exact search can leave it
    alone.  A tile's documents are cut into blocks by hashes; a block gives
    at most one pair less than documents.
    """
    rows = sets.select("id", "n", F.explode("keys").alias("key"))
    many = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("tile")).where("m > 1")
            .select("key", "tile"))
    # keys with the same smallest id lead to the same tile: their documents go there once
    members = materialize(rows.join(many, "key").select("tile", "id", "n").distinct(), "copy-tiles")
    size = members.groupBy("tile").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_ELEMENTS)).alias("blocks"))
    # a tile of several blocks is cut in two ways, so that the blocks hang together
    cut = F.when(F.col("blocks") > 1, F.array(F.pmod(F.xxhash64("id", "tile"), F.col("blocks")),
                                              F.pmod(F.xxhash64("tile", "id"), F.col("blocks")) + F.col("blocks")))
    places = materialize(members.join(size, "tile").select(
        "id", "tile", F.explode(F.coalesce(cut, F.array(F.lit(0).cast("long")))).alias("block")), "copy-places")
    own = places.groupBy("id").agg(F.collect_list(F.struct("tile", "block")).alias("places"))
    texts = _sieved(docs, places).join(own, "id")

    def load(b: pa.RecordBatch) -> list:
        return list(zip(_column(b, "id").to_pylist(), _sets(_column(b, "text"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _runs(batches, ["tile", "block"], load):
            if len(members) > 1:
                links = tiles.spanning_links([s for _, s in members])
                if links:
                    yield _pairs([(members[i][0], members[j][0]) for i, j in links])

    spread = texts.select("id", "text", F.explode("places").alias("p")).select("p.tile", "p.block", "id", "text")
    return (spread.repartition("tile", "block").sortWithinPartitions("tile", "block", "id")
            .mapInArrow(work, "a long, b long"))


def _prefixes(docs: DataFrame, counters: np.ndarray, ids: Bloom, wanted: Bloom | None) -> DataFrame:
    """(token, id, n): the shingles of each document that a similar document
    must share one of, for the documents that ``ids`` lets through.  Sets of Jaccard 0.8 or more share one of their first
    n - ceil(0.8 n) + 1 elements in any order common to all; in this one
    shingles on rarely hit counters come first, so what many documents share
    comes last.  The counters decide cost only, never the result."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            b = b.filter(pa.array(ids.test(_column(b, "id"))))
            tokens, owners, sizes = [], [], []
            for i, s in zip(_column(b, "id").to_numpy(zero_copy_only=False), _sets(_column(b, "text"))):
                n = len(s)
                if not n:
                    continue
                k = n - (4 * n + 4) // 5 + 1
                often = counts[(s >> np.uint64(64 - COUNTERS)).astype(np.int64)]
                if k < n:
                    last = np.partition(often, k - 1)[k - 1]
                    sure = s[often < last]
                    # ties go by hash, the smaller first; s is sorted by it
                    some = np.concatenate([sure, s[often == last][:k - len(sure)]])
                else:
                    some = s
                tokens.append(some)
                owners.append(np.full(k, i, np.int64))
                sizes.append(np.full(k, n, np.int64))
            if tokens:
                out = pa.RecordBatch.from_arrays(
                    [_longs(np.concatenate(tokens)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes))],
                    names=["token", "id", "n"])
                yield out if wanted is None else out.filter(pa.array(wanted.test(out.column(0))))

    return docs.mapInArrow(work, "token long, id long, n long")


def _placed(rows: DataFrame) -> DataFrame:
    """(tile, band, i, j, next, block, id, component): the members of the
    tiles of ``rows`` (tile, id, n, component), laid out in cells of two
    blocks (``i`` and ``j``) that are compared with each other.

    Tiles are cut into size bands a factor of 1.25 wide: similar sets are in
    the same band or in neighbouring ones.  Blocks go by component: one with
    more members than a block holds gets blocks of its own, which never meet
    each other, and the others share blocks.  So m near copies that meet one
    foreign set are laid out once each, and not m / BLOCK times.
    """
    # log() is exact enough but at the edges of bands; a set near an edge goes to both sides
    edge = F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))
    near = F.array_distinct(F.array(F.floor(edge - 1e-6).cast("long"), F.floor(edge + 1e-6).cast("long")))
    spread = rows.withColumn("band", F.explode(near)).select(
        "tile", "id", "component",
        F.explode(F.array(F.struct(F.col("band").alias("band"), F.lit(0).alias("next")),
                          F.struct((F.col("band") - 1).alias("band"), F.lit(1).alias("next")))).alias("t")).select(
        "tile", "id", "component", "t.*")
    # what a block holds: BLOCK sets, and fewer where the sets are long
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_ELEMENTS) / F.pow(F.lit(1.25), F.col("band") + 2))))
    each = materialize(spread.groupBy("tile", "band", "component").agg(F.count(F.lit(1)).alias("m"),
                                                                       F.min("next").alias("own"))
                       .withColumn("many", F.when(F.col("m") > room, F.ceil(F.col("m") / room)).otherwise(F.lit(0))),
                       "tile-components")
    # bands without two components, or without a member of their own, have nothing to compare
    sized = (each.groupBy("tile", "band")
             .agg(F.sum(F.when(F.col("many") == 0, F.col("m")).otherwise(0)).alias("few"), F.sum("many").alias("apart"),
                  F.min("own").alias("own"), F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi AND own = 0")
             .select("tile", "band", F.ceil(F.col("few") / room).alias("bins"), "apart"))
    # the blocks of large components stand behind the shared ones, in the order of the components
    before = Window.partitionBy("tile", "band").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = each.where("many > 0").select("tile", "band", "component", "many",
                                          F.coalesce(F.sum("many").over(before), F.lit(0)).alias("first"))
    mine = (spread.join(sized, ["tile", "band"]).join(large, ["tile", "band", "component"], "left")
            .withColumn("first", F.col("first") + F.col("bins"))
            .withColumn("block", F.coalesce(F.col("first") + F.pmod(F.xxhash64("id"), F.col("many")),
                                            F.pmod(F.xxhash64("component"), F.col("bins")))))
    blocks = F.sequence(F.lit(0).cast("long"), F.col("bins") + F.col("apart") - 1)
    met = F.filter(blocks, lambda x: F.col("first").isNull() | (x < F.col("first"))
                   | (x >= F.col("first") + F.col("many")))
    return mine.select("tile", "band", "next", "id", "component", "block", F.explode(met).alias("other")).select(
        "tile", "band", "next", "id", "component", "block", F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"))


_CELL = ["tile", "band", "i", "j"]


def _cells(batches: Iterator[pa.RecordBatch], load) -> Iterator[tuple[dict, list, list, tuple]]:
    """Per cell of two members or more: key, ids, what ``load`` made, and (component, next, block) arrays."""
    def members(b: pa.RecordBatch) -> list:
        return list(zip(_column(b, "id").to_pylist(), load(b), _column(b, "component").to_pylist(),
                        _column(b, "next").to_pylist(), _column(b, "block").to_pylist()))
    for key, ms in _runs(batches, _CELL, members):
        if len(ms) > 1:
            yield key, [m[0] for m in ms], [m[1] for m in ms], tuple(np.array([m[k] for m in ms]) for k in (2, 3, 4))


def _crossing(docs: DataFrame, comps: DataFrame, counters: np.ndarray) -> DataFrame:
    """Links between the components of ``comps`` (id, component), which has
    one document per set: verified pairs of similar documents that connect
    whatever similarity connects.

    Of all prefix tokens those go on that two components share.  Tokens with
    the same smallest document make one tile, so a document comes to a tile
    once, however many tokens lead there.  In each cell of a tile bitmaps
    rule pairs out; the sets that are left over meet once more in the same
    cell, where pairs are intersected until their components hang together.
    No pair leaves a task but the links: at most one less than the cell has
    components.
    """
    reps = Bloom(comps)
    first = materialize(
        _prefixes(docs, counters, reps, None).groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        .where("lo < hi").select("token"), "shared-tokens")
    # the tokens that two documents share: the rest is not shuffled again
    rows = _prefixes(docs, counters, reps, Bloom(first, "token")).join(first, "token", "left_semi")
    own = materialize(rows.join(comps, "id").select("token", "id", "n", "component"), "prefix-components")
    apart = (own.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                      F.min("id").alias("tile")).where("lo < hi").select("token", "tile"))
    rows = materialize(own.join(apart, "token").select("tile", "id", "n", "component").distinct(), "crossing")
    if not rows.take(1):
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    placed = materialize(_placed(rows), "cells")

    def load_maps(b: pa.RecordBatch) -> list:
        return [(n, np.frombuffer(m, np.uint64)) for n, m in
                zip(_column(b, "n").to_pylist(), _column(b, "bytes").to_pylist())]

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, maps, (group, band, block) in _cells(batches, load_maps):
            left = tiles.crossing_members(np.array([n for n, _ in maps]), [m for _, m in maps], group, band, block)
            if len(left):
                k = len(left)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, key[c], np.int64)) for c in _CELL]
                    + [pa.array([ids[x] for x in left], pa.int64()), pa.array(group[left].astype(np.int64)),
                       pa.array(band[left].astype(np.int32)), pa.array(block[left].astype(np.int64))],
                    names=[*_CELL, "id", "component", "next", "block"])

    def in_cells(frame: DataFrame, made: DataFrame) -> DataFrame:
        return frame.join(made, "id").repartition(*_CELL).sortWithinPartitions(*_CELL, "id")

    maps = _of_sets(docs, rows.select("id").distinct(), lambda s: tiles.bitmap(s).tobytes())
    left = materialize(in_cells(placed, maps).mapInArrow(
        rule_out, "tile long, band long, i long, j long, id long, component long, next int, block long"), "cells-left")

    def load_sets(b: pa.RecordBatch) -> list:
        return [np.frombuffer(x, np.uint64) for x in _column(b, "bytes").to_pylist()]

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, sets, (group, band, block) in _cells(batches, load_sets):
            links = tiles.crossing_links(sets, group, band, block)
            if links:
                yield _pairs([(ids[x], ids[y]) for x, y in links])

    sets = _of_sets(docs, left.select("id").distinct(), lambda s: s.tobytes())
    return in_cells(left, sets).mapInArrow(intersect, "a long, b long")


def _of_sets(docs: DataFrame, ids: DataFrame, make) -> DataFrame:
    """(id, n, bytes): size and ``make`` of the set of each document with one of the ids."""
    bloom = Bloom(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(bloom.test(_column(b, "id"))))
            n, made = [], []
            for s in _sets(_column(b, "text")):
                n.append(len(s))
                made.append(make(s))
            yield pa.RecordBatch.from_arrays(
                [_column(b, "id"), pa.array(n, pa.int64()), pa.array(made, pa.binary())], names=["id", "n", "bytes"])
    made = docs.mapInArrow(work, "id long, n long, bytes binary")
    return made.join(ids, "id", "left_semi").dropDuplicates(["id", "n", "bytes"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id for every row of ``docs``.

    Two documents are linked when the Jaccard similarity of their sets of
    5-word shingles is 0.8 or more (words split at ASCII whitespace, A-Z
    lower-cased; fewer than five words are one shingle); the component is
    the smallest id that links reach.  Sets are compared by 64-bit hashes of
    their shingles.  Texts without words, null texts among them, have an
    empty set and are linked with nothing.  Ids are integers; rows that
    repeat an id are one document with its row's own text, each returned; a
    null id is linked with nothing and its component is null.  An empty
    table gives no rows; other columns are not read.

    Steps: equal sets become one; sets that share a least hash are compared
    in tiles and joined; prefix tokens shared by different components lead
    to size-banded tiles where bitmaps rule pairs out; the rest is
    intersected exactly.  Copies are never expanded into pairs: a tile gives
    a spanning forest, pairs within a component are not looked at again, and
    two components are intersected in a cell only until one pair links them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    known = rows.where(F.col("id").isNotNull())
    both = materialize(_profile(rows), "profile")
    profile = both.where(F.col("counter").isNull())
    counts = both.where(F.col("counter").isNotNull()).groupBy("counter").agg(F.sum("count").alias("count")).toPandas()
    counters = np.zeros(1 << COUNTERS, np.int64)        # at most 2**COUNTERS rows, whatever the corpus
    counters[counts["counter"].to_numpy(np.int64)] = counts["count"]
    full = profile.where("n > 0 AND id IS NOT NULL")
    same = materialize(full.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"),
                                                 F.first("keys").alias("keys")), "set-classes")
    copies = _copies(known, same.select(F.col("rep").alias("id"), "n", "keys"))
    near = materialize(components(copies), "copies")
    to_rep = materialize(full.join(same.select("digest", "rep"), "digest").select("id", "rep").distinct(), "to-rep")
    comps = to_rep.join(near.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "id", F.coalesce("component", "rep").alias("component"))
    comps = materialize(comps.groupBy("id").agg(F.min("component").alias("component")), "components")
    # of equal sets one document stands for all from here on
    links = _crossing(known, comps.join(same.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), counters)
    name = comps.where("id <> component")
    of = (links.join(name.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
          .join(name.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
          .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = components(of).select(F.col("id").alias("component"), F.col("component").alias("final"))
    final = comps.join(merged, "component", "left").select("id", F.coalesce("final", "component").alias("component_id"))
    return (profile.select("id", "n").join(final, "id", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, one document per component: the one
    with the component's id.  Documents without words all stay, and so do
    rows without an id."""
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    gone = found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_kf_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_kf_gone"], "left_anti")
