"""Benchmark decontamination: a broadcast set of n-gram hashes scanned over documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelasflow.llm import text as T
from kelasflow.llm.common import materialize, text_of

WINDOW = 13
# Benchmark text broadcast at once; a larger benchmark is scanned in several
# parts of at most about this size, and the hits of the parts are merged.
PART_BYTES = 64 << 20
FILTER_BITS = 20


@dataclass
class WindowSet:
    """The distinct windows of one length: sorted hashes, texts, items of each."""

    length: int
    hashes: np.ndarray
    texts: list[bytes]          # words joined by one space
    items: list[list[str]]
    sieve: np.ndarray           # by the top bits of a hash: some window has them


def window_sets(items: list[tuple[str, str]], window: int = WINDOW) -> list[WindowSet]:
    """Windows of ``window`` words of every item; an item of fewer words, but
    not none, is one window."""
    col = pa.array([t for _, t in items], pa.large_string())
    found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    for c in T.chunks(col):
        w = T.words(c, T.ALNUM)
        at = 0
        for d in range(c.n):
            n = int(w.counts[d])
            ws = [c.low[a:b].tobytes() for a, b in zip(w.start[at:at + n], w.end[at:at + n])]
            at += n
            size = min(window, n)
            for i in range(n - size + 1 if n else 0):
                found[size][b" ".join(ws[i:i + size])].add(items[c.first + d][0])
    out = []
    for size, windows in sorted(found.items()):
        texts = list(windows)
        hashes = np.array([_hash(t, size) for t in texts], np.uint64)
        order = np.argsort(hashes, kind="stable")
        sieve = np.zeros(1 << FILTER_BITS, bool)
        sieve[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        out.append(WindowSet(size, hashes[order], [texts[i] for i in order],
                             [sorted(windows[texts[i]]) for i in order], sieve))
    return out


def _hash(text: bytes, size: int) -> np.uint64:
    c = next(T.chunks(pa.array([text.decode()], pa.large_string())))
    return T.window_hashes(T.words(c, T.ALNUM).hash, size)[0]


@dataclass
class Scan:
    """What a run of documents has in common with the benchmark."""

    words: T.Words
    hit: np.ndarray                     # per word: inside an occurrence of a window
    items: list[set[str]]               # per document


def scan(c: T.Chunk, sets: list[WindowSet]) -> Scan:
    w = T.words(c, T.ALNUM)
    n = len(w.hash)
    edge = np.zeros(n + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(c.n)]
    packed = None
    for s in sets:
        h = T.window_hashes(w.hash, s.length)
        at = np.flatnonzero(s.sieve[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = at[w.doc[at] == w.doc[at + s.length - 1]]
        lo = np.searchsorted(s.hashes, h[at], "left")
        hi = np.searchsorted(s.hashes, h[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            continue
        packed = packed if packed is not None else _packed(c, w)
        order = np.argsort(lo, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lo[order])) + 1):
            for k in range(lo[group[0]], hi[group[0]]):     # several windows only where hashes collide
                good = _same(packed, at[group], s.texts[k])
                np.add.at(edge, good, 1)
                np.add.at(edge, good + s.length, -1)
                for d in np.unique(w.doc[good]):
                    items[d].update(s.items[k])
    return Scan(w, np.cumsum(edge[:-1]) > 0, items)


def _packed(c: T.Chunk, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each word starts there."""
    size = w.end - w.start
    start = np.concatenate([[0], np.cumsum(size + 1)])
    keep = T.ALNUM[c.low]
    keep[w.end] = True
    out = c.low[keep].copy()
    out[start[1:] - 1] = 32
    return out, start[:-1]


def _same(packed: tuple[np.ndarray, np.ndarray], at: np.ndarray, text: bytes) -> np.ndarray:
    """Those of the word positions where the very words of ``text`` stand."""
    data, start = packed
    want = np.frombuffer(text + b" ", np.uint8)
    at = at[start[at] + len(want) <= len(data)]
    good = np.ones(len(at), bool)
    step = max(1, (1 << 22) // len(want))
    for i in range(0, len(at), step):
        good[i:i + step] = (data[start[at[i:i + step], None] + np.arange(len(want))] == want).all(axis=1)
    return at[good]


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return e[0::2], e[1::2]


_SCAN_TYPE = ("struct<n_words:bigint,runs:array<struct<first:int,last:int,start:int,end:int>>,"
              "items:array<string>>")
_RUN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan_udf(shared):
    @F.arrow_udf(_SCAN_TYPE)
    def scan_texts(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sets = shared.value
        for col in cols:
            n_words, runs, items = [], [], []
            for c in T.chunks(col):
                s = scan(c, sets)
                n_words.extend(s.words.counts.tolist())
                first = np.concatenate([[0], np.cumsum(s.words.counts)])
                for d in range(c.n):
                    items.append(sorted(s.items[d]))
                    if not s.items[d]:
                        runs.append([])
                        continue
                    base = 0 if d == 0 else int(c.ends[d - 1]) + 1
                    a, b = _runs(s.hit[first[d]:first[d + 1]])
                    starts, ends = s.words.start[first[d] + a] - base, s.words.end[first[d] + b - 1] - base
                    # byte positions become code points: continuation bytes do not count
                    lead = np.concatenate([[0], np.cumsum((c.raw[base:c.ends[d]] & 0xC0) != 0x80)])
                    runs.append([{"first": int(i), "last": int(j), "start": int(lead[x]), "end": int(lead[y])}
                                 for i, j, x, y in zip(a, b, starts, ends)])
            yield pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(runs, _RUN), pa.array(items, pa.list_(pa.string()))],
                names=["n_words", "runs", "items"])
    return scan_texts


def _parts(bench: DataFrame, item_col: str, text_col: str, part_bytes: int):
    """The benchmark in parts whose text is at most about ``part_bytes``."""
    rows = bench.select(F.col(item_col).cast("string").alias("item"), text_of(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(total // part_bytes) + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield k, n, [(r["item"] or "", r["text"]) for r in part.toLocalIterator()]


def contamination(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES,
                  prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_hit, items, runs and contaminated added (their
    names behind ``prefix``; columns of these names are replaced).

    A document word is hit when it stands inside any occurrence of a window,
    however often and however the windows overlap; ``runs`` are the maximal
    hit runs per part of the benchmark, in words and in code points.  A
    document is contaminated when n_hit > 0 and 20 * n_hit >= n_words.  Null
    texts have no words, null items no windows, and an empty benchmark hits
    nothing; repeated items and repeated windows count once per item_id.  The
    scan is a projection: no document is shuffled, and only the windows,
    bounded by ``part_bytes`` of text at a time, are broadcast.
    """
    sc = docs.sparkSession.sparkContext
    out, cols = docs, []
    for k, n, items in _parts(bench, item_col, item_text_col, part_bytes):
        cols.append(f"_kf_scan{k}")
        out = out.withColumn(cols[-1], _scan_udf(sc.broadcast(window_sets(items, window)))(text_col))
        if k + 1 < n:
            out = materialize(out, "decontamination")
    runs = F.array_sort(F.flatten(F.array(*[F.col(c)["runs"] for c in cols])))
    n_hit = F.aggregate(
        runs, F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, r: F.struct(F.greatest(acc["upto"], r["last"]).alias("upto"),
                                (acc["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(acc["upto"], r["first"])))
                                .alias("n")),
        lambda acc: acc["n"])
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(c)["items"] for c in cols]))))
    n_words = F.col(cols[0])["n_words"]
    out = out.withColumns({prefix + "n_words": n_words, prefix + "n_hit": n_hit, prefix + "items": items,
                           prefix + "runs": runs})
    dirty = (F.col(prefix + "n_hit") > 0) & (20 * F.col(prefix + "n_hit") >= F.col(prefix + "n_words"))
    return out.withColumn(prefix + "contaminated", dirty).drop(*cols)


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated documents, columns as they were."""
    found = contamination(docs, bench, text_col, prefix="_kf_", **options)
    return found.where(~F.col("_kf_contaminated")).select(*docs.columns)


def cut_spans(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every hit run cut out of the texts (separators stay)."""
    found = contamination(docs, bench, text_col, prefix="_kf_", **options)
    text = F.col(text_col)
    cut = F.aggregate(
        F.col("_kf_runs"), F.struct(F.lit(0).alias("upto"), F.lit("").alias("text")),
        lambda acc, r: F.struct(
            F.greatest(acc["upto"], r["end"]).alias("upto"),
            F.concat(acc["text"], text.substr(acc["upto"] + 1, F.greatest(F.lit(0), r["start"] - acc["upto"])))
            .alias("text")),
        lambda acc: F.concat(acc["text"], text.substr(acc["upto"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("_kf_runs") > 0, cut).otherwise(text)).select(*docs.columns)
