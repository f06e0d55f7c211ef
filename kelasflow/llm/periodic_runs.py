"""Runs of repeated word sequences, found by block convolution.

A run is a stretch of words with smallest period q (words q apart are
identical) of at least max(24, 3 q) words that no neighbouring word extends.
At every dyadic scale B the words of a run of documents are cut into aligned
blocks of B.  A run whose period lies in [B, 2 B) contains a block that occurs
again, whole, at the distance of the period; the number-theoretic transform of
squared differences (:mod:`kelasflow.llm.ntt`) finds all such distances of a
block in the window after it, exactly.  Each distance seeds an extension to
both sides; the stretches that are long enough are the runs.

Two exact rules spare transforms: in a run every word occurs again within the
period, so a block with a word that does not is skipped; and inside a known
stretch of a smaller period no new smallest period can begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelasflow.llm.common import text_of
from kelasflow.llm.ntt import PRIMES, _power_list, occurrences
from kelasflow.llm.text import NOT_SPACE, Chunk, chunks
from kelasflow.llm.word_codes import encode, runs as word_runs

MIN_WORDS, MIN_TIMES = 24, 3
SLICE = 1 << 18             # numbers transformed at once (one longer block is taken alone)
FAR = np.int64(1) << 62
HASH_PRIME, HASH_BASE = PRIMES[0][0], 1_000_003


def _next_distance(x: np.ndarray) -> np.ndarray:
    """Distance to the next equal number, or FAR."""
    out = np.full(len(x), FAR)
    order = np.argsort(x, kind="stable")
    again = x[order[1:]] == x[order[:-1]]
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


class _Matcher:
    """Longest equal stretches by prefix sums modulo a prime: an answer is
    never too short, and the caller compares the numbers of what it keeps."""

    def __init__(self, x: np.ndarray):
        p = np.uint64(HASH_PRIME)
        self.n, self.p = len(x), p
        self.power = _power_list(HASH_BASE, len(x) + 1, HASH_PRIME)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) % p * self.power[:-1] % p, out=self.sums[1:])
        self.sums %= p

    def _equal(self, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
        a = (self.sums[i + size] + (self.p - self.sums[i])) % self.p
        b = (self.sums[j + size] + (self.p - self.sums[j])) % self.p
        return a * self.power[j - i] % self.p == b

    def right(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How many numbers from i equal those from i + d."""
        got = np.zeros(len(i), np.int64)
        step = 1 << max(0, self.n.bit_length() - 1)
        while step:
            at = np.flatnonzero(i + d + got + step <= self.n)
            at = at[self._equal(i[at] + got[at], i[at] + got[at] + d[at], step)] if len(at) else at
            got[at] += step
            step >>= 1
        return got

    def left(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How many numbers before i equal those before i + d."""
        got = np.zeros(len(i), np.int64)
        step = 1 << max(0, self.n.bit_length() - 1)
        while step:
            at = np.flatnonzero(i - got - step >= 0)
            at = at[self._equal(i[at] - got[at] - step, i[at] - got[at] - step + d[at], step)] if len(at) else at
            got[at] += step
            step >>= 1
        return got


def _exact(x: np.ndarray, start: int, end: int, d: int, seed: int) -> tuple[int, int]:
    """The stretch of period d around ``seed``, compared number by number."""
    if (np.array_equal(x[start:end - d], x[start + d:end]) and (start == 0 or x[start - 1] != x[start - 1 + d])
            and (end == len(x) or x[end] != x[end - d])):
        return start, end
    same = x[:len(x) - d] == x[d:]
    before, after = np.flatnonzero(~same[:seed]), np.flatnonzero(~same[seed:])
    return (int(before[-1]) + 1 if len(before) else 0), (seed + int(after[0]) if len(after) else len(same)) + d


def periodic_stretches(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of every run in ``x``; none is longer than ``longest``."""
    found: dict[tuple[int, int], int] = {}
    if longest < MIN_WORDS:
        return []
    again = _next_distance(x)
    if not (again < FAR).any():
        return []
    matcher = None
    size, far = 1, again
    while MIN_TIMES * size <= longest and len(far):
        candidate = far < 2 * size
        if found and candidate.any():
            inside = np.zeros(len(far) + 1, np.int64)
            for (s, e), _ in found.items():             # blocks whose whole window lies in a known run
                a, b = -(-s // size), (e - 3 * size) // size
                if b >= a:
                    inside[a] += 1
                    inside[b + 1] -= 1
            candidate &= np.cumsum(inside)[:-1] == 0
        at = np.flatnonzero(candidate) * size
        rows = max(1, SLICE // (2 * size))
        for k in range(0, len(at), rows):
            b = at[k:k + rows]
            place = b[:, None] + np.arange(3 * size)
            here = np.where(place < len(x), x[np.minimum(place, len(x) - 1)] + 1, 0)
            row, lag = occurrences(here[:, :size], here[:, size:])
            if not len(row):
                continue
            matcher = matcher or _Matcher(x)
            seed, d = b[row], lag + size
            start, end = seed - matcher.left(seed, d), seed + d + matcher.right(seed, d)
            long = end - start >= np.maximum(MIN_WORDS, MIN_TIMES * d)
            kept, first = np.unique(np.stack([start, end, d], 1)[long], axis=0, return_index=True)
            for (s, e, q), i in zip(kept.tolist(), np.flatnonzero(long)[first].tolist()):
                if (s, e) in found and found[s, e] < q:         # a multiple of a period known already
                    continue
                s, e = _exact(x, s, e, q, int(seed[i]))
                if e - s >= max(MIN_WORDS, MIN_TIMES * q):
                    found[s, e] = min(q, found.get((s, e), q))
        size *= 2
        if len(far) % 2:
            far = np.append(far, FAR)
        far = np.maximum(far[0::2], far[1::2])
    return [(s, e, q) for (s, e), q in found.items()]


def _joined(body: np.ndarray, size: np.ndarray, doc: np.ndarray, keep: np.ndarray, n: int) -> pa.Array:
    """Per document its kept words joined by one space."""
    body, size, doc = body[np.repeat(keep, size)], size[keep], doc[keep]
    inner = np.ones(len(doc), np.int64)
    inner[:1] = 0
    inner[1:][doc[1:] != doc[:-1]] = 0                  # a document's first word follows no space
    out = np.full(len(body) + int(inner.sum()), 32, np.uint8)
    out[np.arange(len(body)) + np.repeat(np.cumsum(inner), size)] = body
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(doc, size + inner, n).astype(np.int64), out=offsets[1:])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out))


def _runs_of_chunk(c: Chunk) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], pa.Array]:
    """Words per document, runs per document (start, length, period), collapsed texts."""
    start, end, doc = word_runs(c, c.raw, NOT_SPACE)
    counts = np.bincount(doc, minlength=c.n)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(c.n)]
    keep = np.ones(len(start), bool)
    if len(start):
        code, words = encode(c.raw, NOT_SPACE, start, end)
        x = len(words) + np.zeros(len(code) + c.n, np.int64)
        place = np.arange(len(code)) + doc              # a number of its own after each document
        x[place] = code
        bars = np.cumsum(counts) + np.arange(c.n)
        x[bars] = len(words) + np.arange(c.n)
        first = np.cumsum(counts) - counts
        for s, e, q in periodic_stretches(x, int(counts.max())):
            d = int(np.searchsorted(bars, s, "left"))
            found[d].append((s - d - int(first[d]), e - s, q))
            keep[s - d + q:e - d] = False
    body = c.raw[NOT_SPACE[c.raw]]
    return counts, [sorted(f, key=lambda r: (r[0], r[2])) for f in found], _joined(body, end - start, doc, keep, c.n)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(1)):
            counts, found, collapsed = _runs_of_chunk(c)
            entry = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
            best = [_strongest(runs) for runs in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(c.first, c.n), pa.array(counts.astype(np.int64)), pa.array(entry, RUNS),
                 pa.array([b and {"start": b[0], "length": b[1], "period": b[2]} for b in best], RUNS.value_type),
                 collapsed.cast(pa.string())], ["id", "n_words", "runs", "strongest", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Periodic runs of every document and its text without their repetitions.

    Returns the id, n_words, runs (array of start, length, period in words,
    by start, then period), strongest (the run of greatest exact length /
    period; of equal ones that of smallest start, then period; null without
    runs) and collapsed (the words joined by one space, without those that a
    run holds after its first period).  Words are runs of anything but ASCII
    white space; null text has none.  Repeated rows and ids are kept as they
    are; an empty table gives no rows; other columns are not read, so their
    names cannot clash.  A document is handled whole, many short ones at once.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    run = "struct<start:bigint,length:bigint,period:bigint>"
    found = rows.mapInArrow(_find, f"id {kind}, n_words long, runs array<{run}>, strongest {run}, collapsed string")
    return found.withColumnRenamed("id", id_col)
