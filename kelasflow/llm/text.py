"""Byte-level tokenising and hashing of Arrow text columns with numpy.

The helpers work on the UTF-8 buffer of a whole record batch, a bounded run of
documents at a time, so a task never builds a Python object per word.  A null
text is an empty one.  Hashes are 64-bit; they are seeded by constants below,
so every task and every run gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes of text handled at once; one longer document is handled alone, whole.
CHUNK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_all = np.arange(256)
# [^\x20\x09-\x0D]+ : bytes of multi-byte code points belong to words.
NOT_SPACE = ~((_all == 32) | ((_all >= 9) & (_all <= 13)))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = ((_all >= 48) & (_all <= 57)) | ((_all >= 97) & (_all <= 122)) | (_all >= 128)

_rng = np.random.default_rng(20260215)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1, 1 << 62)) * 4 + 3
BASE_INV = pow(BASE, -1, 1 << 64)
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Chunk:
    """A run of documents: ``first`` is the index of the first one in its batch."""

    first: int
    n: int
    raw: np.ndarray         # bytes as they are, one space after each document
    ends: np.ndarray        # position of that space, per document
    low: np.ndarray         # raw with A-Z lower-cased


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset: col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of a batch in runs of about ``limit`` bytes."""
    data, offs = text_buffer(col)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        rel = offs[i:j + 1] - offs[i]
        raw = np.insert(data[offs[i]:offs[j]], rel[1:], 32)
        yield Chunk(i, j - i, raw, rel[1:] + np.arange(j - i), LOWER[raw])
        i = j


def powers(n: int, base: int) -> np.ndarray:
    size = 1 << max(19, int(n).bit_length())
    return _powers_at(size, base)[:n]


@lru_cache(maxsize=4)
def _powers_at(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    start: np.ndarray       # byte positions in the chunk
    end: np.ndarray
    doc: np.ndarray         # index of the document in the chunk
    hash: np.ndarray        # 64-bit hash of the lower-cased word
    counts: np.ndarray      # words per document


def words(c: Chunk, allowed: np.ndarray) -> Words:
    """Maximal runs of ``allowed`` bytes of the lower-cased text."""
    inside = allowed[c.low]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]         # a document ends in a space: every run closes
    doc = np.searchsorted(c.ends, start, "left")
    counts = np.bincount(doc, minlength=c.n) if len(doc) else np.zeros(c.n, np.int64)
    code = BYTE_CODE[c.low] * powers(len(c.low), BASE)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code, dtype=np.uint64)])
    h = (total[end] - total[start]) * powers(len(c.low), BASE_INV)[start]
    return Words(start, end, doc, mix(h + (end - start).astype(np.uint64)), counts)


def window_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes (k up to 64)."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = w[:n] * PLACE[0]
    for i in range(1, k):
        acc = acc + w[i:n + i] * PLACE[i]
    return mix(acc + np.uint64(k))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    s = np.sort(h)
    keep = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def shingle_sets(c: Chunk, k: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``k``-word shingles; a
    document of fewer words has its whole sequence as one; none has none."""
    w = words(c, NOT_SPACE)
    h = window_hashes(w.hash, k)
    first = np.concatenate([[0], np.cumsum(w.counts)])
    out = []
    for i in range(c.n):
        a, n = first[i], int(w.counts[i])
        if n >= k:
            out.append(distinct(h[a:a + n - k + 1]))
        elif n:
            out.append(window_hashes(w.hash[a:a + n], n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
