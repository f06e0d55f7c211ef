"""Exact numbers for the words of a run of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kelasflow.llm.text import Chunk


def runs(c: Chunk, data: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``allowed`` bytes in ``data`` (the raw or the
    lower-cased bytes of the chunk): start, end, index of the document."""
    inside = allowed[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]         # a document ends in a space: every run closes
    return start, end, np.searchsorted(c.ends, start, "left")


def word_array(body: np.ndarray, size: np.ndarray) -> pa.Array:
    """Words of the given sizes that stand one after another in ``body``."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size),
                                            [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


def encode(data: np.ndarray, allowed: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, the distinct words): equal numbers are equal
    bytes.  ``start`` and ``end`` are all runs of ``allowed`` bytes in ``data``."""
    coded = word_array(data[allowed[data]], end - start).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
