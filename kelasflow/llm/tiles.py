"""Hashed bitmaps over shingle sets, and the comparison of sets within a tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Bits per shingle of a bitmap, rounded up to a power of two of at least 64 bits.
BITS_PER_SHINGLE = 4


def enough(overlap: np.ndarray | int, total: np.ndarray | int) -> np.ndarray | bool:
    """Jaccard similarity of 0.8 or more, of sets with ``total`` elements together."""
    return 180 * overlap >= 80 * total


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bit h mod size for every hash; halves of a larger bitmap fold into a smaller one."""
    bits = 64
    while bits < BITS_PER_SHINGLE * len(shingles):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(bm: np.ndarray, words: int) -> np.ndarray:
    """A bitmap brought down to ``words`` words of 64 bits."""
    while bm.shape[-1] > words:
        half = bm.shape[-1] // 2
        bm = bm[..., :half] | bm[..., half:]
    return bm


def overlap_bound(x: np.ndarray, nx: int, ys: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Upper bound of the overlaps of one set with others: a bit that the other
    side lacks stands for at least one element that it lacks."""
    only_x = np.bitwise_count(x & ~ys).sum(axis=1, dtype=np.int64)
    only_y = np.bitwise_count(ys & ~x).sum(axis=1, dtype=np.int64)
    return np.minimum(nx - only_x, ny - only_y)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


class Tile:
    """Sets of about one size band, ordered by size, with their bitmaps."""

    def __init__(self, sizes: np.ndarray, maps: list[np.ndarray]):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.maps = [maps[i] for i in self.order]
        width = np.array([len(m) for m in self.maps])
        self.of_width = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
        self.stacked = {w: np.stack([self.maps[i] for i in at]) for w, at in self.of_width.items()}

    def against(self, i: int, allowed: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(js, bounds) of the sets before ``i`` (of those ``allowed``) that
        could still be similar to it, a pair of arrays per width of bitmap."""
        n = int(self.sizes[i])
        low = int(np.searchsorted(self.sizes[:i], -(-4 * n // 5), "left"))
        for w, at in self.of_width.items():
            a, b = np.searchsorted(at, [low, i])
            if a == b:
                continue
            js, maps = at[a:b], self.stacked[w][a:b]
            if allowed is not None:
                some = allowed[js]
                if not some.any():
                    continue
                js, maps = js[some], maps[some]
            words = min(w, len(self.maps[i]))
            ny = self.sizes[js]
            bound = overlap_bound(fold(self.maps[i], words), n, fold(maps, words), ny)
            good = enough(bound, n + ny)
            yield js[good], bound[good]

    def before(self, i: int, allowed: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """The same, pair by pair."""
        for js, bound in self.against(i, allowed):
            yield from zip(js.tolist(), bound.tolist())


class Forest:
    """Union-find over the members of a tile."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def spanning_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect what similarity connects in the tile:
    at most one pair less than sets.  A pair already connected is not
    compared; the most promising ones are compared first."""
    tile = Tile(np.array([len(s) for s in sets]), [bitmap(s) for s in sets])
    order, forest, out = tile.order, Forest(len(sets)), []
    for i in range(1, len(sets)):
        for j, _ in sorted(tile.before(i), key=lambda jb: -jb[1]):
            if forest.root(i) == forest.root(j):
                continue
            x, y = sets[order[i]], sets[order[j]]
            if enough(overlap(x, y), len(x) + len(y)):
                forest.join(i, j)
                out.append((int(order[i]), int(order[j])))
    return out


def _may_meet(i: int, group: np.ndarray, band: np.ndarray, block: np.ndarray, two: bool) -> np.ndarray:
    """Members that member ``i`` is to be compared with.

    A cell holds sets of a band and of the next one (``band`` 0 and 1): pairs
    within the next band belong to that band's own cells.  In a cell of two
    blocks only pairs across are asked for; each block has its own cell."""
    allowed = group != group[i]
    if band[i]:
        allowed &= band == 0
    if two:
        allowed &= block != block[i]
    return allowed


def crossing_members(sizes: np.ndarray, maps: list[np.ndarray], group: np.ndarray, band: np.ndarray,
                     block: np.ndarray) -> np.ndarray:
    """Members of a cell that the bitmaps leave with a partner in another group."""
    tile = Tile(sizes, maps)
    order = tile.order
    group, band, block = group[order], band[order], block[order]
    two = bool((block != block[0]).any())
    left = np.zeros(len(order), bool)
    for i in range(1, len(order)):
        allowed = _may_meet(i, group, band, block, two)
        if allowed[:i].any():
            for js, _ in tile.against(i, allowed):
                left[js] = True
                left[i] |= bool(len(js))
    return np.sort(order[left])


def crossing_links(sets: list[np.ndarray], group: np.ndarray, band: np.ndarray, block: np.ndarray
                   ) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect the groups which similarity connects
    in the cell: at most one less than groups."""
    tile = Tile(np.array([len(s) for s in sets]), [bitmap(s) for s in sets])
    order, out = tile.order, []
    group, band, block = group[order].copy(), band[order], block[order]
    two = bool((block != block[0]).any())
    for i in range(1, len(order)):
        allowed = _may_meet(i, group, band, block, two)
        if not allowed[:i].any():
            continue
        x = sets[order[i]]
        for j, _ in sorted(tile.before(i, allowed), key=lambda jb: -jb[1]):
            y = sets[order[j]]
            if group[i] != group[j] and enough(overlap(x, y), len(x) + len(y)):
                group[group == group[j]] = group[i]         # one group from now on
                out.append((int(order[i]), int(order[j])))
    return out
