"""Where blocks of numbers occur in windows: exact sums of squared differences.

The sums come from convolutions modulo primes (number-theoretic transforms),
rows of blocks at once.  A sum is zero exactly when it is zero modulo primes
whose product exceeds the largest possible sum.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Primes k * 2^m + 1 below 2^31 and a primitive root of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))


@lru_cache(maxsize=256)
def _roots(half: int, prime: int, root: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. half-1 of a 2*half-th root of unity, and of its inverse."""
    w = pow(root, (prime - 1) // (2 * half), prime)
    return _power_list(w, half, prime), _power_list(pow(w, -1, prime), half, prime)


def _power_list(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:                     # each doubling multiplies the first part by base^size
        step = np.uint64(pow(base, size, prime))
        out[size:2 * size] = out[:min(size, n - size)] * step % np.uint64(prime)
        size *= 2
    return out


def transform(a: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Rows of ``a`` (a power of two long) transformed; the result is in bit-reversed order."""
    p, n = np.uint64(prime), a.shape[1]
    half = n // 2
    while half:
        part = a.reshape(len(a), -1, 2, half)
        u, v = part[:, :, 0], part[:, :, 1]
        a = np.stack([(u + v) % p, (u + (p - v)) % p * _roots(half, prime, root)[0] % p], 2).reshape(len(a), n)
        half //= 2
    return a


def inverse(a: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Undo :func:`transform`."""
    p, n = np.uint64(prime), a.shape[1]
    half = 1
    while half < n:
        part = a.reshape(len(a), -1, 2, half)
        u, v = part[:, :, 0], part[:, :, 1] * _roots(half, prime, root)[1] % p
        a = np.stack([(u + v) % p, (u + (p - v)) % p], 2).reshape(len(a), n)
        half *= 2
    return a * np.uint64(pow(n, -1, prime)) % p


def _zero_modulo(block: np.ndarray, window: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Per row and lag, whether sum over i of (block[i] - window[i + lag])^2 is 0 modulo the prime."""
    p, size = np.uint64(prime), block.shape[1]
    block, window = block % p, window % p
    mirrored = np.zeros_like(window)
    mirrored[:, 0] = block[:, 0]
    mirrored[:, -1:-size:-1] = block[:, 1:]             # entry -i holds block[i]
    cross = inverse(transform(mirrored, prime, root) * transform(window, prime, root) % p, prime, root)[:, :size]
    squares = np.cumsum(window * window % p, axis=1)
    squares = np.concatenate([np.zeros((len(window), 1), np.uint64), squares], 1)
    total = (block * block % p).sum(1, keepdims=True) + squares[:, size:2 * size] - squares[:, :size]
    return total % p == 2 * cross % p


def occurrences(block: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, lag) of every zero-mismatch occurrence of ``block[row]`` at
    ``window[row, lag:lag + size]``, for lags 0 .. size-1.

    Both are non-negative integers below 2^32, ``size`` a power of two, and a
    window has 2 * size entries.
    """
    size, top = block.shape[1], int(max(block.max(initial=0), window.max(initial=0)))
    block, window = block.astype(np.uint64), window.astype(np.uint64)
    row = np.arange(len(block))
    hit, bound = None, 1
    for prime, root in PRIMES:
        zero = _zero_modulo(block[row], window[row], prime, root)
        hit = zero if hit is None else hit & zero
        bound *= prime
        some = hit.any(1)
        row, hit = row[some], hit[some]
        if bound > size * top * top or not len(row):
            break
    else:
        raise OverflowError(f"blocks of {size} numbers up to {top} exceed the moduli")
    at, lag = np.nonzero(hit)
    return row[at], lag
