"""Vectorised hashing of bytes and words, used inside tasks."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BASE2 = 0xC2B2AE3D27D4EB4F
#: Powers of a base that a worker keeps; longer tables are made anew, so that one long text is not remembered.
KEPT = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 62, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers (the finaliser of a well-known hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= KEPT:
            _powers[base] = have
    return have[:n]


class Sums:
    """Prefix sums from which the hash of any range of some bytes (or, with ``values``, of other symbols) follows at once."""

    def __init__(self, data: np.ndarray, base: int = BASE, values: np.ndarray | None = None):
        self.inverse = pow(base, -1, 1 << 64)
        self.n = len(data)
        self.at = np.zeros(self.n + 1, np.uint64)
        np.cumsum((_VALUE[data] if values is None else values) * powers(base, self.n), out=self.at[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash per range, independent of where it stands."""
        return mix((self.at[end] - self.at[start]) * powers(self.inverse, self.n + 1)[start] + (end - start).astype(np.uint64))


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs without ASCII white space."""
    gap = np.r_[True, _SPACE[data], True]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def pick(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each pair, one after the other."""
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def shingles(data: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes, sorted, of all runs of k words; of fewer words the whole sequence is one."""
    start, end = word_ranges(data)
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64)
    w = Sums(data).ranges(start, end)
    size = min(n, k)
    h = np.zeros(n - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = h * np.uint64(BASE) + w[j : n - size + 1 + j]
        return np.unique(mix(h + np.uint64(size)))
