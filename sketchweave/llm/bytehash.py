"""Vectorised 64-bit hashes of byte ranges: a polynomial prefix sum, then a finaliser."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


TABLE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * BASE)
FOLDED = TABLE.copy()
FOLDED[65:91] = TABLE[97:123]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i in 0 .. n."""
    if len(_powers[0]) <= n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, b in enumerate((BASE, inverse)):
            steps = np.full(n + 1, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def prefixes(raw: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Prefix sums from which :func:`ranges` takes the hash of any byte range."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * powers(len(raw))[0][: len(raw)], out=out[1:])
    return out


def ranges(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, equal for equal bytes wherever they stand (before the finaliser)."""
    return (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]


def strings(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Finalised hash of each string of an array."""
    return mix(ranges(prefixes(raw), offsets[:-1], offsets[1:]))
