"""Seeded Murmur3 inside code generation.

Spark's ``hash`` folds from the left: the seed for the second column is the hash
of the first.  A 4-byte integer is hashed bijectively, so for every wanted seed
one integer has it as its hash, and ``hash(that, key)`` is Murmur3 of the key
under the wanted seed.  Keys must have a multiple of 4 bytes.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import SketchConfig

MASK = (1 << 32) - 1
# The constants of 32-bit Murmur3, and Spark's own seed.
C1, C2, C3, M1, M2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
SPARK_SEED = 42


def rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & MASK


def murmur3(key: bytes, seed: int) -> int:
    """Reference value in plain Python, for any key length."""
    h, n = seed, len(key)
    for i in range(0, n - n % 4, 4):
        k = rotl(int.from_bytes(key[i : i + 4], "little") * C1 & MASK, 15) * C2 & MASK
        h = (rotl(h ^ k, 13) * 5 + C3) & MASK
    if n % 4:
        h ^= rotl(int.from_bytes(key[n - n % 4 :], "little") * C1 & MASK, 15) * C2 & MASK
    h ^= n
    h = (h ^ h >> 16) * M1 & MASK
    h = (h ^ h >> 13) * M2 & MASK
    return h ^ h >> 16


def _unshift(x: int, r: int) -> int:
    y = x
    for _ in range(32 // r):
        y = x ^ y >> r
    return y


@functools.lru_cache(maxsize=256)
def seed_prefix(seed: int) -> int:
    """The signed integer whose Spark hash is ``seed``."""
    inv = lambda a: pow(a, -1, 1 << 32)
    h = _unshift(seed, 16) * inv(M2) & MASK
    h = _unshift(h, 13) * inv(M1) & MASK
    h = _unshift(h, 16) ^ 4
    h = rotl((h - C3) * inv(5) & MASK, 32 - 13) ^ SPARK_SEED
    k = rotl(h * inv(C2) & MASK, 32 - 15) * inv(C1) & MASK
    return k - (1 << 32) if k >> 31 else k


def string_key(feature: Column, key_len: int = 12) -> Column:
    """The first bytes of a string feature, filled with zero bytes."""
    return F.rpad(F.substring(F.encode(feature, "UTF-8"), 1, key_len), key_len, F.lit(bytes(1)))


def key_of(feature: Column, kind: str, cfg: SketchConfig) -> Column:
    """Hash input of a feature: 4 bytes of an integer, leading bytes of a string."""
    return string_key(feature, cfg.key_len) if kind == "string" else feature.cast("int")


def murmur(key: Column, seed: int) -> Column:
    """Unsigned Murmur3 of a non-null key column under ``seed``, as a long."""
    return F.hash(F.lit(seed_prefix(seed)), key).cast("long").bitwiseAND(F.lit(MASK))


def bucket(key: Column, seed: int, n_buckets: int) -> Column:
    return (murmur(key, seed) % n_buckets).cast("int")


def sign(key: Column, seed: int) -> Column:
    return (murmur(key, seed).bitwiseAND(F.lit(1)) * 2 - 1).cast("int")


def cells(key: Column, cfg: SketchConfig) -> Column:
    """Array of (r, b, sg): row, bucket and sign of a key in every row of the sketch."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("r"), bucket(key, cfg.seeds[i], cfg.n_buckets).alias("b"), sign(key, cfg.sign_seed(i)).alias("sg"))
            for i in range(cfg.n_rows)
        ]
    )
