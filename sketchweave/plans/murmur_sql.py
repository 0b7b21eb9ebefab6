"""Seeded Murmur3 of 4-byte multiples in plain SQL, for the oracles.

Every step is a select item that names the one before it, so nothing is computed
twice.
"""

from __future__ import annotations


def hash_items(blocks: list[str], seed: str, out: str = "hash") -> str:
    """Select items that end with ``out``, the hash of the blocks (unsigned 32-bit expressions)."""
    items, h = [], f"({seed})::UBIGINT"
    word = "4294967296::UBIGINT"
    low = "4294967295::UBIGINT"
    for i, b in enumerate(blocks):
        items += [
            f"(({b})::UBIGINT * 3432918353::UBIGINT) % {word} AS ka{i}",
            f"((ka{i} << 15) | (ka{i} >> 17)) & {low} AS kb{i}",
            f"(kb{i} * 461845907::UBIGINT) % {word} AS kc{i}",
            f"xor({h}, kc{i}) AS ha{i}",
            f"((ha{i} << 13) | (ha{i} >> 19)) & {low} AS hb{i}",
            f"(hb{i} * 5::UBIGINT + 3864292196::UBIGINT) % {word} AS hc{i}",
        ]
        h = f"hc{i}"
    items += [
        f"xor({h}, {4 * len(blocks)}::UBIGINT) AS fa",
        "xor(fa, fa >> 16) AS fb",
        f"(fb * 2246822507::UBIGINT) % {word} AS fc",
        "xor(fc, fc >> 13) AS fd",
        f"(fd * 3266489909::UBIGINT) % {word} AS fe",
        f"xor(fe, fe >> 16)::BIGINT AS {out}",
    ]
    return ",\n    ".join(items)


def int_blocks(column: str) -> list[str]:
    return [f"({column})::BIGINT & 4294967295"]


def string_blocks(column: str, key_len: int = 12) -> list[str]:
    """Blocks of the leading bytes of a string, filled with zero bytes."""
    h = f"rpad(left(hex(encode({column})), {2 * key_len}), {2 * key_len}, '0')"
    pair = lambda i: f"substr({h}, {2 * i + 1}, 2)"
    return [f"('0x' || {' || '.join(pair(4 * k + j) for j in (3, 2, 1, 0))})" for k in range(key_len // 4)]


def blocks(column: str, kind: str) -> list[str]:
    return string_blocks(column) if kind == "string" else int_blocks(column)
