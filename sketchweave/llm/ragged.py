"""Ragged arrays on numpy: flat values, starts and counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def positions(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The flat positions of the runs [start, start + count), one after the other."""
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - counts), counts) + np.arange(total)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths (0 for an empty run)."""
    total = np.concatenate([np.zeros((1,) + values.shape[1:], values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if offsets and len(array) else np.zeros(len(array) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(array: pa.Array, most_bytes: int):
    """(start, stop) row ranges of at most that many bytes each, one row at least."""
    _, offsets = utf8(array)
    start = 0
    while start < len(array):
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), len(array))
        yield start, stop
        start = stop
