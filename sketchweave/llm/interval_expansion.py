"""Common prefixes up to a minimum length by breadth-first expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

from .ragged import positions


def suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffix array.  text: ints, every value under ``first real symbol`` unique, so that no two suffixes
    agree beyond ``longest`` symbols; prefix doubling stops there."""
    n, base = len(text), int(text.max()) + 2
    if base < 1 << 21:
        # Three symbols at once; a suffix that ends before counts as smallest.
        key, h = np.zeros(n, np.int64), 3
        for k in range(3):
            key *= base
            key[: n - k] += text[k:].astype(np.int64) + 1
    else:
        key, h = text.astype(np.int64), 1
    rank = np.zeros(n, np.int32)
    while True:
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        rank[order[0]] = 0
        rank[order[1:]] = np.cumsum(key[1:] != key[:-1], dtype=np.int32)
        if h > longest or rank[order[-1]] == n - 1:
            return order
        key = rank.astype(np.int64) * (n + 1)
        key[: max(0, n - h)] += rank[h:] + 1
        h *= 2


def classes(raw: np.ndarray, lengths: np.ndarray, least: int) -> np.ndarray:
    """Class number of every position of the concatenated strings, by the next ``least`` bytes.

    Positions with fewer bytes left in their string get -1.  Two positions have
    one class exactly if the bytes are equal.
    """
    total, k = len(raw), len(lengths)
    out = np.full(total, -1, np.int64)
    if not total:
        return out
    # Every string ends with a symbol of its own, smaller than all bytes.
    ends = np.cumsum(lengths + 1) - 1
    text = np.empty(total + k, np.int32)
    mark = np.zeros(total + k, bool)
    mark[ends] = True
    text[~mark] = raw.astype(np.int32) + k
    text[mark] = np.arange(k)
    order = suffix_order(text, int(lengths.max()) + 1)
    n = len(text)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    # LF: the place of the suffix one symbol longer; backward extension of an interval is LF of its members.
    before = order - 1
    lf = np.where(before >= 0, place[before], np.int32(-1))
    lf[(before >= 0) & mark[before]] = -1  # no extension over the end of a string
    # known[i]: the common prefix of places i - 1 and i is shorter than least.
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    symbol = text[order]
    del place, before, text
    for length in range(least):
        # Intervals of strings of this length, each extended backward by every symbol before its members.
        at = positions(low, high - low)
        longer = lf[at]
        if len(at) * 8 > n:
            reached = np.zeros(n, bool)
            reached[longer[longer >= 0]] = True
            to = np.flatnonzero(reached)
        else:
            to = np.sort(longer[longer >= 0])
        if not len(to):
            break
        if length == 0:
            cut = np.append(True, symbol[to[1:]] != symbol[to[:-1]])
        else:
            of = np.repeat(np.arange(len(low), dtype=np.int32), high - low)
            source = np.empty(n, np.int32)
            source[longer[longer >= 0]] = of[longer >= 0]
            cut = np.append(True, (to[1:] != to[:-1] + 1) | (source[to[1:]] != source[to[:-1]]) | (symbol[to[1:]] != symbol[to[:-1]]))
        begin = np.flatnonzero(cut)
        new_low = to[begin]
        new_high = np.append(to[begin[1:] - 1], to[-1]) + 1
        if length == 0:
            known[new_low] = True
            known[new_high] = True
            low, high = new_low, new_high
            continue
        # The place after an interval is settled by the shortest string that ends there.
        fresh = ~known[new_high]
        fresh_low = ~known[new_low]
        known[new_high[fresh]] = True
        known[new_low[fresh_low]] = True
        use = fresh | fresh_low
        low, high = new_low[use], new_high[use]
        if not len(low):
            break
    number = np.cumsum(known[:n])
    left = np.repeat(ends, lengths + 1) - np.arange(n)
    ok = ~mark & (left >= least)
    out_all = np.full(n, -1, np.int64)
    out_all[order] = number
    out_all[~ok] = -1
    out[:] = out_all[~mark]
    return out
