"""Removal of long repeated substrings, exact at the byte.

A byte goes if it lies in a string of ``least`` bytes that also starts in a
document with a smaller id; strings are judged on the input.

The text is cut into blocks that are written once; blocks and hash buckets
exchange packed messages in three rounds (``exchange``), and hashes only ever
narrow down what is compared:

1. Blocks are cut at content-defined places.  The hashes of neighbouring pieces
   and the anchors of all strings (the smallest hash of the short grams in a
   string; equal strings have equal anchors) tell what other blocks may have.
2. Pairs of pieces that others may have are compared on their bytes: where a
   smaller document has them as well, all strings inside are settled, so copies
   are collapsed before the index is built.  Of the other strings with a shared
   anchor, fingerprints tell which others may have whole; this also spreads an
   anchor that very many different strings share.
3. The passages of the strings left meet in their anchor's bucket.  There a
   Burrows-Wheeler transform of the distinct passages is expanded breadth-first
   by backward extension; the boundaries of common prefixes are found by
   increasing length, up to ``least``, which leaves the classes of equal strings.

Replies are bits, one per sent item.  Per block, an item is sent once, with the
smallest document that has it, so a passage of very many documents costs a
bucket one entry per block.

Defined results: null is empty; documents shorter than ``least`` lose nothing; a
null id counts as larger than all others; rows of one id never match each other;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .bytehash import mix
from .common import Scratch, pick
from .exchange import LAST, TextBlocks, bucket_cuts, replies, unpacked
from .interval_expansion import classes
from .ragged import positions

LEAST = 50
#: Bytes of a gram; half the window in which a cutting place has the smallest gram hash; bytes of a block.
GRAM, REACH, BLOCK = 24, 64, 2 << 20
SECOND = mix(bytehash.TABLE + np.uint64(99))
PAIR = [("a", np.uint64), ("b", np.uint32), ("id", np.int64)]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window [i, i + width); shorter by width - 1."""
    if len(x) < width:
        return x[:0]
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def group(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (first is primary) and the start of each run of equal keys."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, order
    change = np.zeros(len(order), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(change)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """32 bits of a hash beside those that name its bucket."""
    return ((hashes >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Classes:
    """Items (byte ranges) of a block by their bytes: class of each, smallest id, keys and a sample of each class.

    Classes come in the order of their first key.
    """

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray):
        while True:
            order, begin = group([h1, h2])
            self.of = np.empty(len(h1), np.int64)
            self.of[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h1))))
            self.sample = order[begin]
            lead = self.sample[self.of] if len(h1) else self.of
            more = np.flatnonzero(lead != np.arange(len(h1)))
            odd = more[~equal_ranges(raw, start[lead[more]], end[lead[more]], start[more], end[more])]
            if not len(odd):
                break
            # Equal hashes of other bytes: a key of their own.
            h2 = h2.copy()
            h2[odd] = mix(h2[odd] + mix(start[odd].astype(np.uint64) + np.uint64(1)))
        self.lead = np.minimum.reduceat(ids[order], begin) if len(begin) else np.zeros(0, np.int64)
        self.h1, self.h2 = h1[self.sample], h2[self.sample]
        self.later = ids > self.lead[self.of] if len(h1) else np.zeros(0, bool)


def equal_ranges(raw: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether each two byte ranges hold the same bytes."""
    same = a_end - a == b_end - b
    n = np.where(same, a_end - a, 0)
    differs = np.append(0, np.cumsum(raw[positions(a, n)] != raw[positions(b, n)]))
    ends = np.cumsum(n)
    return same & (differs[ends] == differs[ends - n])


class Block:
    """Texts of a block and what each of them derives: pieces, anchors, strings, passages.

    Everything is a function of the texts and of the replies so far, in a fixed
    order, so messages and their replies need no numbers.
    """

    def __init__(self, raw: np.ndarray, sizes: np.ndarray, ids: np.ndarray, least: int, width: int):
        self.raw, self.sizes, self.ids, self.least, self.width = raw, sizes, ids, least, width
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(raw)
        self.prefix = p = bytehash.prefixes(raw)
        grams = max(0, n - GRAM + 1)
        self.gram = mix((p[GRAM:] - p[: n + 1 - GRAM]) * bytehash.powers(n)[1][:grams]) if grams else np.zeros(0, np.uint64)
        key = (self.gram >> np.uint64(32) << np.uint64(32)) | np.arange(grams, dtype=np.uint64)
        self.text_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.valid = np.zeros(n, bool)
        long = sizes >= least
        self.valid[positions(self.starts[long], sizes[long] - least + 1)] = True
        self._pieces(key)
        self._anchors(key)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "second"):
            self.second = bytehash.prefixes(self.raw, SECOND)
        length = (end - start).astype(np.uint64)
        return mix(bytehash.ranges(self.prefix, start, end) + length), mix(bytehash.ranges(self.second, start, end) + length)

    def _inside(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which strings lie in any of the ranges."""
        n = len(self.raw) + 1
        step = np.bincount(start, minlength=n) - np.bincount(end - self.least + 1, minlength=n)
        return (np.cumsum(step[:-1]) > 0) & self.valid

    def _pieces(self, key: np.ndarray) -> None:
        """Pairs of neighbouring pieces and their classes."""
        low = sliding_min(key, 2 * REACH + 1)
        cut = np.flatnonzero(key[REACH : REACH + len(low)] == low) + REACH
        cut = np.unique(np.concatenate([cut, self.starts[self.sizes > 0]]))
        of = self.text_of[cut].astype(np.int64) if len(cut) else cut
        end = lambda k: np.where(np.append(of[k:], np.full(min(k, len(of)), -1)) == of, np.append(cut[k:], np.zeros(min(k, len(of)), np.int64)), self.ends[of])
        one, two = end(1), end(2)
        whole = (cut == self.starts[of]) if len(cut) else np.zeros(0, bool)
        use = ((one < self.ends[of]) | whole) & (two - cut >= self.least) if len(cut) else whole
        self.start, self.end = cut[use], two[use]
        self.pairs = Classes(self.raw, self.start, self.end, *self._hash(self.start, self.end), self.ids[of[use]])
        # Settled within the block already.
        gone = self.pairs.later
        self.removed = self._inside(self.start[gone], self.end[gone])

    def _anchors(self, key: np.ndarray) -> None:
        """Runs of strings with one anchor: places of all strings, run of each, anchor of each run."""
        low = sliding_min(key, self.least - GRAM + 1)
        self.at = np.flatnonzero(self.valid)
        anchor = (low[self.at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        change = np.append(True, (anchor[1:] != anchor[:-1]) | (self.at[1:] != self.at[:-1] + 1) | (self.text_of[self.at[1:]] != self.text_of[self.at[:-1]])) if len(self.at) else np.zeros(0, bool)
        self.run_of = np.cumsum(change) - 1
        first = np.flatnonzero(change)
        # Mixed anew, as the smallest hashes of windows are small ones and would meet in the first buckets.
        self.run_anchor = mix(self.gram[anchor[first]])
        self.anchors, self.anchor_of = np.unique(self.run_anchor, return_inverse=True)
        # In several documents of this block.
        order, begin = group([self.anchor_of])
        ids = self.ids[self.text_of[self.at[first]]][order]
        self.here = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin) if len(begin) else np.zeros(0, bool)

    # Round 1: which pairs and anchors other blocks may have.

    def ask_hashes(self) -> list[bytes]:
        c = self.pairs
        rows = np.empty(len(c.h1), PAIR)
        rows["a"], rows["b"], rows["id"] = c.h1, c.h2 >> np.uint64(32), c.lead
        marks = fingerprint(self.anchors)
        cuts = zip(bucket_cuts(c.h1, self.width), bucket_cuts(self.anchors, self.width))
        return [np.uint32(j - i).tobytes() + rows[i:j].tobytes() + marks[k:m].tobytes() if j > i or m > k else b"" for (i, j), (k, m) in cuts]

    def take_hashes(self, found: dict[int, np.ndarray]) -> None:
        cuts = list(zip(bucket_cuts(self.pairs.h1, self.width), bucket_cuts(self.anchors, self.width)))
        shared, gone, anchors = [], [], []
        for bucket, ((i, j), (k, m)) in enumerate(cuts):
            bits = found.get(bucket, np.zeros(0, bool))
            shared.append(bits[: j - i]), gone.append(bits[j - i : 2 * (j - i)]), anchors.append(bits[2 * (j - i) :])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, bool)
        self.shared_pairs, gone = np.flatnonzero(join(shared)), join(gone)
        other = gone[self.pairs.of] if len(self.start) else np.zeros(0, bool)
        # Strings that a smaller document of another block seems to have.
        self.maybe = self._inside(self.start[other], self.end[other])
        self.asked = (join(anchors) | self.here)[self.anchor_of][self.run_of] if len(self.at) else np.zeros(0, bool)
        use = self.asked & ~self.removed[self.at] & ~self.maybe[self.at]
        self.strings = self.at[use]
        h = mix(bytehash.ranges(self.prefix, self.strings, self.strings + self.least))
        order = np.argsort(h)
        sorted_ = h[order]
        begin = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(h) else np.zeros(0, np.int64)
        self.string_of = np.empty(len(h), np.int64)
        self.string_of[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
        self.string_keys = sorted_[begin]
        ids = self.ids[self.text_of[self.strings[order]]]
        self.string_here = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin) if len(begin) else np.zeros(0, bool)

    # Round 2: the bytes of shared pairs, and which strings other blocks may have.

    def ask_bytes(self) -> list[bytes]:
        c, k = self.pairs, self.shared_pairs
        a, n, lead = self.start[c.sample[k]], (self.end - self.start)[c.sample[k]], c.lead[k]
        marks = fingerprint(self.string_keys)
        out = []
        for (i, j), (x, y) in zip(bucket_cuts(c.h1[k], self.width), bucket_cuts(self.string_keys, self.width)):
            body = self.raw[positions(a[i:j], n[i:j])].tobytes()
            out.append(np.uint32(j - i).tobytes() + n[i:j].astype(np.uint32).tobytes() + lead[i:j].tobytes() + body + marks[x:y].tobytes() if j > i or y > x else b"")
        return out

    def take_bytes(self, found: dict[int, np.ndarray]) -> None:
        gone, shared = np.zeros(len(self.pairs.h1), bool), np.zeros(len(self.string_keys), bool)
        k = self.shared_pairs
        for bucket, ((i, j), (x, y)) in enumerate(zip(bucket_cuts(self.pairs.h1[k], self.width), bucket_cuts(self.string_keys, self.width))):
            bits = found.get(bucket, np.zeros(0, bool))
            if len(bits):
                gone[k[i:j]], shared[x:y] = bits[: j - i], bits[j - i :]
        other = gone[self.pairs.of] if len(self.start) else np.zeros(0, bool)
        self.removed |= self._inside(self.start[other], self.end[other])
        open_ = np.zeros(len(self.raw), bool)
        open_[self.strings[(shared | self.string_here)[self.string_of]]] = True
        # What only seemed to be settled is open after all.
        open_[self.at[self.asked]] |= self.maybe[self.at[self.asked]]
        open_ &= ~self.removed
        use = open_[self.at]
        at, run = self.at[use], self.run_of[use]
        change = np.append(True, (at[1:] != at[:-1] + 1) | (run[1:] != run[:-1])) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(at)) - 1
        a, b = (at[first], at[last] + self.least) if len(at) else (at, at)
        v, ids = self.run_anchor[run[first]], self.ids[self.text_of[a]]
        h1, h2 = self._hash(a, b)
        # The bucket of the anchor comes first in the order of the classes.
        step = -(-(1 << 64) // self.width)
        bounds = np.array([i * step for i in range(1, self.width)], np.uint64)
        top = np.searchsorted(bounds, v, side="right").astype(np.uint64) << np.uint64(40)
        self.passage = (a, b)
        self.passages = Classes(self.raw, a, b, top | (h1 >> np.uint64(24)), h2, ids)
        gone = self.passages.later
        self.removed[positions(a[gone], b[gone] - a[gone] - self.least + 1)] = True

    # Round 3: the passages.

    def _passage_cuts(self) -> list[tuple[int, int]]:
        cuts = np.searchsorted(self.passages.h1 >> np.uint64(40), np.arange(self.width + 1, dtype=np.uint64))
        return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))

    def ask_passages(self) -> list[bytes]:
        """The messages, and for the block itself all that the result needs beside the replies."""
        c = self.passages
        a, b = (x[c.sample] for x in self.passage)
        out = []
        for i, j in self._passage_cuts():
            n = (b[i:j] - a[i:j]).astype(np.uint32)
            out.append(np.uint32(j - i).tobytes() + n.tobytes() + c.lead[i:j].tobytes() + self.raw[positions(a[i:j], n)].tobytes() if j > i else b"")
        rows = np.stack([*self.passage, c.of]).astype(np.uint32)
        return [*out, np.array([rows.shape[1], len(c.sample)], np.uint32).tobytes() + rows.tobytes() + c.sample.astype(np.uint32).tobytes() + np.packbits(self.removed).tobytes()]


def removed_strings(notes: bytes, bits: np.ndarray, size: int, least: int) -> np.ndarray:
    """Which strings of a block of ``size`` bytes go.  bits: for every string of every class of passages, whether a smaller id has it elsewhere."""
    m, k = np.frombuffer(notes, np.uint32, 2).tolist()
    a, b, of = np.frombuffer(notes, np.uint32, 3 * m, 8).astype(np.int64).reshape(3, m)
    sample = np.frombuffer(notes, np.uint32, k, 8 + 12 * m)
    out = np.unpackbits(np.frombuffer(notes, np.uint8, offset=8 + 12 * m + 4 * k), count=size).astype(bool)
    n = b - a - least + 1
    per_class = n[sample]
    begin = np.cumsum(per_class) - per_class
    out[positions(a, n)[bits[positions(begin[of], n)]]] = True
    return out


def cut_out(raw: np.ndarray, sizes: np.ndarray, removed: np.ndarray, least: int):
    """Per text: removed bytes, removed spans, what is left; removed: the strings that go, by their first byte."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    step = removed.astype(np.int8)
    step[least:] -= removed[: len(raw) - least] if len(raw) > least else step[least:]
    gone = np.cumsum(step, dtype=np.int32) > 0
    before = np.append(False, gone[:-1]) if len(gone) else gone
    before[starts[sizes > 0]] = False
    total, spans = (np.append(0, np.cumsum(x, dtype=np.int32)) for x in (gone, gone & ~before))
    keep = raw[~gone].tobytes()
    places = zip((starts - total[starts]).tolist(), (ends - total[ends]).tolist())
    return total[ends] - total[starts], spans[ends] - spans[starts], [keep[a:b] for a, b in places]


def packed_bits(found: list[np.ndarray]) -> list[tuple[int, bytes]]:
    return [(len(f), np.packbits(f).tobytes()) for f in found]


def met_elsewhere(marks: list[np.ndarray]) -> np.ndarray:
    """For the marks of every block, one after the other: whether another block has the mark."""
    every = np.concatenate(marks) if marks else np.zeros(0, np.uint32)
    order = np.argsort(every)
    every = every[order]
    begin = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(every)))
    out = np.zeros(len(every), bool)
    out[order] = np.repeat(count > 1, count)
    return out


def solve_hashes(blobs: list[bytes]) -> list[tuple[int, bytes]]:
    n = [int(np.frombuffer(b[:4], np.uint32)[0]) for b in blobs]
    e = np.concatenate([np.frombuffer(b, PAIR, k, 4) for b, k in zip(blobs, n)])
    marks = [np.frombuffer(b, np.uint32, offset=4 + 20 * k) for b, k in zip(blobs, n)]
    order, begin = group([e["a"], e["b"]])
    shared, gone = np.zeros(len(e), bool), np.zeros(len(e), bool)
    if len(e):
        count = np.diff(np.append(begin, len(e)))
        low = np.minimum.reduceat(e["id"][order], begin)
        shared[order], gone[order] = np.repeat(count > 1, count), e["id"][order] > np.repeat(low, count)
    cuts = np.cumsum(n)[:-1]
    anchors = np.split(met_elsewhere(marks), np.cumsum([len(m) for m in marks])[:-1])
    return packed_bits([np.concatenate(x) for x in zip(np.split(shared, cuts), np.split(gone, cuts), anchors)])


def solve_bytes(blobs: list[bytes]) -> list[tuple[int, bytes]]:
    low: dict[bytes, int] = {}
    items, marks = [], []
    for blob in blobs:
        k = int(np.frombuffer(blob[:4], np.uint32)[0])
        ends = np.append(0, np.cumsum(np.frombuffer(blob, np.uint32, k, 4), dtype=np.int64)) + 4 + 12 * k
        ids, at = np.frombuffer(blob, np.int64, k, 4 + 4 * k).tolist(), ends.tolist()
        texts = [blob[x:y] for x, y in zip(at[:-1], at[1:])]
        for text, i in zip(texts, ids):
            if low.setdefault(text, i) > i:
                low[text] = i
        items.append((texts, ids))
        marks.append(np.frombuffer(blob[at[-1] :], np.uint32))
    strings = np.split(met_elsewhere(marks), np.cumsum([len(m) for m in marks])[:-1])
    return packed_bits([np.concatenate([np.array([low[t] < i for t, i in zip(*x)], bool), y]) for x, y in zip(items, strings)])


def repeated_strings(blobs: list[bytes], least: int) -> list[np.ndarray]:
    """Per blob, a bit for every string of its passages: whether a smaller id has the string."""
    sizes, ids, bodies, counts = [], [], [], []
    for blob in blobs:
        k = int(np.frombuffer(blob[:4], np.uint32)[0])
        n = np.frombuffer(blob[4 : 4 + 4 * k], np.uint32).astype(np.int64)
        sizes.append(n)
        ids.append(np.frombuffer(blob[4 + 4 * k : 4 + 12 * k], np.int64))
        bodies.append(np.frombuffer(blob[4 + 12 * k :], np.uint8))
        counts.append(int((n - least + 1).sum()))
    raw, sizes, ids = np.concatenate(bodies), np.concatenate(sizes), np.concatenate(ids)
    # Equal passages stand in the transform once.
    offsets = np.append(0, np.cumsum(sizes))
    bytes_ = raw.tobytes()
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(bytes_[a:b], len(number)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64)
    lengths = np.array([len(k) for k in number], np.int64)
    once = np.frombuffer(b"".join(number), np.uint8)
    string = classes(once, lengths, least)
    string = string[string >= 0]
    per = lengths - least + 1
    begin = np.cumsum(per) - per
    flat = string[positions(begin[of], per[of])]
    owner = np.repeat(ids, per[of])
    low = np.full(int(string.max()) + 1, LAST, np.int64)
    np.minimum.at(low, flat, owner)
    return np.split(low[flat] < owner, np.cumsum(counts)[:-1])


ASK = (Block.ask_hashes, Block.ask_bytes, Block.ask_passages)
TAKE = (Block.take_hashes, Block.take_bytes)


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256."""
    if least <= GRAM:
        raise ValueError(f"least must be over {GRAM}")
    docs = pick(df, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    blocks = TextBlocks(docs, block, Scratch(df.sparkSession, "substrings"))
    width = blocks.width

    bits = lambda r: np.unpackbits(np.frombuffer(r["data"], np.uint8), count=r["n"]).astype(bool)

    def messages(row, k):
        ids, _, sizes, raw = unpacked(row)
        b = Block(raw, sizes, ids, least, width)
        for j in range(k):
            TAKE[j](b, {r["bucket"]: bits(r) for r in replies(row, j)})
        return ASK[k](b)

    for k, solve in enumerate((solve_hashes, solve_bytes, lambda blobs: packed_bits(repeated_strings(blobs, least)))):
        blocks.ask(lambda row, k=k: messages(row, k), solve)

    def final(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, null, sizes, raw = unpacked(row)
                *found, notes = replies(row, 2)
                gone = removed_strings(notes["data"], np.concatenate([np.zeros(0, bool), *map(bits, found)]), len(raw), least)
                removed, spans, kept = cut_out(raw, sizes, gone, least)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = blocks.rows.mapInArrow(final, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
