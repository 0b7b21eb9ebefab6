"""Packing examples into fixed-length sequences by vector bin packing.

A sequence is a bin with simultaneous limits on tokens, on segments and on
loss-bearing tokens.  Bins are filled one at a time: of the waiting examples
that fit, the one with the largest dot product of its sizes with the bin's
remaining capacity (each as a share of the limit) is placed next.

Each scan task packs what it reads, in windows of a bounded number of tokens,
so nothing is shuffled; a task that is run again gives the same sequences.

Defined results: a null text is empty and still has its end token; a null id is
carried as null; repeated rows are separate examples; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import pick
from .ragged import slices

TOKENS, SEGMENTS = 2048, 512
#: Tokens that a task holds and packs at a time, and bytes of text that it encodes at a time.
WINDOW, SLICE = 4_000_000, 8 << 20

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill_bins(sizes: np.ndarray, limits: np.ndarray, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Bins of (example, start, tokens).  sizes: tokens, segments, loss tokens of each example.

    With ``cut``, an example may be cut where a bin ends; then all its tokens bear
    loss or none does.  Examples over a limit must not occur.
    """
    if not len(sizes):
        return []
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)
    order = np.argsort(kind_of.ravel(), kind="stable")[::-1]
    waiting: list[list[tuple[int, int]]] = [[] for _ in kinds]
    for i in order.tolist():
        waiting[kind_of.ravel()[i]].append((i, 0))
    known = {tuple(k): n for n, k in enumerate(kinds.tolist())}
    kinds, count = kinds.astype(np.float64), np.array([len(w) for w in waiting])
    share, bins, left = kinds / limits, [], len(sizes)
    while left:
        room, now = limits.astype(np.float64), []
        while left and room[1] >= 1 and room[0] >= 1:
            score = np.where((kinds <= room).all(axis=1) & (count > 0), share @ (room / limits), -1.0)
            best = int(score.argmax())
            if score[best] < 0:
                if not cut:
                    break
                score = np.where((count > 0) & (np.minimum(kinds[:, 0], room[0]) * (kinds[:, 2] > 0) <= room[2]), share @ (room / limits), -1.0)
                best = int(score.argmax())
                if score[best] < 0:
                    break
                part = int(room[0])
                i, start = waiting[best].pop()
                count[best] -= 1
                now.append((i, start, part))
                rest = [int(kinds[best, 0]) - part, 1, int(kinds[best, 0]) - part if kinds[best, 2] else 0]
                if tuple(rest) not in known:
                    known[tuple(rest)] = len(kinds)
                    kinds, share = np.vstack([kinds, rest]), np.vstack([share, np.array(rest) / limits])
                    count = np.append(count, 0)
                    waiting.append([])
                waiting[known[tuple(rest)]].append((i, start + part))
                count[known[tuple(rest)]] += 1
                break
            i, start = waiting[best].pop()
            count[best] -= 1
            left -= 1
            now.append((i, start, int(kinds[best, 0])))
            room -= kinds[best]
        bins.append(now)
    return bins


def powers_of_two(bin_: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A bin cut into sequences whose lengths are powers of two: the bits of its length."""
    total = sum(n for _, _, n in bin_)
    out, queue = [], list(bin_)
    for bit in reversed(range(total.bit_length())):
        need, part = (total >> bit & 1) << bit, []
        while need:
            i, start, n = queue.pop(0)
            part.append((i, start, min(n, need)))
            if n > need:
                queue.insert(0, (i, start + need, n - need))
            need -= part[-1][2]
        if part:
            out.append(part)
    return out


def pack_lengths(lengths: np.ndarray, tokens: int, segments: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of documents that may be cut freely and bear loss on every token."""
    out = [[(i, k * tokens, tokens)] for i in np.flatnonzero(lengths >= tokens).tolist() for k in range(int(lengths[i]) // tokens)]
    rest = lengths % tokens
    rows = np.flatnonzero(rest)
    sizes = np.stack([rest[rows], np.ones(len(rows), np.int64), rest[rows]], axis=1)
    bins = fill_bins(sizes, np.array([tokens, segments, tokens]), cut=True)
    whole = lengths - rest
    bins = [[(int(rows[i]), int(whole[rows[i]]) + start, n) for i, start, n in b] for b in bins]
    full = lambda b: (n := sum(x for _, _, x in b)) == tokens or n & (n - 1) == 0
    for b in bins:
        out += [b] if full(b) else powers_of_two(b)
    return out


def pack_documents(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tokens: int = TOKENS, segments: int = SEGMENTS, window: int = WINDOW) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ids are those of the tokenizer without special tokens, then ``end_id``.
    """
    docs = pick(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, context = bpe.load(tokenizer_file), TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        held_ids, held, size = [], [], 0

        def flush():
            nonlocal sequence, held_ids, held, size
            ids, lengths = (np.concatenate(x) for x in zip(*held))
            names = pa.concat_arrays(held_ids)
            first = np.cumsum(lengths) - lengths
            rows = []
            for seq in pack_lengths(lengths, tokens, segments):
                at = 0
                for i, start, n in seq:
                    flat = ids[first[i] + start : first[i] + start + n]
                    rows.append((i, start, n, zlib.crc32(flat.astype("<u4").tobytes()), int(lengths[i]), sequence, at))
                    at += n
                sequence += 1
            held_ids, held, size = [], [], 0
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(cols[0])), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                flat, counts = coder.encode(batch.column(1).slice(a, b - a))
                ends = np.cumsum(counts)
                ids = np.insert(flat, ends, end_id).astype(np.uint32)
                held.append((ids, counts + 1))
                held_ids.append(batch.column(0).slice(a, b - a))
                size += len(ids)
                if size >= window:
                    yield from flush()
        if held:
            yield from flush()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, {PIECES}").withColumnRenamed("id", id_col)


def conversation_examples(turns: DataFrame, tokenizer_file: str, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant", end_id: int = 1) -> DataFrame:
    """Per conversation: id, tokens (each turn's and an end token), loss_tokens (those of ``loss_role``'s turns).

    A null text is empty, a turn without a role bears no loss, and turns without an id are one conversation.
    """
    rows = pick(turns, id=id_col, role=role_col, text=text_col).selectExpr("id", f"coalesce(role = '{loss_role}', false) AS loss", "text")

    def run(batches):
        coder = bpe.load(tokenizer_file)
        for batch in batches:
            for a, b in slices(batch.column(2), SLICE):
                part = batch.slice(a, b - a)
                n = coder.encode(part.column(2))[1] + 1
                loss = np.asarray(part.column(1).to_numpy(zero_copy_only=False), bool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(np.where(loss, n, 0), pa.int64())], names=["id", "tokens", "loss_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {kind}, tokens long, loss_tokens long")
    return counted.groupBy("id").agg(F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens")).withColumnRenamed("id", id_col)


def pack_examples(df: DataFrame, id_col: str, tokens_col: str, loss_col: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS, window: int = 100_000) -> DataFrame:
    """Instruction examples, never cut, under all three limits: id, sequence_id, offset, tokens, loss_tokens.

    An example over a limit by itself gets a sequence of its own; one without
    tokens takes a segment; null counts are 0.
    """
    rows = pick(df, id=id_col, tokens=tokens_col, loss=loss_col).selectExpr("id", "coalesce(cast(tokens as long), 0) tokens", "coalesce(cast(loss as long), 0) loss")

    def run(batches):
        context = TaskContext.get()
        sequence, held = (context.partitionId() if context else 0) << 32, []

        def flush():
            nonlocal sequence, held
            t = pa.Table.from_batches(held)
            held = []
            n, m = np.asarray(t["tokens"]), np.asarray(t["loss"])
            sizes = np.stack([n, np.ones_like(n), m], axis=1)
            over = (sizes > np.array([tokens, segments, loss])).any(axis=1)
            ok = np.flatnonzero(~over)
            bins = [[(int(ok[i]), s, k) for i, s, k in b] for b in fill_bins(sizes[ok], np.array([tokens, segments, loss]), cut=False)]
            out = []
            for b in bins + [[(int(i), 0, int(n[i]))] for i in np.flatnonzero(over)]:
                at = 0
                for i, _, k in b:
                    out.append((i, sequence, at, k, int(m[i])))
                    at += k
                sequence += 1
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks().take(pa.array(cols[0])), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["id", "sequence_id", "offset", "tokens", "loss_tokens"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= window:
                yield from flush()
        if held:
            yield from flush()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, sequence_id long, offset long, tokens long, loss_tokens long").withColumnRenamed("id", id_col)
