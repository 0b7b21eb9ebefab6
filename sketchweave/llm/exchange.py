"""Questions from blocks of texts to hash buckets, and the replies.

Texts are packed into blocks that are written once, bucketed by block.  A round
asks: every block sends each hash bucket one packed message, the bucket's task
sees the messages of all blocks together and replies to each of them, and the
replies are gathered per block.  As the blocks are bucketed, only messages and
replies are shuffled, never the texts; and as a block derives its messages anew
from its texts and the replies so far, in a fixed order, neither carries numbers.

A hash bucket is a range of 64-bit hashes; there are as many as shuffle
partitions, each dealt to a partition of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width
from .ragged import slices, utf8

#: What a null id is packed as; the mask beside the ids tells it from a real one.
LAST = np.iinfo(np.int64).max
#: Row numbers of a scan task, and blocks of one.
ROWS, BLOCKS = 40, 24


def packed(docs: DataFrame, size: int) -> DataFrame:
    """docs: id, text.  One row per block of about ``size`` bytes: block, first (number of its first row), ids, null, sizes, text."""

    def run(batches):
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        number, first = task << BLOCKS, task << ROWS
        for batch in batches:
            for a, b in slices(batch.column(1), size):
                part = batch.slice(a, b - a)
                raw, offsets = utf8(part.column(1))
                ids = np.asarray(part.column(0).fill_null(LAST)).astype(np.int64)
                null = np.asarray(part.column(0).is_null())
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([first], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, null, np.diff(offsets), raw)]], names=["block", "first", "ids", "null", "sizes", "text"])
                number += 1
                first += b - a

    return docs.mapInArrow(run, "block long, first long, ids binary, null binary, sizes binary, text binary")


def unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, null mask, text sizes and bytes of a block."""
    return tuple(np.frombuffer(row[k], t) for k, t in (("ids", np.int64), ("null", bool), ("sizes", np.int64), ("text", np.uint8)))


def bucket_cuts(keys: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(start, stop) in sorted 64-bit keys of each of ``width`` equal ranges of hashes."""
    step = -(-(1 << 64) // width)
    at = np.searchsorted(keys, np.array([i * step for i in range(1, width)], np.uint64)).tolist()
    return list(zip([0, *at], [*at, len(keys)]))


def replies(row, k: int) -> list[dict]:
    """The replies of round ``k`` to a block: bucket, n (items), data; by bucket."""
    return sorted(row[f"r{k}"] or [], key=lambda r: r["bucket"])


class TextBlocks:
    """The blocks of a table's texts, with the replies of every round so far in columns r0, r1, ..."""

    def __init__(self, docs: DataFrame, size: int, scratch: Scratch):
        spark, name = docs.sparkSession, f"blocks_{uuid.uuid4().hex[:12]}"
        self.scratch, self.width, self.rounds = scratch, shuffle_width(spark), 0
        writer = packed(docs, size).repartition(self.width, "block").write.option("path", scratch.new("blocks")).option("compression", "zstd")
        writer.bucketBy(self.width, "block").saveAsTable(name)
        self.rows = spark.table(name)
        # The scan is resolved; the catalogue needs no entry of it any more, and the files stay.
        spark.sql(f"DROP TABLE {name}")

    def ask(self, messages: Callable, solve: Callable) -> None:
        """messages(row): a blob per bucket, empty for none, and one more if the block has notes for itself,
        which come back as the reply of bucket ``width``.  solve(blobs of one bucket): (n, reply) for each of them."""
        width = self.width

        def send(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    # Notes lie beside the buckets, dealt by block.
                    out = [(i if i < width else width + row["block"] % width, blob) for i, blob in enumerate(messages(row)) if blob]
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([row["block"]] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "block", "blob"])

        def answer(batches):
            def solved(bucket, held):
                found = solve([x for _, x in held]) if bucket < width else [(0, x) for _, x in held]
                return pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([min(bucket, width)] * len(held), pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["block", "bucket", "n", "data"])

            now, held = None, []
            for batch in batches:
                for bucket, block, blob in zip(*[c.to_pylist() for c in batch.columns]):
                    if bucket != now and held:
                        yield solved(now, held)
                        held = []
                    now = bucket
                    held.append((block, blob))
            if held:
                yield solved(now, held)

        dealt = self.rows.mapInArrow(send, "bucket long, block long, blob binary").repartitionById(self.width, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
        found = self.scratch.table(dealt.mapInArrow(answer, "block long, bucket long, n long, data binary"), f"replies-{self.rounds}")
        gathered = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "data")).alias(f"r{self.rounds}"))
        self.rows = self.rows.join(gathered.hint("shuffle_hash"), "block", "left")
        self.rounds += 1
