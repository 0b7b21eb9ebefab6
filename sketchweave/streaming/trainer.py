"""Structured Streaming training: a batch step per micro-batch on versioned state.

The state after micro-batch n is a folder ``version=n``; a batch that is run
again after a failure starts from the version before it and overwrites its own,
so every batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.config import SketchConfig
from ..operators.batch import State, logistic_step
from ..sources import model_io


class StreamTrainer:
    """``batch_files``: most files that a micro-batch takes, the capacity of the queue before the trainer (see ``source``)."""

    def __init__(self, path: str, cfg: SketchConfig, step: Callable[..., State] = logistic_step, batch_files: int = 1000):
        self.path, self.cfg, self.step, self.batch_files = path.rstrip("/"), cfg, step, batch_files

    def _at(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def state(self, spark: SparkSession, version: int) -> State:
        """The state after a micro-batch; the empty one before the first."""
        if version < 0:
            return State()
        t = model_io.load(spark, self._at(version), self.cfg, "sketch", "model")
        return State(t["sketch"], t["model"])

    def source(self, spark: SparkSession, schema: str, path: str) -> DataFrame:
        """A stream of example rows in Parquet files, the oldest first, ``batch_files`` at a time."""
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", self.batch_files).parquet(path)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty() and batch_id > 0:
            now = self.state(spark, batch_id - 1)
        else:

            def keep(table, name):
                # The model is derived from the sketch as written, not from the batch again.
                table.write.mode("overwrite").parquet(f"{self._at(batch_id)}/{name}")
                return spark.read.schema(table.schema).parquet(f"{self._at(batch_id)}/{name}")

            now = self.step(batch, self.state(spark, batch_id - 1), self.cfg, keep=keep)
            model_io.save(self._at(batch_id), self.cfg, model=now.model)
            return
        model_io.save(self._at(batch_id), self.cfg, sketch=now.sketch, model=now.model)

    def run(self, stream: DataFrame, checkpoint: str):
        """stream: example rows in long form.  Trains on all that is there and returns the query."""
        query = stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
