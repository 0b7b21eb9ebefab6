"""Models as Parquet tables with their configuration beside them, and prediction sinks."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import SketchConfig


def save(path: str, cfg: SketchConfig, **tables: DataFrame) -> None:
    """Writes the tables (sketch, topk, hashed, ...) and the configuration."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(dataclasses.asdict(cfg)),)], "config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")


def load(spark: SparkSession, path: str, cfg: SketchConfig | None, *names: str) -> dict[str, DataFrame]:
    """The named tables; fails if they were written under another shape than that of ``cfg``."""
    saved = json.loads(spark.read.parquet(f"{path}/config").first()[0])
    if cfg is not None:
        for key in ("n_rows", "n_buckets", "n_classes", "key_len", "seeds"):
            ours = getattr(cfg, key)
            if saved[key] != (list(ours) if isinstance(ours, tuple) else ours):
                raise ValueError(f"the model at {path} has {key} = {saved[key]}, not {ours}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_predictions(predictions: DataFrame, path: str, epoch: int) -> None:
    """One partition per epoch: example_id, label, prediction or p."""
    predictions.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)


def prediction_lines(predictions: DataFrame, score: str) -> DataFrame:
    """The text form ``label score``, in example order within a partition."""
    return predictions.sortWithinPartitions("example_id").select(F.concat_ws(" ", "label", score).alias("value"))
