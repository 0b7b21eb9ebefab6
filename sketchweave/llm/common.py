"""Shared storage and small helpers for the corpus operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
every executor and the driver see.  Tables are plain Parquet, so a lost
executor costs a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is set, a local master takes a temporary one and a cluster fails."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sketchweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and return a scan of it."""
    return _written(df, new_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(path: str, spark: SparkSession) -> None:
    """Remove a folder of shared storage that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The intermediate tables of one run, under one folder of shared storage.

    ``result`` writes the outcome beside that folder and removes the folder, so a
    run leaves nothing behind but its result.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path, self.tables = spark, name, new_path(spark, name), 0

    def new(self, name: str) -> str:
        self.tables += 1
        return f"{self.path}/{self.tables:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, self.new(name))

    def result(self, df: DataFrame) -> DataFrame:
        out = materialise(df, f"{self.name}-result")
        delete(self.path, self.spark)
        return out


def fold_ascii(text):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names, so extra columns can't clash."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
