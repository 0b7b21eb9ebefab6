"""Where models and streams of the registered queries are kept."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is set, a local master takes a temporary one and a cluster fails."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sketchweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keeper(spark: SparkSession):
    """A ``keep`` for training steps: writes a table under the shared folder and returns a scan of it."""
    path = f"{scratch(spark)}/steps-{uuid.uuid4().hex[:12]}"
    count = itertools.count()

    def keep(table, name):
        at = f"{path}/{next(count):04d}-{name}"
        table.write.parquet(at)
        return spark.read.schema(table.schema).parquet(at)

    return keep
