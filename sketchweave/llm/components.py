"""Connected components by alternating large-star and small-star steps on an edge table.

Minima are pre-aggregated before every shuffle and stored before they are joined
back, so that the join reads plain shuffles on both sides and adaptive execution
can split a hub's edges over tasks.  Every round is a table in shared storage;
the one before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, delete

ROUNDS = 60


def _star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "large-star")
    large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    large = scratch.table(large, "large-edges")
    low = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), "small-star")
    small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """edges: a, b (no nulls).  One row per node of an edge: node, component (its smallest node)."""
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "components")
    last, path = None, scratch.new("components")
    edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct().write.parquet(f"{path}/0")
    now = spark.read.parquet(f"{path}/0")
    for i in range(1, ROUNDS + 1):
        sign = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if sign == last:
            break
        last = sign
        if not sign[0]:
            break
        step = Scratch(spark, "star")
        _star(now, step).write.parquet(f"{path}/{i}")
        delete(step.path, spark)
        if i > 1:
            delete(f"{path}/{i - 1}", spark)
        now = spark.read.parquet(f"{path}/{i}")
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
