"""Count-Sketch and hashed weights as tables of cells; an absent cell is 0.

Sketch: (r, b, w) or, with classes, (r, b, class, w).  Hashed weights: (b, class, w)
or (b, w).  Updates are additive, so partial sketches merge by summation, and an
update is aggregated per feature before it is spread over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import SketchConfig
from ..functions.hashing import bucket, cells, key_of
from ..functions.link import median_of


def feature_kind(df: DataFrame) -> str:
    return "string" if df.schema["feature"].dataType.simpleString() == "string" else "int"


def with_cells(df: DataFrame, cfg: SketchConfig) -> DataFrame:
    """One row per feature row and sketch row: adds r, b, sg."""
    key = key_of(F.col("feature"), feature_kind(df), cfg)
    return df.where("feature IS NOT NULL").withColumn("cell", F.explode(cells(key, cfg))).select(*df.columns, "cell.r", "cell.b", "cell.sg")


def build(deltas: DataFrame, cfg: SketchConfig, classes: bool = False, summed: bool = False) -> DataFrame:
    """deltas: feature[, class], delta.  The sketch of their sum; ``summed``: a feature (and class) has one row already."""
    by = ["class"] if classes else []
    per_feature = deltas if summed else deltas.groupBy("feature", *by).agg(F.sum("delta").alias("delta"))
    return with_cells(per_feature, cfg).groupBy("r", "b", *by).agg(F.sum(F.col("sg") * F.col("delta")).alias("w"))


def merge(*sketches: DataFrame) -> DataFrame:
    """The sum of sketches (or hashed tables) of one shape."""
    whole = sketches[0]
    for s in sketches[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy(*[c for c in whole.columns if c != "w"]).agg(F.sum("w").alias("w"))


def estimate(features: DataFrame, sketch: DataFrame, cfg: SketchConfig) -> DataFrame:
    """features: feature (distinct).  feature, w: the median over rows of the signed cells."""
    hit = with_cells(features.select("feature"), cfg).join(sketch, ["r", "b"], "left")
    rows = [F.coalesce(F.max(F.when(F.col("r") == i, F.col("sg") * F.col("w"))), F.lit(0.0)) for i in range(cfg.n_rows)]
    return _median(hit.groupBy("feature"), rows, ["feature"])


def estimate_classes(features: DataFrame, sketch: DataFrame, cfg: SketchConfig) -> DataFrame:
    """feature, class, w for every class that has a cell of the feature; the others are 0."""
    hit = with_cells(features.select("feature"), cfg).join(sketch, ["r", "b"])
    rows = [F.coalesce(F.max(F.when(F.col("r") == i, F.col("sg") * F.col("w"))), F.lit(0.0)) for i in range(cfg.n_rows)]
    return _median(hit.groupBy("feature", "class"), rows, ["feature", "class"])


def estimate_class(features: DataFrame, sketch: DataFrame, cfg: SketchConfig, cls: int) -> DataFrame:
    """feature, w of one class of a multi-class sketch; only its cells are read."""
    return estimate(features, sketch.where(F.col("class") == cls).select("r", "b", "w"), cfg)


def _median(grouped, rows, keys) -> DataFrame:
    wide = grouped.agg(*[v.alias(f"v{i}") for i, v in enumerate(rows)])
    return wide.select(*keys, median_of([F.col(f"v{i}") for i in range(len(rows))]).alias("w"))


def feature_bucket(df: DataFrame, cfg: SketchConfig) -> DataFrame:
    """Adds b, the bucket of a feature in the hashed table (first seed, no sign)."""
    return df.where("feature IS NOT NULL").withColumn("b", bucket(key_of(F.col("feature"), feature_kind(df), cfg), cfg.seeds[0], cfg.n_buckets))


def hashed_build(deltas: DataFrame, cfg: SketchConfig, classes: bool = False, summed: bool = False) -> DataFrame:
    by = ["class"] if classes else []
    per_feature = deltas if summed else deltas.groupBy("feature", *by).agg(F.sum("delta").alias("delta"))
    return feature_bucket(per_feature, cfg).groupBy("b", *by).agg(F.sum("delta").alias("w"))


def hashed_put(puts: DataFrame, cfg: SketchConfig) -> DataFrame:
    """puts: feature, value, seq.  The cell keeps the value of the largest seq."""
    return feature_bucket(puts, cfg).groupBy("b").agg(F.max_by("value", "seq").alias("w"))


def hashed_get(features: DataFrame, table: DataFrame, cfg: SketchConfig) -> DataFrame:
    return feature_bucket(features.select("feature"), cfg).join(table, "b", "left").select("feature", F.coalesce("w", F.lit(0.0)).alias("w"))
