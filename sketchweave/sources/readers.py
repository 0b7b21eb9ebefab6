"""Text readers for sparse examples, and adapters from tables.

Decisions where text is malformed: tokens are split on one space, so doubled and
trailing spaces give empty tokens; the numeric reader skips empty tokens and an
optional ``|``; a label or id takes its leading integer and is 0 without one; a
value takes its leading number and is 0 without one; a last line without newline
is a record like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTEGER, NUMBER = r"^\s*([+-]?\d+)", r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def leading_int(token: Column) -> Column:
    return F.coalesce(F.regexp_extract(token, INTEGER, 1).try_cast("int"), F.lit(0))


def leading_double(token: Column) -> Column:
    return F.coalesce(F.regexp_extract(token, NUMBER, 1).try_cast("double"), F.lit(0.0))


def tokenize(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds tokens: the line split on single spaces."""
    return lines.withColumn("tokens", F.split(F.col(line), " "))


def parse_numeric(lines: DataFrame, line: str = "value") -> DataFrame:
    """``LABEL ID:VALUE ...``: label int and features array<struct<id, value>>; other columns stay."""
    t = tokenize(lines, line)
    pairs = F.filter(F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda x: (x != "") & (x != "|"))
    parsed = F.transform(pairs, lambda x: F.struct(leading_int(F.split_part(x, F.lit(":"), F.lit(1))).alias("id"), leading_double(F.split_part(x, F.lit(":"), F.lit(2))).alias("value")))
    return t.withColumn("label", leading_int(F.element_at("tokens", 1))).withColumn("features", parsed).drop("tokens", line)


def parse_string(lines: DataFrame, line: str = "value", n_classes: int | None = None) -> DataFrame:
    """``LABEL ANY F1 F2 ...``, labels from 1: label (from 0) and features array<string>; the second token is ignored.

    With ``n_classes``, a label outside 1 .. n_classes fails the query.
    """
    t = tokenize(lines, line)
    label = leading_int(F.element_at("tokens", 1)) - 1
    if n_classes is not None:
        label = F.when((label >= 0) & (label < n_classes), label).otherwise(F.raise_error(F.concat(F.lit("label outside 1 to "), F.lit(str(n_classes)), F.lit(": "), F.element_at("tokens", 1))).cast("int"))
    features = F.slice("tokens", 3, F.greatest(F.size("tokens") - 2, F.lit(0)))
    return t.withColumn("label", label).withColumn("features", features).drop("tokens", line)


def read_sparse_numeric(spark: SparkSession, path) -> DataFrame:
    return parse_numeric(spark.read.text(path))


def read_sparse_string(spark: SparkSession, path, n_classes: int | None = None) -> DataFrame:
    return parse_string(spark.read.text(path), n_classes=n_classes)


def long_form(examples: DataFrame) -> DataFrame:
    """example_id, label, feature, x: one row per feature of an example."""
    kind = examples.schema["features"].dataType.elementType.simpleString()
    rows = examples.select("example_id", "label", F.explode("features").alias("f"))
    if kind == "string":
        return rows.select("example_id", "label", F.col("f").alias("feature"), F.lit(1.0).alias("x"))
    return rows.select("example_id", "label", F.col("f.id").alias("feature"), F.col("f.value").alias("x"))


# Adapters from tables to the long form.


def event_numeric(events: DataFrame) -> DataFrame:
    """Binary examples: user and hour of an event; label 1 for errors."""
    hour = (F.hour("ts") + 1_000_000).cast("int")
    rows = events.select(F.col("event_id").alias("example_id"), (F.col("event_type") == "error").cast("int").alias("label"), F.col("user_id").cast("int").alias("user"), hour.alias("hour"))
    return rows.select("example_id", "label", F.explode(F.array("user", "hour")).alias("feature"), F.lit(1.0).alias("x"))


EVENT_CLASSES = ("click", "error", "purchase", "signup", "view")


def event_classes(events: DataFrame) -> DataFrame:
    """Multi-class examples: the same features; the label is the kind of event."""
    label = F.array_position(F.array(*[F.lit(c) for c in EVENT_CLASSES]), F.col("event_type")) - 1
    rows = events.select(F.col("event_id").alias("example_id"), label.cast("int").alias("label"), F.col("user_id").cast("int").alias("user"), (F.hour("ts") + 1_000_000).cast("int").alias("hour"))
    return rows.where("label >= 0").select("example_id", "label", F.explode(F.array("user", "hour")).alias("feature"), F.lit(1.0).alias("x"))


def document_tokens(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """Binary examples: distinct space-separated tokens of labelled documents."""
    docs = documents.join(labels.select("doc_id", F.col(label).alias("label")), "doc_id")
    rows = docs.select(F.col("doc_id").alias("example_id"), "label", F.explode(F.array_distinct(F.split("text", " "))).alias("feature"))
    return rows.where("feature <> ''").withColumn("x", F.lit(1.0))
