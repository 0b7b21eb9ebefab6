"""Mixing sources to target weights by systematic sampling.

Per source, documents stand in one fixed order; each is expected
``target / source size`` times.  The prefix sum of the expected copies plus one
random offset crosses an integer boundary for every copy that is emitted.  The
order runs through size classes, so that the words taken stay within about one
document of the target.

The prefix sum is hierarchical: (source, size class, slot) counts are
pre-aggregated, offsets are summed over slots within a class and over classes
within a source, and only the rows of one slot are ordered in one task.  A hot
source, or a hot size, is spread over all slots.

Only DataFrame functions are used.

Defined results: null text has size 0; a null source is a source of its own,
the last one; a row with a null id stands in the order by its size; repeated rows are separate
rows; with no words at all every target is 0; extra columns are ignored.
The number of sources is that of a mixing recipe (hundreds); all per-source
work is on that aggregated table.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick

WORD = r"[^\x20\x09-\x0D]+"
#: A prime and a multiplier for the slot of an id; both fit exact 64-bit products.
PRIME, FACTOR = 2147483647, 48271
SLOTS, ROWS_PER_SLOT = 128, 1 << 20


def offset_of(seed: int) -> float:
    """The one random offset of a mix: 20 random bits, so sums with integers are exact."""
    return random.Random(seed).getrandbits(20) / (1 << 20)


def size_class(size):
    """The bit length of the size and its next two bits: classes of a quarter octave."""
    bits = F.length(F.bin(size))
    return F.when(size == 0, 0).otherwise(bits * 4 + F.expr("shiftright(size * 4, length(bin(size)) - 1)") % 4).cast("int")


def source_targets(totals: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """totals: source, source_size.  Adds target: weights in source order, capped at ``cap`` times the size.

    Water level: a source gets ``min(cap * size, level * weight)``; the level is the
    largest of those that are consistent with the sources below it being capped.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    t = totals.withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
    t = t.withColumn("rank", F.col("most") / F.col("w"))
    by_rank = Window.orderBy("rank", F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    t = (
        t.withColumn("below", F.coalesce(F.sum("most").over(by_rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("share", F.sum("w").over(by_rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("below")) / F.col("share"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("rank"), F.col("level"))).over(whole))
    )
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("w"))
    return t.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), cap: int = 3, seed: int = 20) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, copies, taken."""
    docs = pick(df, id=id_col, text=text_col, source=source_col)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select("id", "source", size.alias("size"))
    base = base.withColumn("key", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("v"), "source")))
    scratch = Scratch(df.sparkSession, "mix")
    base = scratch.table(base.withColumn("cls", size_class(F.col("size"))), "sizes")
    slots = max(SLOTS, base.count() // ROWS_PER_SLOT)
    scrambled = F.pmod(F.pmod(F.coalesce("id", "size"), F.lit(PRIME)) * FACTOR, F.lit(PRIME)) % slots
    base = base.withColumn("slot", scrambled)

    groups = scratch.table(base.groupBy("key", "cls", "slot").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words")), "groups")
    classes = groups.groupBy("key", "cls").agg(F.first("source").alias("source"), F.sum("n").alias("n"), F.sum("words").alias("words"))
    totals = classes.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(totals.select("source", "source_size"), weights, cap)
    targets = targets.withColumn("key", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("v"), "source"))).drop("source")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    in_source = before(Window.partitionBy("key").orderBy("cls"))
    in_class = before(Window.partitionBy("key", "cls").orderBy("slot"))
    classes = classes.select("key", "cls", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("class_offset"))
    plan = (
        groups.select("key", "cls", "slot", F.coalesce(F.sum("n").over(in_class), F.lit(0)).alias("slot_offset"))
        .join(classes, ["key", "cls"])
        .join(targets, "key")
        .select("key", "cls", "slot", (F.col("class_offset") + F.col("slot_offset")).alias("offset"), "source_size", "target")
    )
    row = F.row_number().over(Window.partitionBy("key", "cls", "slot").orderBy("size", "id"))
    placed = base.withColumn("row", row).join(plan, ["key", "cls", "slot"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    index = F.col("offset") + F.col("row")
    u = F.lit(offset_of(seed))
    copies = F.least(F.floor(u + F.col("rate") * index) - F.floor(u + F.col("rate") * (index - 1)), F.ceil("rate"))
    return scratch.result(
        placed.withColumn("rate", rate)
        .withColumn("copies", copies.cast("long"))
        .select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
