"""Synchronous mini-batch training and prediction, in DataFrame operations only.

All gradients of a batch use the model at its start and their deltas are summed,
so a step does not depend on partitioning or on the order of rows.  Examples are
in long form: example_id, label, feature, x.  Models: logistic (feature, w);
fine (class, feature, w); coarse (feature, w = L1 norm).

A step is lazy: its sketch and model are plans over the ones before.  ``keep``
(a function of a table and its name) may write what a step uses several times,
the summed deltas and the new sketch, so that nothing is computed twice and plans
don't grow with the number of steps.

With many classes, a table row per feature holds the numbers of all classes as an
array, so that joins and sums handle one row for a feature of an example and not
one for every class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import link
from ..functions.config import SketchConfig
from . import sketch as sk
from . import topk as tk


@dataclass
class State:
    """What a step reads and returns; None stands for all zeros."""

    sketch: DataFrame | None = None
    model: DataFrame | None = None


def empty_model(examples: DataFrame, classes: bool = False) -> DataFrame:
    kind = examples.schema["feature"].dataType.simpleString()
    return examples.sparkSession.createDataFrame([], f"feature {kind}, w double" if not classes else f"class int, feature {kind}, w double")


def lazy(table: DataFrame, _: str) -> DataFrame:
    return table


def _add(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else sk.merge(old, new)


# Logistic regression


def logistic_scores(examples: DataFrame, model: DataFrame | None) -> DataFrame:
    """example_id, label, z, p."""
    weighed = examples.withColumn("w", F.lit(0.0)) if model is None else tk.lookup(examples, model)
    z = weighed.groupBy("example_id", "label").agg(F.sum(F.col("w") * F.col("x")).alias("z"))
    return z.withColumn("p", link.sigmoid(F.col("z")))


def logistic_step(examples: DataFrame, state: State, cfg: SketchConfig, refresh: str = "touched", keep=lazy) -> State:
    """One batch: sketch update, then the top k of the batch's features and the model's.

    ``refresh``: whether model features outside the batch keep their weight
    ("touched") or are estimated anew ("all").
    """
    if state.model is None:
        residual = examples.withColumn("g", F.col("label") - F.lit(0.5))
    else:
        scores = logistic_scores(examples, state.model).select("example_id", (F.col("label") - F.col("p")).alias("g"))
        residual = examples.join(scores, "example_id")
    deltas = keep(residual.groupBy("feature").agg((F.sum(F.col("g") * F.col("x")) * cfg.lr).alias("delta")), "deltas")
    sketch = keep(_add(state.sketch, sk.build(deltas, cfg, summed=True)), "sketch")
    touched = deltas.select("feature")
    if state.model is None:
        weights = sk.estimate(touched, sketch, cfg)
    elif refresh == "all":
        weights = sk.estimate(tk.active_set(touched, state.model), sketch, cfg)
    else:
        kept = state.model.join(touched, "feature", "left_anti")
        weights = sk.estimate(touched, sketch, cfg).unionByName(kept.select("feature", "w"))
    return State(sketch, tk.global_topk(weights, cfg.k))


def predict_logistic(examples: DataFrame, model: DataFrame) -> DataFrame:
    return logistic_scores(examples, model).select("example_id", "label", "p")


# Multi-class: logits as (example_id, label, z array) over all classes


def class_columns(n_classes: int, value) -> list:
    """One column per class from ``value(class)``."""
    return [value(c).alias(f"z{c}") for c in range(n_classes)]


def class_arrays(weights: DataFrame, key: str, n_classes: int) -> DataFrame:
    """weights: key, class, w.  key, ws: the weights of all classes as an array, 0 where there is none."""
    wide = weights.groupBy(key).agg(*class_columns(n_classes, lambda c: F.max(F.when(F.col("class") == c, F.col("w")))))
    return wide.select(key, F.array(*[F.coalesce(f"z{c}", F.lit(0.0)) for c in range(n_classes)]).alias("ws"))


def logits(examples: DataFrame, weights: DataFrame, n_classes: int, key: str = "feature") -> DataFrame:
    """examples with a column ``key``; weights: key, class, w.  example_id, label, z (array over classes, 0 where nothing contributes)."""
    hit = examples.join(class_arrays(weights, key, n_classes), key, "left")
    z = hit.groupBy("example_id", "label").agg(*class_columns(n_classes, lambda c: F.sum(F.col("ws")[c] * F.col("x"))))
    return z.select("example_id", "label", F.array(*[F.coalesce(f"z{c}", F.lit(0.0)) for c in range(n_classes)]).alias("z"))


def class_deltas(examples: DataFrame, scores: DataFrame, cfg: SketchConfig) -> DataFrame:
    """feature, class, delta, summed over the batch: by feature as arrays, and only then a row per class."""
    gradient = scores.select("example_id", link.softmax_gradient(link.softmax(F.col("z")), F.col("label")).alias("g"))
    hit = examples.select("example_id", "feature", "x").join(gradient, "example_id")
    wide = hit.groupBy("feature").agg(*class_columns(cfg.n_classes, lambda c: F.sum(F.col("g")[c] * F.col("x")) * -cfg.lr))
    return wide.select("feature", F.posexplode(F.array(*[f"z{c}" for c in range(cfg.n_classes)])).alias("class", "delta"))


def zero_scores(examples: DataFrame, n_classes: int) -> DataFrame:
    return examples.select("example_id", "label").distinct().withColumn("z", F.array(*[F.lit(0.0)] * n_classes))


def predictions(scores: DataFrame) -> DataFrame:
    """Logits are compared at DIGITS decimals, so that the last bits of a sum decide nothing."""
    z = F.transform("z", lambda x: F.round(x, tk.DIGITS))
    return scores.select("example_id", "label", link.argmax_floor(z).alias("prediction"))


def losses(scores: DataFrame) -> DataFrame:
    """example_id, loss: log probability of the label."""
    return scores.select("example_id", link.cross_entropy(link.softmax(F.col("z")), F.col("label")).alias("loss"))


# Feature hashing


def hashed_scores(examples: DataFrame, table: DataFrame | None, cfg: SketchConfig) -> DataFrame:
    if table is None:
        return zero_scores(examples, cfg.n_classes)
    return logits(sk.feature_bucket(examples, cfg), table, cfg.n_classes, key="b")


def hashed_step(examples: DataFrame, table: DataFrame | None, cfg: SketchConfig, keep=lazy) -> DataFrame:
    deltas = class_deltas(examples, hashed_scores(examples, table, cfg), cfg)
    return keep(_add(table, sk.hashed_build(deltas, cfg, classes=True, summed=True)), "hashed")


# Fine: one top-k table per class, thresholded training scores


def fine_scores(examples: DataFrame, state: State, cfg: SketchConfig) -> DataFrame:
    """Training scores: sketch estimates of every feature over its class's threshold."""
    if state.sketch is None:
        return zero_scores(examples, cfg.n_classes)
    weights = sk.estimate_classes(examples.select("feature").distinct(), state.sketch, cfg)
    if state.model is not None:
        minimum = tk.thresholds(state.model, cfg.k)
        weights = weights.join(minimum, "class", "left").withColumn("minimum", F.coalesce("minimum", F.lit(0.0)))
        weights = weights.select("feature", "class", link.hard_threshold(F.col("w"), F.col("minimum"), tk.DIGITS).alias("w")).where("w <> 0")
    return logits(examples, weights, cfg.n_classes)


def fine_step(examples: DataFrame, state: State, cfg: SketchConfig, keep=lazy) -> State:
    deltas = keep(class_deltas(examples, fine_scores(examples, state, cfg), cfg), "deltas")
    sketch = keep(_add(state.sketch, sk.build(deltas, cfg, classes=True, summed=True)), "sketch")
    touched = deltas.select("feature").distinct()
    weights = sk.estimate_classes(touched, sketch, cfg).select("class", "feature", "w")
    if state.model is not None:
        weights = weights.unionByName(state.model.join(touched, "feature", "left_anti").select("class", "feature", "w"))
    return State(sketch, tk.topk_per_class(weights, cfg.k))


def predict_fine(examples: DataFrame, model: DataFrame, cfg: SketchConfig, fidelity: bool = False) -> DataFrame:
    """Scores by the held values; ``fidelity`` sums their sizes instead, without sign."""
    held = model.withColumn("w", F.abs("w")) if fidelity else model
    return predictions(logits(examples, held, cfg.n_classes))


# Coarse: one top-k table by L1 norm over classes; scores always read the sketch


def coarse_scores(examples: DataFrame, state: State, cfg: SketchConfig) -> DataFrame:
    if state.model is None or state.sketch is None:
        return zero_scores(examples, cfg.n_classes)
    active = tk.members(examples.select("feature").distinct(), state.model)
    return logits(examples, sk.estimate_classes(active, state.sketch, cfg), cfg.n_classes)


def l1_norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("feature").agg(F.sum(F.abs("w")).alias("w"))


def coarse_step(examples: DataFrame, state: State, cfg: SketchConfig, keep=lazy) -> State:
    deltas = keep(class_deltas(examples, coarse_scores(examples, state, cfg), cfg), "deltas")
    sketch = keep(_add(state.sketch, sk.build(deltas, cfg, classes=True, summed=True)), "sketch")
    touched = deltas.select("feature").distinct()
    weights = l1_norms(sk.estimate_classes(touched, sketch, cfg))
    if state.model is not None:
        weights = weights.unionByName(state.model.join(touched, "feature", "left_anti").select("feature", "w"))
    return State(sketch, tk.global_topk(weights, cfg.k))


def predict_coarse(examples: DataFrame, state: State, cfg: SketchConfig) -> DataFrame:
    return predictions(coarse_scores(examples, state, cfg))


def predict_hashed(examples: DataFrame, table: DataFrame, cfg: SketchConfig) -> DataFrame:
    return predictions(hashed_scores(examples, table, cfg))


# Training log and multi-part training


def batch_of(position, cfg: SketchConfig):
    """Batch number of a row position that counts from 1."""
    return F.floor((position - 1) / cfg.batch_rows)


def loss_log(rows: DataFrame) -> DataFrame:
    """rows: batch_id, loss.  batch_id, cnt (rows so far), avg_loss (less the mean log likelihood)."""
    per = rows.groupBy("batch_id").agg(F.count("*").alias("n"), (-F.avg("loss")).alias("avg_loss"))
    so_far = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select("batch_id", F.sum("n").over(so_far).alias("cnt"), "avg_loss")


def rows_read(examples: DataFrame, cfg: SketchConfig) -> DataFrame:
    """examples: example_id from 0.  batch_id, rows of the batch, and rows read up to its end."""
    per = examples.groupBy(batch_of(F.col("example_id") + 1, cfg).alias("batch_id")).agg(F.countDistinct("example_id").alias("rows"))
    so_far = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("rows_read", F.sum("rows").over(so_far))


def fit_parts(parts, step, state, settle=lambda x, _: x, log=lambda banner: None):
    """Trains on one part after the other and yields (epoch, state); ``settle`` may write a state to
    storage, ``log`` gets the banners of each epoch's training and validation."""
    for epoch, part in enumerate(parts):
        log(f"Epoch: {epoch}")
        state = settle(step(part, state), epoch)
        log(f"Validation: {epoch}")
        yield epoch, state


def fit_validate(parts, test: DataFrame, step, state, predict, settle=lambda x, _: x, log=lambda banner: None) -> DataFrame:
    """Trains on the parts in turn and predicts the test examples after each: epoch and the columns of ``predict(test, state)``."""
    out = None
    for epoch, state in fit_parts(parts, step, state, settle, log):
        one = predict(test, state).withColumn("epoch", F.lit(epoch))
        out = one if out is None else out.unionByName(one)
    return out
