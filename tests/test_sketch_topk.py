import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sketchweave.functions.config import SketchConfig
from sketchweave.operators import sketch as sk
from sketchweave.operators import topk as tk

CFG = SketchConfig(n_buckets=101)
WIDE = SketchConfig(n_buckets=10_000_019)


def deltas(spark, rows):
    return spark.createDataFrame(rows, "feature int, delta double")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_merge_is_the_sketch_of_the_whole(spark):
    rows = [(i % 37, float(i % 5 - 2)) for i in range(400)]
    whole = sk.build(deltas(spark, rows), CFG)
    parts = sk.merge(sk.build(deltas(spark, rows[:150]), CFG), sk.build(deltas(spark, rows[150:]), CFG))
    assert rows_of(whole.select("r", "b", "w")) == rows_of(parts.select("r", "b", "w"))


def test_order_does_not_matter(spark):
    rows = [(i % 37, float(i % 5 - 2)) for i in range(200)]
    shuffled = random.Random(0).sample(rows, len(rows))
    assert rows_of(sk.build(deltas(spark, rows), CFG)) == rows_of(sk.build(deltas(spark, shuffled), CFG))


@pytest.mark.parametrize("n_rows", [1, 2, 3, 4, 5])
def test_estimate_is_exact_without_collisions(spark, n_rows):
    cfg = WIDE.but(n_rows=n_rows)
    d = deltas(spark, [(i, float(i)) for i in range(50)])
    assert rows_of(sk.estimate(d, sk.build(d, cfg), cfg)) == [(i, float(i)) for i in range(50)]


def test_unknown_and_null_features(spark):
    d = deltas(spark, [(1, 2.0), (None, 5.0)])
    s = sk.build(d, WIDE)
    assert rows_of(sk.estimate(deltas(spark, [(1, 0.0), (7, 0.0)]), s, WIDE)) == [(1, 2.0), (7, 0.0)]


def test_class_estimates(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 2, -2.0), ("b", 1, 3.0)], "feature string, class int, delta double")
    cfg = WIDE.but(n_classes=3)
    est = sk.estimate_classes(d.select("feature").distinct(), sk.build(d, cfg, classes=True), cfg)
    assert rows_of(est) == [("a", 0, 1.0), ("a", 2, -2.0), ("b", 1, 3.0)]


def test_hashed_put_keeps_the_last(spark):
    puts = spark.createDataFrame([(5, 1.0, 1), (5, 9.0, 3), (5, 4.0, 2)], "feature int, value double, seq long")
    table = sk.hashed_put(puts, WIDE)
    assert rows_of(sk.hashed_get(spark.createDataFrame([(5,), (6,)], "feature int"), table, WIDE)) == [(5, 9.0), (6, 0.0)]


def test_topk_tables(spark):
    w = spark.createDataFrame([(0, 1, 1.0), (0, 2, -3.0), (0, 3, 3.0), (1, 1, 0.5)], "class int, feature int, w double")
    assert [r.feature for r in tk.global_topk(w.where("class = 0"), 2).collect()] == [2, 3]
    assert rows_of(tk.topk_per_class(w, 2).select("class", "feature")) == [(0, 2), (0, 3), (1, 1)]
    assert rows_of(tk.thresholds(tk.topk_per_class(w, 2), 2)) == [(0, 3.0), (1, 0.0)]
    plan = tk.global_topk(w, 2)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_heap_golden():
    h = tk.HystereticHeap(3)
    state = lambda: {k: (h.heap[i][0], h.value[k]) for k, i in h.slot.items()}
    for k, v in (("a", 1.0), ("b", -2.0), ("c", 4.0)):
        h.push(k, v)
    assert state() == {"a": (1, 1), "b": (2, -2), "c": (4, 4)}
    h.push("d", 1.04)
    assert "d" not in h
    h.push("d", -1.0625)
    assert state() == {"b": (2, -2), "c": (4, 4), "d": (1.0625, -1.0625)}
    h.push("b", 2.0625)
    assert state()["b"] == (2, 2.0625)
    h.push("b", -2.25)
    assert state()["b"] == (2.25, -2.25)
    h.push("c", 0.5)
    assert h.minimum() == 0.5
    h.push("e", 0.52)
    assert "e" not in h
    h.push("e", 0.53125)
    assert state() == {"b": (2.25, -2.25), "d": (1.0625, -1.0625), "e": (0.53125, 0.53125)}


@given(st.integers(1, 8), st.lists(st.tuples(st.integers(0, 15), st.floats(-10, 10, allow_nan=False)), max_size=80))
@settings(max_examples=60)
def test_heap_invariants(capacity, pushes):
    h, last = tk.HystereticHeap(capacity), {}
    for k, v in pushes:
        h.push(k, v)
        last[k] = v
        assert h.check() and len(h) <= capacity
    assert all(h.get(k) == last[k] for k in h.slot)
    assert h.get("absent") == 0.0


def test_median_rule(spark):
    from sketchweave.functions.link import median_of

    df = spark.createDataFrame([(4.0, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    assert df.select(median_of([F.col(x) for x in "abcd"])).first()[0] == 2.5
    assert df.select(median_of([F.col(x) for x in "abc"])).first()[0] == np.median([4, 1, 2])
