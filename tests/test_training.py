import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchweave.functions.config import SketchConfig
from sketchweave.functions.hashing import murmur3
from sketchweave.operators import batch as bt
from sketchweave.operators import online as on
from sketchweave.operators.topk import HystereticHeap
from sketchweave.streaming.trainer import StreamTrainer

BIG = SketchConfig(n_buckets=10_000_019, k=1000)
SMALL = SketchConfig(n_buckets=61, k=15)


def examples(spark, n=60, n_classes=2, seed=3):
    rng = random.Random(seed)
    labels = [rng.randrange(n_classes) for _ in range(n)]
    rows = [(i, labels[i], f, 1.0) for i in range(n) for f in sorted(rng.sample(range(25), 4))]
    return rows, spark.createDataFrame(rows, "example_id long, label int, feature int, x double")


def place(f, cfg):
    key = int(f).to_bytes(4, "little", signed=True)
    return [(murmur3(key, cfg.seeds[i]) % cfg.n_buckets, 1 if murmur3(key, cfg.sign_seed(i)) & 1 else -1) for i in range(cfg.n_rows)]


def plain_logistic(rows, cfg):
    """The ordered trainer, written out."""
    cells, heap = {}, HystereticHeap(cfg.k, cfg.eps)
    by = {}
    for i, y, f, x in rows:
        by.setdefault(i, (y, []))[1].append((f, x))
    for _, (y, fs) in sorted(by.items()):
        p = 1 / (1 + math.exp(-sum(heap.get(f) * x for f, x in fs)))
        for f, x in fs:
            spots = place(f, cfg)
            for r, (b, s) in enumerate(spots):
                cells[r, b] = cells.get((r, b), 0.0) + s * cfg.lr * (y - p) * x
            heap.push(f, median(s * cells[r, b] for r, (b, s) in enumerate(spots)))
    return dict(heap.items())


@pytest.mark.parametrize("cfg", [BIG, SMALL])
def test_online_logistic_against_plain(spark, cfg):
    rows, df = examples(spark)
    got = {r.feature: r.w for r in on.fit_online(df, cfg, "logistic").collect()}
    want = plain_logistic(rows, cfg)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_batch_of_one_is_online_without_collisions(spark):
    rows, df = examples(spark, n=6)
    state = bt.State()
    for i in range(6):
        step = bt.logistic_step(df.where(F.col("example_id") == i), state, BIG)
        state = bt.State(spark.createDataFrame(step.sketch.collect(), step.sketch.schema), spark.createDataFrame(step.model.collect(), step.model.schema))
    got = {r.feature: r.w for r in state.model.collect()}
    want = plain_logistic(rows, BIG)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def plain_softmax(rows, cfg, kind):
    by = {}
    for i, y, f, _ in rows:
        by.setdefault(i, (y, []))[1].append(f)
    w = np.zeros((cfg.n_rows, cfg.n_buckets, cfg.n_classes))
    get = lambda f: np.median([s * w[r, b] for r, (b, s) in enumerate(place(f, cfg))], axis=0)
    heaps = [HystereticHeap(cfg.k, cfg.eps) for _ in range(cfg.n_classes)]
    for _, (y, fs) in sorted(by.items()):
        z = np.zeros(cfg.n_classes)
        for f in fs:
            v = get(f)
            if kind == "coarse":
                z += v if f in heaps[0] else 0
            else:
                z += [x if abs(x) >= h.minimum() else 0 for x, h in zip(v, heaps)]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        p[y] -= 1
        for f in fs:
            for r, (b, s) in enumerate(place(f, cfg)):
                w[r, b] += -cfg.lr * s * p
        for f in fs:
            if kind == "coarse":
                heaps[0].push(f, float(np.abs(get(f)).sum()))
            else:
                for c, x in enumerate(get(f)):
                    heaps[c].push(f, float(x))
    return {(c, f): v for c, h in enumerate(heaps) for f, v in h.items()}


@pytest.mark.parametrize("kind", ["fine", "coarse"])
def test_online_softmax_against_plain(spark, kind):
    cfg = SMALL.but(n_classes=3, k=7, lr=0.1)
    rows, df = examples(spark, n_classes=3)
    got = {(r["class"], r.feature): r.w for r in on.fit_online(df, cfg, kind).collect()}
    want = plain_softmax(rows, cfg, kind)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_first_logistic_step(spark):
    df = spark.createDataFrame([(0, 1, 5, 1.0), (1, 0, 6, 1.0)], "example_id long, label int, feature int, x double")
    model = bt.logistic_step(df, bt.State(), BIG).model
    assert sorted(map(tuple, model.collect())) == [(5, 0.25), (6, -0.25)]


def test_coarse_cold_start(spark):
    df = spark.createDataFrame([(0, 0, 5, 1.0)], "example_id long, label int, feature int, x double")
    cfg = BIG.but(n_classes=2, lr=0.1)
    assert bt.coarse_step(df, bt.State(), cfg).model.collect()[0].w == pytest.approx(0.1)


def test_refresh_modes(spark):
    df = spark.createDataFrame([(0, 1, 5, 1.0)], "example_id long, label int, feature int, x double")
    other = spark.createDataFrame([(1, 1, 6, 1.0)], "example_id long, label int, feature int, x double")
    first = bt.logistic_step(df, bt.State(), BIG)
    for mode in ("touched", "all"):
        assert sorted(r.feature for r in bt.logistic_step(other, first, BIG, refresh=mode).model.collect()) == [5, 6]


def test_step_with_an_empty_batch(spark):
    _, df = examples(spark, n=5)
    first = bt.logistic_step(df, bt.State(), BIG)
    again = bt.logistic_step(df.where("false"), first, BIG)
    assert sorted(map(tuple, again.model.collect())) == sorted(map(tuple, first.model.collect()))


def test_fine_fidelity_sums_sizes(spark):
    df = spark.createDataFrame([(0, 0, 5, 1.0)], "example_id long, label int, feature int, x double")
    model = spark.createDataFrame([(0, 5, -2.0), (1, 5, 1.0)], "class int, feature int, w double")
    cfg = BIG.but(n_classes=2)
    assert bt.predict_fine(df, model, cfg).first().prediction == 1
    assert bt.predict_fine(df, model, cfg, fidelity=True).first().prediction == 0


def test_stream_equals_batches_and_survives_a_repeat(spark, tmp_path):
    _, df = examples(spark, n=20)
    parts = [df.where("example_id < 10"), df.where("example_id >= 10")]
    trainer = StreamTrainer(str(tmp_path / "state"), BIG)
    for i, p in enumerate(parts):
        trainer.update(p, i)
    trainer.update(parts[1], 1)
    want = bt.logistic_step(parts[1], bt.logistic_step(parts[0], bt.State(), BIG), BIG).model
    got = {r.feature: r.w for r in trainer.state(spark, 1).model.collect()}
    assert got == pytest.approx({r.feature: r.w for r in want.collect()})


def test_multi_part_training(spark):
    _, df = examples(spark, n=20)
    parts = [df.where("example_id < 10"), df.where("example_id >= 10")]
    epochs = list(bt.fit_parts(parts, lambda e, s: bt.logistic_step(e, s, BIG), bt.State()))
    assert [e for e, _ in epochs] == [0, 1]
    log = bt.loss_log(bt.logistic_scores(df, epochs[-1][1].model).selectExpr("example_id div 10 as batch_id", "ln(p) as loss"))
    assert [r.cnt for r in log.orderBy("batch_id").collect()] == [10, 20]


@pytest.mark.parametrize("kind", ["logistic", "fine", "coarse", "hashed"])
def test_online_predictions_after_each_part(spark, kind):
    rows = [(i, i % 2, f, 1.0) for i in range(40) for f in (i % 2, 10 + i % 5)]
    df = spark.createDataFrame(rows, "example_id long, label int, feature int, x double")
    cfg = BIG.but(n_buckets=9973, n_classes=2, lr=0.5)
    got = on.fit_predict_online([df.where("example_id < 20"), df.where("example_id >= 20")], df, cfg, kind).collect()
    assert len(got) == 80 and {r.epoch for r in got} == {0, 1}
    assert all(r.prediction == r.label for r in got)


def test_online_fine_fidelity_stores_sizes(spark):
    _, df = examples(spark, n=10, n_classes=3)
    cfg = BIG.but(n_buckets=9973, n_classes=3)
    signed = {(r["class"], r.feature): r.w for r in on.fit_online(df, cfg, "fine").collect()}
    sizes = {(r["class"], r.feature): r.w for r in on.fit_online(df, cfg, "fine", fidelity=True).collect()}
    assert any(w < 0 for w in signed.values()) and sizes == pytest.approx({k: abs(v) for k, v in signed.items()})


@pytest.mark.parametrize("workers", [1, 3])
def test_parallel_workers_merge_by_sum_and_union(spark, workers):
    rows, df = examples(spark, n=80)
    sketch, model = on.fit_parallel(df, SMALL, "logistic", workers)
    total, held = {}, set()
    for w in range(workers):
        mine = [r for r in rows if r[0] % workers == w]
        held |= set(plain_logistic(mine, SMALL))
        one = on.Logistic(SMALL)
        by = {}
        for i, y, f, x in mine:
            by.setdefault(i, (y, []))[1].append((f, x))
        for _, (y, fs) in sorted(by.items()):
            spots = [place(f, SMALL) for f, _ in fs]
            one.step(y, on.Example([f for f, _ in fs], np.array([x for _, x in fs]), np.array([[b for b, _ in p] for p in spots]), np.array([[s for _, s in p] for p in spots], float)))
        for r, b, _, v in one.cells():
            total[r, b] = total.get((r, b), 0.0) + v
    got = {(r.r, r.b): r.w for r in sketch.collect()}
    assert got.keys() == total.keys() and all(got[k] == pytest.approx(total[k], abs=1e-12) for k in total)
    weight = {f: median(s * total.get((r, b), 0.0) for r, (b, s) in enumerate(place(f, SMALL))) for f in held}
    best = sorted(weight, key=lambda f: (-round(abs(weight[f]), 12), f))[: SMALL.k]
    assert {r.feature: r.w for r in model.collect()} == {f: pytest.approx(weight[f], abs=1e-12) for f in best}


@pytest.mark.parametrize("kind", ["fine", "coarse", "hashed"])
def test_one_parallel_worker_holds_what_the_ordered_trainer_holds(spark, kind):
    cfg = SketchConfig(n_buckets=10_007, n_classes=3, k=6, lr=0.1)
    _, df = examples(spark, n_classes=3)
    ordered = {(r["class"], r.feature) for r in on.fit_online(df, cfg, kind).collect()}
    assert {(r["class"], r.feature) for r in on.fit_parallel(df, cfg, kind, 1)[1].collect()} == ordered


def test_stream_takes_a_file_at_a_time(spark, tmp_path):
    _, df = examples(spark, n=30)
    trainer = StreamTrainer(str(tmp_path / "state"), BIG, batch_files=1)
    for k in range(3):
        df.where(F.col("example_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = trainer.run(trainer.source(spark, df._jdf.schema().toDDL(), str(tmp_path / "in")), str(tmp_path / "checkpoint"))
    assert query.lastProgress["batchId"] == 2
    state = bt.State()
    for k in range(3):
        state = bt.logistic_step(df.where(F.col("example_id") % 3 == k), state, BIG)
    got = {r.feature: r.w for r in trainer.state(spark, 2).model.collect()}
    assert got == {r.feature: pytest.approx(r.w, abs=1e-12) for r in state.model.collect()}


def test_banners_and_counters(spark):
    _, df = examples(spark, n=25)
    banners = []
    parts = [df.where("example_id < 10"), df.where("example_id >= 10")]
    out = bt.fit_validate(parts, df, lambda e, s: bt.logistic_step(e, s, BIG), bt.State(), lambda t, s: bt.predict_logistic(t, s.model), log=banners.append)
    assert banners == ["Epoch: 0", "Validation: 0", "Epoch: 1", "Validation: 1"] and out.count() == 50
    assert [(r.batch_id, r.rows, r.rows_read) for r in bt.rows_read(df, BIG.but(batch_rows=10)).orderBy("batch_id").collect()] == [(0, 10, 10), (1, 10, 20), (2, 5, 25)]


def test_softmax_of_many_classes(spark):
    from sketchweave.functions import link

    z = np.random.default_rng(1).normal(size=(5, 193)) * 30
    got = spark.createDataFrame([(v.tolist(),) for v in z], "z array<double>").select(link.softmax(F.col("z")).alias("p")).collect()
    e = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose([r.p for r in got], e / e.sum(axis=1, keepdims=True), atol=1e-12)
