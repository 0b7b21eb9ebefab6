import math

import pytest
from pyspark.sql import functions as F

from sketchweave.functions import link
from sketchweave.functions.config import SketchConfig
from sketchweave.sources import model_io, readers


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_tokenizer_keeps_empty_tokens(spark):
    rows = readers.tokenize(lines(spark, "a b ", "a  b", "")).collect()
    assert [r.tokens for r in rows] == [["a", "b", ""], ["a", "", "b"], [""]]


def test_numeric_reader(spark):
    got = readers.parse_numeric(lines(spark, "1 5:0.5 7:2e1", "-1 | 3:1  4:-2.5 ", "", "x 9:abc 10", "+1")).collect()
    assert [(r.label, [(f.id, f.value) for f in r.features]) for r in got] == [
        (1, [(5, 0.5), (7, 20.0)]),
        (-1, [(3, 1.0), (4, -2.5)]),
        (0, []),
        (0, [(9, 0.0), (10, 0.0)]),
        (1, []),
    ]


def test_string_reader(spark):
    got = readers.parse_string(lines(spark, "1 | a b", "3 x c"), n_classes=3).collect()
    assert [(r.label, r.features) for r in got] == [(0, ["a", "b"]), (2, ["c"])]
    with pytest.raises(Exception, match="label outside"):
        readers.parse_string(lines(spark, "0 | a"), n_classes=3).collect()


def test_files_and_unterminated_last_line(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1 2:3\n-1 4:5")
    df = readers.read_sparse_numeric(spark, str(tmp_path))
    assert sorted(r.label for r in df.collect()) == [-1, 1]
    long = readers.long_form(df.withColumn("example_id", F.monotonically_increasing_id()))
    assert sorted((r.label, r.feature, r.x) for r in long.collect()) == [(-1, 4, 5.0), (1, 2, 3.0)]


@pytest.mark.parametrize("z,best,p", [([-1.0, -2.0, -3.0], 0, [0.665241, 0.244728, 0.090031]), ([0.0, 2.0, 2.0], 1, [0.063379, 0.468311, 0.468311]), ([-3.0, -1.0, -2.0], 0, None)])
def test_class_vectors(spark, z, best, p):
    r = spark.createDataFrame([(z,)], "z array<double>").select(link.argmax_floor(F.col("z")).alias("best"), link.softmax(F.col("z")).alias("p")).first()
    assert r.best == best
    if p:
        assert r.p == pytest.approx(p, abs=1e-6)


def test_saturated_loss_is_finite(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 0.5)], "y int, p double")
    got = [r[0] for r in df.select(link.log_likelihood(F.col("y"), F.col("p"))).collect()]
    assert all(map(math.isfinite, got)) and got[2] == pytest.approx(math.log(0.5))


def test_model_needs_the_same_shape(spark, tmp_path):
    cfg = SketchConfig()
    t = spark.createDataFrame([(0, 1, 2.0)], "r int, b int, w double")
    model_io.save(str(tmp_path), cfg, sketch=t)
    assert model_io.load(spark, str(tmp_path), cfg, "sketch")["sketch"].collect() == t.collect()
    with pytest.raises(ValueError, match="n_buckets"):
        model_io.load(spark, str(tmp_path), cfg.but(n_buckets=7), "sketch")


def test_prediction_sink(spark, tmp_path):
    p = spark.createDataFrame([(2, 1, 0), (1, 0, 0)], "example_id long, label int, prediction int")
    model_io.write_predictions(p, str(tmp_path / "p"), 0)
    model_io.write_predictions(p, str(tmp_path / "p"), 1)
    assert spark.read.parquet(str(tmp_path / "p")).groupBy("epoch").count().count() == 2
    assert [r.value for r in model_io.prediction_lines(p.coalesce(1), "prediction").collect()] == ["0 0", "1 0"]
