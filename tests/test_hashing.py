import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sketchweave.functions import hashing
from sketchweave.functions.config import SketchConfig

# Published vectors of 32-bit Murmur3.
VECTORS = [
    (b"", 0, 0),
    (b"", 1, 1364076727),
    (b"test", 0, 3127628307),
    (b"hello", 0, 613153351),
    ((1).to_bytes(4, "little"), 42, 3735386339),
    ((0).to_bytes(4, "little"), 0, 593689054),
    ((-1).to_bytes(4, "little", signed=True), 16807, 1216411063),
    (b"abcdefghijkl", 42, 3023586376),
    (b"ACGTACGTACGT", 16807, 3407695136),
    (b"abc" + bytes(9), 16807, 2278902935),
]


@pytest.mark.parametrize("key,seed,value", VECTORS)
def test_plain_murmur(key, seed, value):
    assert hashing.murmur3(key, seed) == value


@given(st.integers(0, 2**32 - 1))
def test_seed_prefix_inverts_the_hash(seed):
    assert hashing.murmur3(hashing.seed_prefix(seed).to_bytes(4, "little", signed=True), hashing.SPARK_SEED) == seed


@pytest.mark.parametrize("seed,prefix", [(0, 2601007743), (1, 2384078164), (42, 2252548187), (16807, 3659726847)])
def test_known_prefixes(seed, prefix):
    assert hashing.seed_prefix(seed) % (1 << 32) == prefix


def test_native_hash_of_ints_and_strings(spark):
    ids = [0, 1, -1, 2**31 - 1, -(2**31), 12345]
    words = ["abc", "abcdefghijklmnop", "éauxè", "", "x" * 40, "日本語テスト"]
    df = spark.createDataFrame(list(zip(ids, words)), "i int, s string")
    for seed in (0, 42, 16807, 2**32 - 1):
        rows = df.select("i", "s", hashing.murmur(F.col("i"), seed).alias("hi"), hashing.murmur(hashing.string_key(F.col("s")), seed).alias("hs")).collect()
        for r in rows:
            assert r.hi == hashing.murmur3(r.i.to_bytes(4, "little", signed=True), seed)
            assert r.hs == hashing.murmur3(r.s.encode()[:12].ljust(12, b"\0"), seed)


def test_hash_runs_in_code_generation(spark):
    cfg = SketchConfig()
    plan = spark.range(10).select(hashing.bucket(F.col("id").cast("int"), cfg.seeds[0], cfg.n_buckets))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    assert "Python" not in plan and "WholeStageCodegen" in plan


@pytest.mark.parametrize("change", [{"key_len": 10}, {"key_len": 0}, {"n_rows": 9}, {"n_rows": 0}, {"k": 0}])
def test_bad_configurations(change):
    with pytest.raises(ValueError):
        SketchConfig(**change)
