"""Registered queries of the sketch engine and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, link
from ..functions.config import SketchConfig
from ..operators import batch as bt
from ..operators import online as on
from ..operators import sketch as sk
from ..operators import topk as tk
from ..sources import model_io, readers
from ..streaming.storage import keeper, scratch
from ..streaming.trainer import StreamTrainer
from .murmur_sql import blocks, hash_items

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

BIN = SketchConfig(k=50, lr=0.5)
EVEN = BIN.but(n_rows=4)
MULTI = SketchConfig(n_buckets=1023, n_classes=5, k=20, lr=0.001)
DIGITS, RANK = 6, tk.DIGITS


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark, sf_dir):
    return readers.document_tokens(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def all_tokens(spark, sf_dir):
    """The tokens of all documents, labelled or not."""
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("feature")).where("feature <> ''").distinct()


def numeric(spark, sf_dir):
    return readers.event_numeric(table(spark, sf_dir, "events"))


def classes(spark, sf_dir):
    return readers.event_classes(table(spark, sf_dir, "events"))


def part_quantity(spark, sf_dir):
    """Order-free numeric features: delta = quantity of a part."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("int").alias("feature"), F.col("l_quantity").alias("delta"))


def part_quantity_classes(spark, sf_dir):
    """The same by return flag, classes 0 to 2."""
    c = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("int").alias("feature"), c.cast("int").alias("class"), F.col("l_quantity").alias("delta"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded to DIGITS, without a negative zero."""
    return df.withColumns({c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in columns})


def r6(x: str) -> str:
    return f"round({x}, {DIGITS}) + 0.0"


# SQL building blocks (common table expressions)

TOKENS = """tok AS (
  SELECT DISTINCT d.doc_id AS example_id, l.toxic AS label, unnest(string_split(d.text, ' ')) AS feature
  FROM documents d JOIN labels l USING (doc_id)
), ex AS (SELECT *, 1.0::DOUBLE AS x FROM tok WHERE feature <> '')"""

ALL_TOKENS = "ex AS (SELECT DISTINCT feature FROM (SELECT unnest(string_split(text, ' ')) AS feature FROM documents) WHERE feature <> '')"

NUMERIC = """ex AS (
  SELECT event_id AS example_id, (event_type = 'error')::INT AS label, unnest([user_id::INT, hour(ts)::INT + 1000000]) AS feature, 1.0::DOUBLE AS x FROM events
)"""

CLASSES = """ex AS (
  SELECT event_id AS example_id, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::INT AS label,
    unnest([user_id::INT, hour(ts)::INT + 1000000]) AS feature, 1.0::DOUBLE AS x FROM events
), kinds AS (SELECT unnest(range(5))::INT AS class)"""

QUANTITY = "dl AS (SELECT l_partkey::INT AS feature, l_quantity AS delta FROM lineitem)"
QUANTITY_CLASSES = "dl AS (SELECT l_partkey::INT AS feature, (list_position(['A', 'N', 'R'], l_returnflag) - 1)::INT AS class, l_quantity AS delta FROM lineitem)"


def seeds_sql(cfg: SketchConfig) -> str:
    rows = [f"({i}, 0, {cfg.seeds[i]})" for i in range(cfg.n_rows)] + [f"({i}, 1, {cfg.sign_seed(i)})" for i in range(cfg.n_rows)]
    return f"(VALUES {', '.join(rows)}) seeds(r, part, seed)"


def cells_sql(cfg: SketchConfig, kind: str, source: str = "ex", name: str = "cells") -> str:
    """cells: feature, r, b, sg of the distinct features of ``source``."""
    return f"""{name}_h AS MATERIALIZED (
  SELECT feature, r, part, {hash_items(blocks("feature", kind), "seed")}
  FROM (SELECT DISTINCT feature FROM {source} WHERE feature IS NOT NULL) CROSS JOIN {seeds_sql(cfg)}
), {name} AS MATERIALIZED (
  SELECT feature, r, max(CASE WHEN part = 0 THEN hash % {cfg.n_buckets} END)::INT AS b, max(CASE WHEN part = 1 THEN (hash & 1) * 2 - 1 END)::INT AS sg
  FROM {name}_h GROUP BY feature, r
)"""


def bucket_sql(cfg: SketchConfig, kind: str, source: str = "ex") -> str:
    """bk: feature, b in the hashed table."""
    return f"""bk AS MATERIALIZED (
  SELECT feature, (hash % {cfg.n_buckets})::INT AS b FROM (
    SELECT feature, {hash_items(blocks("feature", kind), str(cfg.seeds[0]))} FROM (SELECT DISTINCT feature FROM {source} WHERE feature IS NOT NULL))
)"""


def median_sql(n: int) -> str:
    if n == 3:
        return "greatest(least(v0, v1), least(greatest(v0, v1), v2))"
    return f"list_median([{', '.join(f'v{i}' for i in range(n))}])" if n != 4 else "(list_sort([v0, v1, v2, v3])[2] + list_sort([v0, v1, v2, v3])[3]) / 2"


def sketch_sql(deltas: str, name: str, by: str = "", old: str | None = None) -> str:
    """A sketch of pre-aggregated deltas, added to an old one."""
    new = f"SELECT c.r, c.b{by}, sum(c.sg * d.delta) AS w FROM {deltas} d JOIN cells c USING (feature) GROUP BY c.r, c.b{by}"
    if old:
        new = f"SELECT r, b{by}, sum(w) AS w FROM (SELECT r, b{by}, w FROM {old} UNION ALL {new}) GROUP BY r, b{by}"
    return f"{name} AS MATERIALIZED ({new})"


def estimate_sql(features: str, sketch: str, cfg: SketchConfig, name: str, by_class: bool = False) -> str:
    rows = ", ".join(f"coalesce(max(CASE WHEN c.r = {i} THEN c.sg * s.w END), 0.0) AS v{i}" for i in range(cfg.n_rows))
    join, by = ("JOIN", ", s.class") if by_class else ("LEFT JOIN", "")
    cls = ", class" if by_class else ""
    return f"""{name} AS MATERIALIZED (
  SELECT feature{cls}, {median_sql(cfg.n_rows)} AS w FROM (
    SELECT f.feature{by}, {rows} FROM (SELECT DISTINCT feature FROM {features}) f JOIN cells c USING (feature) {join} {sketch} s ON s.r = c.r AND s.b = c.b GROUP BY f.feature{by})
)"""


def top_sql(source: str, k: int, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT feature, w FROM {source} ORDER BY round(abs(w), {RANK}) DESC, feature LIMIT {k})"


def top_class_sql(source: str, k: int, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT class, feature, w FROM {source} QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(abs(w), {RANK}) DESC, feature) <= {k}
)"""


def with_sql(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


# Hashing


def _hash_features(df, kind, cfg):
    key = hashing.key_of(F.col("feature"), kind, cfg)
    return df.select("feature").distinct().select("feature", *[hashing.murmur(key, s).alias(f"h{i}") for i, s in enumerate(cfg.seeds[:3])])


def _hash_sql(source, kind, cfg=BIN):
    pick = ", ".join(f"max(CASE WHEN r = {i} AND part = 0 THEN hash END) AS h{i}" for i in range(3))
    return with_sql(source, cells_sql(cfg, kind), final=f"SELECT feature, {pick} FROM cells_h GROUP BY feature")


@query(_hash_sql(NUMERIC, "int"))
def murmur_int(spark, sf_dir):
    return _hash_features(numeric(spark, sf_dir), "int", BIN)


@query(_hash_sql(ALL_TOKENS, "string"))
def murmur_str12(spark, sf_dir):
    return _hash_features(all_tokens(spark, sf_dir), "string", BIN)


@query(with_sql(NUMERIC, cells_sql(BIN, "int"), final="SELECT feature, r, b, sg FROM cells"))
def bucket_sign(spark, sf_dir):
    return sk.with_cells(numeric(spark, sf_dir).select("feature").distinct(), BIN)


@query(with_sql(ALL_TOKENS, bucket_sql(BIN, "string"), final="SELECT feature, b FROM bk"))
def feature_bucket(spark, sf_dir):
    return sk.feature_bucket(all_tokens(spark, sf_dir), BIN)


# Sources: lines made of table columns, then parsed


def numeric_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sign = F.when(F.col("event_type") == "error", "1").otherwise("-1")
    return e.select("event_id", F.concat(sign, F.lit(" "), F.col("user_id").cast("string"), F.lit(":1  "), (F.hour("ts") + 1_000_000).cast("string"), F.lit(":0.5 ")).alias("value"))


def string_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = F.array_position(F.array(*[F.lit(x) for x in readers.EVENT_CLASSES]), F.col("event_type"))
    return e.select("event_id", F.concat(c.cast("string"), F.lit(" | u"), F.col("user_id").cast("string"), F.lit(" h"), F.hour("ts").cast("string")).alias("value"))


NUMERIC_LINES = "SELECT event_id, (CASE WHEN event_type = 'error' THEN '1' ELSE '-1' END) || ' ' || user_id || ':1  ' || (hour(ts) + 1000000) || ':0.5 ' AS value FROM events"
STRING_LINES = "SELECT event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) || ' | u' || user_id || ' h' || hour(ts) AS value FROM events"


@query(f"SELECT event_id, (unnest(range(1, 1 + len(string_split(value, ' ')))) - 1)::INT AS pos, unnest(string_split(value, ' ')) AS token FROM ({NUMERIC_LINES})")
def tokenize(spark, sf_dir):
    return readers.tokenize(numeric_lines(spark, sf_dir)).select("event_id", F.posexplode("tokens").alias("pos", "token"))


@query(f"""
WITH t AS (SELECT event_id, string_split(value, ' ') AS tokens FROM ({NUMERIC_LINES})),
f AS (SELECT event_id, tokens[1]::INT AS label, unnest(list_filter(tokens[2:], lambda x: x <> '')) AS pair FROM t)
SELECT event_id, label, split_part(pair, ':', 1)::INT AS id, split_part(pair, ':', 2)::DOUBLE AS value FROM f""")
def parse_numeric(spark, sf_dir):
    p = readers.parse_numeric(numeric_lines(spark, sf_dir))
    return p.select("event_id", "label", F.explode("features").alias("f")).select("event_id", "label", "f.id", "f.value")


@query(f"""
WITH t AS (SELECT event_id, string_split(value, ' ') AS tokens FROM ({STRING_LINES}))
SELECT event_id, tokens[1]::INT - 1 AS label, unnest(tokens[3:]) AS feature FROM t""")
def parse_string(spark, sf_dir):
    p = readers.parse_string(string_lines(spark, sf_dir), n_classes=5)
    return p.select("event_id", "label", F.explode("features").alias("feature"))


@query(f"SELECT event_id, ((CASE WHEN event_type = 'error' THEN 1 ELSE -1 END) + 1) // 2 AS label01 FROM events")
def label_map(spark, sf_dir):
    return readers.parse_numeric(numeric_lines(spark, sf_dir)).select("event_id", link.binary_label(F.col("label")).alias("label01"))


# Sketch

PER_PART = "dp AS (SELECT feature, sum(delta) AS delta FROM dl GROUP BY feature)"
PER_PART_CLASS = "dp AS (SELECT feature, class, sum(delta) AS delta FROM dl GROUP BY feature, class)"


def _quantity_sql(cfg, *more, final):
    return with_sql(QUANTITY, PER_PART, cells_sql(cfg, "int", "dp"), sketch_sql("dp", "sketch"), *more, final=final)


@query(_quantity_sql(BIN, final="SELECT r, b, w FROM sketch"))
def sketch_build(spark, sf_dir):
    return sk.build(part_quantity(spark, sf_dir), BIN)


def _estimate(spark, sf_dir, cfg):
    d = part_quantity(spark, sf_dir)
    return sk.estimate(d.select("feature").distinct(), sk.build(d, cfg), cfg)


@query(_quantity_sql(BIN, estimate_sql("dp", "sketch", BIN, "est"), final="SELECT feature, w FROM est"))
def sketch_estimate3(spark, sf_dir):
    return _estimate(spark, sf_dir, BIN)


@query(_quantity_sql(EVEN, estimate_sql("dp", "sketch", EVEN, "est"), final="SELECT feature, w FROM est"))
def sketch_estimate4(spark, sf_dir):
    return _estimate(spark, sf_dir, EVEN)


@query(_quantity_sql(BIN, final="SELECT r, b, w FROM sketch"))
def sketch_merge(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    part = lambda c: sk.build(d.where(c).select(F.col("l_partkey").cast("int").alias("feature"), F.col("l_quantity").alias("delta")), BIN)
    return sk.merge(part("l_returnflag = 'A'"), part("l_returnflag = 'N'"), part("l_returnflag NOT IN ('A', 'N')"))


CLASS3 = BIN.but(n_classes=3)


def _class_sql(*more, final):
    return with_sql(QUANTITY_CLASSES, PER_PART_CLASS, cells_sql(CLASS3, "int", "dp"), sketch_sql("dp", "sketch", ", class"), estimate_sql("dp", "sketch", CLASS3, "est", True), *more, final=final)


def _class_weights(spark, sf_dir):
    d = part_quantity_classes(spark, sf_dir)
    return sk.estimate_classes(d.select("feature").distinct(), sk.build(d, CLASS3, classes=True), CLASS3)


@query(_class_sql(final="SELECT r, b, class, w FROM sketch"))
def sketch_classes(spark, sf_dir):
    return sk.build(part_quantity_classes(spark, sf_dir), CLASS3, classes=True)


@query(_class_sql(final="SELECT feature, class, w FROM est"))
def sketch_estimate_classes(spark, sf_dir):
    return _class_weights(spark, sf_dir)


@query(_class_sql("one AS (SELECT f.feature, coalesce(e.w, 0.0) AS w FROM (SELECT DISTINCT feature FROM dp) f LEFT JOIN (SELECT * FROM est WHERE class = 1) e USING (feature))", final="SELECT feature, w FROM one"))
def sketch_estimate_class(spark, sf_dir):
    d = part_quantity_classes(spark, sf_dir)
    return sk.estimate_class(d.select("feature").distinct(), sk.build(d, CLASS3, classes=True), CLASS3, 1)


@query(with_sql(QUANTITY, bucket_sql(BIN, "int", "dl"), final="SELECT b, sum(delta) AS w FROM dl JOIN bk USING (feature) GROUP BY b"))
def hashed_table(spark, sf_dir):
    return sk.hashed_build(part_quantity(spark, sf_dir), BIN)


ORDER_FEATURES = "dl AS (SELECT o_custkey::INT AS feature, o_totalprice AS value, o_orderkey AS seq FROM orders)"


@query(with_sql(ORDER_FEATURES, bucket_sql(BIN, "int", "dl"), final="SELECT b, arg_max(value, seq) AS w FROM dl JOIN bk USING (feature) GROUP BY b"))
def hashed_put(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return sk.hashed_put(o.select(F.col("o_custkey").cast("int").alias("feature"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq")), BIN)


@query(with_sql(ORDER_FEATURES, bucket_sql(BIN, "int", "dl"), "t AS (SELECT b, arg_max(value, seq) AS w FROM dl JOIN bk USING (feature) GROUP BY b)", final="SELECT feature, w FROM bk JOIN t USING (b)"))
def hashed_get(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("int").alias("feature"))
    return sk.hashed_get(o.distinct(), hashed_put(spark, sf_dir), BIN)


# Top-k: the first logistic step on document tokens

FIRST_STEP = (
    TOKENS,
    f"dp AS MATERIALIZED (SELECT feature, sum(label - 0.5::DOUBLE) * {BIN.lr}::DOUBLE AS delta FROM ex GROUP BY feature)",
    cells_sql(BIN, "string", "dp"),
    sketch_sql("dp", "sketch"),
    estimate_sql("dp", "sketch", BIN, "est"),
)


def _first_step(spark, sf_dir):
    return bt.logistic_step(tokens(spark, sf_dir), bt.State(), BIN)


@query(with_sql(*FIRST_STEP, top_sql("est", BIN.k, "model"), final="SELECT feature, w FROM model"))
def topk_global(spark, sf_dir):
    return _first_step(spark, sf_dir).model


@query(_class_sql(top_class_sql("est", 50, "model"), final="SELECT class, feature, w FROM model"))
def topk_per_class(spark, sf_dir):
    return tk.topk_per_class(_class_weights(spark, sf_dir), 50).select("class", "feature", "w")


@query(_class_sql(top_class_sql("est", 50, "model"), final="SELECT class, CASE WHEN count(*) < 50 THEN 0.0 ELSE min(abs(w)) END AS minimum FROM model GROUP BY class"))
def topk_threshold(spark, sf_dir):
    return tk.thresholds(tk.topk_per_class(_class_weights(spark, sf_dir), 50), 50)


@query(_class_sql(top_class_sql("est", 50, "model"), final="SELECT class, count(*) >= 50 AS \"full\" FROM model GROUP BY class"))
def topk_full(spark, sf_dir):
    return tk.full(tk.topk_per_class(_class_weights(spark, sf_dir), 50), 50)


@query(with_sql(*FIRST_STEP, top_sql("est", BIN.k, "model"), final="SELECT example_id, ex.feature, coalesce(model.w, 0.0) AS w FROM ex LEFT JOIN model USING (feature)"))
def topk_lookup(spark, sf_dir):
    return tk.lookup(tokens(spark, sf_dir), topk_global(spark, sf_dir)).select("example_id", "feature", "w")


@query(with_sql(*FIRST_STEP, top_sql("est", BIN.k, "model"), final="SELECT example_id, feature FROM ex WHERE feature IN (SELECT feature FROM model)"))
def topk_members(spark, sf_dir):
    return tk.members(tokens(spark, sf_dir), topk_global(spark, sf_dir)).select("example_id", "feature")


@query(with_sql(*FIRST_STEP, top_sql("est", BIN.k, "model"), "exact AS (SELECT feature, delta AS w FROM dp)", top_sql("exact", BIN.k, "best"), final="SELECT feature, model.w AS sketched, best.w AS exact FROM model FULL JOIN best USING (feature)"))
def topk_vs_exact(spark, sf_dir):
    """Features that the sketch selects beside those of the exact sums."""
    t = tokens(spark, sf_dir)
    exact = t.groupBy("feature").agg((F.sum(F.col("label") - 0.5) * BIN.lr).alias("w"))
    model = topk_global(spark, sf_dir).withColumnRenamed("w", "sketched")
    return model.join(tk.global_topk(exact, BIN.k).withColumnRenamed("w", "exact"), "feature", "full")


@query(_class_sql("a AS (SELECT DISTINCT feature FROM (SELECT feature FROM est QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(abs(w), 12) DESC, feature) <= 50))", final="SELECT feature FROM a"))
def topk_active_set(spark, sf_dir):
    per = tk.topk_per_class(_class_weights(spark, sf_dir), 50)
    return tk.active_set(*[per.where(F.col("class") == c) for c in range(3)])


# Links, losses, gradients: class vectors are the whole embeddings, a class per component


def vectors(spark, sf_dir):
    z = F.transform("embedding", lambda x: x.cast("double") * 4)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.pmod("label", F.size("embedding")).cast("int").alias("label"), z.alias("z"))


VECTORS = """v AS (SELECT vec_id, ((label % len(embedding) + len(embedding)) % len(embedding))::INT AS label, [x::DOUBLE * 4 FOR x IN embedding] AS z FROM embeddings),
t AS (SELECT *, list_max(z) AS top FROM v),
s AS (SELECT *, [exp(x - top) FOR x IN z] AS e FROM t),
p AS (SELECT vec_id, label, z, [x / list_sum(e) FOR x IN e] AS p FROM s),
c AS (SELECT vec_id, label, (unnest(range(len(z))))::INT AS class, unnest(z) AS z FROM v)"""


def exploded(df, column, name):
    return df.select("vec_id", F.posexplode(column).alias("class", name))


def components(spark, sf_dir):
    """One row per component of an embedding: vec_id, label, class, z."""
    return vectors(spark, sf_dir).select("vec_id", "label", F.posexplode("z").alias("class", "z"))


@query(f"WITH {VECTORS} SELECT vec_id, class, {r6('1 / (1 + exp(-z))')} AS p FROM c")
def sigmoid(spark, sf_dir):
    return rounded(components(spark, sf_dir).select("vec_id", "class", link.sigmoid(F.col("z")).alias("p")), "p")


@query(f"WITH {VECTORS}, q AS (SELECT vec_id, class, label % 2 AS y, 1 / (1 + exp(-z)) AS p FROM c) SELECT vec_id, class, {r6('CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END')} AS loss FROM q")
def logloss(spark, sf_dir):
    c = components(spark, sf_dir)
    return rounded(c.select("vec_id", "class", link.log_likelihood(F.col("label") % 2, link.sigmoid(F.col("z"))).alias("loss")), "loss")


@query(f"WITH {VECTORS} SELECT vec_id, unnest(range(len(p)))::INT AS class, {r6('unnest(p)')} AS p FROM p")
def softmax(spark, sf_dir):
    return rounded(exploded(vectors(spark, sf_dir), link.softmax(F.col("z")), "p"), "p")


@query(f"WITH {VECTORS} SELECT vec_id, CASE WHEN list_max(z) > 1.17549435e-38 THEN list_position(z, list_max(z)) - 1 ELSE 0 END AS prediction FROM v")
def argmax_floor(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", link.argmax_floor(F.col("z")).alias("prediction"))


@query(f"WITH {VECTORS} SELECT vec_id, {r6('ln(p[label + 1] + 1e-10)')} AS loss FROM p")
def xent(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(v.select("vec_id", link.cross_entropy(link.softmax(F.col("z")), F.col("label")).alias("loss")), "loss")


@query(f"WITH {VECTORS}, u AS (SELECT vec_id, label, unnest(range(len(p)))::INT AS class, unnest(p) AS p FROM p) SELECT vec_id, class, {r6('p - (class = label)::INT')} AS g FROM u")
def grad_softmax(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(exploded(v, link.softmax_gradient(link.softmax(F.col("z")), F.col("label")), "g"), "g")


@query(_class_sql(final="SELECT feature, sum(abs(w)) AS w FROM est GROUP BY feature"))
def l1_norm(spark, sf_dir):
    return bt.l1_norms(_class_weights(spark, sf_dir))


@query(f"WITH {VECTORS} SELECT vec_id, class, {r6('CASE WHEN z >= 0.5 OR z <= -0.5 THEN z ELSE 0.0 END')} AS w FROM c")
def hard_threshold(spark, sf_dir):
    return rounded(components(spark, sf_dir).select("vec_id", "class", link.hard_threshold(F.col("z"), F.lit(0.5)).alias("w")), "w")


# Steps.  A table makes two batches, of even and of odd example ids; every query covers both.

HALVES = NUMERIC + ", b0 AS (SELECT * FROM ex WHERE example_id % 2 = 0), b1 AS (SELECT * FROM ex WHERE example_id % 2 = 1)"
NUM = BIN.but(k=100, lr=0.001)


def half(df, i):
    return df.where(F.col("example_id") % 2 == i)


def _logistic_first(cfg, deltas="b0"):
    return (
        f"d0 AS MATERIALIZED (SELECT feature, sum((label - 0.5::DOUBLE) * x) * {cfg.lr}::DOUBLE AS delta FROM {deltas} GROUP BY feature)",
        cells_sql(cfg, "int"),
        sketch_sql("d0", "s0"),
        estimate_sql("d0", "s0", cfg, "e0"),
        top_sql("e0", cfg.k, "m0"),
    )


def _logistic_second(cfg):
    return (
        "z1 AS (SELECT example_id, label, sum(coalesce(m0.w, 0) * x) AS z FROM b1 LEFT JOIN m0 USING (feature) GROUP BY example_id, label)",
        "g1 AS (SELECT example_id, label - 1 / (1 + exp(-z)) AS g FROM z1)",
        f"d1 AS MATERIALIZED (SELECT feature, sum(g * x) * {cfg.lr}::DOUBLE AS delta FROM b1 JOIN g1 USING (example_id) GROUP BY feature)",
        sketch_sql("d1", "s1", old="s0"),
        estimate_sql("d1", "s1", cfg, "e1"),
        "c1 AS (SELECT feature, w FROM e1 UNION ALL SELECT feature, w FROM m0 WHERE feature NOT IN (SELECT feature FROM d1))",
        top_sql("c1", cfg.k, "m1"),
    )


def two_steps(step, state, examples, cfg):
    """The state after both batches; what a step uses again is written once."""
    keep = keeper(examples.sparkSession)
    state = step(half(examples, 0), state, cfg, keep=keep)
    if isinstance(state, bt.State):
        state = bt.State(state.sketch, keep(state.model, "model"))
    return step(half(examples, 1), state, cfg, keep=keep)


def two_logistic(spark, sf_dir):
    return two_steps(bt.logistic_step, bt.State(), numeric(spark, sf_dir), NUM)


@query(with_sql(NUMERIC, *_logistic_first(NUM, "ex"), final=f"SELECT feature, {r6('w')} AS w FROM m0"))
def logistic_step(spark, sf_dir):
    return rounded(bt.logistic_step(numeric(spark, sf_dir), bt.State(), NUM).model, "w")


@query(with_sql(HALVES, *_logistic_first(NUM), *_logistic_second(NUM), final=f"SELECT feature, {r6('w')} AS w FROM m1"))
def logistic_two_steps(spark, sf_dir):
    return rounded(two_logistic(spark, sf_dir).model, "w")


CLASS_HALVES = CLASSES + ", b0 AS (SELECT * FROM ex WHERE example_id % 2 = 0), b1 AS (SELECT * FROM ex WHERE example_id % 2 = 1)"


def class_deltas_sql(examples: str, z: str | None, cfg: SketchConfig, name: str) -> str:
    """name: feature, class, delta.  z: example_id, class, z, of all classes."""
    if z is None:
        p = f"SELECT DISTINCT e.example_id, e.label, k.class, {1 / cfg.n_classes!r}::DOUBLE AS p FROM {examples} e CROSS JOIN kinds k"
    else:
        p = f"SELECT example_id, label, class, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS p FROM {z} WINDOW w AS (PARTITION BY example_id)"
    return f"""{name}_p AS MATERIALIZED ({p}),
{name} AS MATERIALIZED (
  SELECT e.feature, p.class, sum((p.p - (p.class = p.label)::INT) * e.x) * -{cfg.lr}::DOUBLE AS delta FROM {examples} e JOIN {name}_p p USING (example_id) GROUP BY e.feature, p.class
)"""


def logits_sql(examples: str, contributions: str, name: str) -> str:
    """contributions: a select of example_id, class, w."""
    return f"""{name}_c AS ({contributions}),
{name} AS MATERIALIZED (
  SELECT e.example_id, e.label, k.class, coalesce(sum(c.w), 0.0) AS z FROM (SELECT DISTINCT example_id, label FROM {examples}) e CROSS JOIN kinds k
  LEFT JOIN {name}_c c ON c.example_id = e.example_id AND c.class = k.class GROUP BY e.example_id, e.label, k.class
)"""


def predict_sql(z: str) -> str:
    return f"""SELECT example_id, label, CASE WHEN max(z) > 1.17549435e-38 THEN min(CASE WHEN z = top THEN class END) ELSE 0 END AS prediction
FROM (SELECT *, max(z) OVER (PARTITION BY example_id) AS top FROM {z}) GROUP BY example_id, label"""


HASHED = (
    CLASS_HALVES,
    bucket_sql(MULTI, "int"),
    class_deltas_sql("b0", None, MULTI, "d0"),
    "t0 AS MATERIALIZED (SELECT b, class, sum(delta) AS w FROM d0 JOIN bk USING (feature) GROUP BY b, class)",
    logits_sql("b1", "SELECT example_id, class, w * x AS w FROM b1 JOIN bk USING (feature) JOIN t0 USING (b)", "z1"),
)


HASHED_SECOND = (
    class_deltas_sql("b1", "z1", MULTI, "d1"),
    "t1 AS MATERIALIZED (SELECT b, class, sum(w) AS w FROM (SELECT b, class, w FROM t0 UNION ALL SELECT b, class, delta FROM d1 JOIN bk USING (feature)) GROUP BY b, class)",
)


def two_hashed(spark, sf_dir):
    return two_steps(bt.hashed_step, None, classes(spark, sf_dir), MULTI)


@query(with_sql(*HASHED, *HASHED_SECOND, final=f"SELECT b, class, {r6('w')} AS w FROM t1"))
def fh_step(spark, sf_dir):
    return rounded(two_hashed(spark, sf_dir), "w")


FIRST_CLASS = (
    CLASS_HALVES,
    cells_sql(MULTI, "int"),
    class_deltas_sql("b0", None, MULTI, "d0"),
    sketch_sql("d0", "s0", ", class"),
    estimate_sql("d0", "s0", MULTI, "e0", True),
)
FINE = (
    *FIRST_CLASS,
    top_class_sql("e0", MULTI.k, "m0"),
    f"low AS (SELECT class, CASE WHEN count(*) < {MULTI.k} THEN 0.0 ELSE min(abs(w)) END AS low FROM m0 GROUP BY class)",
)
FINE_SECOND = (
    estimate_sql("b1", "s0", MULTI, "q1", True),
    logits_sql("b1", "SELECT example_id, q1.class, w * x AS w FROM b1 JOIN q1 USING (feature) LEFT JOIN low ON low.class = q1.class WHERE round(abs(w), 12) >= round(coalesce(low, 0), 12)", "z1"),
    class_deltas_sql("b1", "z1", MULTI, "d1"),
    sketch_sql("d1", "s1", ", class", old="s0"),
    estimate_sql("d1", "s1", MULTI, "e1", True),
    "c1 AS (SELECT class, feature, w FROM e1 UNION ALL SELECT class, feature, w FROM m0 WHERE feature NOT IN (SELECT feature FROM d1))",
    top_class_sql("c1", MULTI.k, "m1"),
)


def two_fine(spark, sf_dir):
    return two_steps(bt.fine_step, bt.State(), classes(spark, sf_dir), MULTI)


@query(with_sql(*FINE, *FINE_SECOND, final=f"SELECT class, feature, {r6('w')} AS w FROM m1"))
def fine_step(spark, sf_dir):
    return rounded(two_fine(spark, sf_dir).model, "w").select("class", "feature", "w")


COARSE = (*FIRST_CLASS, "l0 AS (SELECT feature, sum(abs(w)) AS w FROM e0 GROUP BY feature)", top_sql("l0", MULTI.k, "m0"))
COARSE_SCORES = (
    "a1 AS (SELECT * FROM b1 WHERE feature IN (SELECT feature FROM m0))",
    estimate_sql("a1", "s0", MULTI, "q1", True),
    logits_sql("b1", "SELECT example_id, class, w * x AS w FROM a1 JOIN q1 USING (feature)", "z1"),
)


COARSE_SECOND = (
    class_deltas_sql("b1", "z1", MULTI, "d1"),
    sketch_sql("d1", "s1", ", class", old="s0"),
    estimate_sql("d1", "s1", MULTI, "e1", True),
    "c1 AS (SELECT feature, sum(abs(w)) AS w FROM e1 GROUP BY feature UNION ALL SELECT feature, w FROM m0 WHERE feature NOT IN (SELECT feature FROM d1))",
    top_sql("c1", MULTI.k, "m1"),
)


def two_coarse(spark, sf_dir):
    return two_steps(bt.coarse_step, bt.State(), classes(spark, sf_dir), MULTI)


@query(with_sql(*COARSE, *COARSE_SCORES, *COARSE_SECOND, final=f"SELECT feature, {r6('w')} AS w FROM m1"))
def coarse_step(spark, sf_dir):
    return rounded(two_coarse(spark, sf_dir).model, "w")


def _p_sql(model: str, name: str) -> str:
    return f"{name} AS (SELECT example_id, label, 1 / (1 + exp(-sum(coalesce({model}.w, 0) * x))) AS p FROM ex LEFT JOIN {model} USING (feature) GROUP BY example_id, label)"


@query(
    with_sql(
        HALVES,
        *_logistic_first(NUM),
        *_logistic_second(NUM),
        _p_sql("m1", "zp"),
        "r AS (SELECT (example_id // 100)::BIGINT AS batch_id, CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END AS loss FROM zp)",
        final=f"SELECT batch_id, (sum(count(*)) OVER (ORDER BY batch_id))::BIGINT AS cnt, {r6('-avg(loss)')} AS avg_loss FROM r GROUP BY batch_id",
    )
)
def batch_loss_log(spark, sf_dir):
    scores = bt.logistic_scores(numeric(spark, sf_dir), two_logistic(spark, sf_dir).model)
    rows = scores.select(bt.batch_of(F.col("example_id") + 1, NUM.but(batch_rows=100)).alias("batch_id"), link.log_likelihood(F.col("label"), F.col("p")).alias("loss"))
    return rounded(bt.loss_log(rows), "avg_loss")


@query("SELECT batch_id, rows, (sum(rows) OVER (ORDER BY batch_id))::BIGINT AS rows_read FROM (SELECT (event_id // 1000)::BIGINT AS batch_id, count(DISTINCT event_id) AS rows FROM events GROUP BY 1)")
def rows_read(spark, sf_dir):
    """The reader's row counter, by batch."""
    return bt.rows_read(numeric(spark, sf_dir), NUM.but(batch_rows=1000))


# Prediction: trained on both batches, applied to all examples


@query(with_sql(HALVES, *_logistic_first(NUM), *_logistic_second(NUM), _p_sql("m1", "zp"), final=f"SELECT example_id, label, {r6('p')} AS p FROM zp"))
def predict_logistic(spark, sf_dir):
    return rounded(bt.predict_logistic(numeric(spark, sf_dir), two_logistic(spark, sf_dir).model), "p")


def _predict_sql(contributions: str, name: str = "zz") -> tuple[str, str]:
    """Logits of all examples, rounded before they are compared, as the library compares them."""
    return logits_sql("ex", contributions, name), f"{name}r AS (SELECT example_id, label, class, round(z, {RANK}) AS z FROM {name})"


@query(with_sql(*HASHED, *HASHED_SECOND, *_predict_sql("SELECT example_id, class, w * x AS w FROM ex JOIN bk USING (feature) JOIN t1 USING (b)"), final=predict_sql("zzr")))
def predict_fh(spark, sf_dir):
    return bt.predict_hashed(classes(spark, sf_dir), two_hashed(spark, sf_dir), MULTI)


@query(with_sql(*FINE, *FINE_SECOND, *_predict_sql("SELECT example_id, m1.class, w * x AS w FROM ex JOIN m1 USING (feature)"), final=predict_sql("zzr")))
def predict_fine(spark, sf_dir):
    return bt.predict_fine(classes(spark, sf_dir), two_fine(spark, sf_dir).model, MULTI)


@query(
    with_sql(
        *COARSE,
        *COARSE_SCORES,
        *COARSE_SECOND,
        "aa AS (SELECT * FROM ex WHERE feature IN (SELECT feature FROM m1))",
        estimate_sql("aa", "s1", MULTI, "qq", True),
        *_predict_sql("SELECT example_id, class, w * x AS w FROM aa JOIN qq USING (feature)"),
        final=predict_sql("zzr"),
    )
)
def predict_coarse(spark, sf_dir):
    return bt.predict_coarse(classes(spark, sf_dir), two_coarse(spark, sf_dir), MULTI)


# Programs: train on one part after the other, validate on all examples after each


@query(with_sql(HALVES, *_logistic_first(NUM), *_logistic_second(NUM), _p_sql("m0", "p0"), _p_sql("m1", "p1"), final=f"SELECT 0 AS epoch, example_id, label, {r6('p')} AS p FROM p0 UNION ALL SELECT 1, example_id, label, {r6('p')} FROM p1"))
def epochs_logistic(spark, sf_dir):
    e, keep = numeric(spark, sf_dir), keeper(spark)
    step = lambda part, state: bt.logistic_step(part, state, NUM, keep=keep)
    settle = lambda state, _: bt.State(state.sketch, keep(state.model, "model"))
    out = bt.fit_validate([half(e, 0), half(e, 1)], e, step, bt.State(), lambda test, state: bt.predict_logistic(test, state.model), settle)
    return rounded(out, "p").select("epoch", "example_id", "label", "p")


@query(
    with_sql(
        *COARSE,
        *COARSE_SCORES,
        *COARSE_SECOND,
        "a0 AS (SELECT * FROM ex WHERE feature IN (SELECT feature FROM m0))",
        estimate_sql("a0", "s0", MULTI, "q0", True),
        *_predict_sql("SELECT example_id, class, w * x AS w FROM a0 JOIN q0 USING (feature)", "y0"),
        "aa AS (SELECT * FROM ex WHERE feature IN (SELECT feature FROM m1))",
        estimate_sql("aa", "s1", MULTI, "qq", True),
        *_predict_sql("SELECT example_id, class, w * x AS w FROM aa JOIN qq USING (feature)", "y1"),
        final=f"SELECT 0 AS epoch, * FROM ({predict_sql('y0r')}) UNION ALL SELECT 1, * FROM ({predict_sql('y1r')})",
    )
)
def epochs_coarse(spark, sf_dir):
    e, keep = classes(spark, sf_dir), keeper(spark)
    step = lambda part, state: bt.coarse_step(part, state, MULTI, keep=keep)
    settle = lambda state, _: bt.State(state.sketch, keep(state.model, "model"))
    out = bt.fit_validate([half(e, 0), half(e, 1)], e, step, bt.State(), lambda test, state: bt.predict_coarse(test, state, MULTI), settle)
    return out.select("epoch", "example_id", "label", "prediction")


# Ordered training.  The heaps' order of equal weights has no SQL: these are tested against a plain trainer.


@query()
def online_logistic(spark, sf_dir):
    return on.fit_online(numeric(spark, sf_dir), BIN.but(k=63), "logistic").select("feature", "w")


@query()
def online_fine(spark, sf_dir):
    return on.fit_online(classes(spark, sf_dir), MULTI.but(k=31), "fine")


@query()
def online_coarse(spark, sf_dir):
    return on.fit_online(classes(spark, sf_dir), MULTI.but(k=31), "coarse").select("feature", "w")


@query()
def parallel_logistic(spark, sf_dir):
    """Four ordered workers, merged."""
    return on.fit_parallel(numeric(spark, sf_dir), BIN.but(k=63), "logistic", 4)[1].select("feature", "w")


# Plain hashed weights have no heap: the ordered trainer is a recursion over the examples, one a step.

HASHED_RATE = MULTI.but(lr=0.05)


def _ordered_hashed(parts: str, final: str) -> str:
    """state: part, w (the weights after the part's last example, bucket by bucket); parts: a select of example_id, part."""
    k, lr = MULTI.n_classes, HASHED_RATE.lr
    row = lambda w, b: f"{w}[{b} * {k} + 1:{b} * {k} + {k}]"
    put = lambda w, b: f"list_concat(list_concat({w}[1:{b} * {k}], [{row(w, b)}[j] + d[j] FOR j IN range(1, {k + 1})]), {w}[{b} * {k} + {k + 1}:])"
    return "WITH RECURSIVE " + ",\n".join(
        [
            CLASSES,
            bucket_sql(MULTI, "int"),
            f"seq AS MATERIALIZED (SELECT row_number() OVER (ORDER BY part, example_id) AS i, part, label, b1, b2 FROM (SELECT example_id, label, arg_min(b, feature) AS b1, arg_max(b, feature) AS b2 FROM ex JOIN bk USING (feature) GROUP BY ALL) JOIN ({parts}) USING (example_id))",
            f"""state(part, i, w) USING KEY (part) AS (
  SELECT -1::BIGINT, 0::BIGINT, [0.0::DOUBLE FOR j IN range({MULTI.n_buckets * k})]
  UNION ALL
  SELECT part, i, {put("w1", "b2")} FROM (
    SELECT part, i, b2, d, {put("w", "b1")} AS w1 FROM (
      SELECT part, i, b1, b2, w, [(e[j] / list_sum(e) - (j = label + 1)::INT) * -{lr}::DOUBLE FOR j IN range(1, {k + 1})] AS d FROM (
        SELECT *, [exp(x - list_max(z)) FOR x IN z] AS e FROM (
          SELECT s.part, s.i, s.label, s.b1, s.b2, t.w, [{row("t.w", "s.b1")}[j] + {row("t.w", "s.b2")}[j] FOR j IN range(1, {k + 1})] AS z FROM state t JOIN seq s ON s.i = t.i + 1)))))""",
            final,
        ]
    )


PREDICTED = f"""zr AS (
  SELECT part AS epoch, example_id, label, unnest(range({MULTI.n_classes}))::INT AS class,
    unnest([round(w[b1 * {MULTI.n_classes} + j] + w[b2 * {MULTI.n_classes} + j], {RANK}) FOR j IN range(1, {MULTI.n_classes + 1})]) AS z
  FROM state CROSS JOIN (SELECT example_id, label, arg_min(b, feature) AS b1, arg_max(b, feature) AS b2 FROM ex JOIN bk USING (feature) GROUP BY ALL) WHERE part >= 0
)
SELECT epoch::INT AS epoch, example_id, label, CASE WHEN max(z) > 1.17549435e-38 THEN min(CASE WHEN z = top THEN class END) ELSE 0 END AS prediction
FROM (SELECT *, max(z) OVER (PARTITION BY epoch, example_id) AS top FROM zr) GROUP BY epoch, example_id, label"""


@query(
    _ordered_hashed(
        "SELECT event_id AS example_id, 0::BIGINT AS part FROM events",
        f"cell AS (SELECT (unnest(range(len(w))) // {MULTI.n_classes})::INT AS b, (unnest(range(len(w))) % {MULTI.n_classes})::INT AS class, unnest(w) AS w FROM state WHERE part = 0)\nSELECT b, class, {r6('w')} AS w FROM cell WHERE w <> 0",
    )
)
def online_hashed(spark, sf_dir):
    return rounded(on.fit_online(classes(spark, sf_dir), HASHED_RATE, "hashed").select(F.col("feature").alias("b"), "class", "w"), "w")


@query(_ordered_hashed("SELECT event_id AS example_id, 0::BIGINT AS part FROM events", PREDICTED))
def train_test_hashed(spark, sf_dir):
    """One pass in order, then predictions."""
    e = classes(spark, sf_dir)
    return on.fit_predict_online([e], e, HASHED_RATE, "hashed").select("epoch", "example_id", "label", "prediction")


@query(_ordered_hashed("SELECT event_id AS example_id, event_id % 2 AS part FROM events", PREDICTED))
def epochs_hashed(spark, sf_dir):
    """Two parts in order, with predictions after each."""
    e = classes(spark, sf_dir)
    return on.fit_predict_online([half(e, 0), half(e, 1)], e, HASHED_RATE, "hashed").select("epoch", "example_id", "label", "prediction")


# Persistence and streaming


def _saved(spark, cfg, **tables):
    path = f"{scratch(spark)}/model-{uuid.uuid4().hex}"
    model_io.save(path, cfg, **tables)
    return path


@query(with_sql(*FIRST_STEP, top_sql("est", BIN.k, "model"), final="SELECT feature, w FROM model"))
def model_roundtrip(spark, sf_dir):
    state = _first_step(spark, sf_dir)
    return model_io.load(spark, _saved(spark, BIN, sketch=state.sketch, model=state.model), BIN, "model")["model"]


@query(_quantity_sql(BIN, final="SELECT r, b, w FROM sketch"))
def sketch_roundtrip(spark, sf_dir):
    return model_io.load(spark, _saved(spark, BIN, sketch=sketch_build(spark, sf_dir)), BIN, "sketch")["sketch"]


@query(with_sql(QUANTITY, bucket_sql(BIN, "int", "dl"), final="SELECT b, sum(delta) AS w FROM dl JOIN bk USING (feature) GROUP BY b"))
def hashed_roundtrip(spark, sf_dir):
    return model_io.load(spark, _saved(spark, BIN, hashed=hashed_table(spark, sf_dir)), BIN, "hashed")["hashed"]


def _streamed(spark, sf_dir, batches):
    """The trainer after a stream of one file per batch, one file a time."""
    path = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    trainer = StreamTrainer(f"{path}/state", NUM, batch_files=1)
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(f"{path}/in")
    trainer.run(trainer.source(spark, "example_id long, label int, feature int, x double", f"{path}/in"), f"{path}/checkpoint")
    return trainer


@query(with_sql(NUMERIC, *_logistic_first(NUM, "ex"), final=f"SELECT feature, {r6('w')} AS w FROM m0"))
def stream_logistic(spark, sf_dir):
    """The stream of one micro-batch of all examples."""
    return rounded(_streamed(spark, sf_dir, [numeric(spark, sf_dir)]).state(spark, 0).model, "w")


@query(with_sql(HALVES, *_logistic_first(NUM), *_logistic_second(NUM), final=f"SELECT feature, {r6('w')} AS w FROM m1"))
def stream_batches(spark, sf_dir):
    """A stream of two micro-batches of one file each, with the state kept between them."""
    e = numeric(spark, sf_dir)
    return rounded(_streamed(spark, sf_dir, [half(e, 0), half(e, 1)]).state(spark, 1).model, "w")
