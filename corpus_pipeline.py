"""A corpus pipeline over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.  Decisions are made for
rows, by a number that every row has within a stage: rows repeated with one
doc_id, or without one, are rows of their own, and of equal texts one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchweave.llm.common import Scratch, delete
from sketchweave.llm.exact_dedup import exact_dedup
from sketchweave.llm.jaccard_join import jaccard_components
from sketchweave.llm.mixing import mix
from sketchweave.llm.packing import pack_documents
from sketchweave.llm.quality import classify
from sketchweave.llm.queries import tokenizer_file

#: Near duplicates: words of a shingle, and the similarity in per cent from which one document of a group stays.
SHINGLE, SIMILARITY = 5, 80


def _numbered(docs: DataFrame) -> DataFrame:
    """With a number of its own for every row, the same in every scan of the stage's input."""
    return docs.withColumn("_row", F.monotonically_increasing_id())


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of numbered ``docs`` whose number is in ``rows`` (_row)."""
    return docs.join(rows.select("_row"), "_row", "left_semi").drop("_row")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).where("predicted = 1").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays (of equal ids, the last one)."""
    docs = _numbered(docs)
    keyed = docs.select(F.struct("doc_id", "_row").alias("key"), "text")
    return _only(docs, exact_dedup(keyed, id_col="key", keep="max").where("kept").select("key._row"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts, the first row stays."""
    docs = _numbered(docs)
    groups = jaccard_components(docs, id_col="_row", width=SHINGLE, percent=SIMILARITY)
    return _only(docs, groups.where("_row = component_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    columns, docs = docs.columns, _numbered(docs)
    copies = mix(docs, id_col="_row").where("copies > 0").select("_row", "copies")
    # Copies grow with the documents, so they are shuffled at every size and never broadcast.
    placed = docs.join(copies.hint("shuffle_merge"), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return placed.select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality", good_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others kept; a stage's table goes when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            scratch = Scratch(spark, f"stage-{i}")
            docs = scratch.table(docs, "rows")
            if last:
                delete(last.path, spark)
            last = scratch
    return docs
