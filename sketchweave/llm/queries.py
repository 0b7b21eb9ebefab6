"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .html_extract import extract_pages
from .jaccard_join import jaccard_components
from .langid import identify
from .license_scan import scan
from .mixing import FACTOR, PRIME, ROWS_PER_SLOT, SLOTS, mix, offset_of
from .packing import conversation_examples, pack_documents, pack_examples
from .quality import classify
from .suffix_dedup import dedup_substrings
from .vector_dedup import near_vectors


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_scan_licenses(spark, sf_dir):
    return scan(_documents(spark, sf_dir))


def op2_pack_documents(spark, sf_dir):
    return pack_documents(_documents(spark, sf_dir), tokenizer_file())


def pack_conversations(spark, sf_dir):
    """Conversations under limits on tokens, segments and loss-bearing tokens at once."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return pack_examples(conversation_examples(turns, tokenizer_file()), "conv_id", "tokens", "loss_tokens", segments=16, loss=1024)


def op3_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op4_mix_sources(spark, sf_dir):
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_dedup_substrings(spark, sf_dir):
    return dedup_substrings(_documents(spark, sf_dir)).drop("kept")


def op6_near_vectors(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_identify_language(spark, sf_dir):
    return identify(_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(_documents(spark, sf_dir), keep="max").withColumnRenamed("digest", "text_sha256")


def op9_extract_html(spark, sf_dir):
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_components(_documents(spark, sf_dir))


QUERIES = {
    "op1_scan_licenses": op1_scan_licenses,
    "op2_pack_documents": op2_pack_documents,
    "op3_quality": op3_quality,
    "op4_mix_sources": op4_mix_sources,
    "op5_dedup_substrings": op5_dedup_substrings,
    "op6_near_vectors": op6_near_vectors,
    "op7_identify_language": op7_identify_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_extract_html": op9_extract_html,
    "op10_jaccard_join": op10_jaccard_join,
    "pack_conversations": pack_conversations,
}

ORACLE_SQL = {
    "op4_mix_sources": rf"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), classed AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) * 4 + ((size * 4) >> (length(bin(size)) - 1)::INT) % 4 END AS cls,
    (coalesce(doc_id, size) % {PRIME} + {PRIME}) % {PRIME} * {FACTOR} % {PRIME} % greatest({SLOTS}, (SELECT count(*) // {ROWS_PER_SLOT} FROM documents)) AS slot
  FROM base
), weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM base GROUP BY source
), ranked AS (
  SELECT *, (source_size * 3)::DOUBLE / w AS rank FROM weighed
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighed) - coalesce(sum(source_size * 3) OVER (ORDER BY rank, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY rank, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ranked
), targets AS (
  SELECT source, source_size, coalesce(least((source_size * 3)::DOUBLE, (SELECT max(level) FROM levels WHERE level <= rank) * w), 0.0)::DOUBLE AS target FROM ranked
), placed AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END::DOUBLE AS rate,
    (row_number() OVER (PARTITION BY c.source ORDER BY c.cls, c.slot, c.size, c.doc_id NULLS FIRST))::DOUBLE AS i
  FROM classed c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (least(floor({offset_of(20)!r}::DOUBLE + rate * i) - floor({offset_of(20)!r}::DOUBLE + rate * (i - 1)), ceil(rate)))::BIGINT * size AS taken
FROM placed
""",
    "op8_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
""",
}
