"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Words and word shapes of a text are hashed into a fixed number of features,
weighted by log counts and inverse document frequency, and projected on the
leading singular vectors of a bounded sample of labelled texts.  The sample's
vectors are broadcast (their number and width are parameters); each document's
cosine with every one of them is computed exactly, in blocks, and the labels of
the nearest are averaged with weights that grow with similarity.

Defined results: null and empty texts have the zero vector and get the sample's
share of label 1; a null id counts as held out; rows whose label is null or not
0 or 1 are not learned from, and a text with several labels is learned once for
each; with nothing to learn from every score is 1, so that nothing is rejected;
repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import bytehash
from .common import pick
from .langid import held_out
from .ragged import slices, sums, utf8

#: Labelled rows that the fit takes, about (the documented bound of the sample).
FIT_ROWS = 4000
#: Features by kind: words, shapes, order of words.
WORDS, SHAPES, ORDER = 2048, 1536, 16
FEATURES = WORDS + SHAPES + ORDER
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 25, 4
THRESHOLD = 0.3
BLOCK = 512


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word feature, shape feature and hash of distinct words."""
    lower = pc.utf8_lower(words)
    keys = bytehash.strings(*utf8(lower))
    shape = words
    for pattern, mark in ((r"\p{Lu}\p{Lu}+", "X"), (r"\p{Ll}+", "a"), (r"\p{N}+", "9")):
        shape = pc.replace_substring_regex(shape, pattern, mark)
    shapes = bytehash.strings(*utf8(shape))
    return (keys % np.uint64(WORDS)).astype(np.int64), (shapes % np.uint64(SHAPES)).astype(np.int64) + WORDS, keys


def counts(texts: pa.Array):
    """Blocks of (start row, count matrix) of at most BLOCK texts."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    per_text = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words, shapes, keys = word_features(coded.dictionary)
    index = np.asarray(coded.indices)
    real = np.asarray(pc.greater(pc.binary_length(coded.dictionary), 0))[index]
    text_of = np.repeat(np.arange(len(texts)), per_text)
    key = keys[index]
    same = np.zeros((len(index), 2), np.int64)
    for lag in (1, 2):
        same[lag:, lag - 1] = (key[lag:] == key[:-lag]) & (text_of[lag:] == text_of[:-lag])
    repeats = sums(same, per_text)
    bits = lambda x: np.minimum(np.ceil(np.log2(x + 1)), 1023)
    ends = np.cumsum(per_text)
    for a in range(0, len(texts), BLOCK):
        b = min(a + BLOCK, len(texts))
        lo, hi = int(ends[a] - per_text[a]), int(ends[b - 1])
        rows = (text_of[lo:hi] - a) * FEATURES
        ok = real[lo:hi]
        flat = np.concatenate([(rows + words[index[lo:hi]])[ok], (rows + shapes[index[lo:hi]])[ok]])
        m = np.bincount(flat, minlength=(b - a) * FEATURES).reshape(b - a, FEATURES).astype(np.float32)
        m[:, WORDS + SHAPES : WORDS + SHAPES + 2] = repeats[a:b]
        total = np.maximum(per_text[a:b], 1)
        for k, share in enumerate((repeats[a:b, 0] / total, repeats[a:b, 1] / total)):
            m[:, WORDS + SHAPES + 2 + k] = np.where(share > 0.2, bits(per_text[a:b]) * 8, 0)
        yield a, m


class Model:
    """idf (features), basis (features x dimensions), vectors (sample x dimensions, unit length), labels."""

    def __init__(self, idf, basis, vectors, labels):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels

    def project(self, m: np.ndarray) -> np.ndarray:
        v = (np.log1p(m) * self.idf) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for a, m in counts(texts):
            v = self.project(m)
            cosine = v @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** SHARPNESS
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[a : a + len(m)] = np.where(total > 1e-12, vote, self.labels.mean())
        return np.clip(out, 0.0, 1.0)


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 3) -> Model | None:
    if not len(labels):
        return None
    m = np.vstack([block for _, block in counts(texts)])
    idf = (np.log((1 + len(m)) / (1 + (m > 0).sum(axis=0))) + 0.2).astype(np.float32)
    x = np.log1p(m) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rank = min(DIMENSIONS, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, x.shape[0]))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    model = Model(idf, (q @ vt[:rank].T).astype(np.float32), None, labels.astype(np.float64))
    model.vectors = model.project(m).astype(np.float32)
    return model


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int) -> Model | None:
    """docs: id, text, held_out.  labels: id, label.  The sample is chosen by a hash of the id."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).where(~held_out("id"))
    n = known.count()
    share = min(1.0, fit_rows / n) if n else 1.0
    chosen = known.where(F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = [(r[0], int(r[1])) for r in chosen.limit(2 * fit_rows).collect()]
    if not rows:
        return None
    small = docs.sparkSession.createDataFrame(rows, known.schema)
    table = docs.select("id", "text").join(F.broadcast(small), "id").toArrow().sort_by("id")
    return fit(table["text"].combine_chunks(), np.asarray(table["label"].to_numpy(zero_copy_only=False))) if table.num_rows else None


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD, learn_from: DataFrame | None = None) -> DataFrame:
    """All columns of ``df`` and held_out, score, predicted (a column of one of these names is replaced).

    ``learn_from`` has the texts of the labelled rows; it is ``df`` by default.
    """
    source = pick(df if learn_from is None else learn_from, id=id_col, text=text_col)
    model = learn(source, labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")), fit_rows)
    shared = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop("score", "predicted").withColumn("held_out", held_out(id_col))
    at = df.columns.index(text_col)
    schema = StructType([*df.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            for a, b in slices(batch.column(at), 8 << 20):
                part = batch.slice(a, b - a)
                score = np.ones(part.num_rows) if model is None else model.score(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return df.mapInArrow(run, schema)
