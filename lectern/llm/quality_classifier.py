"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed byte pairs, hashed words and a few shape terms (length class, shares of doubled
words, of repeated lines and of repeated five-word windows). Term weights are square roots of shares times inverse document
frequency. The fit takes a bounded sample of labelled rows (``FIT_ROWS``, smallest hash first), finds the
leading right singular vectors of their term matrix, and keeps the rows' unit vectors there with their labels.
These, of fixed size, are broadcast. Every document is projected, its exact cosine with every labelled vector
is computed in blocks, and the labels of its ``NEIGHBOURS`` nearest (ties at the last place included) vote with
the fourth power of their cosine.

Defined results: null text is empty; an empty text has its shape terms alone and is scored like any other;
repeated rows and equal texts get equal scores; rows whose label is null aren't learnt from; with no labelled
rows every score is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS, DIMENSIONS, NEIGHBOURS, THRESHOLD = 3000, 32, 25, 0.7
PAIRS, WORDS, SHAPES = 1024, 1024, 32
TERMS = PAIRS + WORDS + SHAPES
BLOCK = 512


def terms(text: str | None) -> np.ndarray:
    """Square roots of term shares of a whole text, as float32."""
    raw = (text or "").encode()
    out = np.zeros(TERMS, dtype=np.float32)
    a = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(a) > 1:
        pair = ((a[:-1] * 256 + a[1:]) * np.uint32(2654435761)) >> np.uint32(22)
        out[:PAIRS] = np.bincount(pair, minlength=PAIRS) / len(pair)
    words = raw.split()
    if words:
        hashes = np.array([crc32(w) for w in words], dtype=np.uint64)
        out[PAIRS : PAIRS + WORDS] = np.bincount((hashes % WORDS).astype(np.int64), minlength=WORDS) / len(words)
        out[-3] = np.mean(hashes[1:] == hashes[:-1]) if len(words) > 1 else 0
        if len(words) >= 5:
            windows = np.zeros(len(words) - 4, dtype=np.uint64)
            for k in range(5):
                windows = windows * np.uint64(1_000_003) + hashes[k : len(words) - 4 + k]
            out[-1] = 1 - len(np.unique(windows)) / len(windows)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[-2] = 1 - len(set(lines)) / len(lines)
    out[PAIRS + WORDS + min(len(words).bit_length(), SHAPES - 4)] = 0.05
    return np.sqrt(out)


@dataclass
class Model:
    weights: np.ndarray  # terms: idf
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # rows x dimensions, of unit length
    labels: np.ndarray

    def project(self, matrix: np.ndarray) -> np.ndarray:
        v = (matrix * self.weights) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        """Votes for a block of term vectors."""
        if not len(self.labels):
            return np.full(len(matrix), 0.5)
        cosines = self.project(matrix) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        last = np.partition(cosines, -k, axis=1)[:, -k][:, None]
        votes = np.where(cosines >= last, np.maximum(cosines, 1e-6) ** 4, 0)
        return np.clip(votes @ self.labels / votes.sum(axis=1), 0, 1).astype(float)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, dimensions: int = DIMENSIONS) -> Model:
    """doc_id, text and doc_id, quality -> the model, from at most ``rows`` labelled rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "quality": b.quality, "terms": [terms(t).astype(np.float16).tobytes() for t in b.text]})

    sample = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # One row for a doc_id that comes with several texts: any number of repeated rows can't outgrow the bound.
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInPandas(run, "doc_id long, quality int, terms binary").groupBy("doc_id", "quality").agg(F.min("terms").alias("terms"))
    got = found.orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r.terms, dtype=np.float16) for r in got], dtype=np.float32).reshape(len(got), TERMS)
    y = np.array([r.quality for r in got], dtype=np.float32)
    weights = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    _, axes = np.linalg.eigh((x * weights).T @ (x * weights))
    model = Model(weights, np.ascontiguousarray(axes[:, ::-1][:, :dimensions], dtype=np.float32), np.zeros((0, dimensions), np.float32), y)
    model.vectors = model.project(x).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of every document, between 0 and 1, in place of any column of that name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for batch in batches:
            texts = batch.fillna("").tolist()
            blocks = [m.scores(np.array([terms(t) for t in texts[k : k + BLOCK]])) for k in range(0, len(texts), BLOCK)]
            yield pd.Series(np.concatenate(blocks) if blocks else [], dtype="float64")

    return docs.withColumn(out, F.pandas_udf(run, "double")(F.col(text)))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op4_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels.filter(~held_out()))
    scored = score(docs, model).select("doc_id", held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
