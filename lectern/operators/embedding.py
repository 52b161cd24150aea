"""Embedding upkeep and model hooks: each different input goes to the model once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[list[float]]]


def call_model(inputs: DataFrame, model: Model, batch: int = 64, attempts: int = 3, backoff: float = 0.2) -> DataFrame:
    """M1, M4, M5. Inputs (hash, input) with distinct hashes -> hash, vector, error.

    A batch that fails is tried again with growing pauses; when it fails for good its rows carry the error and the run goes on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part, error, vectors = b.iloc[k : k + batch], None, None
                for n in range(attempts):
                    try:
                        vectors, error = model(part.input.tolist()), None
                        break
                    except Exception as e:  # the model's own failures, whatever they are, end up in the rows
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(backoff * 2**n if n + 1 < attempts else 0)
                yield pd.DataFrame({"hash": part.hash.values, "vector": vectors if vectors is not None else [None] * len(part), "error": [error] * len(part)})

    return inputs.select("hash", "input").mapInPandas(run, "hash string, vector array<double>, error string")


def unchanged(wanted: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """M2. Wanted rows (question_id, hash) that have no vector of this model and hash yet."""
    return wanted.join(stored.filter(F.col("model") == model).select("question_id", "hash"), ["question_id", "hash"], "left_anti")


def reusable(stored: DataFrame) -> DataFrame:
    """W1. The newest vector for each model and hash."""
    order = Window.partitionBy("model", "hash").orderBy(F.col("updated_at").desc_nulls_last(), F.col("created_at").desc(), "question_id")
    return stored.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def embed(wanted: DataFrame, stored: DataFrame, name: str, model: Model) -> DataFrame:
    """M1-M4, A15. Wanted (question_id, document_id, hash, input) -> question_id, document_id, hash, outcome, vector, error.

    Unchanged rows are skipped, vectors of an equal hash reused, the rest asked for, each different input once.
    """
    todo = unchanged(wanted, stored, name)
    skipped = wanted.join(todo.select("question_id"), "question_id", "left_anti").select("question_id", "document_id", "hash", F.lit("skipped").alias("outcome"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("error"))
    old = reusable(stored.filter(F.col("model") == name)).select("hash", F.col("vector").alias("old"))
    split = todo.join(old, "hash", "left")
    reused = split.filter("old is not null").select("question_id", "document_id", "hash", F.lit("reused").alias("outcome"), F.col("old").alias("vector"), F.lit(None).cast("string").alias("error"))
    fresh = split.filter("old is null")
    first = Window.partitionBy("hash").orderBy("question_id")
    asked = call_model(fresh.groupBy("hash").agg(F.min("input").alias("input")), model)
    done = fresh.withColumn("place", F.row_number().over(first)).join(asked, "hash")
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("place") == 1, "embedded").otherwise("reused")
    return skipped.unionByName(reused).unionByName(done.select("question_id", "document_id", "hash", outcome.alias("outcome"), "vector", "error"))


def accounting(outcomes: DataFrame) -> DataFrame:
    """A15. Counts of each outcome and the status of each document's run."""
    per = outcomes.groupBy("document_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("embedded", "reused", "skipped", "failed")])
    done = F.col("embedded") + F.col("reused") + F.col("skipped")
    return per.withColumn("status", F.when(F.col("failed") == 0, "completed").when(done > 0, "partial").otherwise("failed"))


def wrong_size(vectors: DataFrame, size: int) -> DataFrame:
    """M9. Vectors that don't have this many numbers."""
    return vectors.filter(F.col("embedding").isNull() | (F.size("embedding") != size))


def label_once(questions: DataFrame, cache: DataFrame, label: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """M6. questions (id, key) and a cache (key, labels) -> (id, labels) and the grown cache; ``label`` gets each new key once."""
    fresh = label(questions.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti"))
    grown = cache.unionByName(fresh.select("key", "labels"))
    return questions.select("id", "key").join(grown, "key").select("id", "labels"), grown


def needs_fallback(questions: DataFrame, least: float = 0.6) -> DataFrame:
    """M7. Documents whose best question is under the confidence."""
    return questions.groupBy("document_id").agg(F.max("confidence").alias("best")).filter(F.col("best") < least)


def changed_documents(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """M8. Documents (document_id, hash) that the manifest doesn't list with this hash."""
    return documents.join(manifest, ["document_id", "hash"], "left_anti")
