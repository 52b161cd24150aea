"""Language identification by multilingual mixture inference.

A document is a bag of letter trigrams (lower-cased words of letters, a blank before, between and behind them),
drawn from a mixture of languages whose trigram probabilities were learnt beforehand. Expectation maximisation
estimates the document's language proportions. The language set starts with all learnt languages; the one of
least share is left out again and again, proportions being estimated anew, and the set with the largest
likelihood less ``PENALTY`` * ln(1 + trigrams) for each language is kept. The prediction is the language with the largest share
in that set, and the score is that share.

The model is fitted on a bounded sample: for each of the ``LANGUAGES`` most frequent languages, the ``FIT_ROWS`` different documents with
the smallest hashes. Trigrams are hashed to ``BUCKETS`` counts, so the broadcast model has a fixed largest size (16 MB).

Defined results: a text that is null or has no letter gets ``und``, score 0 and no languages; where no language has been learnt, so
does every text; rows without a language aren't learnt from; repeated rows and equal texts get equal results and are learnt from once; ties
of shares go to the language that comes first by code point; very long texts are counted as a whole, in a table of fixed
size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

BUCKETS = 1 << 16
LANGUAGES, FIT_ROWS, SALTS = 64, 500, 16
#: Added to every count, so that no trigram is impossible.
SMOOTHING = 0.05
PENALTY = 8.0
#: Expectation maximisation ends when no share moves by more than this, or after so many rounds.
SETTLED, ROUNDS = 1e-4, 100
UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's trigrams and their counts; both empty where it has no letter."""
    words = WORDS.findall((text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return np.zeros(0, np.int64), np.zeros(0)
    a = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), dtype="<u4")
    mixed = a[:-2] * np.uint32(2654435761) + a[1:-1] * np.uint32(2246822519) + a[2:] * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    counts = np.bincount((mixed * np.uint32(668265263)) >> np.uint32(16), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(float)


def proportions(p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation maximisation. p: languages x trigrams -> shares of the languages, log-likelihood."""
    shares, n = np.full(len(p), 1 / len(p)), counts.sum()
    if len(p) > 1:
        for _ in range(ROUNDS):
            before = shares
            shares = shares * (p @ (counts / (shares @ p))) / n
            if np.abs(shares - before).max() < SETTLED:
                break
    return shares, float(counts @ np.log(shares @ p))


@dataclass
class Model:
    languages: list[str]  # by code point
    p: np.ndarray  # languages x buckets

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """The languages of a text with their shares, the largest first."""
        at, counts = trigrams(text)
        if not len(at) or not self.languages:
            return []
        p, names = self.p[:, at].astype(float), np.arange(len(self.languages))
        price = PENALTY * np.log1p(counts.sum())
        shares, fit = proportions(p, counts)
        best, kept = fit - price * len(names), (names, shares)
        while len(names) > 1:
            left = np.delete(np.arange(len(names)), np.argmin(shares))
            names, p = names[left], p[left]
            shares, fit = proportions(p, counts)
            if fit - price * len(names) >= best:
                best, kept = fit - price * len(names), (names, shares)
        found = [(round(float(s), 6), self.languages[k]) for k, s in zip(*kept)]
        return [(name, s) for s, name in sorted(found, key=lambda x: (-x[0], x[1]))]


def fit(docs: DataFrame, languages: int = LANGUAGES, rows: int = FIT_ROWS) -> Model:
    """text, lang -> the model. Hashes and languages alone are counted and ranked; texts are read for the sample only."""
    known = docs.filter("lang is not null").select("lang", "text", F.xxhash64("lang", "text").alias("key"))
    most = [r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    # The least hashes of a frequent language are found in SALTS parts of it first.
    part = F.row_number().over(Window.partitionBy("lang", F.pmod("key", F.lit(SALTS))).orderBy("key"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    different = known.filter(F.col("lang").isin(most)).groupBy("lang", "key").count()
    few = different.withColumn("part", part).filter(F.col("part") <= rows)
    keys = few.withColumn("rank", rank).filter(F.col("rank") <= rows).select("lang", "key")
    sample = known.join(F.broadcast(keys), ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.lang, b.text):
                at, counts = trigrams(text)
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += counts.astype(np.int64)
        for lang, counts in sums.items():
            yield pd.DataFrame({"lang": [lang], "counts": [counts.tobytes()]})

    # The sample's size is bounded, so a few tasks are enough, each with one row of counts a language.
    found: dict[str, np.ndarray] = {}
    for r in sample.repartition(8, "key").mapInPandas(run, "lang string, counts binary").toLocalIterator():
        found[r.lang] = found.get(r.lang, 0) + np.frombuffer(r.counts, np.int64)
    names = sorted(x for x in found if found[x].sum())
    p = np.zeros((len(names), BUCKETS), np.float32)
    for k, name in enumerate(names):
        p[k] = (found[name] + SMOOTHING) / (found[name].sum() + SMOOTHING * BUCKETS)
    return Model(names, p)


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Adds a struct of lang_pred, score and languages, an array of (lang, share) with the largest share first."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for batch in batches:
            found = [m.mixture(t) for t in batch]
            yield pd.DataFrame({
                "lang_pred": [x[0][0] if x else UNKNOWN for x in found],
                "score": [min(1.0, x[0][1]) if x else 0.0 for x in found],
                "languages": [[{"lang": name, "share": s} for name, s in x] for x in found],
            })

    kind = "lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return docs.withColumn(out, F.pandas_udf(run, kind)(F.col(text)))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op13_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    language = unused(docs, "language")
    return identify(docs, model, out=language).select("doc_id", held_out().alias("held_out"), f"{language}.*")
