"""Quality rules with a hashed n-gram log-likelihood ratio between trusted and raw text.

N-grams are single words, word endings and adjacent word pairs, hashed into ``buckets``. The raw multinomial
counts the n-grams of every document; the trusted one those of a bounded sample of documents labelled good
(``trusted_docs``, a documented bound of the fit). A document's score is the mean of
log(p_trusted / p_raw) over its n-grams, so it doesn't depend on length. It is kept where the score is at
least ``threshold``, a fixed number that every document is held against, and where no base rule fails.

Only the bucket table, of fixed size, passes through the driver.

Defined results: null or blank text has no words, score 0 and fails the base rules; repeated rows are judged
alike; without labels or documents all ratios are 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

BUCKETS = 16_384
TRUSTED_DOCS = 20_000
THRESHOLD = -0.25
SYMBOLS = r"[#*$%&|<>]"


def hashes(w):
    return F.transform(w, lambda x: F.xxhash64(x))


def ending(w):
    """The hash of a word's last two characters."""
    return F.xxhash64(F.right(w, F.lit(2)), F.lit(1))


def counts(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text), good (distinct doc_id, few) -> bucket, raw, trusted: n-grams of all documents and of the good ones. Words become rows, as those are hashed and counted in generated code and lambdas over arrays aren't."""
    seen = docs.select("doc_id", words(F.col("text")).alias("w")).join(F.broadcast(good.withColumn("trusted", F.lit(1))), "doc_id", "left")
    after = F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1)))
    seen = seen.select("trusted", F.explode(F.arrays_zip(F.col("w").alias("a"), after.alias("b"))).alias("x")).select("trusted", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    place = lambda h: F.pmod(h, F.lit(buckets))
    # The last word has no pair; xxhash64 would skip the null.
    pair = F.when(F.col("b").isNotNull(), place(F.xxhash64(F.xxhash64("a"), F.xxhash64("b"))))
    seen = seen.select("trusted", place(F.xxhash64("a")).alias("one"), place(ending(F.col("a"))).alias("end"), pair.alias("pair"))
    seen = seen.select("trusted", F.explode(F.array("one", "end", "pair")).alias("bucket")).filter("bucket is not null")
    return seen.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("trusted"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS) -> list[float]:
    """The log ratio of every bucket, from the counts of all documents and of the trusted sample."""
    good = labels.filter("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_docs)
    rows = counts(docs, good, buckets).collect()
    raw_all, trusted_all = sum(r.raw for r in rows) + buckets, sum(r.trusted for r in rows) + buckets
    out = [0.0] * buckets
    if trusted_all > buckets:
        from math import log

        for r in rows:
            out[r.bucket] = round(log((r.trusted + 1) / trusted_all) - log((r.raw + 1) / raw_all), 4)
    return out


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text -> the same with words w, their hashes h, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "text").withColumn("w", words(F.col("text"))).withColumn("h", hashes(F.col("w")))
    n = F.size("w")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.expr("case when size(w) < 5 then array() else transform(sequence(1, size(w) - 4), i -> xxhash64(h[i-1], h[i], h[i+1], h[i+2], h[i+3])) end")
    d = d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "lines": lines,
        "windows": windows,
    })
    # Windows sorted with their places: those equal to a neighbour are repeated; each covers 5 words, less what the next one covers.
    sorted_windows = F.expr("array_sort(transform(windows, (h, i) -> struct(h, i)))")
    repeated = F.expr("array_sort(transform(filter(transform(s, (x, j) -> struct(x.i as i, (j > 0 and s[j - 1].h = x.h) or (j + 1 < size(s) and s[j + 1].h = x.h) as r)), x -> x.r), x -> x.i))")
    covered = F.expr("aggregate(transform(rep, (p, j) -> if(j + 1 < size(rep), least(5, rep[j + 1] - p), 5)), 0L, (a, x) -> a + x)")
    d = d.withColumn("s", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), sorted_windows)).withColumn("rep", F.when(F.col("s").isNotNull(), repeated))
    d = d.withColumns({
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("lines", "windows", "s", "rep")
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def judge(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs -> the base columns, llr (mean log ratio) and kept."""
    d = base_columns(docs)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    ratio = lambda h: F.get(table, F.pmod(h, F.lit(len(ratios))).cast("int"))
    # A pair's hash comes from those of its words.
    pairs = F.expr("case when size(h) < 2 then array() else transform(slice(h, 2, size(h) - 1), (x, i) -> xxhash64(h[i], x)) end")
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + ratio(x))
    total = F.aggregate("w", total, lambda a, x: a + ratio(ending(x)))
    total = F.aggregate(pairs, total, lambda a, x: a + ratio(x))
    n = 2 * F.size("w") + F.greatest(F.size("w") - 1, F.lit(0))
    d = d.withColumn("llr", F.when(F.size("w") > 0, total / n).otherwise(0.0))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("w", "h")


def op10_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ratios = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return judge(docs, ratios).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
