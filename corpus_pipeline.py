"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` applies them in order; between stages rows are written as Parquet in the shared folder and read back.

Defined results: null texts pass as null until the last stage encodes them as empty; a document of a group of near
duplicates stays if its doc_id is the smallest, nulls last; among rows that share an id, or have none, the hash of
the whole row decides, so different texts under one id all stay and a rerun keeps the same rows; a document that
the mix repeats comes as so many rows; an empty table gives an empty result; extra columns of documents are kept
up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, personal_data, quality_classifier, sentencepiece_codec, simhash
from lectern.llm.common import stored, unused


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_classifier.Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_classifier.fit(docs, labels.filter(~quality_classifier.held_out()))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts."""
    score = unused(docs, "quality_score")
    scored = quality_classifier.score(docs, quality_model(spark, docs, sf_dir), out=score)
    return scored.filter(F.col(score) >= quality_classifier.THRESHOLD).select(*docs.columns)


def row_hash(docs: DataFrame) -> Column:
    """The MD5 of a whole row: a key of its own for every document, with or without a doc_id."""
    others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    return F.unhex(F.md5(F.concat_ws(" ", F.md5("text"), others)))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the smallest by doc_id, nulls last, then by the hash of the row."""
    key = F.struct(F.col("doc_id").isNull().alias("unnumbered"), F.col("doc_id").alias("id"), row_hash(docs).alias("hash"))
    found = simhash.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    own, first_own = unused(docs, "row_hash"), unused(docs, "first_hash")
    first = stored(found.filter("doc_id = component_id").groupBy(F.col("doc_id.hash").alias(first_own)).agg(F.count("*").alias("copies")), "first")
    # As many rows as documents stay, so neither side is broadcast at any size.
    hashed = docs.withColumn(own, row_hash(docs))
    kept = hashed.join(first.select(first_own).hint("merge"), F.col(own) == F.col(first_own), "left_semi")
    # Rows that share a hash are alike in all columns.
    return (kept if first.filter("copies > 1").isEmpty() else kept.dropDuplicates([own])).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    out = personal_data.redact(docs, personal_data.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document as many rows as the mix takes of it, weighed by what its text is like (``mixing.text_weight``)."""
    own, taken_own, epochs, epoch = (unused(docs, name) for name in ("row_hash", "taken_hash", "mix_epochs", "mix_epoch"))
    hashed = docs.withColumn(own, row_hash(docs))
    taken = mixing.mix(hashed.select("doc_id", "text", "source", own), keep=(own,)).filter("epochs > 0")
    taken = taken.groupBy(F.col(own).alias(taken_own)).agg(F.max("epochs").cast("int").alias(epochs))
    rows = hashed.join(taken.hint("merge"), F.col(own) == F.col(taken_own))
    return rows.withColumn(epoch, F.explode(F.sequence(F.lit(1), epochs))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests and whether decoding gives the text back."""
    return sentencepiece_codec.digests(docs, sentencepiece_codec.model_path(), ("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", deduplicate),
    ("personal_data", redact),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]

#: SQL can't express the classifier, the fingerprints, the field or the tokenizer; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
