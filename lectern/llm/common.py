"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset, a local session gets a new one and a cluster an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a slim intermediate table to the shared folder and reads it back, which cuts lineage and survives lost executors."""
    spark, where = df.sparkSession, new_folder(df.sparkSession, label)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def slices(texts: list[str], chars: int = 300_000) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters: what a Python worker takes apart at a time. Spark bounds whole Arrow batches by bytes."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def words(text):
    """Words of a text column as an array; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have: the given one, or with underscores."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
