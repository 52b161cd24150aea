"""Tables that an operator writes once to the folder which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_folder(spark: SparkSession) -> str:
    """A new folder in the session's spark.checkpoint.dir. Where that is unset, a local session gets a new one and a cluster an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written and read back: worked out once however often they are used, with a short lineage."""
    where = new_folder(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """The rows with their number from 1 in an order over all of them.

    They are dealt to ranges in that order, numbered within each, and moved on by the rows of the ranges before: one row a range is all that comes together in a task.
    """
    rows = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = rows.withColumn("_inside", inside).join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return placed.withColumn(name, (F.col("_before") + F.col("_inside")).cast("int")).drop("_range", "_inside", "_before")
