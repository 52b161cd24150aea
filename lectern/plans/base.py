"""Registration of queries with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.shared import new_folder
from lectern.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Views:
    """Views and tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def folder(v: Views) -> str:
    return new_folder(v.spark)


def query(name: str, sql: str | None = None, *views: str, digits: int = 6):
    """Registers fn(views) under a name. Doubles are rounded, as sums of doubles depend on the order."""

    def add(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Views(spark, sf_dir))
            return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"}) if any(t == "double" for _, t in df.dtypes) else df

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE[name] = with_views(sql, *views) if views else sql
        return fn

    return add
