"""Streams run to their end over the driver's events, as files that arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.views import SPARK, VIEWS
from lectern.streaming import streams as t

from . import review_plans  # noqa: F401
from .base import ORACLE, folder, query


ARRIVALS, FILES = 4, 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _arriving(v, days_late: int = 0) -> DataFrame:
    """The attempts view as a stream over files of events that come in ARRIVALS micro-batches. Each event comes up to so many days after its time, so that batches hold rows older than those before."""
    where = folder(v)
    events = v.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    comes = F.unix_micros("ts") / 1e6 + F.pmod(F.xxhash64("event_id"), F.lit(86_400 * days_late + 1))
    events = events.withColumn("comes", comes)
    cuts = events.approxQuantile("comes", [k / ARRIVALS for k in range(1, ARRIVALS)], 0.001)
    number = sum((F.col("comes") > c).cast("int") for c in cuts)
    for k in range(ARRIVALS):  # one after another, as streams take files by their age
        events.filter(number == k).drop("comes").repartition(FILES).write.mode("append").parquet(where)
    name = f"events_{uuid.uuid4().hex}"
    v.spark.readStream.schema(events.drop("comes").schema).option("maxFilesPerTrigger", FILES).parquet(where).createOrReplaceTempView(name)
    return v.spark.sql(VIEWS["attempts"].format(**SPARK).replace("from events", f"from {name}"))


def _run(v, stream: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream puts out until its input ends, with the number of their batch."""
    where, key = folder(v), "spark.sql.streaming.stateStore.providerClass"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(where)

    before = v.spark.conf.get(key)
    v.spark.conf.set(key, ROCKS)
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", folder(v)).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        v.spark.conf.set(key, before)
    return v.spark.read.parquet(where)


def _latest(df: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


@query("T1_ingest_pages", "select document_id, page_number, sha256(text) as hash from pages_view group by all", "pages_view")
def _(v):
    where, table, checkpoint = folder(v), folder(v), folder(v)
    for _ in range(2):  # the second time, the same pages come in new files and add nothing
        v.pages_view.repartition(4).write.mode("append").parquet(where)
        t.ingest_pages(v.spark.readStream.schema(v.pages_view.schema).option("maxFilesPerTrigger", 2).parquet(where), table, checkpoint).awaitTermination()
    return v.spark.read.parquet(table).select("document_id", "page_number", "hash")


@query("T2_daily_accuracy", "select created_at::date as day, count(*) as attempted, count_if(is_correct) as correct, round(count_if(is_correct) / count(*) * 100, 6) as accuracy from attempts group by all", "attempts")
def _(v):
    return _latest(_run(v, t.daily_accuracy(_arriving(v, 5), "40 days"), "update"), "day")


@query("T3_running_mastery", "select user_id, trim(topic) as topic, count(*) as attempted, count_if(is_correct) as correct, round(count_if(is_correct) / count(*) * 100 * (count(*) / (count(*) + 5.0::double)), 6) as mastery from attempts where trim(topic) <> '' group by all", "attempts")
def _(v):
    return _latest(_run(v, t.running_mastery(_arriving(v, 5)), "update"), "user_id", "topic").select("user_id", "topic", "attempted", "correct", "mastery")


@query("T4_review_schedule", ORACLE["W6_review_schedule"])
def _(v):
    rows = _latest(_run(v, t.review_schedule(_arriving(v, 5), "40 days"), "update"), "user_id", "key")
    return rows.withColumns({c: F.round(c, 4) for c in ("interval_days", "easiness")})


@query("T5_throttle", ORACLE["W13_throttle"].replace("select id, key, created_at, allowed from w", "select id, key, allowed from w"))
def _(v):
    return _run(v, t.throttle(_arriving(v), "user_id", 2, 3 * 86_400), "append").select("id", "key", "allowed")


@query("T6_without_repeats", "select user_id, session_id from attempts group by all", "attempts")
def _(v):
    return _run(v, t.without_repeats(_arriving(v, 5), "user_id", "session_id", late="40 days").select("user_id", "session_id"), "append").select("user_id", "session_id")


