"""Streams over several micro-batches with late rows against batch forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import review
from lectern.plans.base import Views
from lectern.plans.stream_plans import ARRIVALS, ROCKS, _arriving, _latest, _run
from lectern.streaming import streams

SF = "/root/testdata/sf0.001"
KIND = "user_id long, question_id string, source_question_id string, id long, created_at timestamp, is_correct boolean"
START = datetime(2026, 3, 1)


def fed(spark, tmp_path, batches):
    """A stream that gets one list of attempts in each micro-batch, and all of them as a table."""
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return stream, spark.read.parquet(str(tmp_path / "in"))


def attempt(user, key, i, hours, right):
    return (user, f"q{key}", None, i, START + timedelta(hours=hours), right)


def schedules(df):
    return {(r.user_id, r.key): (r.repetitions, round(r.interval_days, 6), round(r.easiness, 6), r["last"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_late_rows_give_the_schedule_of_all_rows(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [attempt(r.randrange(3), r.randrange(3), i, i + r.random(), r.random() < 0.7) for i in range(300)]
    rows += [attempt(9, 9, 1000 + k, 400, k != 3) for k in range(6)]  # ties by time go by id
    # An attempt comes up to 60 hours after its time, so that batches overlap.
    rows.sort(key=lambda x: x[4] + timedelta(hours=r.random() * 60))
    batches = [rows[k : k + 60] for k in range(0, len(rows), 60)]
    stream, table = fed(spark, tmp_path, batches)
    out = _run(Views(spark, SF), streams.review_schedule(stream, "80 hours"), "update")
    assert out.select("batch").distinct().count() >= len(batches)
    assert schedules(_latest(out, "user_id", "key")) == schedules(review.schedule(table, "user_id"))


def test_events_come_late_over_several_batches(spark):
    v = Views(spark, SF)
    seen = _run(v, _arriving(v, 5).select("id", "created_at"), "append").groupBy("batch").agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"), F.count("*").alias("n")).orderBy("batch").collect()
    assert len(seen) == ARRIVALS and sum(x.n for x in seen) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert all(y.a < x.b for x, y in zip(seen, seen[1:]))


def test_state_ends_after_its_expiry(spark, tmp_path):
    # The second batch moves the watermark, the third one finds no state of the first.
    batches = [[attempt(1, 1, 1, 0, False), attempt(1, 1, 2, 1, True)], [attempt(2, 2, 3, 500, True)], [attempt(2, 2, 4, 501, True)], [attempt(1, 1, 5, 502, True)]]
    stream, _ = fed(spark, tmp_path, batches)
    got = schedules(_latest(_run(Views(spark, SF), streams.review_schedule(stream, "1 hour", timedelta(hours=100)), "update"), "user_id", "key"))
    assert got[1, "q1"][:3] == (1, 1.0, 2.5) and got[2, "q2"][0] == 2


def test_ingest_knows_earlier_pages(spark, tmp_path):
    where, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    kind = "document_id long, page_number int, text string"
    runs = [[(1, 1, "a"), (1, 2, "b"), (1, 1, "a")], [(1, 1, "a"), (1, 1, "changed"), (2, 1, None)], [(2, 1, None), (1, 2, "b")]]
    read = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(where)
    for k, rows in enumerate(runs):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(where)
        q = streams.ingest_pages(read(), table, checkpoint)
        q.awaitTermination()
        # A batch reads its own file; what came before is state.
        assert all(p["numInputRows"] <= 3 for p in q.recentProgress), k
    assert sorted(tuple(r) for r in spark.read.parquet(table).select("document_id", "page_number", F.coalesce("text", F.lit("-"))).collect()) == [(1, 1, "a"), (1, 1, "changed"), (1, 2, "b"), (2, 1, "-")]


def test_the_state_store_is_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    _run(Views(spark, SF), _arriving(Views(spark, SF)).select("id"), "append")
    assert spark.conf.get(key) == before != ROCKS
