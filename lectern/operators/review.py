"""Review schedules, due lists, job views and throttling: ordered folds for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import blank_to_null

STEPS = (("uploaded", 5), ("extracting", 20), ("questions", 45), ("images", 60), ("classifying", 73), ("embeddings", 95))


def review_key(attempts: DataFrame) -> DataFrame:
    """W9. The key is question_id, else source_question_id; rows with neither are left out."""
    return attempts.withColumn("key", F.coalesce(blank_to_null(F.col("question_id")), blank_to_null(F.col("source_question_id")))).filter("key is not null")


def schedule_fold(attempts: DataFrame, *keys: str) -> DataFrame:
    """W6 as a replay of each question's attempts in time. A wrong answer resets the streak and costs 0.2 of ease, down to 1.3.

    It gathers each key's history, so it is for keys of a bounded one; ``schedule`` gives the same by aggregates.
    """
    rows = review_key(attempts).groupBy(*keys, "key").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "is_correct"))).alias("log"))
    state = F.expr("""aggregate(log, struct(0 as reps, 0D as days, 2.5D as ease),
        (s, x) -> if(x.is_correct,
            struct(s.reps + 1 as reps, case s.reps when 0 then 1D when 1 then 6D else s.days * s.ease end as days, s.ease as ease),
            struct(0 as reps, 1D as days, greatest(1.3D, s.ease - 0.2D) as ease)))""")
    return rows.select(*keys, "key", state.alias("s"), F.element_at("log", -1)["created_at"].alias("last")).select(*keys, "key", F.col("s.reps").alias("repetitions"), F.col("s.days").alias("interval_days"), F.col("s.ease").alias("easiness"), "last")


def schedule(attempts: DataFrame, *keys: str) -> DataFrame:
    """W6 in closed form: ease depends on the number of misses, the interval on the streak since the last one.

    Aggregates only, so a question with very many attempts is summed before the shuffle.
    """
    rows = review_key(attempts)
    order = F.struct("created_at", "id")
    misses = rows.groupBy(*keys, "key").agg(F.count_if(~F.col("is_correct")).alias("misses"), F.max(F.when(~F.col("is_correct"), order)).alias("last_miss"), F.max("created_at").alias("last"))
    on = [*keys, "key"]
    streak = rows.join(misses.select(*on, "last_miss"), on).filter(F.col("last_miss").isNull() | (order > F.col("last_miss"))).groupBy(*on).agg(F.count("*").cast("int").alias("repetitions"))
    out = misses.join(streak, on, "left").fillna(0, ["repetitions"]).withColumn("easiness", F.greatest(F.lit(1.3), 2.5 - 0.2 * F.col("misses")))
    days = F.when(F.col("repetitions") <= 1, 1.0).when(F.col("repetitions") == 2, 6.0).otherwise(6 * F.pow("easiness", F.col("repetitions") - 2))
    return out.select(*on, "repetitions", days.alias("interval_days"), "easiness", "last")


def next_review(last: Column, days: Column) -> Column:
    """W8. last + days; negative or NaN days count as none. Days beyond 100,000 are cut there."""
    safe = F.when(F.isnan(days) | (days < 0), 0.0).otherwise(F.least(days, F.lit(100_000.0)))
    return F.timestamp_micros(F.unix_micros(last.cast("timestamp")) + F.round(safe * 86_400e6).cast("long")).cast("timestamp_ntz")


def due(schedule: DataFrame, now: Column) -> DataFrame:
    """W7. Rows whose next_review is unset or not after now; unset ones sort first."""
    return schedule.filter(F.col("next_review").isNull() | (F.col("next_review") <= now))


def latest_job(jobs: DataFrame) -> DataFrame:
    """W10. Each document's newest processing job, else its newest job."""
    order = Window.partitionBy("document_id").orderBy((F.col("type") == "process_document").desc(), F.col("created_at").desc(), F.col("id").desc())
    return jobs.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def job_progress(jobs: DataFrame) -> DataFrame:
    """W11. Status, progress between 0 and 100 and the state of each step."""
    index, percent = F.lit(-1), F.lit(None).cast("int")
    for i, (step, p) in enumerate(STEPS):
        index = F.when(F.col("current_step") == step, i).otherwise(index)
        percent = F.when(F.col("current_step") == step, p).otherwise(percent)
    status = F.when(F.lower("status").isin("pending", "queued"), "queued").when(F.lower("status").isin("processing", "running", "active"), "active").otherwise(F.lower("status"))
    rows = jobs.withColumns({"status": status, "index": index})
    progress = F.when(F.col("status") == "completed", 100).when((F.col("progress") == 0) & percent.isNotNull(), percent).otherwise(F.col("progress"))
    states = []
    for i, (step, _) in enumerate(STEPS):
        first = F.lit(i == 0)
        state = (
            F.when(F.col("status") == "completed", "done")
            .when((F.col("status") == "failed") & (F.col("index") == i), "failed")
            .when(F.col("index") == -1, F.when(first & (F.col("status") != "failed"), "active").otherwise("pending"))
            .when(F.col("index") > i, "done")
            .when(F.col("index") == i, "active")
            .otherwise("pending")
        )
        states.append(F.concat(F.lit(f"{step}="), state))
    return rows.select("id", "document_id", "status", F.greatest(F.lit(0), F.least(F.lit(100), progress)).alias("progress"), F.concat_ws(",", *states).alias("steps"))


def stuck_jobs(jobs: DataFrame, now: Column, limit: int = 25) -> DataFrame:
    """W12. Jobs that wait, or are active beyond their timeout; the oldest ones."""
    late = (F.col("status") == "active") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.col("timeout_seconds")))
    return jobs.filter(F.col("status").isin("queued", "pending") | late).orderBy("updated_at", "id").limit(limit)


def throttle(events: DataFrame, key: str, limit: int, seconds: float) -> DataFrame:
    """W13. Whether each event is allowed: at most ``limit`` accepted events of its key in the window before it; refused ones don't count.

    A key's verdicts depend on all before them, so a key is one task's work, sorted by Spark; it is read in
    batches and never held whole. Events without a key count as one key.
    """
    rows = events.select("id", F.col(key).alias("key"), "created_at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {"key": object(), "times": []}
        for b in batches:
            flags = []
            for k, t in zip(b.key.astype(object).where(b.key.notna(), None), b.created_at):
                if k != held["key"]:
                    held = {"key": k, "times": []}
                held["times"] = [x for x in held["times"] if (t - x).total_seconds() < seconds]
                ok = len(held["times"]) < limit
                if ok:
                    held["times"].append(t)
                flags.append(ok)
            yield b.assign(allowed=flags)

    return rows.repartition("key").sortWithinPartitions("key", "created_at", "id").mapInPandas(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", allowed boolean")
