"""Review, job and throttle queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import review as r

from .base import query

CLOSED = """k as (select *, coalesce(nullif(trim(question_id), ''), nullif(trim(source_question_id), '')) as key from attempts),
  o as (select *, row_number() over (partition by user_id, key order by created_at, id) as n from k where key is not null),
  m as (select user_id, key, count_if(not is_correct) as misses, coalesce(max(n) filter (not is_correct), 0) as last_miss, count(*) as total, max(created_at) as last from o group by all),
  s as (select user_id, key, (total - last_miss)::int as repetitions, greatest(1.3::double, 2.5::double - 0.2::double * misses) as easiness, last from m),
  w as (select *, case when repetitions <= 1 then 1.0::double when repetitions = 2 then 6.0::double else 6.0::double * pow(easiness, repetitions - 2) end as interval_days from s)"""
NOW = "2024-01-20 00:00:00"


@query("W6_review_schedule", f"with {CLOSED} select user_id, key, repetitions, round(interval_days, 4) as interval_days, round(easiness, 4) as easiness, last from w", "attempts", digits=4)
def _(v):
    return r.schedule(v.attempts, "user_id")


@query("W6_review_schedule_fold", f"with {CLOSED} select user_id, key, repetitions, round(interval_days, 4) as interval_days, round(easiness, 4) as easiness, last from w", "attempts", digits=4)
def _(v):
    return r.schedule_fold(v.attempts, "user_id")


DUE = f"""with {CLOSED}, d as (select user_id, key, case when user_id % 9 = 0 then null else make_timestamp(epoch_us(last) + round(least(interval_days, 100000.0) * 86400e6)::bigint) end as next_review from w)
select user_id, key, next_review from d where next_review is null or next_review <= timestamp '{NOW}'"""


@query("W7_due_list", DUE, "attempts")
def _(v):
    rows = r.schedule(v.attempts, "user_id").withColumn("next_review", F.when(F.col("user_id") % 9 != 0, r.next_review(F.col("last"), F.col("interval_days"))))
    return r.due(rows, F.lit(NOW).cast("timestamp")).select("user_id", "key", "next_review")


@query("W8_next_review", "select id, make_timestamp(epoch_us(created_at) + round(case when time_taken_seconds < 5 or isnan(time_taken_seconds) then 0 else time_taken_seconds - 5 end * 86400e6)::bigint) as next_review from attempts", "attempts")
def _(v):
    return v.attempts.select("id", r.next_review(F.col("created_at"), F.col("time_taken_seconds") - 5).alias("next_review"))


@query("W9_review_key", """with k as (select id, coalesce(nullif(trim(question_id), ''), nullif(trim(source_question_id), '')) as key from attempts) select * from k where key is not null""", "attempts")
def _(v):
    return r.review_key(v.attempts).select("id", "key")


@query("W10_latest_job", """select * exclude n from (select *, row_number() over (partition by document_id order by (type = 'process_document') desc, created_at desc, id desc) as n from jobs) where n = 1""", "jobs")
def _(v):
    return r.latest_job(v.jobs)


def _steps_sql() -> str:
    names = [s for s, _ in r.STEPS]
    index = "case current_step " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(names)) + " else -1 end"
    percent = "case current_step " + " ".join(f"when '{s}' then {p}" for s, p in r.STEPS) + " end"
    state = lambda i, s: f"'{s}=' || case when status = 'completed' then 'done' when status = 'failed' and i = {i} then 'failed' when i = -1 then {"case when status <> 'failed' then 'active' else 'pending' end" if i == 0 else "'pending'"} when i > {i} then 'done' when i = {i} then 'active' else 'pending' end"
    return f"""with x as (select *, {index} as i, {percent} as p from jobs)
    select id, document_id, status, greatest(0, least(100, case when status = 'completed' then 100 when progress = 0 and p is not null then p else progress end)) as progress, concat_ws(',', {", ".join(state(i, s) for i, s in enumerate(names))}) as steps from x"""


@query("W11_job_progress", _steps_sql(), "jobs")
def _(v):
    return r.job_progress(v.jobs)


@query("W12_stuck_jobs", "select id, status, updated_at from jobs where status in ('queued', 'pending') or (status = 'active' and updated_at < timestamp '1996-01-01' - to_seconds(timeout_seconds)) order by updated_at, id limit 25", "jobs")
def _(v):
    return r.stuck_jobs(v.jobs, F.lit("1996-01-01").cast("timestamp")).select("id", "status", "updated_at")


@query("W13_throttle", """with recursive e as (select id, user_id as key, created_at, row_number() over (partition by user_id order by created_at, id) as i from attempts),
  w as (
    select distinct key, 0::bigint as i, null::bigint as id, null::timestamp as created_at, []::timestamp[] as held, true as allowed from e
    union all
    select key, i, id, created_at, case when len(h) < 2 then list_append(h, created_at) else h end, len(h) < 2
    from (select e.*, list_filter(w.held, lambda t: epoch_us(e.created_at) - epoch_us(t) < 3 * 86400000000) as h from w join e on e.key is not distinct from w.key and e.i = w.i + 1))
select id, key, created_at, allowed from w where i > 0""", "attempts")
def _(v):
    return r.throttle(v.attempts, "user_id", 2, 3 * 86_400)
