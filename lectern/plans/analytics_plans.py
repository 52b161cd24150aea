"""Analytics queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import analytics as a

from .base import query

BREAKDOWN = """b as (select user_id, trim(topic) as topic, count(*) as attempted, count_if(is_correct) as correct from attempts where trim(topic) <> '' group by all),
  bd as (select *, attempted - correct as incorrect, correct / attempted * 100 as accuracy from b)"""
NOW = "2024-02-01 00:00:00"


@query("A1_session_metrics", """
with s as (select session_id, count(*) as attempted, count_if(is_correct) as correct, avg(time_taken_seconds) as m from attempts group by all)
select session_id, attempted, correct, attempted - correct as incorrect, correct as score, round(correct / attempted * 100, 6) as accuracy, round(m, 6) as mean_seconds from s
union all select 'none', 0, 0, 0, 0, 0.0, 0.0""", "attempts")
def _(v):
    rows = v.attempts
    sessions = rows.select("session_id").distinct().unionByName(v.spark.sql("select 'none' as session_id"))
    return a.session_metrics(rows, sessions)


@query("A2_topic_breakdown", f"with {BREAKDOWN} select user_id, topic, attempted, correct, incorrect, round(accuracy, 6) as accuracy from bd", "attempts")
def _(v):
    return a.topic_breakdown(v.attempts, "user_id")


@query("A3_weak_topics", f"with {BREAKDOWN} select user_id, topic, attempted, correct, incorrect, round(accuracy, 6) as accuracy from bd where accuracy < 70", "attempts")
def _(v):
    return a.weak_topics(a.topic_breakdown(v.attempts, "user_id"))


@query("A4_topic_mastery", f"""with {BREAKDOWN}, m as (select *, accuracy * (attempted / (attempted + 5.0::double)) as mastery from bd)
select user_id, topic, attempted, correct, incorrect, round(accuracy, 6) as accuracy, round(mastery, 6) as mastery,
  case when mastery >= 80 then 'mastered' when mastery >= 60 then 'proficient' when mastery >= 40 then 'developing' when mastery >= 20 then 'beginner' else 'novice' end as level from m""", "attempts")
def _(v):
    return a.topic_mastery(a.topic_breakdown(v.attempts, "user_id"))


@query("A5_daily_accuracy", "select created_at::date as day, count(*) as attempted, count_if(is_correct) as correct, round(count_if(is_correct) / count(*) * 100, 6) as accuracy from attempts group by all", "attempts")
def _(v):
    return a.daily_accuracy(v.attempts)


DIFFICULTY = """d as (select concat('q', id) as question_id, max(difficulty) as difficulty from questions group by all),
  j as (select a.*, coalesce(lower(nullif(trim(d.difficulty), '')), 'unknown') as difficulty from attempts a left join d on d.question_id = coalesce(nullif(trim(a.source_question_id), ''), trim(a.question_id)))"""


def _difficulties(v):
    return v.questions.groupBy(F.concat(F.lit("q"), "id").alias("question_id")).agg(F.max("difficulty").alias("difficulty"))


@query("J7_attempt_difficulty", f"with {DIFFICULTY} select id, difficulty from j", "attempts", "questions")
def _(v):
    return a.with_difficulty(v.attempts, _difficulties(v)).select("id", "difficulty")


@query("A6_difficulty_stats", f"with {DIFFICULTY} select difficulty, count(*) as attempted, count_if(is_correct) as correct, round(avg(time_taken_seconds), 6) as mean_seconds, round(count_if(is_correct) / count(*) * 100, 6) as accuracy from j group by all", "attempts", "questions")
def _(v):
    return a.difficulty_stats(a.with_difficulty(v.attempts, _difficulties(v)))


@query("A7_timing", """with t as (select trim(topic) as topic, case when isnan(time_taken_seconds) or time_taken_seconds < 0 or time_taken_seconds is null then 0 else time_taken_seconds end as s from attempts)
select topic, count(*) as attempted, round(avg(s), 6) as mean, round(quantile_cont(s, 0.5), 6) as median, round(quantile_disc(s, 0.9), 6) as p90 from t group by all""", "attempts")
def _(v):
    return a.timing(v.attempts.withColumn("topic", F.trim("topic")), "topic")


@query("A8_exam_readiness", f"""with {BREAKDOWN},
  m as (select user_id, avg(accuracy * (attempted / (attempted + 5.0::double))) as mastery from bd group by all),
  o as (select user_id, count_if(is_correct) / count(*) * 100 as accuracy, count(distinct lower(nullif(trim(topic), ''))) as topics, max(created_at) as latest from attempts group by all),
  r as (select user_id, coalesce(mastery, 0) as mastery, accuracy, least(100.0::double, topics / 6 * 100) as coverage,
        case when d <= 1 then 100.0 when d <= 3 then 85.0 when d <= 7 then 65.0 when d <= 14 then 40.0 when d <= 30 then 20.0 else 5.0 end::double as recency
        from (select *, greatest(0, (epoch_us(timestamp '{NOW}') - epoch_us(latest)) / 86400e6) as d from o) left join m using (user_id)),
  s as (select *, 0.40::double * mastery + 0.25::double * accuracy + 0.20::double * coverage + 0.15::double * recency as score from r)
select user_id, round(mastery, 6) as mastery, round(accuracy, 6) as accuracy, round(coverage, 6) as coverage, recency, round(score, 6) as score,
  case when score >= 80 then 'exam-ready' when score >= 60 then 'almost-ready' when score >= 40 then 'developing' else 'getting-started' end as band from s""", "attempts")
def _(v):
    return a.readiness(v.attempts, F.lit(NOW).cast("timestamp"), 6)


@query("A12_extraction_metrics", """with q as (select id % 40 as document_id, count(*) as questions, avg(confidence) as mean_confidence, count_if(confidence < 0.6) as ambiguous, avg((confidence < 0.4)::int) as fallback_rate from questions group by all),
  p as (select document_id, count(*) as pages from pages_view group by all)
select document_id, pages, coalesce(questions, 0) as questions, round(coalesce(mean_confidence, 0), 6) as mean_confidence, coalesce(ambiguous, 0) as ambiguous, round(coalesce(fallback_rate, 0), 6) as fallback_rate, round(coalesce(questions, 0) / pages, 6) as questions_per_page
from p left join q using (document_id)""", "questions", "pages_view")
def _(v):
    return a.extraction_metrics(v.questions.withColumn("document_id", F.col("id") % 40), v.pages_view)


def _flagged(v):
    return v.pages_view.withColumns({"needs_ocr": F.length(F.trim("text")) < 40, "error": F.when(F.col("page_number") % 5 == 4, "lost")})


@query("A13_page_summary", "select document_id, count(*) as pages, count_if(length(trim(text)) < 40) as needs_ocr, count_if(page_number % 5 = 4) as errors, count(*) - count_if(page_number % 5 = 4) as extracted from pages_view group by all", "pages_view")
def _(v):
    return a.page_summary(_flagged(v))


@query("A14_page_lengths", "select document_id, page_number, length(text) as characters from pages_view", "pages_view")
def _(v):
    return a.page_lengths(v.pages_view)


@query("A19_document_topics", """with y as (select document_id, list_sort(list(distinct year)) as ys from questions group by all)
select q.document_id, t.name, count(*) as questions, any_value(array_to_string(ys, ',')) as years, any_value(ys[1]) as first_year, any_value(ys[-1]) as last_year
from questions q join question_topics l on l.question_id = q.id join topics t on t.id = l.topic_id join y on y.document_id = q.document_id group by q.document_id, t.name""", "questions", "question_topics", "topics")
def _(v):
    return a.document_topics(v.questions, v.question_topics, v.topics)


@query("A20_topic_difficulties", "select topic_id, count_if(difficulty = 'easy') as easy, count_if(difficulty = 'medium') as medium, count_if(difficulty = 'hard') as hard from question_topics l join questions q on q.id = l.question_id group by all", "questions", "question_topics")
def _(v):
    return a.topic_difficulties(v.questions, v.question_topics)


@query("A21_round_robin_topics", """with i as (select session_id as quiz_id, id as position, nullif(trim(topic), '') as t, time_taken_seconds as s from attempts),
  z as (select quiz_id, count(*) as n, max(s) as total from i group by all)
select quiz_id, position, coalesce(t, (['x', 'y', 'z'])[(position % 3 + 1)::int]) as topic, round(total / n, 6) as seconds from i join z using (quiz_id)""", "attempts")
def _(v):
    items = v.attempts.select(F.col("session_id").alias("quiz_id"), F.col("id").alias("position"), "topic", "time_taken_seconds")
    return a.round_robin_topics(items, ["x", "y", "z"], F.col("time_taken_seconds"))


@query("A22_call_accounting", "select model, operation, count(*) as calls, count_if(failed) as errors, sum(tokens)::bigint as tokens, round(avg(latency), 6) as mean_latency, round(max(latency), 6) as max_latency from calls group by all", "calls")
def _(v):
    return a.call_accounting(v.calls)


@query("A23_step_durations", "select document_id, round(coalesce(sum(latency) filter (operation = 'click'), 0), 4) as click, round(coalesce(sum(latency) filter (operation = 'view'), 0), 4) as view from calls group by all", "calls", digits=4)
def _(v):
    return a.step_durations(v.calls, ["click", "view"])


@query("A24_bank_totals", "select 'documents' as name, count(*) as total from documents union all select 'questions', count(*) from questions union all select 'topics', count(*) from topics", "questions", "topics")
def _(v):
    return a.bank_totals(documents=v.table("documents"), questions=v.questions, topics=v.topics)
