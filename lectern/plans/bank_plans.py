"""Question-bank queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import bank as b
from lectern.sources.shared import numbered

from .base import folder, query

META = "id, document_id, subject, year, difficulty, question_type"
COLS = META.split(", ")


@query("S1_scan_documents", "select id, document_id, subject, created_at from questions where subject = 'en' order by created_at desc, id desc limit 20 offset 5", "questions")
def _(v):
    return b.page(v.questions.filter("subject = 'en'"), F.desc("created_at"), F.desc("id"), offset=5).select("id", "document_id", "subject", "created_at")


@query("S2_scan_questions", f"select {META} from questions where year = 2016", "questions")
def _(v):
    return b.metadata_filter(v.questions, year=2016).select(*COLS)


@query("S3_session_attempts", "select id, session_id, created_at, row_number() over (partition by session_id order by created_at, id) as place from attempts", "attempts")
def _(v):
    from pyspark.sql import Window

    return v.attempts.select("id", "session_id", "created_at", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id")).alias("place"))


@query("S4_session_history", """with s as (select user_id, session_id, max(created_at) as created_at from attempts group by all)
select user_id, session_id, created_at from (select *, row_number() over (partition by user_id order by created_at desc, session_id) as n from s) where n <= 20""", "attempts")
def _(v):
    s = v.attempts.groupBy("user_id", "session_id").agg(F.max("created_at").alias("created_at"))
    return b.page_per(s, "user_id", F.desc("created_at"), F.col("session_id"))


@query("S5_page_source", "select document_id, page_number, text from pages_view", "pages_view")
def _(v):
    packed = v.pages_view.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages"))
    return packed.select("document_id", F.inline("pages"))


@query("S6_batch_append", f"select {META} from questions", "questions")
def _(v):
    where, q = folder(v), v.questions.select(*COLS)
    b.append(q.filter("id % 2 = 0"), where)
    b.append(q.filter("id % 2 = 1"), where)
    return v.spark.read.parquet(where)


@query("S7_upsert_vectors", "select question_id, case when question_id % 3 = 0 then 'new' else model end as model, case when question_id % 3 = 0 then label + 1 else label end as label from vectors", "vectors")
def _(v):
    old = v.vectors.select("question_id", "model", "label")
    new = old.filter("question_id % 3 = 0").select("question_id", F.lit("new").alias("model"), (F.col("label") + 1).alias("label"))
    return b.upsert(old, new, "question_id")


@query("S8_artifact_sink", "select document_id, count(*) as n from pages_view group by all", "pages_view")
def _(v):
    where = folder(v)
    v.pages_view.withColumn("part", F.col("document_id") % 8).write.partitionBy("part").json(where)
    return v.spark.read.schema("document_id long, page_number int, role string, text string, part int").json(where).groupBy("document_id").agg(F.count("*").alias("n"))


@query("S10_read_by_id", "select i.id, q.subject, q.year from (select o_orderkey as id from orders) i left join questions q on q.id = i.id", "questions")
def _(v):
    ids = v.table("orders").select(F.col("o_orderkey").alias("id"))
    return b.by_id(ids, v.questions.select("id", "subject", "year"))


@query("S11_cascade_delete", "select l.* from question_topics l join questions q on q.id = l.question_id where q.document_id not in ('src1', 'src2')", "questions", "question_topics")
def _(v):
    gone = v.questions.filter("document_id in ('src1', 'src2')").select(F.col("id").alias("question_id"))
    return b.exclude(v.question_topics, gone, "question_id")


@query("F1_metadata_filter", f"select {META} from questions where subject = 'en' and year >= 2018 and year <= 2021 and difficulty = 'hard'", "questions")
def _(v):
    return b.metadata_filter(v.questions, subject=" en ", year_min=2018, year_max=2021, difficulty="hard", kind=" ").select(*COLS)


@query("F1_metadata_filters", """with f(query_id, s, y1, y2, d) as (values (1, 'en', 2016, null, null), (2, null, null, 2016, 'easy'), (3, 'de', null, null, null), (4, null, null, null, 'none'))
select query_id, id from questions q join f on (s is null or s = subject) and (y1 is null or year >= y1) and (y2 is null or year <= y2) and (d is null or d = difficulty)""", "questions")
def _(v):
    f = v.spark.sql("select * from values (1, 'en', 2016, cast(null as int), cast(null as string)), (2, null, null, 2016, 'easy'), (3, 'de', null, null, null), (4, null, null, null, 'none') as t(query_id, subject, year_min, year_max, difficulty)")
    return b.metadata_filters(v.questions, f)


@query("F2_topic_by_id", "select id from questions where exists (select 1 from question_topics where question_id = id and topic_id = 'clicks')", "questions", "question_topics")
def _(v):
    return b.has_topic(v.questions, v.question_topics, ids=["clicks"]).select("id")


@query("F3_topic_by_name", "select id from questions where exists (select 1 from question_topics l join topics t on t.id = l.topic_id where l.question_id = questions.id and lower(t.name) = 'click')", "questions", "question_topics", "topics")
def _(v):
    return b.has_topic(v.questions, v.question_topics, v.topics, names=["Click"]).select("id")


@query("F5_owner_visibility", "select id from questions where case when owner < 6 then owner end = 3 or case when owner < 6 then owner end is null", "questions")
def _(v):
    return b.visible(v.questions.withColumn("owner", F.when(F.col("owner") < 6, F.col("owner"))), 3).select("id")


@query("F6_source_filter", "select id from questions where lower(trim(difficulty)) = 'medium' and lower(subject) = 'en' and year >= 2016", "questions")
def _(v):
    return b.source_filter(v.questions, difficulty=" MEDIUM ", subject="EN", year_min=2016).select("id")


@query("F7_clean_sources", """with s as (select case when id % 10 = 0 then ' ' else concat('q', id // 2) end as id, question_text, difficulty, id as rank from questions),
  f as (select * from (select *, row_number() over (partition by id order by rank) as n from s where trim(id) <> '') where n = 1)
select id, rank from f where trim(coalesce(question_text, '')) <> '' and lower(difficulty) = 'easy'""", "questions")
def _(v):
    s = v.questions.select(F.expr("case when id % 10 = 0 then ' ' else concat('q', id div 2) end").alias("id"), "question_text", "difficulty", F.col("id").alias("rank"))
    return b.clean_sources(s, difficulty="easy").select("id", "rank")


@query("F9_check_attempts", """select id, selected_answer = correct_answer as is_correct, concat_ws(',', case when trim(question_id) = '' and trim(coalesce(source_question_id, '')) = '' then 'question' end, case when selected_answer > 3 then 'selected' end, case when time_taken_seconds - 20 < 0 then 'time' end) as broken from attempts""", "attempts")
def _(v):
    rows = b.check_attempts(v.attempts.withColumn("time_taken_seconds", F.col("time_taken_seconds") - 20))
    return rows.select("id", "is_correct", F.array_join("violations", ",").alias("broken"))


@query("F10_check_questions", """select id, concat_ws(',', case when trim(question_text) = '' then 'text' end, case when end_page - 1 < start_page then 'end_page' end, case when confidence * 1.1 > 1 then 'confidence' end) as broken from questions""", "questions")
def _(v):
    rows = b.check_questions(v.questions.withColumns({"end_page": F.col("end_page") - 1, "confidence": F.col("confidence") * 1.1}))
    return rows.select("id", F.array_join("violations", ",").alias("broken"))


@query("F13_page_selection", "select document_id, page_number from pages_view where page_number in (1, 3)", "pages_view")
def _(v):
    return v.pages_view.filter(F.col("page_number").isin(1, 3)).select("document_id", "page_number")


@query("J1_vectors_with_questions", "select q.id, v.label, q.subject from vectors v join questions q on q.id = v.question_id", "vectors", "questions")
def _(v):
    return v.vectors.join(v.questions.withColumnRenamed("id", "question_id"), "question_id").select(F.col("question_id").alias("id"), "label", "subject")


@query("J2_question_topics", "select l.question_id, array_to_string(list_sort(list(t.name)), ',') as names from question_topics l join topics t on t.id = l.topic_id join questions q on q.id = l.question_id group by all", "questions", "question_topics", "topics")
def _(v):
    return b.topics_of(v.questions, v.question_topics, v.topics)


@query("J3_topic_counts", "select t.id, t.name, t.subject, count(l.question_id) as questions from topics t left join question_topics l on l.topic_id = t.id group by all", "question_topics", "topics")
def _(v):
    return b.topics_with_counts(v.topics, v.question_topics)


@query("A9_topic_list", "select id, questions, row_number() over (order by questions desc, id) as place from (select t.id, count(l.question_id) as questions from topics t left join question_topics l on l.topic_id = t.id group by all)", "question_topics", "topics")
def _(v):
    counted = b.topics_with_counts(v.topics, v.question_topics).select("id", "questions")
    return numbered(counted, F.desc("questions"), F.col("id"))


@query("J5_exclude_ids", "select id from questions where id not in (select question_id from vectors where label < 3)", "questions", "vectors")
def _(v):
    return b.exclude(v.questions, v.vectors.filter("label < 3").select(F.col("question_id").alias("id"))).select("id")


@query("J11_nearest_above", """with i as (select o_orderkey as image_id, o_custkey % 50 as document_id, o_orderkey % 4 as page_number, o_orderkey % 700 as y from orders),
  q as (select id, id % 50 as document_id, start_page % 4 as page_number, id * 37 % 700 as y from questions)
select image_id, (select arg_min(q.id, struct_pack(d := q.y - i.y, q := q.id)) from q where q.document_id = i.document_id and q.page_number = i.page_number and q.y >= i.y) as question_id from i""", "questions")
def _(v):
    i = v.table("orders").selectExpr("o_orderkey as image_id", "o_custkey % 50 as document_id", "o_orderkey % 4 as page_number", "o_orderkey % 700 as y")
    return b.nearest_above(i, v.questions.selectExpr("id", "id % 50 as document_id", "start_page % 4 as page_number", "id * 37 % 700 as y"))


@query("J12_first_topic", "select q.id as question_id, min(t.name) as topic from questions q left join (question_topics l join topics t on t.id = l.topic_id) on l.question_id = q.id group by all", "questions", "question_topics", "topics")
def _(v):
    return b.first_topic(v.questions.select(F.col("id").alias("question_id")), v.question_topics, v.topics)


@query("J13_topic_subjects", """with f as (select session_id, trim(topic) as topic, arg_min(trim(subject), struct_pack(a := created_at, b := id)) as s from attempts where trim(topic) <> '' group by all)
select session_id, topic, coalesce(nullif(s, ''), 'all') as subject from f""", "attempts")
def _(v):
    return b.topic_subjects(v.attempts, v.attempts.select("session_id").distinct().withColumn("subject", F.lit("all")))


@query("J14_topic_questions", "select l.topic_id, q.id, q.created_at from question_topics l join questions q on q.id = l.question_id where l.topic_id in ('view', 'views')", "questions", "question_topics")
def _(v):
    links = v.question_topics.filter("topic_id in ('view', 'views')").withColumnRenamed("question_id", "id")
    return v.questions.join(links, "id").select("topic_id", "id", "created_at")


@query("U3_exclude_difference", "select id from questions where id not in (select question_id from question_topics)", "questions", "question_topics")
def _(v):
    return b.exclude(v.questions, v.question_topics.select(F.col("question_id").alias("id"))).select("id")


@query("U4_only_ids", "select id from questions where id in (select question_id from vectors)", "questions", "vectors")
def _(v):
    return b.only(v.questions, v.vectors.select(F.col("question_id").alias("id"))).select("id")


OWN = "o as (select coalesce(nullif(trim(source_question_id), ''), nullif(trim(question_id), '')) as k, is_correct from attempts where user_id = 7)"


@query("U5_unseen", f"with {OWN} select id from questions where concat('q', id) not in (select k from o where k is not null)", "questions", "attempts")
def _(v):
    return b.answered(v.questions, v.attempts, 7)[0].select("id")


@query("U5_incorrect", f"with {OWN} select id from questions where concat('q', id) in (select k from o where not is_correct)", "questions", "attempts")
def _(v):
    return b.answered(v.questions, v.attempts, 7)[1].select("id")


@query("U8_merge_topics", """select question_id, case when topic_id like '%X' then replace(topic_id, 'X', '') else topic_id end as topic_id, max(confidence) as confidence from question_topics group by 1, 2""", "question_topics", "topics")
def _(v):
    mapping = v.topics.filter("id like '%X'").selectExpr("id as source_id", "replace(id, 'X', '') as target_id")
    return b.merge_topics(v.question_topics, v.topics, mapping)[0]


@query("U9_merge_unknown", "select concat(id, '?') as id from topics where id like '%X'", "topics")
def _(v):
    mapping = v.topics.filter("id like '%X'").selectExpr("id as source_id", "concat(id, '?') as target_id")
    return b.unknown_topics(mapping, v.topics)


@query("U10_replace_topics", "select * from question_topics where question_id % 4 <> 1 union all select id, 'view', 1.0 from questions where id % 4 = 1", "question_topics", "questions")
def _(v):
    return b.replace_topics(v.question_topics, v.questions.filter("id % 4 = 1").select(F.col("id").alias("question_id"), F.lit("view").alias("topic_id"), F.lit(1.0).alias("confidence")))


@query("U11_upsert_links", """with o as (select question_id, topic_id, max(confidence) as c from question_topics where question_id % 2 = 0 group by all),
  n as (select question_id, topic_id, max(case when question_id % 3 = 0 then null else confidence / 2 end) as c from question_topics where question_id % 4 <> 2 group by all)
select question_id, topic_id, coalesce(n.c, o.c) as confidence from o full outer join n using (question_id, topic_id)""", "question_topics")
def _(v):
    best = lambda d, c: d.groupBy("question_id", "topic_id").agg(F.max(c).alias("confidence"))
    old = best(v.question_topics.filter("question_id % 2 = 0"), F.col("confidence"))
    return b.upsert_links(old, best(v.question_topics.filter("question_id % 4 <> 2"), F.when(F.col("question_id") % 3 != 0, F.col("confidence") / 2)))


@query("U12_find_or_create", """with w as (select lower(trim(subject)) || chr(1) || '' as k, min(subject) as name from questions group by 1)
select substr(sha256(k), 1, 32) as id, name, null::varchar as subject from w""", "questions", "topics")
def _(v):
    wanted = v.questions.select(F.col("subject").alias("name"), F.lit(None).cast("string").alias("subject"))
    return b.find_or_create(v.topics, wanted)


@query("U13_default_topics", "select id as question_id, coalesce(nullif(trim(subject), ''), 'General') as topic from questions where id not in (select question_id from question_topics)", "questions", "question_topics")
def _(v):
    return b.default_topics(v.questions, v.question_topics)


@query("W5_duplicates", """with i as (select subject as quiz_id, id as position, question_text as question from questions),
  l as (select quiz_id, position, lag(position) over (partition by quiz_id, lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) order by position) as earlier from i) select * from l where earlier is not null""", "questions")
def _(v):
    items = v.questions.select(F.col("subject").alias("quiz_id"), F.col("id").alias("position"), F.col("question_text").alias("question"))
    return b.duplicates(items).select("quiz_id", "position", "earlier")
