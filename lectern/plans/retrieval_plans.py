"""Retrieval queries: every document and vector whose id is divisible by 100 is a query, against whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.stemming import STOP_WORDS, duck_chain
from lectern.operators import bank
from lectern.operators import retrieval as r
from lectern.sources.shared import stored

from .base import query

BASE = ("questions", "vectors", "question_topics")
CTE = f"""qs as (select id as query_id, array_to_string(list_filter(regexp_split_to_array(lower(question_text), '[^a-z0-9]+'), lambda x: length(x) >= 3)[1:2], ' ') as query from questions where id % 100 = 0),
  qv as (select question_id as query_id, embedding::double[] as e, label from vectors where question_id % 100 = 0),
  tf as (select id, t, count(*) as n from (select id, unnest(list_filter(regexp_split_to_array(lower(question_text), '[^a-z0-9]+'), lambda x: x <> '')) as t from questions) group by all),
  qt as (select query_id, query, unnest(list_distinct(list_filter(string_split(query, ' '), lambda x: x <> ''))) as t from qs),
  told as (select distinct t as word from (select t from tf union all select t from qt) where t not in ({", ".join(repr(w) for w in STOP_WORDS)})),
  {duck_chain("told", "kinds")},
  ts as (select id, stem, sum(n) as n from tf join kinds on word = t group by all),
  qst as (select distinct query_id, stem from qt join kinds on word = t),
  qn as (select query_id, count(*) as k from qst group by all),
  kw as (select query_id, id, sum(n / (n + 1)) / any_value(k) as s from ts join qst using (stem) join qn using (query_id) group by query_id, id having count(*) = any_value(k)),
  sub as (select query_id, id from questions join qs on trim(query) <> '' and contains(lower(question_text), query)),
  ks as (select query_id, id, round(greatest(coalesce(s, 0), case when sub.id is not null then 0.05 else 0 end), 6) as score from kw full outer join sub using (query_id, id)),
  kr as (select query_id, id, score, rank from (select ks.*, row_number() over (partition by query_id order by score desc, created_at desc, id) as rank from ks join questions using (id)) where rank <= 10),
  vs as (select query_id, question_id as id, round(list_cosine_similarity(embedding::double[], e), 6) as score from vectors, qv),
  vr as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from vs) where rank <= 10),
  fw as (select query_id, id, round(0.5 * coalesce(vr.score, 0) + 0.5 * coalesce(kr.score, 0), 8) as score, concat_ws(',', case when kr.rank is not null then 'keyword' end, case when vr.rank is not null then 'vector' end) as sources from vr full outer join kr using (query_id, id)),
  hw as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from fw) where rank <= 10),
  fr as (select query_id, id, round(coalesce(1.0 / (60 + vr.rank), 0)::double + coalesce(1.0 / (60 + kr.rank), 0)::double, 8) as score from vr full outer join kr using (query_id, id)),
  hr as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from fr) where rank <= 10),
  xb as (select query_id, id, round(hw.score + case when contains(lower(question_text), trim(query)) then 0.1 else 0 end, 8) as score, sources from hw left join qs using (query_id) left join questions using (id)),
  xr as (select *, row_number() over (partition by query_id order by score desc, id) as rank from xb),
  rel as (select query_id, question_id as id from vectors join qv using (label)),
  ls as (select 'vector' as strategy, query_id, id, rank from vr union all select 'keyword', query_id, id, rank from kr union all select 'hybrid', query_id, id, rank from hw union all select 'hybrid+rerank', query_id, id, rank from xr
    union all select 'metadata', query_id, id, row_number() over (partition by query_id order by score desc, id) from (select vs.*, row_number() over (partition by query_id order by score desc, id) as n from vs where exists (select 1 from question_topics l where l.question_id = vs.id and l.topic_id like 'v%')) where n <= 10),
  ev as (select s.strategy, q.query_id, count(ls.id) as got, count(rel.id) as shared, any_value(t.total) as total, count(rel.id) filter (rank <= 3) as a3, count(rel.id) filter (rank <= 5) as a5, count(rel.id) filter (rank <= 10) as a10
    from qs q cross join (select unnest(['vector', 'keyword', 'hybrid', 'hybrid+rerank', 'metadata']) as strategy) s left join ls on ls.strategy = s.strategy and ls.query_id = q.query_id left join rel on rel.query_id = ls.query_id and rel.id = ls.id
    left join (select query_id, count(*) as total from rel group by all) t on t.query_id = q.query_id group by s.strategy, q.query_id),
  em as (select strategy, query_id, case when total > 0 then shared / total else 0.0 end as recall, case when got > 0 then shared / got else 0.0 end as precision, a3 > 0 as hit3, a5 > 0 as hit5, a10 > 0 as hit10 from ev),
  cm as (select strategy, count(*) as queries, avg(recall) as recall, avg(precision) as precision, avg(hit3::int) as hit3, avg(hit5::int) as hit5, avg(hit10::int) as hit10 from em group by all)"""


def _inputs(v):
    corpus = v.questions.select("id", F.col("question_text").alias("text"), "document_id", "created_at")
    vectors = v.vectors.select(F.col("question_id").alias("id"), F.col("embedding").alias("vector"), "label", "model")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) >= 3)
    text = corpus.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.array_join(F.slice(words, 1, 2), " ").alias("query"))
    vector = vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", "label")
    return corpus, vectors, text, vector


def _branches(v, k=10):
    corpus, vectors, text, vector = _inputs(v)
    return corpus, vectors, text, vector, r.vector_search(vectors, vector, k), r.keyword_search(corpus, text, k)


@query("R1_vector_cosine", f"with {CTE} select * from vr", *BASE)
def _(v):
    _, vectors, _, vector = _inputs(v)
    return r.vector_search(vectors, vector, 10)


def _metric(expr: str, more: str = "") -> str:
    return f"with qv as (select question_id as query_id, embedding::double[] as e from vectors where question_id % 100 = 0), s as (select query_id, question_id as id, round({expr}, 6) as score from vectors, qv) select * from (select *{more}, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 10"


@query("R2_vector_l2", _metric("1 / (1 + list_distance(embedding::double[], e))"), "vectors")
def _(v):
    _, vectors, _, vector = _inputs(v)
    return r.vector_search(vectors, vector, 10, "l2")


@query("R3_vector_dot", _metric("list_inner_product(embedding::double[], e)", ", 1 + score as reference_form"), "vectors")
def _(v):
    _, vectors, _, vector = _inputs(v)
    return r.vector_search(vectors, vector, 10, "dot")


@query("R4_one_model", _metric("list_cosine_similarity(embedding::double[], e)").replace("from vectors, qv", "from vectors, qv where model = 'm1'"), "vectors")
def _(v):
    _, vectors, _, vector = _inputs(v)
    return r.vector_search(vectors.filter("model = 'm1'"), vector, 10)


@query("F4_threshold", _metric("list_cosine_similarity(embedding::double[], e)").replace("from s)", "from s where score >= 0.2)"), "vectors")
def _(v):
    _, vectors, _, vector = _inputs(v)
    return r.vector_search(vectors, vector, 10, threshold=0.2)


@query("R5_keyword", f"with {CTE} select query_id, id, score, greatest(0, 1 - score) as distance, rank from kr", *BASE)
def _(v):
    corpus, _, text, _ = _inputs(v)
    return r.keyword_search(corpus, text, 10)


@query("R7_hybrid_weighted", f"with {CTE} select * from hw", *BASE, digits=8)
def _(v):
    *_, vr, kr = _branches(v)
    return r.fuse(vr, kr, 10)


@query("R8_hybrid_rrf", f"with {CTE} select * from hr", *BASE, digits=8)
def _(v):
    *_, vr, kr = _branches(v)
    return r.fuse(vr, kr, 10, "rrf", (1.0, 1.0)).drop("sources")


@query("R9_keyword_only", f"with {CTE} select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from kr", *BASE)
def _(v):
    *_, vr, kr = _branches(v)
    return r.fuse(vr, kr, 10, weights=(0.0, 1.0)).drop("sources")


@query("R10_exact_rerank", f"with {CTE} select query_id, id, score, rank, sources from xr", *BASE, digits=8)
def _(v):
    corpus, _, text, _, vr, kr = _branches(v)
    return r.rerank(r.fuse(vr, kr, 10), text, corpus, r.exact_boost())


@query("R11_overlap_rerank", f"""with {CTE}, d as (select id, list(distinct t) as ts from tf group by all), w as (select query_id, list(t) as qs from qt group by all),
  o as (select query_id, id, round(hw.score + coalesce(len(list_filter(qs, lambda x: list_contains(ts, x))) / len(qs), 0), 8) as score, sources from hw left join w using (query_id) left join d using (id))
select *, row_number() over (partition by query_id order by score desc, id) as rank from o""", *BASE, digits=8)
def _(v):
    corpus, _, text, _, vr, kr = _branches(v)
    return r.rerank(r.fuse(vr, kr, 10), text, corpus, r.overlap_boost())


STOP = ", ".join(f"'{w}'" for w in r.STOP_WORDS)
REWRITE = f"""select query_id, query, normalized, case when query_id % 2 = 0 then normalized || ' operating systems' else normalized end as expanded,
  coalesce(nullif(array_to_string(list_filter(string_split(normalized, ' '), lambda x: x not in ({STOP})), ' '), ''), normalized) as keyword
from (select query_id, case when query_id % 2 = 0 then '  What is  OS ' else '' end || query as query, trim(regexp_replace(lower(case when query_id % 2 = 0 then '  What is  OS ' else '' end || query), '\\s+', ' ', 'g')) as normalized from qs)"""


def _asked(v):
    return _inputs(v)[2].withColumn("query", F.concat(F.when(F.col("query_id") % 2 == 0, "  What is  OS ").otherwise(""), "query"))


@query("R13_rewrite", f"with {CTE} {REWRITE}", *BASE)
def _(v):
    return r.rewrite(_asked(v))


@query("R14_variants", f"""with {CTE}, w as ({REWRITE}), f as (select query_id, [trim(query), expanded, keyword, trim(query) || ' t1'] as fs from w)
select query_id, unnest(list_filter(fs, lambda x, i: x <> '' and list_position(fs, x) = i)) as query from f""", *BASE)
def _(v):
    return r.variants(r.rewrite(_asked(v)).withColumn("topics", F.array(F.lit("t1")))).select("query_id", "query")


FUSED = "f as (select query_id, id, round(sum(1 / (60 + rank)), 8) as score, count(*) as lists, string_agg(distinct strategy, ',' order by strategy) as sources from ls where strategy in ('vector', 'keyword') group by all)"


@query("R15_fuse_lists", f"with {CTE}, {FUSED} select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from f) where rank > 2 and rank <= 12", *BASE, digits=8)
def _(v):
    *_, vr, kr = _branches(v)
    lists = vr.select("query_id", F.lit(0).alias("variant"), F.lit("vector").alias("source"), "id", "rank").unionByName(kr.select("query_id", F.lit(1).alias("variant"), F.lit("keyword").alias("source"), "id", "rank"))
    return r.fuse_lists(lists, 10, 2)


@query("U1_union_first", f"with {CTE}, g as (select query_id, id, min(struct_pack(v := case strategy when 'vector' then 0 else 1 end, r := rank)) as a from ls where strategy in ('vector', 'keyword') group by all) select query_id, id, place from (select *, row_number() over (partition by query_id order by a, id) as place from g) where place <= 15", *BASE)
def _(v):
    *_, vr, kr = _branches(v)
    return r.union_first(vr.select("query_id", F.lit(0).alias("variant"), "id", "rank").unionByName(kr.select("query_id", F.lit(1).alias("variant"), "id", "rank")), 15)


def _strategies(v):
    corpus, vectors, text, vector, vr, kr = _branches(v)
    vr, kr = stored(vr), stored(kr)  # five strategies share them
    hybrid = stored(r.fuse(vr, kr, 10))
    links = v.question_topics.filter("topic_id like 'v%'").select(F.col("question_id").alias("id"))
    lists = {"vector": vr, "keyword": kr, "hybrid": hybrid, "hybrid+rerank": r.rerank(hybrid, text, corpus, r.exact_boost()), "metadata": r.vector_search(bank.only(vectors, links), vector, 10)}
    hits = None
    for name, df in lists.items():
        rows = df.select(F.lit(name).alias("strategy"), "query_id", "id", "rank")
        hits = rows if hits is None else hits.unionByName(rows)
    asked = text.join(vector.select("query_id", "label"), "query_id", "left")
    return hits, vectors.select("id", "label"), asked, [*lists]


@query("S9_relevance", f"with {CTE} select * from rel", *BASE)
def _(v):
    _, vectors, _, vector = _inputs(v)
    return r.relevant_rows(vectors, vector)


@query("A16_evaluation", f"with {CTE} select strategy, query_id, round(recall, 6) as recall, round(precision, 6) as precision, hit3, hit5, hit10 from em", *BASE)
def _(v):
    return r.evaluate_by_class(*_strategies(v))


@query("R18_by_category", f"with {CTE} select strategy, subject as category, count(*) as queries, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(hit3::int), 6) as hit3, round(avg(hit5::int), 6) as hit5, round(avg(hit10::int), 6) as hit10 from em join questions on id = query_id group by all", *BASE)
def _(v):
    return r.by_category(r.evaluate_by_class(*_strategies(v)), v.questions.select(F.col("id").alias("query_id"), F.col("subject").alias("category")))


@query("A17_strategies", f"with {CTE} select strategy, queries, round(recall, 6) as recall, round(precision, 6) as precision, round(hit3, 6) as hit3, round(hit5, 6) as hit5, round(hit10, 6) as hit10 from cm", *BASE)
def _(v):
    return r.compare(r.evaluate_by_class(*_strategies(v)))


@query("K9_best_strategy", f"with {CTE} select strategy, round(recall, 6) as recall from cm order by recall desc, hit5 desc, hit10 desc, strategy limit 1", *BASE)
def _(v):
    return r.best(r.compare(r.evaluate_by_class(*_strategies(v)))).select("strategy", "recall")


@query("R20_by_document", f"""with {CTE}, g as (select query_id, document_id, count(*) as hits, max(score) as top_score, array_to_string(list(id order by score desc, id), ',') as children from hw join questions using (id) group by all)
select *, row_number() over (partition by query_id order by top_score desc, document_id) as rank from g""", *BASE, digits=8)
def _(v):
    corpus, *_, vr, kr = _branches(v)
    return r.by_document(r.fuse(vr, kr, 10), corpus)


@query("R21_snippet", r"select id, case when length(t) > 160 then substr(t, 1, 160) || '...' else t end as snippet, 'Subject: ' || subject || ' | Year: ' || year as context from (select *, trim(regexp_replace(question_text, '\s+', ' ', 'g')) as t from questions)", "questions")
def _(v):
    return v.questions.select("id", r.snippet(F.col("question_text")).alias("snippet"), r.context_line(("Subject", F.col("subject")), ("Topic", F.lit(" ")), ("Year", F.col("year"))).alias("context"))


@query("R22_contextual_query", f"with {CTE} select query_id, 'Subject: en | ' || query as query from qs where query <> ''", *BASE)
def _(v):
    text = _inputs(v)[2].filter("query <> ''")
    return text.select("query_id", F.concat_ws(" | ", r.context_line(("Subject", F.lit("en"))), "query").alias("query"))


@query("R23_debug_counts", f"with {CTE} select query_id, coalesce(a, 0) as vector_rows, coalesce(b, 0) as keyword_rows, coalesce(c, 0) as fused_rows from (select query_id, count(*) as a from vr group by all) full join (select query_id, count(*) as b from kr group by all) using (query_id) full join (select query_id, count(*) as c from hw group by all) using (query_id)", *BASE)
def _(v):
    *_, vr, kr = _branches(v)
    return r.debug_counts(vr, kr, r.fuse(vr, kr, 10))


@query("R24_listing", f"with {CTE}, t as (select question_id as id, min(topic_id) as topic from question_topics group by all) select query_id, id, score, topic from hw left join t using (id)", *BASE, digits=8)
def _(v):
    *_, vr, kr = _branches(v)
    topics = v.question_topics.select(F.col("topic_id").alias("id"), F.col("topic_id").alias("name")).distinct()
    hits = r.fuse(vr, kr, 10).withColumnRenamed("id", "question_id")
    return bank.first_topic(hits, v.question_topics, topics).select("query_id", F.col("question_id").alias("id"), "score", "topic")


@query("Q1_hybrid_sources", f"with {CTE}, g as (select query_id % 4 as request_id, id, min(struct_pack(v := query_id, r := rank)) as a from hw where id % 7 <> 0 group by all) select request_id, id, place from (select *, row_number() over (partition by request_id order by a, id) as place from g) where place <= 8", *BASE)
def _(v):
    from lectern.operators.quiz import hybrid_sources

    *_, vr, kr = _branches(v)
    lists = r.fuse(vr, kr, 10).select((F.col("query_id") % 4).alias("request_id"), F.col("query_id").alias("topic_no"), "id", "rank")
    excluded = v.vectors.select(F.col("question_id").alias("id")).unionByName(v.questions.select("id")).filter("id % 7 = 0")
    return hybrid_sources(lists, 8, excluded)
