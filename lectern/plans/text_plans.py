"""Text and topic queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import replies
from lectern.functions import text as t
from lectern.functions import topics as tp

from .base import query

Q = "questions"


def _text():
    return F.col("question_text")


@query("X1_normalize", r"select id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(question_text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') as text from questions", Q)
def _(v):
    return v.questions.select("id", t.normalize(_text()).alias("text"))


@query("X2_needs_ocr", "select id, length(trim(question_text)) < 20 as needs_ocr from questions", Q)
def _(v):
    return v.questions.select("id", t.needs_ocr(_text()).alias("needs_ocr"))


NAME = "(difficulty || case id % 5 when 0 then ' processes' when 1 then '-locks' when 2 then ' CPU' when 3 then ' Databases' else ' dictionaries' end || case when id % 7 = 0 then '  io' else '' end)"


def _name():
    return F.expr(NAME)


CANON = f"""n as (select id, lower(trim(regexp_replace(coalesce({NAME}, ''), '[\\s-]+', ' ', 'g'))) as lower from questions),
  s as (select id, lower, list_transform(string_split(lower, ' '), lambda w: case when strlen(w) <= 3 then w when ends_with(w, 'ies') and strlen(w) > 4 then w[:-4] || 'y' when regexp_matches(w, '(ses|xes|ches|shes)$') then w[:-3] when regexp_matches(w, '[^sui]s$') then w[:-2] else w end) as ws from n),
  c as (select id, array_to_string(list_transform(ws, lambda w: case when w = 'cpu' then 'CPU' when w = 'io' then 'I/O' else upper(w[1:1]) || w[2:] end), ' ') as name from s)"""


@query("X14_canonical_name", f"with {CANON} select id, name from c", Q)
def _(v):
    return v.questions.select("id", tp.canonical_name(_name()).alias("name"))


@query("X15_canonical_key", f"with {CANON} select id, lower(name) as key from c", Q)
def _(v):
    return v.questions.select("id", tp.canonical_key(_name()).alias("key"))


@query("A10_merge_candidates", "with k as (select id, case when lower(name) = 'purchases' then 'purchas' else regexp_replace(lower(name), 's$', '') end as key from topics) select key, count(*) as topics, array_to_string(list_sort(list(id)), ',') as ids from k group by key having count(*) > 1", "topics")
def _(v):
    return tp.merge_candidates(v.topics)


def _label_sql():
    rule = lambda topic, c, ws: f"select id, case when {' or '.join(f'''contains(lower(x), '{w}')''' for w in ws)} then '{topic}' end as topic, {c}::double as confidence, subject from x"
    return "with x as (select id, question_text || ' ' || case id % 6 when 0 then 'Deadlocks and disk' when 1 then 'page fault in a thread' when 2 then 'round robin ratio x' else '' end as x, case when id % 2 = 0 then subject else 'Operating Systems' end as subject from questions), r as (" + " union all ".join(rule(*r) for r in tp.RULES) + ") select * from r where topic is not null"


@query("X16_keyword_tags", _label_sql(), Q)
def _(v):
    extra = F.expr("question_text || ' ' || case id % 6 when 0 then 'Deadlocks and disk' when 1 then 'page fault in a thread' when 2 then 'round robin ratio x' else '' end")
    return tp.tag(v.questions.withColumn("question_text", extra).withColumn("subject", F.expr("case when id % 2 = 0 then subject else ' ' end")))


@query("A11_merge_labels", """with l as (select question_id, case when topic_id like '%X' then lower(replace(topic_id, 'X', '')) else topic_id end as t, max(confidence) as confidence from question_topics group by 1, regexp_replace(topic_id, 's$|X$', ''), 2),
  m as (select question_id, case when t = 'purchases' then 'purchas' else regexp_replace(t, 's$', '') end as t, max(confidence) as confidence from l group by all)
select question_id, upper(t[1:1]) || t[2:] as topic, confidence from m""", "question_topics")
def _(v):
    labels = v.question_topics.select("question_id", F.monotonically_increasing_id().alias("position"), F.regexp_replace("topic_id", "X$", "").alias("topic"), "confidence", F.lit("").alias("subject"))
    return tp.merge_labels(labels).select("question_id", "topic", "confidence")


@query("X18_figure_type", "select id, case when d in ('plot', 'graphs') then 'graph' when d = 'equation' then 'math_figure' else 'unknown' end as strict, case when d in ('plot', 'graphs') then 'graph' when d = 'equation' then 'math_figure' else replace(d, ' ', '_') end as quiz from (select id, case id % 4 when 0 then 'plot' when 1 then 'graphs' when 2 then 'equation' else 'odd kind' end as d from questions)", Q)
def _(v):
    d = F.expr("case id % 4 when 0 then ' Plot' when 1 then 'graphs' when 2 then 'Equation ' else 'odd kind' end")
    return v.questions.select("id", t.figure_type(d).alias("strict"), t.quiz_figure_type(d).alias("quiz"))


@query("X19_table_rows", r"""with l as (select id, list_filter(regexp_split_to_array(question_text, '\r?\n'), lambda x: trim(x) <> '' and not regexp_matches(x, '^[\s|:+=-]+$')) as ls from questions)
select id, len(ls) as n_rows, case when contains(ls[1], '|') then len(string_split(regexp_replace(trim(ls[1]), '^\||\|$', '', 'g'), '|')) else len(string_split(ls[1], case when contains(ls[1], chr(9)) then chr(9) else ',' end)) end as n_first from l""", Q)
def _(v):
    return v.questions.select("id", t.table_rows(_text()).alias("r")).select("id", F.size("r").cast("long").alias("n_rows"), F.size(F.get("r", F.lit(0))).cast("long").alias("n_first"))


CUT = "case when length(c) > 40 then substr(c, 1, 37) || '...' else c end"


@query("X20_table_summary", rf"""with l as (select id, list_filter(regexp_split_to_array(question_text, '\r?\n'), lambda x: trim(x) <> '' and not regexp_matches(x, '^[\s|:+=-]+$')) as ls from questions),
  r as (select id, list_transform(ls, lambda x: list_transform(case when contains(x, '|') then string_split(regexp_replace(trim(x), '^\||\|$', '', 'g'), '|') when contains(x, chr(9)) then string_split(x, chr(9)) else string_split(x, ',') end, lambda c: trim(c))) as r from l),
  n as (select *, len(r) as n, list_max(list_transform(r, lambda x: len(x))) as m from r)
select id, case when n = 0 then 'Empty table.' else 'Table with ' || n || ' row' || case when n = 1 then '' else 's' end || ' x ' || m || ' column' || case when m = 1 then '' else 's' end
  || '. Headers: ' || array_to_string(list_transform(r[1], lambda c: case when c = '' then '(blank)' else {CUT} end), ', ') || '.'
  || case when n > 1 then ' First row: ' || array_to_string(list_transform(r[2], lambda c: {CUT}), ', ') || '.' else '' end
  || case when n > 2 then ' (+' || (n - 2) || ' more row' || case when n = 3 then '' else 's' end || '.)' else '' end end as summary from n""", Q)
def _(v):
    return v.questions.select("id", t.table_summary(t.table_rows(_text())).alias("summary"))


#: Texts with formulas put in, in every form.
FORMULAS = """case id % 6 when 0 then concat('see $x_', id, '$ and $$a+', id, '$$ or $ x_', id, ' $ end ', {nl}, 'y = ', id, ' ', {nl}, 'so $x_', id, '$ = 3') when 1 then concat('\\\\[ b = ', id, ' \\\\] then \\\\(c\\\\) ', {nl}, 'c = 4 and b = ', id) when 2 then concat('\\\\begin{{align*}} p', {nl}, 'q = ', id, '\\\\end{{align*}} \\\\frac{{', id, '}}{{2}} \\\\sqrt{{3}} \\\\alpha', {nl}, 'q = ', id) when 3 then concat('a = b', {nl}, 'a < b = c', {nl}, ' a < b = c ', {nl}) else '' end"""
RE2_MATH = t.MATH.replace("'", "''")
NORM = r"""trim(regexp_replace(coalesce({pairs}, s), '\s+', ' ', 'g'))""".replace("{pairs}", ", ".join(f"case when regexp_matches(s, '(?s)^{a}.+{b}$') then regexp_extract(s, '(?s)^{a}(.+){b}$', 1) end" for a, b in t.MATH_PAIRS))


@query("X21_math_expressions", f"""with recursive tx as (select id, {FORMULAS.format(nl='chr(10)').replace(chr(92) * 2, chr(92))} || chr(10) || question_text as text from questions),
  m as (select id, 0 as part, generate_subscripts(x, 1) as k, unnest(x) as e from (select id, regexp_extract_all(text, '{RE2_MATH}') as x from tx)
    union all select id, 1, k, e from (select id, generate_subscripts(x, 1) as k, trim(unnest(x), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as e from (select id, string_split(text, chr(10)) as x from tx)) where contains(e, '=') and strlen(e) <= {t.MATH_LINE_BYTES} and regexp_matches(e, '{t.MATH_HINT}')),
  n as (select *, trim(e, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) as x from m),
  o as (select *, coalesce(case when starts_with(x, '\\begin') then nullif(trim(regexp_extract(x, '(?s)^\\\\begin[^}}]*\\}}(.*)\\\\end', 1), ' ' || chr(10) || chr(9)), '') end, x) as s from n),
  p as (select id, part, x, {NORM} as norm, row_number() over (partition by id order by part, k) as i from o),
  walk as (
    select distinct id, 0::bigint as i, []::struct(x varchar, n varchar)[] as known from tx
    union all
    select p.id, p.i, case when norm = '' or len(list_filter(known, lambda y: y.n = norm)) > 0 or (part = 1 and len(list_filter(known, lambda y: contains(y.x, p.x) or contains(p.x, y.x))) > 0) then known else list_append(known, {{'x': p.x, 'n': norm}}) end
    from walk w join p on p.id = w.id and p.i = w.i + 1)
select id, array_to_string(list_transform(arg_max(known, i), lambda y: y.x), ';') as expressions from walk group by id""", Q)
def _(v):
    text = F.concat(F.expr(FORMULAS.format(nl="char(10)")), F.lit("\n"), F.coalesce(_text(), F.lit("")))
    return v.questions.select("id", F.array_join(t.math_expressions(text), ";").alias("expressions"))


@query("X22_image_text", """select id, 'Figure ' || case when id % 5 = 0 then 'unnamed figure' else 'f' || id end || case when id % 3 = 0 then '' else ' (graph)' end || case id % 4 when 0 then ': ' || subject when 1 then '' else
  ': Undescribed image ' || case when id % 5 = 0 then 'unnamed' else 'f' || id end || ' (content hash ' || substr(sha256(case when id % 5 = 0 then 'unnamed' else 'f' || id end || ':' || coalesce(question_text, '')), 1, 8) || ', ' || strlen(coalesce(question_text, '')) || ' bytes; vision unavailable)' end as text from questions""", Q)
def _(v):
    name, given = F.when(F.col("id") % 5 != 0, F.concat(F.lit(" f"), "id")), F.when(F.col("id") % 4 == 0, F.col("subject"))
    described = F.when(F.col("id") % 4 == 1, F.lit(" ")).otherwise(t.image_description(name, _text().cast("binary"), given))
    return v.questions.select("id", t.image_text(name, F.when(F.col("id") % 3 != 0, " Graph "), described).alias("text"))


@query("X23_tokens", "with x as (select id, list_filter(regexp_split_to_array(lower(question_text), '[^a-z0-9]+'), lambda x: x <> '') as w from questions) select id, len(w) as n, sha256(array_to_string(w, ' ')) as words from x", Q)
def _(v):
    return v.questions.select("id", t.tokens(_text()).alias("w")).select("id", F.size("w").cast("long").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("words"))


@query("X23_study_tokens", f"with x as (select id, list_filter(regexp_split_to_array(lower(question_text), '[^a-z0-9]+'), lambda x: length(x) >= 3 and x not in ({', '.join(repr(s) for s in t.STUDY_STOP_WORDS)})) as w from questions) select id, len(w) as n, sha256(array_to_string(w, ' ')) as words from x", Q)
def _(v):
    return v.questions.select("id", t.study_tokens(_text()).alias("w")).select("id", F.size("w").cast("long").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("words"))


@query("X24_safe_name", "select page_id, case when page_id % 3 = 0 then 'a_b c.pdf' when page_id % 3 = 1 then 'document.pdf' else 'x_.html' end as name from pages")
def _(v):
    raw = F.expr("case page_id % 3 when 0 then '../..\\\\up/ a*b c.pdf' when 1 then '...' else '/tmp/x?.html' end")
    return v.table("pages").select("page_id", t.safe_name(raw).alias("name"))


@query("X25_redact", r"""with w as (select id, generate_subscripts(string_split(t, ' '), 1) as k, unnest(string_split(t, ' ')) as w from (select id, trim(regexp_replace(coalesce(question_text, ''), '\s+', ' ', 'g')) as t from questions)),
  c as (select *, trim(w, '<>( ),;:."''') as core from w),
  p as (select *, instr(core, '@') as spot, length(core) - instr(reverse(core), '.') + 1 as dot, instr(w, core) as place from c),
  m as (select id, string_agg(case when spot > 1 and contains(core, '.') and dot > spot + 1 and dot < length(core) then substr(w, 1, place - 1) || '[redacted-email]' || substr(w, place + length(core)) else w end, ' ' order by k) as t from p group by id)
select id, case when length(t) > 500 then substr(t, 1, 500) || '…[truncated]' else t end as text from m""", Q)
def _(v):
    return v.questions.select("id", t.redact(_text()).alias("text"))


@query("X26_embedding_input", "select id, 'Subject: ' || subject || chr(10) || chr(10) || 'Topics:' || chr(10) || '- a' || chr(10) || '- ' || document_id || chr(10) || chr(10) || 'Question:' || chr(10) || question_text as input from questions", Q)
def _(v):
    return v.questions.select("id", t.embedding_input(F.col("subject"), F.array("document_id", F.lit("a")), _text()).alias("input"))


@query("X27_content_hash", "select id, sha256(question_text) as hash from questions", Q)
def _(v):
    return v.questions.select("id", t.content_hash(_text()).alias("hash"))


@query("X28_cache_key", "select id, substr(sha256(encode(subject) || '\\x00'::blob || encode(question_text)), 1, 32) as key from questions", Q)
def _(v):
    return v.questions.select("id", t.cache_key(F.col("subject"), _text()).alias("key"))


@query("X29_option_list", "select id, case when id % 3 = 2 then '' else 'a,b,c,' || subject end as options from questions", Q)
def _(v):
    raw = F.expr("""case id % 3 when 0 then concat('["a","b","a"," c ","', subject, '","e"]') when 1 then concat('[{"text":"a"},{"label":"b"},{"option":"c"},{"text":"', subject, '"}]') else '["a","b"]' end""")
    return v.questions.select("id", F.array_join(t.option_list(raw), ",").alias("options"))


@query("X30_image_list", "select id, case when id % 2 = 0 then 'i' || id || '::' else 'f' || id || ':graph:' || subject end as images from questions", Q)
def _(v):
    raw = F.expr("""case when id % 2 = 0 then concat('["i', id, '"]') else concat('[{"file":"f', id, '","type":"Plots","caption":"', subject, '"}]') end""")
    return v.questions.select("id", F.array_join(F.transform(t.image_list(raw), lambda x: F.concat_ws(":", x["name"], x["kind"], F.coalesce(x["description"], F.lit("")))), ",").alias("images"))


#: Replies in and out of fences, right ones and all kinds of wrong ones.
REPLY = """case id % 12 when 0 then concat('```json', {nl}, '{{"subject": "', subject, '", "topics": [{{"topic": "a }} b", "confidence": 0.', id, '}}]}}', {nl}, '``` done') when 1 then concat('Sure: {{"subject": "x", "topics": []}} ok')
  when 2 then '{{"subject": "x", "topics": [], "more": 1}}' when 3 then 'no json' when 4 then '{{"subject": "x", "topics": []}} {{}}' when 5 then '{{"subject": " ", "topics": []}}' when 6 then '{{"subject": "x"}}'
  when 7 then '{{"subject": "x", "topics": [{{"topic": "t", "confidence": 1.5}}]}}' when 8 then '{{"subject": "x", "topics": [{{"topic": "t", "why": 1}}]}}' when 9 then '{{"subject": 3, "topics": []}}' when 10 then '{{"subject": "x", "topics": [{{"confidence": 1}}]}}' else concat('```', {nl}, '{{"subject": "x", "topics": [{{"topic": "t"}},', {nl}, '{{"topic": "u", "subject": "v", "confidence": 1}}]}}```') end"""


@query("X31_classified_replies", """select id, case id % 12 when 0 then subject when 1 then 'x' when 11 then 'x' end as subject, case id % 12 when 0 then 'a } b:' when 1 then '' when 11 then 't:,u:v' end as topics,
  case id % 12 when 2 then 'unknown field' when 3 then 'invalid JSON' when 4 then 'trailing data' when 5 then 'subject is required' when 6 then 'topics is required' when 7 then 'confidence out of range' when 8 then 'unknown field' when 9 then 'wrong type' when 10 then 'topic name is required' end as error from questions""", Q)
def _(v):
    rows = replies.classified(v.questions.select("id", F.col("subject").alias("own"), F.expr(REPLY.format(nl="char(10)")).alias("reply")))
    return rows.select("id", "subject", F.array_join(F.transform("topics", lambda x: F.concat_ws(":", x["topic"], x["subject"])), ",").alias("topics"), "error")


@query("X31_rejects", """select case id % 12 when 2 then 'unknown field' when 3 then 'invalid JSON' when 4 then 'trailing data' when 5 then 'subject is required' when 6 then 'topics is required' when 7 then 'confidence out of range' when 8 then 'unknown field' when 9 then 'wrong type' when 10 then 'topic name is required' end as error, count(*) as replies from questions where id % 12 between 2 and 10 group by all""", Q)
def _(v):
    _, rejects = replies.split_rejects(replies.classified(v.questions.select("id", F.expr(REPLY.format(nl="char(10)")).alias("reply"))))
    return rejects.groupBy("error").agg(F.count("*").alias("replies"))


@query("X31_json_in_reply", "select id, case when id % 4 < 3 then id end as value from questions", Q)
def _(v):
    raw = F.expr("""case id % 4 when 3 then 'no json' else concat('Sure:\n```json\n{"a": {"n": ', id, '}}\n``` done') end""")
    return v.questions.select("id", F.get_json_object(replies.json_in(raw), "$.a.n").cast("long").alias("value"))


@query("X32_truncate", "select id, case when length(question_text) > 40 then substr(question_text, 1, 40) || '...' else question_text end as text from questions", Q)
def _(v):
    return v.questions.select("id", t.truncate(_text(), 40).alias("text"))


@query("X33_clamp_labels", "select id, 'x:' || case when id % 3 = 0 then '1.0' when id % 3 = 1 then '0.0' else '0.5' end || ':' || subject as labels from questions", Q)
def _(v):
    labels = F.array(F.struct(F.lit(" x ").alias("topic"), F.expr("case id % 3 when 0 then 1.5D when 1 then -1D else 0.5D end").alias("confidence"), F.lit(" ").alias("subject")), F.struct(F.lit(" ").alias("topic"), F.lit(0.1).alias("confidence"), F.lit("s").alias("subject")))
    return v.questions.select("id", F.array_join(F.transform(t.clamp_labels(labels, F.col("subject")), lambda x: F.concat_ws(":", x["topic"], x["confidence"].cast("string"), x["subject"])), ",").alias("labels"))


@query("X17_diagram_kind", "select id, case id % 5 when 0 then 'flowchart' when 1 then 'network' when 2 then 'photo' when 3 then 'general_diagram' else 'unknown' end as kind from questions", Q)
def _(v):
    kind = F.expr("case id % 5 when 2 then 'photo' when 4 then '' else 'diagram' end")
    text = F.expr("case id % 5 when 0 then 'Flow-chart of the login' when 1 then 'two routers, a router' when 2 then 'Photograph of the lab' else '' end")
    return v.questions.select("id", t.diagram_kind(kind, F.lit("fig.png"), text).alias("kind"))
