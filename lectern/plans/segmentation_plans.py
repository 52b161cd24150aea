"""Segmentation queries over the pages view."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import segmentation as s
from lectern.sources.shared import stored

from .base import query


def _any(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


#: The lines of all documents, step by step: the state of each document is carried from line to line.
EXACT = f"""with recursive l as (
    select document_id, page_number, trim(line) as line, row_number() over (partition by document_id order by page_number, text, n) as i
    from (select document_id, page_number, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from pages_view)),
  f as (
    select *, strlen(line) as z, regexp_matches(line, '{s.HEADER}') as header, regexp_matches(line, '{s.START}') as begins, regexp_matches(line, '{s.STRICT}') as strict,
      regexp_matches(line, '{s.OPTION}') or regexp_matches(line, '{s.PART}') as part, regexp_extract(line, '{s.START}', 1) as number, trim(regexp_extract(line, '{s.START}', 2)) as rest,
      left(line, 1) between 'a' and 'z' as small,
      {_any("line", s.TITLE_MARKS)} or (strlen(line) < 25 and not {_any("line", "?.")} and length(line) - length(replace(line, ' ', '')) <= 3)
        or (strlen(line) < 80 and not contains(line, '?') and contains(lower(line), 'operating system') and not {_any("lower(line)", ("what", "define", "explain"))} and {_any("line", ("–", "-", "202"))})
        or (strlen(line) between 6 and 49 and line = upper(line)) as title,
      contains(line, '?') or {_any("lower(line)", s.QUESTION_WORDS)} or (strlen(line) > 60 and contains(line, ' ')) as asks
    from l),
  run as (
    select distinct document_id, 0::bigint as i, 'none' as kind, false as numbered, false as ended, 0::bigint as size, 0::bigint as blanks, 0::bigint as q, '' as act, '' as body from l
    union all
    select document_id, i,
      case act when 'new' then case when rest = '' then 'bare' else 'open' end when 'after' then 'open' when 'first' then 'open' when 'shut' then case when numbered then 'shut' else 'none' end when 'add' then case kind when 'bare' then 'open' else kind end else kind end,
      act in ('new', 'after') or (act <> 'first' and numbered),
      case when act in ('new', 'after', 'first', 'add') then right(body, 1) in ('.', '?', '!', ':') else ended end,
      case when act in ('new', 'after', 'first') or (act = 'add' and kind = 'bare') then strlen(body) when act = 'add' then size + blanks + 1 + strlen(body) else size end,
      case when act = 'blank' then blanks + 1 when act in ('new', 'after', 'first', 'add') then 0 else blanks end,
      case when act in ('new', 'after', 'first') then i else q end, act, body
    from (select *, case when act = 'new' then rest else line end as body from (select f.*, r.kind, r.numbered, r.ended, r.size, r.blanks, r.q,
        r.size > 0 and not r.ended and (part or (r.size > 50 and small) or (begins and not strict and r.size > 80)) as goes_on,
        case when z = 0 then case when kind = 'open' then 'blank' else '' end
             when header then case when kind <> 'open' then '' when z < 40 then 'add' else 'shut' end
             when begins and length(number) = 4 and number like '20%' and rest = '' then case when kind = 'open' then 'add' else '' end
             when begins then case when kind = 'open' and goes_on then 'add' else 'new' end
             when kind in ('open', 'bare') then 'add'
             when kind = 'shut' then case when goes_on then 'add' else 'after' end
             when z > 15 and not title and asks then 'first' else '' end as act
      from run r join f on f.document_id = r.document_id and f.i = r.i + 1))),
  whole as (
    select r.document_id, q, trim(string_agg(body, chr(10) order by r.i) filter (where act <> 'new' or body <> ''), chr(10)) as text, min(page_number) filter (where act <> 'blank') as start_page, max(page_number) filter (where act <> 'blank') as end_page,
      max(case when act = 'new' then number end) as number,
      max(case act when 'new' then case when strict then 'strict' else number end when 'after' then 'unnumbered-after-numbered' when 'first' then 'unnumbered-start' end) as how
    from run r join f using (document_id, i) where act in ('new', 'after', 'first', 'add', 'blank') group by all)
select document_id, (row_number() over (partition by document_id order by q) - 1)::int as position, number, text, start_page::int as start_page, end_page::int as end_page, how from whole where text <> ''"""


@query("X3_segment_exact", EXACT, "pages_view")
def _(v):
    return s.segment(v.pages_view)


@query("X3_segment_fast", """with l as (select document_id, page_number, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from pages_view),
  b as (select *, trim(line) as t, regexp_matches(trim(line), '(?i)^\\s*(?:Q\\s*\\.?\\s*|Question\\s+)?(\\d+)\\s*[\\.\\)\\:\\-]?\\s*(.*)') as begins from l where trim(line) <> ''),
  i as (select *, sum(begins::int) over (partition by document_id order by page_number, n rows unbounded preceding) as island from b)
select document_id, island::int as position, max(case when begins then regexp_extract(t, '(?i)^\\s*(?:Q\\s*\\.?\\s*|Question\\s+)?(\\d+)', 1) end) as number, min(page_number) as start_page, max(page_number) as end_page, count(*) as lines from i where island > 0 group by document_id, island""", "pages_view")
def _(v):
    return s.segment_fast(v.pages_view).select("document_id", "position", "number", "start_page", "end_page", (F.size(F.split("text", "\n"))).cast("long").alias("lines"))


@query("X6_describe")
def _(v):
    return s.describe(s.segment(v.pages_view)).select("document_id", "position", F.size("options").alias("options"), "question_type", "confidence", F.array_join("notes", ",").alias("notes"))


@query("X5_merge_weak")
def _(v):
    return s.merge_weak(s.describe(s.segment(v.pages_view.withColumn("text", F.regexp_replace("text", r"^Q\d+\. ", "What is ")))))


@query("X10_fallback")
def _(v):
    return s.fallback(v.pages_view, s.segment(v.pages_view.filter("document_id % 2 = 0")))


@query("X12_offsets")
def _(v):
    return s.offsets(s.segment(v.pages_view), v.pages_view).select("document_id", "position", "start_offset", "end_offset")


def _images(v):
    pages = v.pages_view.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    height = F.when(F.col("page_number") % 5 == 4, 0).otherwise((F.col("page_number") * 37 + F.col("document_id") * 11 + F.col("k") * 210) % 700).cast("double")
    return pages.select(
        "document_id", "page_number", F.concat(F.lit("i"), F.col("page_number") % 3, F.lit("-"), "k").alias("name"), F.when(height == 0, 0.0).otherwise(50.0).alias("x"), height.alias("y"),
        F.when(F.col("k") == 0, "Plots").otherwise(" ").alias("figure_type"), F.when(F.col("page_number") % 2 == 0, F.concat(F.lit(" Flowchart of "), "role")).alias("description"))


@query("X13_image_questions")
def _(v):
    return s.image_questions(stored(s.segment(v.pages_view)), _images(v), v.pages_view)


@query("X13_image_details")
def _(v):
    found = s.image_details(s.image_questions(stored(s.segment(v.pages_view)), _images(v), v.pages_view), _images(v))
    return found.select("document_id", "position", F.array_join(F.transform("images", lambda x: x["name"]), ",").alias("images"), F.array_join("notes", ",").alias("notes"))
