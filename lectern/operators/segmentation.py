"""From page text to questions: a window form for all lines at once, and an exact form by a small automaton over ranges of pages.

Whether a line joins the open question depends on how that one ends and how long it is by then, so the exact form
is a scan: ranges of pages are summed up as tables of states, composed, and cut with the state they begin with. What
follows the cut (options, type, confidence, notes) is column work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lectern.functions.text import diagram_kind, figure_type
from lectern.sources.shared import stored

from .bank import nearest_above

#: Fixed patterns: how questions, options, parts and headers begin, and words that tell a question's type.
START = r"(?i)^\s*(?:Q\s*\.?\s*|Question\s+)?(\d+)\s*[\.\)\:\-]?\s*(.*)"
STRICT = r"(?i)^\s*(?:Q\s*\.?\s*\d+[\.\)\:\-]?\s+|Question\s+\d+[\.\)\:\-]?\s+|\d+[\.\)]\s+).*"
OPTION = r"(?i)^\s*(?:\(?[A-D]\)|\(?[A-D]\.|\b[A-D][\.\)])\s*(.*)"
OPTION_BODY = r"(?i)^\s*(?:\(?([A-D])\)?[\.\)]?)\s*(.*)"
PART = r"(?i)^\s*(?:\(?[a-z]\)|\(?[ivxlcdm]+\)|\(?[a-z]\.|\(?[0-9]+\)|[0-9]+\([a-z]\))\s+.*"
HEADER = r"(?i)^\s*(?:Section|Part|Instructions|Note|Appendix|Unit)\b.*"
NUMERICAL = r"(?i)\b(calculate|compute|evaluate|find the value|numerical|solve|determine the|what is the value|average waiting time)\b"
TRUE_FALSE = r"(?i)\b(true\s*/\s*false|true or false)\b"
DESCRIPTIVE = r"(?i)\b(explain|describe|discuss|elaborate|state|define|illustrate|compare|discuss the|explain the|with neat diagram)\b"
QUESTION_WORDS = ("what is", "define", "explain", "describe", "discuss", "calculate", "which", "how", "why", "determine", "find", "deadlock", "process", "paging", "scheduling", "preemptive")
TITLE_MARKS = ("PYQ", "MCQ Test")

#: Lengths in bytes at which the rules change.
SHORT_TITLE, COURSE_TITLE, SHOUTED_LEAST, SHOUTED_MOST, LONG_LINE, SHORT_HEADER, LEAST_START = 25, 80, 5, 50, 60, 40, 15
LONG_TEXT, LONGER_TEXT = 50, 80

_START, _STRICT, _OPTION, _PART, _HEADER = (re.compile(p) for p in (START, STRICT, OPTION, PART, HEADER))


def size(text: str) -> int:
    """Lengths in the rules are bytes."""
    return len(text.encode())


def looks_like_title(line: str) -> bool:
    """X11."""
    n, low = size(line), line.lower()
    short = n < SHORT_TITLE and "?" not in line and "." not in line and line.count(" ") <= 3
    course = n < COURSE_TITLE and "?" not in line and "operating system" in low and not any(w in low for w in ("what", "define", "explain")) and any(m in line for m in ("–", "-", "202"))
    shouted = SHOUTED_LEAST < n < SHOUTED_MOST and line == line.upper()
    return any(m in line for m in TITLE_MARKS) or short or course or shouted


def looks_like_question(line: str) -> bool:
    """X11."""
    low = line.lower()
    return "?" in line or any(w in low for w in QUESTION_WORDS) or (size(line) > LONG_LINE and " " in line)


class State(NamedTuple):
    """What the lines so far mean for the next one. All that counts of the last question's text is here, so there are only some hundred states."""

    kind: str = "none"  # none: no question yet; bare: a number without text; open; shut: ended by a header
    numbered: bool = False  # whether a numbered question has come
    ended: bool = False  # whether the text ends as a sentence does
    size: int = 0  # bytes of the text, MOST at most
    blanks: int = 0  # empty lines behind it, MOST at most
    start: int = -1  # place of the question's first line, -1: before these lines


MOST = LONGER_TEXT + 1


def continues(before: State, line: str) -> bool:
    """X4. Whether a line belongs to the text before it."""
    if not before.size or before.ended:
        return False
    if _OPTION.match(line) or _PART.match(line):
        return True
    if before.size > LONG_TEXT and "a" <= line[:1] <= "z":
        return True
    return bool(_START.match(line)) and not _STRICT.match(line) and before.size > LONGER_TEXT


def text_state(text: str) -> State:
    text = text.strip()
    return State("open", True, text[-1:] in tuple(".?!:"), min(MOST, size(text)))


def _added(s: State, line: str) -> State:
    n = size(line) if s.kind == "bare" else s.size + s.blanks + 1 + size(line)
    return s._replace(kind="open" if s.kind == "bare" else s.kind, ended=line[-1] in ".?!:", size=min(MOST, n), blanks=0)


def step(s: State, line: str, at: int) -> tuple[State, tuple | None]:
    """X3. One stripped line, at a place -> the next state, and what the line does: ("add", text), or ("new", number, text, how)."""

    def begun(number: str | None, text: str, how: str, numbered: bool):
        kind = State("bare", numbered, start=at)
        return (_added(kind, text) if text else kind), ("new", number, text, how)

    if not line:
        return (s._replace(blanks=min(MOST, s.blanks + 1)), ("add", "")) if s.kind == "open" else (s, None)
    if _HEADER.match(line):
        if s.kind == "open" and size(line) < SHORT_HEADER:
            return _added(s, line), ("add", line)
        return (s._replace(kind="shut") if s.numbered else State()) if s.kind == "open" else s, None
    if m := _START.match(line):
        number, rest = m[1], m[2].strip()
        if len(number) == 4 and number.startswith("20") and not rest:  # a year by itself
            return (_added(s, line), ("add", line)) if s.kind == "open" else (s, None)
        if s.kind == "open" and continues(s, line):
            return _added(s, line), ("add", line)
        return begun(number, rest, "strict" if _STRICT.match(line) else number, True)
    if s.kind in ("open", "bare") or (s.kind == "shut" and continues(s, line)):
        return _added(s, line), ("add", line)
    if s.kind == "shut":
        return begun(None, line, "unnumbered-after-numbered", True)
    if size(line) > LEAST_START and not looks_like_title(line) and looks_like_question(line):
        return begun(None, line, "unnumbered-start", False)
    return s, None


def _classes() -> list[State]:
    """A state for every way in which those before a range can differ for it: the text's length enters its first line by a class, later by length and blanks together."""
    out = [State(), State("bare", True)]
    for kind, numbered in (("open", True), ("open", False), ("shut", True)):
        for ended in (False, True):
            for most, least in ((LONG_TEXT, 1), (LONGER_TEXT, LONG_TEXT + 1), (MOST, MOST)):
                out += [State(kind, numbered, ended, min(n, most), n - min(n, most)) for n in range(least, MOST + 1)]
    return out


def _class(s: State) -> State:
    """The one of _classes that a state belongs to."""
    if s.kind in ("none", "bare"):
        return State(s.kind, s.numbered)
    most = LONG_TEXT if s.size <= LONG_TEXT else LONGER_TEXT if s.size <= LONGER_TEXT else MOST
    n = min(MOST, s.size + s.blanks)
    return State(s.kind, s.numbered, s.ended, min(n, most), n - min(n, most))


CLASSES = _classes()
_STATE = pa.struct([("kind", pa.string()), ("numbered", pa.bool_()), ("ended", pa.bool_()), ("size", pa.int32()), ("blanks", pa.int32()), ("start", pa.int64())])
STATE = "struct<kind:string,numbered:boolean,ended:boolean,size:int,blanks:int,start:long>"


def _lines(run: list[dict]) -> Iterator[tuple[int, int, str]]:
    """(place, page, stripped line) of a document's pages in a range."""
    at = 0
    for r in run:
        for line in (r["text"] or "").split("\n"):
            yield at, r["page_number"], line.strip()
            at += 1


def _documents(table: pa.Table) -> Iterator[list[dict]]:
    run: list[dict] = []
    for batch in table.sort_by([(c, "ascending") for c in ("document_id", "page_number", "text")]).to_batches(max_chunksize=1024):
        for r in batch.to_pylist():
            if run and r["document_id"] != run[0]["document_id"]:
                yield run
                run = []
            run.append(r)
    if run:
        yield run


def _transitions(run: list[dict]) -> list[State]:
    """The state behind a document's lines for each state before them. Different states soon become alike, so few are followed."""
    now = {k: [k] for k in CLASSES}  # state: the classes that have come to it
    for at, _, line in _lines(run):
        then: dict[State, list] = {}
        for s, came in now.items():
            then.setdefault(step(s, line, at)[0], []).extend(came)
        now = then
    end = {k: s for s, came in now.items() for k in came}
    return [end[k] for k in CLASSES]


def segment(pages: DataFrame) -> DataFrame:
    """X3, X4. Pages (document_id, page_number, text) -> document_id, position, number, text, start_page, end_page, how.

    What a line means depends on the lines before it by a small state alone (State). Pages are cut into ranges by document and number,
    from a sample that Spark takes. A document that goes over several ranges gets for each of them a table of states behind by states before;
    these are composed along the document, and every range is then cut with the state it begins with. Pieces of a question from several ranges
    are joined at the end. So no document is gathered in one task. Null texts are empty; pages of one number go by text.
    """
    spark, id_kind = pages.sparkSession, pages.schema["document_id"].dataType
    id_name, id_arrow = id_kind.simpleString(), to_arrow_schema(StructType([StructField("document_id", id_kind)])).field(0)
    rows = pages.select("document_id", F.col("page_number").cast("long").alias("page_number"), "text").filter("document_id is not null")
    ranged = stored(rows.repartitionByRange("document_id", "page_number", F.md5("text")).withColumn("range", F.spark_partition_id()))
    # At most two documents of a range go into another one, so the tables below grow with the number of ranges alone.
    wide = ranged.groupBy("document_id").agg(F.min("range").alias("a"), F.max("range").alias("b")).filter("a < b").select("document_id")

    def tables(table: pa.Table) -> pa.Table:
        out = [(run[0]["document_id"], run[0]["range"], [s._asdict() for s in _transitions(run)]) for run in _documents(table)]
        return pa.Table.from_pylist([dict(zip(("document_id", "range", "behind"), r)) for r in out], pa.schema([id_arrow, ("range", pa.int32()), ("behind", pa.list_(_STATE))]))

    def plans(table: pa.Table) -> pa.Table:
        s, owner, out = State(), None, []
        for r in sorted(table.to_pylist(), key=lambda r: r["range"]):
            out.append({"document_id": r["document_id"], "range": r["range"], "before": s._asdict() | {"start": -1}, "owner": owner})
            s = State(**r["behind"][CLASSES.index(_class(s))])
            owner = r["range"] * PLACES + s.start if s.start >= 0 else owner
        return pa.Table.from_pylist(out, pa.schema([id_arrow, ("range", pa.int32()), ("before", _STATE), ("owner", pa.int64())]))

    kind = f"document_id {id_name}"
    found = ranged.join(F.broadcast(wide), "document_id").groupBy("range", "document_id").applyInArrow(tables, f"{kind}, range int, behind array<{STATE}>")
    planned = stored(found.groupBy("document_id").applyInArrow(plans, f"{kind}, range int, before {STATE}, owner long"))

    names = [("range", pa.int32()), ("question", pa.int64()), ("number", pa.string()), ("text", pa.string()), ("start_page", pa.int64()), ("end_page", pa.int64()), ("how", pa.string())]
    schema = pa.schema([id_arrow, *names])

    def cut(table: pa.Table) -> pa.Table:
        out = []
        for run in _documents(table):
            s = State(**run[0]["before"]) if run[0]["before"] else State()
            # The part of a question that began before this range comes first.
            piece = {"question": run[0]["owner"], "number": None, "lines": [], "start_page": None, "end_page": None, "how": None}
            pieces = [piece]
            for at, page, line in _lines(run):
                s, act = step(s, line, at)
                if act and act[0] == "new":
                    piece = {"question": run[0]["range"] * PLACES + at, "number": act[1], "lines": [act[2]] if act[2] else [], "start_page": page, "end_page": page, "how": act[3]}
                    pieces.append(piece)
                elif act:
                    piece["lines"].append(act[1])
                    if act[1]:
                        piece["end_page"] = page
            head = {"document_id": run[0]["document_id"], "range": run[0]["range"]}
            out += [head | {k: v for k, v in p.items() if k != "lines"} | {"text": "\n".join(p["lines"])} for p in pieces if p["lines"] or p["how"]]
        return pa.Table.from_pylist(out, schema)

    rows = ranged.join(F.broadcast(planned), ["document_id", "range"], "left")
    pieces = rows.groupBy("range").applyInArrow(cut, ", ".join([kind, "range int, question long, number string, text string, start_page long, end_page long, how string"]))
    parts = F.array_sort(F.collect_list(F.struct("range", "text")))
    whole = pieces.groupBy("document_id", "question").agg(
        F.max("number").alias("number"), F.max("how").alias("how"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"),
        F.array_join(F.transform(F.filter(parts, lambda p: (p["text"] != "") | (p["range"] != F.floor(F.col("question") / PLACES))), lambda p: p["text"]), "\n").alias("text"))
    whole = stored(whole.withColumn("text", F.regexp_replace("text", r"^\n+|\n+$", "")).filter("text <> ''").withColumn("range", F.floor(F.col("question") / PLACES)))
    # Positions: questions of the ranges before, then the place within the range.
    counts = whole.groupBy("document_id", "range").agg(F.count("*").alias("n"))
    before = counts.select("document_id", "range", F.coalesce(F.sum("n").over(Window.partitionBy("document_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("document_id", "range").orderBy("question")) - 1
    numbered = whole.withColumn("place", place).join(before, ["document_id", "range"])
    return numbered.select("document_id", (F.col("before") + F.col("place")).cast("int").alias("position"), "number", "text", F.col("start_page").cast("int").alias("start_page"), F.col("end_page").cast("int").alias("end_page"), "how")


#: A question's number is its range times this, plus the place of its first line there.
PLACES = 1 << 40


def segment_fast(pages: DataFrame) -> DataFrame:
    """X3 by windows: every line with a number starts a question, the lines after it belong to it. No rule on lengths applies."""
    lines = pages.select("document_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    order = Window.partitionBy("document_id").orderBy("page_number", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("line").rlike(START) & ~F.col("line").rlike(HEADER)
    islands = lines.withColumn("island", F.sum(begins.cast("int")).over(order)).filter("island > 0")
    body = F.when(begins, F.regexp_extract("line", START, 2)).otherwise(F.col("line"))
    rows = islands.withColumn("number", F.when(begins, F.regexp_extract("line", START, 1))).withColumn("body", body)
    per = rows.groupBy("document_id", "island").agg(F.max("number").alias("number"), F.array_sort(F.collect_list(F.struct("page_number", "line_no", "body"))).alias("l"), F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page"))
    return per.select("document_id", F.col("island").cast("int").alias("position"), "number", F.trim(F.array_join(F.transform("l", lambda x: x["body"]), "\n")).alias("text"), "start_page", "end_page")


def mostly_numeric(text: Column) -> Column:
    """X11."""
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return (digits > 8) & (digits / F.octet_length(text) > 0.15)


def describe(questions: DataFrame) -> DataFrame:
    """X6-X9. Adds options, question_type, confidence and notes to segmented questions."""
    text, n = F.col("text"), F.octet_length("text")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    d = questions.withColumn("lines", lines).withColumn("n_options", F.size(F.filter("lines", lambda x: x.rlike(OPTION))))
    collected = F.transform(F.filter("lines", lambda x: x.rlike(OPTION_BODY)), lambda x: F.coalesce(F.nullif(F.trim(F.regexp_extract(x, OPTION_BODY, 2)), F.lit("")), F.regexp_extract(x, OPTION_BODY, 1)))
    d = d.withColumn("options", F.when(F.col("n_options") >= 2, collected).otherwise(F.array().cast("array<string>")))
    many = F.col("n_options") >= 2
    rules = [
        (many & text.rlike(TRUE_FALSE), "true_false", "true_false"),
        (many & (F.size("options") > 4), "MSQ", "msq"),
        (many, "MCQ", "mcq"),
        (text.rlike(NUMERICAL) | mostly_numeric(text), "numerical", "numerical"),
        (n > 200, "descriptive", "descriptive-long"),
        (text.rlike(DESCRIPTIVE) & (n > 30), "descriptive", "descriptive-keyword"),
        (F.contains(text, F.lit("?")) & (n > 30), "descriptive", "descriptive-question-mark"),
        (F.exists("lines", lambda x: x.rlike(PART)), "descriptive", "descriptive-subquestions"),
    ]
    kind, why = F.lit("unknown"), F.lit("unknown")
    for test, name, reason in reversed(rules):
        kind, why = F.when(test, name).otherwise(kind), F.when(test, reason).otherwise(why)
    d = d.withColumn("question_type", kind).withColumn("why", why)
    confidence = 0.45 + F.when(F.col("number").isNotNull(), 0.3).otherwise(0.0) + F.when(F.size("options") > 0, 0.12).otherwise(0.0) + F.when(many & (F.col("question_type") == "MCQ"), 0.03).otherwise(0.0) + F.when((F.col("question_type") == "descriptive") & (n > 120), 0.05).otherwise(0.0)
    notes = F.array_compact(F.array(
        F.concat(F.lit("matched-"), "how"),
        F.concat(F.lit("type-"), "why"),
        F.when(F.col("number").isNotNull(), "matched-numbered").otherwise("unnumbered"),
        F.when(F.size("options") > 0, F.concat(F.lit("options-"), F.size("options").cast("string"))),
    ))
    return d.withColumn("confidence", F.least(F.lit(0.97), confidence)).withColumn("notes", notes).drop("lines", "n_options", "why")


BUCKET = 4096


def merge_weak(questions: DataFrame) -> DataFrame:
    """X5. Joins a piece under 0.6 with the next one under 0.5 on the same or next page, where it continues; a joined piece isn't joined again.

    Pieces meet the next one by their position, in an equi-join. In a run of pieces of which each could join the next, every other one does: a
    run's start is a running maximum, first within buckets of positions, then over them.
    """
    cols = ["document_id", "position", "number", "text", "start_page", "end_page", "question_type", "confidence"]
    rows = questions.select(*cols)
    follows = F.udf(lambda a, b: continues(text_state(a), b), "boolean", useArrow=True)
    after = rows.select("document_id", (F.col("position") - 1).alias("position"), *[F.col(c).alias(f"next_{c}") for c in cols[2:]])
    near = (F.col("confidence") < 0.6) & (F.col("next_confidence") < 0.5) & (F.col("next_start_page") - F.col("end_page")).isin(0, 1)
    pairs = stored(rows.join(after, ["document_id", "position"]).filter(near).filter(follows("text", "next_text")))
    links = pairs.select("document_id", "position")
    # A link begins a run if the position before it has none.
    earlier = links.select("document_id", (F.col("position") + 1).alias("position"), F.lit(True).alias("goes_on"))
    links = links.join(earlier, ["document_id", "position"], "left").withColumn("begin", F.when(F.col("goes_on").isNull(), F.col("position"))).withColumn("bucket", F.floor(F.col("position") / BUCKET))
    inside = Window.partitionBy("document_id", "bucket").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("document_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = links.groupBy("document_id", "bucket").agg(F.max("begin").alias("m")).select("document_id", "bucket", F.max("m").over(over).alias("carried"))
    starts = links.withColumn("own", F.max("begin").over(inside)).join(buckets, ["document_id", "bucket"])
    joined = starts.filter((F.col("position") - F.coalesce("own", "carried")) % 2 == 0).select("document_id", "position")
    first = pairs.join(joined, ["document_id", "position"]).select(
        "document_id", "position", F.coalesce(F.nullif("number", F.lit("")), "next_number").alias("number"), F.trim(F.concat("text", F.lit("\n"), "next_text")).alias("text"), "start_page", F.col("next_end_page").alias("end_page"),
        F.when(F.col("question_type") == "unknown", F.col("next_question_type")).otherwise(F.col("question_type")).alias("question_type"), ((F.col("confidence") + F.col("next_confidence")) / 2).alias("confidence"))
    taken = joined.unionByName(joined.withColumn("position", F.col("position") + 1))
    return first.unionByName(rows.join(taken, ["document_id", "position"], "left_anti").select(*first.columns))


def blocks(text: str) -> list[str]:
    """X10. Paragraphs; those over 600 bytes are packed by sentences to about 400."""
    out = []
    for part in filter(None, map(str.strip, text.split("\n\n"))):
        if size(part) <= 600:
            out.append(part)
            continue
        packed = ""
        for sentence in part.split(". "):
            if packed and size(packed) + size(sentence) > 400:
                out.append(packed.strip())
                packed = ""
            packed = f"{packed}. {sentence}" if packed else sentence
        out += [packed.strip()] if packed else []
    return out


def fallback(pages: DataFrame, questions: DataFrame) -> DataFrame:
    """X10. Blocks of documents that gave no question: document_id, page_number, text, question_type, confidence.

    Options make 0.38, else 0.32; a document without any block gives its pages at 0.25, if it has over 40 bytes.
    """
    bare = pages.join(questions.select("document_id"), "document_id", "left_anti").withColumn("text", F.trim(F.coalesce("text", F.lit("")))).filter("text <> ''")
    long = bare.groupBy("document_id").agg(F.sum(F.octet_length("text")).alias("n")).filter("n > 40").select("document_id")
    bare = bare.join(long, "document_id", "left_semi")
    cut = F.udf(lambda t: [] if looks_like_title(t) or _HEADER.match(t) else [b for b in blocks(t) if size(b) >= 20], "array<string>", useArrow=True)
    found = bare.select("document_id", "page_number", F.explode(cut("text")).alias("text"))
    opts = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(F.regexp_extract(F.trim(x), OPTION_BODY, 2)) != ""))
    text, n = F.col("text"), F.octet_length("text")
    kind = F.when(opts >= 2, "MCQ").when(text.rlike(NUMERICAL), "numerical").when(text.rlike(TRUE_FALSE), "true_false").when((n > 80) | (text.rlike(DESCRIPTIVE) & (n > 30)) | (F.contains(text, F.lit("?")) & (n > 30)), "descriptive").otherwise("unknown")
    found = found.select("document_id", "page_number", "text", kind.alias("question_type"), F.when(opts >= 2, 0.38).otherwise(0.32).alias("confidence"))
    rest = bare.join(found.select("document_id"), "document_id", "left_anti").select("document_id", "page_number", "text", F.lit("unknown").alias("question_type"), F.lit(0.25).alias("confidence"))
    return found.unionByName(rest)


def offsets(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """X12. Where a question's first line starts on its first page, and its last line ends on its last one, in characters from 0; null where not found."""
    page = lambda n, name: pages.select("document_id", F.col("page_number").alias(n), F.col("text").alias(name))
    rows = questions.join(page("start_page", "first_text"), ["document_id", "start_page"], "left").join(page("end_page", "last_text"), ["document_id", "end_page"], "left")
    first, last = F.element_at(F.split("text", "\n"), 1), F.trim(F.element_at(F.split("text", "\n"), -1))
    start = F.instr(F.col("first_text"), first) - 1
    back = F.instr(F.reverse("last_text"), F.reverse(last))
    return rows.withColumn("start_offset", F.when(start >= 0, start)).withColumn("end_offset", F.when((last != "") & (back > 0), F.length("last_text") - back + 1)).drop("first_text", "last_text")


#: Heights on a page from the bottom, for questions in order, for one that goes on from an earlier page, and for lines; how the two estimates are weighed.
TOP, APART, GOES_ON, FIRST_LINE, LINE, BY_ORDER, ANCHOR = 700.0, 160.0, 400.0, 720.0, 14.0, 0.7, 40
#: Finer kinds that make a note.
NOTED_KINDS = ["chart", "circuit", "flowchart", "geometry", "graph", "network", "table", "timeline"]


def line_height(question: Column, number: Column, page: Column) -> Column:
    """X13. Where on its page a question's first line stands, by lines: the first that holds its beginning or lies in it, else the first with its number; null where none does."""
    lines = F.split(page, "\n")
    anchor = F.substring(F.get(F.filter(F.transform(F.split(question, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), 1, ANCHOR)
    place = lambda test: F.nullif(F.array_position(F.transform(lines, test), True), F.lit(0).cast("long"))
    at = F.coalesce(place(lambda x: F.contains(x, anchor) | F.contains(anchor, F.trim(x))), F.when(F.coalesce(number, F.lit("")) != "", place(lambda x: F.contains(x, number))))
    return F.when(page != "", FIRST_LINE - LINE * (at - 1))


def image_questions(questions: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """X13, J11. Images (document_id, page_number, name, x, y) -> the question of each one: document_id, page_number, name, x, y, position, note.

    Of the questions on an image's page, the one whose height is the least at or above the image's, else the topmost. A question's height is 0.7 of
    its order on the page and 0.3 of its first line's; one that goes on from an earlier page lies in the middle. An image at the origin has no place and goes to the page's first question, and one on a page with one
    question to that. Images on pages without a question are left out.
    """
    paged = images.select("document_id", "page_number").distinct()
    spread = questions.withColumn("page_number", F.explode(F.sequence("start_page", F.greatest("start_page", "end_page")))).join(paged, ["document_id", "page_number"], "left_semi")
    begins = F.col("start_page") == F.col("page_number")
    order = F.row_number().over(Window.partitionBy("document_id", "page_number", begins).orderBy("position")) - 1
    texts = pages.groupBy("document_id", "page_number").agg(F.max(F.coalesce("text", F.lit(""))).alias("page_text"))
    placed = spread.withColumn("order", order).join(texts, ["document_id", "page_number"], "left")
    by_line = line_height(F.col("text"), F.col("number"), F.col("page_text"))
    by_order = TOP - APART * F.col("order")
    placed = placed.select("document_id", "page_number", F.col("position").alias("id"), F.when(~begins, GOES_ON).otherwise(F.coalesce(BY_ORDER * by_order + (1 - BY_ORDER) * by_line, by_order)).alias("y"))
    placed = stored(placed)
    on_page = placed.groupBy("document_id", "page_number").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max(F.struct("y", (-F.col("id")).alias("id")))["id"].alias("top"))
    keyed = images.withColumn("image_id", F.struct("document_id", "page_number", "name", "x", "y"))
    above = nearest_above(keyed, placed).select("image_id.*", F.col("question_id").alias("above"))
    nowhere = (F.col("x") == 0) & (F.col("y") == 0)
    position = F.when((F.col("n") == 1) | nowhere, F.col("first")).otherwise(F.coalesce("above", -F.col("top")))
    note = F.when((F.col("n") > 1) & ~nowhere, F.concat(F.lit("image-associated:"), "name", F.lit("@page"), F.col("page_number").cast("string"), F.lit(":y"), F.format_string("%.0f", F.col("y").cast("double"))))
    return above.join(on_page, ["document_id", "page_number"]).select("document_id", "page_number", "name", "x", "y", position.cast("int").alias("position"), note.alias("note"))


def image_details(found: DataFrame, images: DataFrame) -> DataFrame:
    """X13. The images of each question and its visual notes: document_id, position, images (array of name, figure_type, description), notes.

    found is what image_questions gives. Of images with one name in a document the first described one counts, by page, else the first. Notes say how images were placed, that
    there are any, their types and finer kinds, and which of them are described.
    """
    described = F.trim(F.coalesce("description", F.lit(""))) != ""
    best = F.min_by(F.struct("figure_type", F.trim(F.coalesce("description", F.lit(""))).alias("description")), F.struct((~described).alias("bare"), "page_number", "y", "x"))
    named = images.groupBy("document_id", "name").agg(best.alias("d"))
    each = found.groupBy("document_id", "position", "name").agg(F.min("page_number").alias("page_number"), F.array_sort(F.collect_list("note")).alias("notes")).join(named, ["document_id", "name"], "left")
    item = F.struct("page_number", "name", F.coalesce("d.figure_type", F.lit("")).alias("figure_type"), F.coalesce("d.description", F.lit("")).alias("description"), "notes")
    rows = each.groupBy("document_id", "position").agg(F.array_sort(F.collect_list(item)).alias("list"))
    kinds = lambda of: F.array_sort(F.array_distinct(F.transform("list", of)))
    types = F.filter(kinds(lambda x: figure_type(x["figure_type"])), lambda x: ~x.isin("", "unknown"))
    finer = F.filter(kinds(lambda x: diagram_kind(x["figure_type"], x["name"], x["description"])), lambda x: x.isin(NOTED_KINDS))
    noted = lambda prefix, names: F.transform(names, lambda x: F.concat(F.lit(prefix), x))
    seen = F.transform("list", lambda x: F.concat(F.when(x["description"] != "", "visual:described:").otherwise("visual:undescribed:"), x["name"]))
    status = F.array(F.when(F.exists("list", lambda x: x["description"] != ""), "vision:described").otherwise("vision:unavailable"))
    notes = F.concat(F.flatten(F.transform("list", lambda x: x["notes"])), F.array(F.lit("visual:has_image")), noted("visual:figure-", types), noted("visual:diagram-", finer), seen, status)
    return rows.select("document_id", "position", F.transform("list", lambda x: F.struct(x["name"].alias("name"), x["figure_type"].alias("figure_type"), x["description"].alias("description"))).alias("images"), F.array_distinct(notes).alias("notes"))
