"""The question bank: scans, filters, joins, set operations and merges over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import blank_to_null


def page(df: DataFrame, *order: Column, limit: int = 20, offset: int = 0, most: int = 100) -> DataFrame:
    """F8, S1. A page of an ordered table; limit and offset are clamped. The order must end with a unique column."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(most, limit if limit > 0 else 20))


def page_per(df: DataFrame, key: str, *order: Column, limit: int = 20, offset: int = 0) -> DataFrame:
    """S4, K4. The same page for every key at once."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).filter((F.col("rank") > max(0, offset)) & (F.col("rank") <= max(0, offset) + limit)).drop("rank")


def metadata_filter(questions: DataFrame, subject=None, year=None, year_min=None, year_max=None, document=None, kind=None, difficulty=None) -> DataFrame:
    """F1. All given conditions hold; an empty or absent one doesn't count; strings are trimmed."""
    text = {"subject": subject, "document_id": document, "question_type": kind, "difficulty": difficulty}
    tests = [F.col(c) == x.strip() for c, x in text.items() if x and x.strip()]
    tests += [t for x, t in ((year, F.col("year") == year), (year_min, F.col("year") >= year_min), (year_max, F.col("year") <= year_max)) if x is not None]
    return questions.filter(reduce(lambda a, b: a & b, tests)) if tests else questions


def metadata_filters(questions: DataFrame, filters: DataFrame) -> DataFrame:
    """F1 for a table of filters (query_id and nullable conditions): one row for each filter and question that fits it.

    Every filter meets its questions by an equi-join: on subject, else difficulty, else the years that fit.
    """
    keys = ("subject", "year_min", "year_max", "difficulty")
    f = filters.select("query_id", *[F.col(k).alias(f"f_{k}") for k in keys])
    q = questions

    def rest(d: DataFrame) -> DataFrame:
        ok = (F.col("f_year_min").isNull() | (F.col("year") >= F.col("f_year_min"))) & (F.col("f_year_max").isNull() | (F.col("year") <= F.col("f_year_max"))) & (F.col("f_difficulty").isNull() | (F.col("difficulty") == F.col("f_difficulty")))
        return d.filter(ok).select("query_id", "id")

    exact = q.join(f.filter("f_subject is not null"), F.col("subject") == F.col("f_subject"))
    # Without a subject, the difficulty is the key; without both, the years that fit are, of the few that there are.
    free = f.filter("f_subject is null")
    graded = q.join(free.filter("f_difficulty is not null"), F.col("difficulty") == F.col("f_difficulty"))
    years = q.select(F.col("year").alias("own_year")).distinct()
    fits = (F.col("f_year_min").isNull() | (F.col("own_year") >= F.col("f_year_min"))) & (F.col("f_year_max").isNull() | (F.col("own_year") <= F.col("f_year_max")))
    dated = q.join(free.filter("f_difficulty is null").join(years, fits), F.col("year").eqNullSafe(F.col("own_year")))
    return rest(exact).unionByName(rest(graded)).unionByName(rest(dated))


def has_topic(questions: DataFrame, links: DataFrame, topics: DataFrame | None = None, names: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """F2, F3, J4. Questions with a topic of these ids, or of these names whatever the case."""
    if ids is not None:
        links = links.filter(F.col("topic_id").isin(ids))
    if names is not None:
        wanted = topics.filter(F.lower("name").isin([n.lower() for n in names])).select(F.col("id").alias("topic_id"))
        links = links.join(wanted, "topic_id", "left_semi")
    return questions.join(links.select(F.col("question_id").alias("id")), "id", "left_semi")


def visible(df: DataFrame, user: int | None, owner: str = "owner") -> DataFrame:
    """F5. Own rows and rows without an owner; without a user only the latter."""
    free = F.col(owner).isNull()
    return df.filter(free if user is None else free | (F.col(owner) == user))


def source_filter(df: DataFrame, difficulty: str | None = None, subject: str | None = None, kind: str | None = None, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """F6. A null fails where a condition is set; text is compared trimmed and whatever the case."""
    same = lambda c, x: F.coalesce(F.lower(F.trim(c)) == x.strip().lower(), F.lit(False))
    for c, x in (("difficulty", difficulty), ("subject", subject), ("question_type", kind)):
        df = df.filter(same(c, x)) if x and x.strip() else df
    if year_min:
        df = df.filter(F.coalesce(F.col("year") >= year_min, F.lit(False)))
    return df.filter(F.coalesce(F.col("year") <= year_max, F.lit(False))) if year_max else df


def clean_sources(df: DataFrame, **conditions) -> DataFrame:
    """F7. Drops blank ids, then repeats (the first by rank stays), then blank texts, then what the conditions reject."""
    ided = df.withColumn("id", blank_to_null(F.col("id").cast("string"))).filter("id is not null")
    first = ided.withColumn("seen", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).filter("seen = 1").drop("seen")
    return source_filter(first.filter(F.trim(F.coalesce("question_text", F.lit(""))) != ""), **conditions)


def violations(*rules: tuple[str, Column]) -> Column:
    """An array of the names of broken rules; a rule that comes out null counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), None).otherwise(name) for name, ok in rules]))


def check_attempts(df: DataFrame) -> DataFrame:
    """F9, F12. Attempts with is_correct and the rules they break."""
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < 4)
    broken = violations(
        ("question", blank_to_null(F.coalesce("question_id", F.lit(""))).isNotNull() | blank_to_null(F.coalesce("source_question_id", F.lit(""))).isNotNull()),
        ("selected", inside("selected_answer")),
        ("correct", inside("correct_answer")),
        ("time", ~F.isnan("time_taken_seconds") & (F.col("time_taken_seconds") >= 0)),
    )
    return df.withColumn("is_correct", F.col("selected_answer") == F.col("correct_answer")).withColumn("violations", broken)


def check_questions(df: DataFrame) -> DataFrame:
    """F10. Extracted questions with the rules they break."""
    kinds = ["MCQ", "MSQ", "true_false", "numerical", "descriptive", "unknown"]
    broken = violations(
        ("text", F.trim("question_text") != ""),
        ("start_page", F.col("start_page") > 0),
        ("end_page", F.col("end_page") >= F.col("start_page")),
        ("confidence", (F.col("confidence") >= 0) & (F.col("confidence") <= 1)),
        ("type", F.col("question_type").isin(kinds)),
    )
    return df.withColumn("violations", broken)


def topics_of(questions: DataFrame, links: DataFrame, topics: DataFrame) -> DataFrame:
    """J2. Each question's topic names in order."""
    named = links.join(topics.select(F.col("id").alias("topic_id"), "name"), "topic_id")
    per = named.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return questions.select(F.col("id").alias("question_id")).join(per, "question_id")


def topics_with_counts(topics: DataFrame, links: DataFrame) -> DataFrame:
    """J3, A9. Topics with the number of their questions, 0 where none."""
    per = links.groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("questions"))
    return topics.join(per, "id", "left").fillna(0, ["questions"])


def topic_subjects(attempts: DataFrame, sessions: DataFrame) -> DataFrame:
    """J13. The subject of a topic within a session: that of its first attempt; blank, the session's."""
    rows = attempts.withColumn("topic", blank_to_null(F.col("topic"))).filter("topic is not null")
    first = rows.groupBy("session_id", "topic").agg(F.min_by(F.trim("subject"), F.struct("created_at", "id")).alias("first"))
    return first.join(sessions, "session_id", "left").select("session_id", "topic", F.coalesce(blank_to_null(F.col("first")), "subject").alias("subject"))


def first_topic(hits: DataFrame, links: DataFrame, topics: DataFrame) -> DataFrame:
    """J12. The first topic name of each hit, null where none."""
    named = links.join(topics.select(F.col("id").alias("topic_id"), "name"), "topic_id").groupBy("question_id").agg(F.min("name").alias("topic"))
    return hits.join(named, "question_id", "left")


def nearest_above(images: DataFrame, questions: DataFrame) -> DataFrame:
    """J11. Each image's closest question above it on its page; of those at one height the smallest id.

    Both are sorted together from the top of the page down, and each image takes the last question before it: no pairs are made.
    """
    q = questions.select("document_id", "page_number", "y", F.lit(0).alias("side"), F.col("id").alias("question_id"), F.lit(None).cast(images.schema["image_id"].dataType).alias("image_id"))
    i = images.select("document_id", "page_number", "y", F.lit(1).alias("side"), F.lit(None).cast(questions.schema["id"].dataType).alias("question_id"), "image_id")
    down = Window.partitionBy("document_id", "page_number").orderBy(F.desc("y"), "side", F.desc("question_id")).rowsBetween(Window.unboundedPreceding, 0)
    return q.unionByName(i).withColumn("question_id", F.last("question_id", ignorenulls=True).over(down)).filter("side = 1").select("image_id", "question_id")


def exclude(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """J5, U3, S11. Rows whose key isn't listed."""
    return df.join(ids.select(key), key, "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """U4. Rows whose key is listed."""
    return df.join(ids.select(key), key, "left_semi")


def by_id(ids: DataFrame, df: DataFrame, key: str = "id") -> DataFrame:
    """S10. One row for each id asked for, nulls where there is none."""
    return ids.select(key).join(df, key, "left")


def upsert(old: DataFrame, new: DataFrame, key: str, *newest: str) -> DataFrame:
    """S7. Rows of both by key; new ones win over old ones, then the newest, then the largest row."""
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    best = both.groupBy(key).agg(F.max(F.struct("side", *newest, *[c for c in rest if c not in newest])).alias("b"))
    return best.select(key, *[F.col("b")[c].alias(c) for c in rest])


def append(df: DataFrame, path: str) -> None:
    """S6, S8. Adds rows to a Parquet table, as they are dealt."""
    df.write.mode("append").parquet(path)


def answered(questions: DataFrame, attempts: DataFrame, user: int) -> tuple[DataFrame, DataFrame]:
    """U5. Questions that a learner hasn't met, and those answered wrongly at least once."""
    own = attempts.filter(F.col("user_id") == user).withColumn("id", F.coalesce(blank_to_null(F.col("source_question_id")), blank_to_null(F.col("question_id"))))
    keyed = questions.withColumn("key", F.concat(F.lit("q"), "id"))
    seen, wrong = own.select(F.col("id").alias("key")), own.filter(~F.col("is_correct")).select(F.col("id").alias("key"))
    return keyed.join(seen, "key", "left_anti").drop("key"), keyed.join(wrong, "key", "left_semi").drop("key")


def merge_topics(links: DataFrame, topics: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U8, U9. Links of each source topic go to its target, the largest confidence stays; source topics go.

    A mapping that names a source twice or lets a target be a source is refused.
    """
    bad = mapping.groupBy("source_id").count().filter("count > 1").select("source_id").unionByName(mapping.select(F.col("target_id").alias("source_id")).join(mapping.select("source_id"), "source_id", "left_semi"))
    if not bad.isEmpty():
        raise ValueError("a source topic is listed twice or is itself a target")
    moved = links.join(mapping.withColumnRenamed("source_id", "topic_id"), "topic_id", "left")
    merged = moved.groupBy("question_id", F.coalesce("target_id", "topic_id").alias("topic_id")).agg(F.max("confidence").alias("confidence"))
    return merged, topics.join(mapping.select(F.col("source_id").alias("id")), "id", "left_anti")


def unknown_topics(mapping: DataFrame, topics: DataFrame) -> DataFrame:
    """U9. Ids of a mapping that no topic has."""
    ids = mapping.select(F.col("source_id").alias("id")).unionByName(mapping.select(F.col("target_id").alias("id"))).distinct()
    return ids.join(topics, "id", "left_anti")


def replace_topics(links: DataFrame, new: DataFrame) -> DataFrame:
    """U10. All links of the questions in ``new`` are replaced by theirs."""
    return links.join(new.select("question_id"), "question_id", "left_anti").unionByName(new)


def upsert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """U11. A new confidence wins unless it is null."""
    n = new.select("question_id", "topic_id", F.col("confidence").alias("new_confidence"))
    both = links.join(n, ["question_id", "topic_id"], "full_outer")
    return both.select("question_id", "topic_id", F.coalesce("new_confidence", "confidence").alias("confidence"))


def find_or_create(topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """U12. Topics for wanted (name, subject) pairs that aren't there yet; the id is a hash of the key, so reruns agree."""
    key = lambda d: d.withColumn("key", F.concat_ws("\u0001", F.lower(F.trim("name")), F.coalesce("subject", F.lit(""))))
    fresh = key(wanted).groupBy("key").agg(F.min(F.struct("name", "subject")).alias("w"))
    return fresh.join(key(topics).select("key"), "key", "left_anti").select(F.substring(F.sha2("key", 256), 1, 32).alias("id"), F.trim("w.name").alias("name"), F.col("w.subject").alias("subject"))


def default_topics(questions: DataFrame, links: DataFrame) -> DataFrame:
    """U13. Questions without a topic get their subject, or General."""
    bare = questions.join(links.select(F.col("question_id").alias("id")), "id", "left_anti")
    return bare.select(F.col("id").alias("question_id"), F.coalesce(blank_to_null(F.col("subject")), F.lit("General")).alias("topic"))


def duplicates(items: DataFrame, quiz: str = "quiz_id", position: str = "position") -> DataFrame:
    """W5. Items whose text came before in their quiz, with the earlier position."""
    norm = F.lower(F.trim(F.regexp_replace("question", r"\s+", " ")))
    before = F.lag(position).over(Window.partitionBy(quiz, "norm").orderBy(position))
    return items.withColumn("norm", norm).withColumn("earlier", before).filter("earlier is not null").drop("norm")
