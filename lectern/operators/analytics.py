"""Learning analytics: grouped folds over an attempt log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_LIFE = 5.0
WEAK_BELOW = 70.0


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def session_metrics(attempts: DataFrame, sessions: DataFrame) -> DataFrame:
    """A1. One row for each session, zeros where nothing was tried."""
    right = F.count_if("is_correct")
    per = attempts.groupBy("session_id").agg(F.count("*").alias("attempted"), right.alias("correct"), F.avg("time_taken_seconds").alias("mean_seconds"))
    joined = sessions.select("session_id").join(per, "session_id", "left").fillna(0, ["attempted", "correct", "mean_seconds"])
    return joined.select("session_id", "attempted", "correct", (F.col("attempted") - F.col("correct")).alias("incorrect"), F.col("correct").alias("score"), percent(F.col("correct"), F.col("attempted")).alias("accuracy"), "mean_seconds")


def topic_breakdown(attempts: DataFrame, *keys: str) -> DataFrame:
    """A2. Counts by keys and topic; the topic is trimmed, blanks are skipped, case is kept."""
    rows = attempts.withColumn("topic", blank_to_null(F.col("topic"))).filter("topic is not null")
    per = rows.groupBy(*keys, "topic").agg(F.count("*").alias("attempted"), F.count_if("is_correct").alias("correct"))
    return per.withColumns({"incorrect": F.col("attempted") - F.col("correct"), "accuracy": percent(F.col("correct"), F.col("attempted"))})


def weak_topics(breakdown: DataFrame, threshold: float = WEAK_BELOW) -> DataFrame:
    """A3. Topics under the threshold; weakest first when shown."""
    return breakdown.filter(F.col("accuracy") < threshold)


def topic_mastery(breakdown: DataFrame) -> DataFrame:
    """A4. Accuracy weighed by n / (n + 5), in five bands."""
    m = F.col("accuracy") * (F.col("attempted") / (F.col("attempted") + HALF_LIFE))
    level = F.when(F.col("mastery") >= 80, "mastered").when(F.col("mastery") >= 60, "proficient").when(F.col("mastery") >= 40, "developing").when(F.col("mastery") >= 20, "beginner").otherwise("novice")
    return breakdown.withColumn("mastery", m).withColumn("level", level)


def daily_accuracy(attempts: DataFrame) -> DataFrame:
    """A5. By UTC day (the session's time zone is UTC)."""
    per = attempts.filter("created_at is not null").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("attempted"), F.count_if("is_correct").alias("correct"))
    return per.withColumn("accuracy", percent(F.col("correct"), F.col("attempted")))


def with_difficulty(attempts: DataFrame, difficulties: DataFrame) -> DataFrame:
    """J7. The key is source_question_id where it isn't blank, else question_id; a miss isn't tried again with the other."""
    keyed = attempts.withColumn("lookup", F.coalesce(blank_to_null(F.col("source_question_id")), F.trim("question_id")))
    found = keyed.join(difficulties.select(F.col("question_id").alias("lookup"), F.col("difficulty").alias("found")), "lookup", "left")
    return found.withColumn("difficulty", F.coalesce(F.lower(blank_to_null(F.col("found"))), F.lit("unknown"))).drop("found", "lookup")


def difficulty_stats(attempts: DataFrame) -> DataFrame:
    """A6. Attempts with ``difficulty`` -> counts, accuracy and mean time for each label."""
    per = attempts.groupBy("difficulty").agg(F.count("*").alias("attempted"), F.count_if("is_correct").alias("correct"), F.avg("time_taken_seconds").alias("mean_seconds"))
    return per.withColumn("accuracy", percent(F.col("correct"), F.col("attempted")))


def timing(attempts: DataFrame, *keys: str) -> DataFrame:
    """A7. Count, mean, median and nearest-rank 90th percentile; NaN and negative times count as 0."""
    t = F.when(F.isnan("time_taken_seconds") | (F.col("time_taken_seconds") < 0) | F.col("time_taken_seconds").isNull(), 0.0).otherwise(F.col("time_taken_seconds"))
    rows = attempts.withColumn("seconds", t)
    # Exact percentiles keep a count for each distinct value of a group, pre-aggregated before the shuffle.
    return rows.groupBy(*keys).agg(
        F.count("*").alias("attempted"),
        F.avg("seconds").alias("mean"),
        F.expr("percentile(seconds, 0.5)").alias("median"),
        F.expr("percentile_disc(0.9) within group (order by seconds)").alias("p90"),
    )


def readiness(attempts: DataFrame, now: Column, curriculum: int | None = None, key: str = "user_id") -> DataFrame:
    """A8. Score per learner: 0.40 mean mastery + 0.25 accuracy + 0.20 coverage + 0.15 recency, in bands."""
    mastery = topic_mastery(topic_breakdown(attempts, key)).groupBy(key).agg(F.avg("mastery").alias("mastery"))
    overall = attempts.groupBy(key).agg(
        percent(F.count_if("is_correct"), F.count("*")).alias("accuracy"),
        F.countDistinct(F.lower(blank_to_null(F.col("topic")))).alias("topics"),
        F.max("created_at").alias("latest"),
    )
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.col("latest").cast("timestamp"))) / 86_400e6)
    recency = F.when(F.col("latest").isNull(), 0.0)
    for most, score in ((1, 100.0), (3, 85.0), (7, 65.0), (14, 40.0), (30, 20.0)):
        recency = recency.when(days <= most, score)
    coverage = F.least(F.lit(100.0), F.col("topics") / curriculum * 100) if curriculum else F.lit(100.0)
    rows = overall.join(mastery, key, "left").fillna(0.0, ["mastery"]).withColumns({"coverage": coverage, "recency": recency.otherwise(5.0)})
    score = 0.40 * F.col("mastery") + 0.25 * F.col("accuracy") + 0.20 * F.col("coverage") + 0.15 * F.col("recency")
    band = F.when(F.col("score") >= 80, "exam-ready").when(F.col("score") >= 60, "almost-ready").when(F.col("score") >= 40, "developing").otherwise("getting-started")
    return rows.withColumn("score", score).withColumn("band", band).select(key, "mastery", "accuracy", "coverage", "recency", "score", "band")


def extraction_metrics(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """A12. Pages, questions, questions for each page, mean confidence, ambiguous and fallback shares by document."""
    q = questions.groupBy("document_id").agg(F.count("*").alias("questions"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") < 0.6).alias("ambiguous"), F.avg((F.col("confidence") < 0.4).cast("int")).alias("fallback_rate"))
    p = pages.groupBy("document_id").agg(F.count("*").alias("pages"))
    return p.join(q, "document_id", "left").fillna(0).withColumn("questions_per_page", F.col("questions") / F.col("pages"))


def page_summary(pages: DataFrame) -> DataFrame:
    """A13. Pages, extracted ones, those that need recognition, and errors, which count as not extracted."""
    per = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if("needs_ocr").alias("needs_ocr"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return per.withColumn("extracted", F.col("pages") - F.col("errors"))


def page_lengths(pages: DataFrame) -> DataFrame:
    """A14. Characters of each page."""
    return pages.select("document_id", "page_number", F.length("text").alias("characters"))


def document_topics(questions: DataFrame, links: DataFrame, topics: DataFrame) -> DataFrame:
    """A19. Questions by document and topic name, with the document's years."""
    named = links.join(topics.select(F.col("id").alias("topic_id"), "name"), "topic_id")
    per = questions.select(F.col("id").alias("question_id"), "document_id").join(named, "question_id").groupBy("document_id", "name").agg(F.count("*").alias("questions"))
    years = questions.groupBy("document_id").agg(F.sort_array(F.collect_set("year")).alias("ys")).select("document_id", F.array_join(F.col("ys").cast("array<string>"), ",").alias("years"), F.element_at("ys", 1).alias("first_year"), F.element_at("ys", -1).alias("last_year"))
    return per.join(years, "document_id")


def topic_difficulties(questions: DataFrame, links: DataFrame) -> DataFrame:
    """A20. Easy, medium and hard questions of each topic."""
    rows = links.join(questions.select(F.col("id").alias("question_id"), "difficulty"), "question_id")
    return rows.groupBy("topic_id").agg(*[F.count_if(F.col("difficulty") == d).alias(d) for d in ("easy", "medium", "hard")])


def round_robin_topics(items: DataFrame, topics: list[str], total_seconds: Column) -> DataFrame:
    """A21. Items of a quiz without topics get them in turn, and even shares of the quiz's time."""
    names = F.array(*[F.lit(t) for t in topics])
    sizes = items.groupBy("quiz_id").agg(F.count("*").alias("items"), F.max(total_seconds).alias("total"))
    rows = items.join(sizes, "quiz_id")
    return rows.select("quiz_id", "position", F.coalesce(blank_to_null(F.col("topic")), F.element_at(names, F.pmod("position", F.lit(len(topics))).cast("int") + 1)).alias("topic"), (F.col("total") / F.col("items")).alias("seconds"))


def call_accounting(calls: DataFrame) -> DataFrame:
    """A22. Calls, errors, tokens and latency by model and operation."""
    return calls.groupBy("model", "operation").agg(F.count("*").alias("calls"), F.count_if("failed").alias("errors"), F.sum("tokens").alias("tokens"), F.avg("latency").alias("mean_latency"), F.max("latency").alias("max_latency"))


def step_durations(calls: DataFrame, steps: list[str]) -> DataFrame:
    """A23. Total duration of each step by document, one column a step."""
    return calls.groupBy("document_id").agg(*[F.coalesce(F.sum(F.when(F.col("operation") == s, F.col("latency"))), F.lit(0.0)).alias(s) for s in steps])


def bank_totals(**tables: DataFrame) -> DataFrame:
    """A24. Rows of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("total")).select(F.lit(name).alias("name"), "total")
        out = row if out is None else out.unionByName(row)
    return out
