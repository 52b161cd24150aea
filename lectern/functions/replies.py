"""Replies of a model as strict JSON: what a reply says, or why it is rejected.

All of it is column work; a reply is a row of its own. Replies are read with Spark's variant parser, which wants the whole text to be JSON
and no field twice; the fields of an object are then held against those it may have, so that an unknown one is an error and not dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"
#: The fields of a classification and of its topics, and the most topics it can have.
RESULT_FIELDS, TOPIC_FIELDS, MOST_TOPICS = ["subject", "topics"], ["topic", "confidence", "subject"], 10


def trimmed(x: Column) -> Column:
    return F.trim(x, F.lit(BLANKS))


def without_fences(reply: Column) -> Column:
    """What stands between Markdown fences, if the reply begins with one; else the reply, trimmed. The fence's line goes, and all from the last fence on."""
    s = trimmed(F.coalesce(reply, F.lit("")))
    body = F.when(F.contains(s, F.lit("\n")), F.regexp_replace(s, r"^[^\n]*\n", "")).otherwise(F.regexp_replace(s, r"^```(json|JSON)?", ""))
    return F.when(F.startswith(s, F.lit("```")), trimmed(F.regexp_replace(body, r"(?s)```(?!.*```).*$", ""))).otherwise(s)


def json_text(reply: Column) -> Column:
    """X31. The JSON text of a reply: without fences, and without the prose around it if it doesn't begin with a brace."""
    s = without_fences(reply)
    found = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(F.startswith(s, F.lit("{")) | (found == ""), s).otherwise(found)


def json_in(reply: Column) -> Column:
    """X31. The same, null where a reply has no object."""
    s = json_text(reply)
    return F.when(F.startswith(s, F.lit("{")), s)


def _keys(v: Column) -> Column:
    return F.map_keys(v.try_cast("map<string,variant>"))


def classified(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """X31. Adds subject, topics (array of topic, confidence, subject) and error, which is null for a reply that holds in every rule.

    Errors: ``invalid JSON``, ``trailing data``, ``unknown field``, ``wrong type``, ``subject is required``, ``topics is required``, ``too many topics``,
    ``topic name is required``, ``confidence out of range``, ``subject must not be whitespace``. With one, subject and topics are null.
    """
    # In brackets, the parser can't stop behind the first value.
    text, rows = json_text(F.col(reply)), replies.columns
    made = replies.withColumn("_text", text).withColumns({
        "_first": F.try_parse_json("_text"),
        "_whole": F.try_parse_json(F.concat(F.lit("["), "_text", F.lit("]"))).try_cast("array<variant>"),
    }).withColumn("_keys", _keys(F.col("_first")))
    made = made.withColumns({
        "_subject": F.try_variant_get("_first", "$.subject", "string"),
        "_topics": F.try_variant_get("_first", "$.topics", "variant").try_cast("array<variant>"),
        "_kinds": F.array(F.schema_of_variant(F.try_variant_get("_first", "$.subject", "variant")), F.schema_of_variant(F.try_variant_get("_first", "$.topics", "variant"))),
    })
    topic = lambda x: F.struct(F.try_variant_get(x, "$.topic", "string").alias("topic"), F.coalesce(F.try_variant_get(x, "$.confidence", "double"), F.lit(0.0)).alias("confidence"), F.coalesce(F.try_variant_get(x, "$.subject", "string"), F.lit("")).alias("subject"))
    made = made.withColumn("_list", F.transform("_topics", topic))
    blank = lambda x: trimmed(F.coalesce(x, F.lit(""))) == ""
    known = lambda keys, allowed: F.size(F.array_except(keys, F.array(*[F.lit(f) for f in allowed]))) == 0
    is_kind = lambda x, path, kinds: F.coalesce(F.schema_of_variant(F.try_variant_get(x, path, "variant")), F.lit("VOID")).rlike(f"^({kinds}|VOID)")
    errors = [
        (F.col("_first").isNull(), "invalid JSON"),
        (F.coalesce(F.size("_whole"), F.lit(0)) != 1, "trailing data"),
        (F.col("_keys").isNull(), "invalid JSON"),
        (~known(F.col("_keys"), RESULT_FIELDS) | F.exists("_topics", lambda x: ~known(_keys(x), TOPIC_FIELDS)), "unknown field"),
        (~is_kind(F.col("_first"), "$.subject", "STRING") | ~is_kind(F.col("_first"), "$.topics", "ARRAY") | F.exists("_topics", lambda x: _keys(x).isNull() | ~is_kind(x, "$.topic", "STRING") | ~is_kind(x, "$.subject", "STRING") | ~is_kind(x, "$.confidence", "BIGINT|DOUBLE|DECIMAL|FLOAT")), "wrong type"),
        (blank(F.col("_subject")), "subject is required"),
        (F.col("_topics").isNull(), "topics is required"),
        (F.size("_topics") > MOST_TOPICS, "too many topics"),
        (F.exists("_list", lambda x: blank(x["topic"])), "topic name is required"),
        (F.exists("_list", lambda x: (x["confidence"] < 0) | (x["confidence"] > 1)), "confidence out of range"),
        (F.exists("_list", lambda x: (x["subject"] != "") & blank(x["subject"])), "subject must not be whitespace"),
    ]
    error = F.coalesce(*[F.when(test, name) for test, name in errors])
    made = made.withColumn("_error", error)
    right = F.col("_error").isNull()
    return made.select(*rows, F.when(right, F.col("_subject")).alias("subject"), F.when(right, F.col("_list")).alias("topics"), F.col("_error").alias("error"))


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X31. The replies that hold, and a table of rejects with their reason."""
    return parsed.filter("error is null").drop("error"), parsed.filter("error is not null").drop("subject", "topics")
