"""Topic names: canonical forms, keyword tagging, label clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that stand for others, and words with a spelling of their own.
ALIASES = {
    "deadlocks": "Deadlock",
    "deadlock problem": "Deadlock",
    "deadlock problems": "Deadlock",
    "dead lock": "Deadlock",
    "dead locks": "Deadlock",
    "paging": "Paging",
    "cpu scheduling": "CPU Scheduling",
    "synchronization": "Synchronization",
    "memory management": "Memory Management",
    "virtual memory": "Virtual Memory",
    "segmentation": "Segmentation",
    "file systems": "File Systems",
    "file system": "File Systems",
    "processes": "Processes",
    "process": "Processes",
    "threads": "Threads",
    "thread": "Threads",
    "io": "I/O",
    "i/o": "I/O",
}
SPELLINGS = {"cpu": "CPU", "i/o": "I/O", "io": "I/O"}
#: Topic, confidence and the keywords that show it.
RULES = [
    ("Deadlock", 0.85, ["deadlock", "dead lock", "banker", "circular wait", "resource allocation"]),
    ("Paging", 0.82, ["paging", "page fault", "page replacement", "virtual memory"]),
    ("CPU Scheduling", 0.80, ["cpu scheduling", "scheduling", "fcfs", "sjf", "round robin", "preemptive"]),
    ("Synchronization", 0.80, ["synchronization", "semaphore", "mutex", "monitor", "critical section", "race condition"]),
    ("Memory Management", 0.78, ["memory management", "segmentation"]),
    ("Segmentation", 0.78, ["segmentation"]),
    ("File Systems", 0.78, ["file system", "file systems"]),
    ("Processes", 0.70, ["process", "pcb", "context switch"]),
    ("Threads", 0.70, ["thread"]),
    ("I/O", 0.68, ["i/o", "io ", "device", "disk"]),
]
SUBJECT = "Operating Systems"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def singular(word: Column) -> Column:
    """A word without its plural ending. Endings in ses, xes, ches and shes lose two letters, as in "databas"."""
    n = F.octet_length(word)
    return (
        F.when(n <= 3, word)
        .when(word.endswith("ies") & (n > 4), F.concat(F.left(word, F.length(word) - 3), F.lit("y")))
        .when(word.rlike("(ses|xes|ches|shes)$"), F.left(word, F.length(word) - 2))
        .when(word.rlike("[^sui]s$"), F.left(word, F.length(word) - 1))
        .otherwise(word)
    )


def canonical_name(name: Column) -> Column:
    """X14. Blanks and hyphens collapsed, aliases resolved, words made singular and capitalised; blank stays blank."""
    lower = F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s-]+", " ")))
    one = F.array_join(F.transform(F.split(lower, " "), singular), " ")
    aliases, spellings = _map(ALIASES), _map(SPELLINGS)
    shown = F.array_join(F.transform(F.split(one, " "), lambda w: F.coalesce(F.try_element_at(spellings, w), F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w))))), " ")
    return F.coalesce(F.try_element_at(aliases, lower), F.try_element_at(aliases, one), shown)


def canonical_key(name: Column) -> Column:
    """X15."""
    return F.lower(canonical_name(name))


def merge_candidates(topics: DataFrame) -> DataFrame:
    """A10. Topics that share a canonical key: key, topics, ids."""
    keyed = topics.withColumn("key", canonical_key(F.col("name"))).filter("key <> ''")
    return keyed.groupBy("key").agg(F.count("*").alias("topics"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids")).filter("topics > 1")


def merge_labels(labels: DataFrame) -> DataFrame:
    """A11. Labels (question_id, position, topic, confidence, subject) -> one by canonical key, with the largest confidence.

    The subject is that of the label which raised the confidence last and had one, else of the first that had one.
    """
    rows = labels.withColumn("name", canonical_name(F.col("topic"))).filter("name <> ''").withColumn("subject", F.nullif(F.trim("subject"), F.lit("")))
    before = Window.partitionBy("question_id", "name").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    raised = F.coalesce(F.col("confidence") > F.max("confidence").over(before), F.lit(True))
    rows = rows.withColumn("raised", raised)
    known = F.col("subject").isNotNull()
    per = rows.groupBy("question_id", "name").agg(
        F.max("confidence").alias("confidence"),
        F.max(F.when(known & F.col("raised"), F.struct("position", "subject")))["subject"].alias("by_height"),
        F.min(F.when(known, F.struct("position", "subject")))["subject"].alias("by_place"),
    )
    return per.select("question_id", F.col("name").alias("topic"), "confidence", F.coalesce("by_height", "by_place").alias("subject"))


def tag(questions: DataFrame) -> DataFrame:
    """X16, J9. One row for each rule with a keyword in the text; a given subject goes before the rule's."""
    lower = F.lower(F.coalesce("question_text", F.lit("")))
    hits = []
    for topic, confidence, words in RULES:
        found = F.contains(lower, F.lit(words[0]))
        for w in words[1:]:
            found = found | F.contains(lower, F.lit(w))
        hits.append(F.when(found, F.struct(F.lit(topic).alias("topic"), F.lit(confidence).alias("confidence"))))
    subject = F.coalesce(F.nullif(F.trim("subject"), F.lit("")), F.lit(SUBJECT)).alias("subject")
    return questions.select("id", subject, F.explode(F.array_compact(F.array(*hits))).alias("x")).select("id", "x.topic", "x.confidence", "subject")
