"""Known values, stream against batch, and independence of row order."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.functions import text, topics
from lectern.operators import analytics, bank, embedding, quiz, retrieval, review, segmentation
from lectern.plans import registry

ATTEMPT = "id long, user_id long, session_id string, question_id string, source_question_id string, topic string, is_correct boolean, time_taken_seconds double, created_at timestamp_ntz"
AT = datetime(2026, 9, 20, 10)


@pytest.fixture(scope="module")
def attempts(spark):
    rows = [
        (1, 1, "s1", "q1", None, "Deadlock", True, 30.0, AT),
        (2, 1, "s1", "q2", None, "Deadlock", True, 40.0, AT),
        (3, 1, "s1", "q3", None, "Paging", False, 60.0, AT + timedelta(days=1)),
        (4, 1, "s1", "q4", None, "Paging", False, 120.0, AT + timedelta(days=1)),
    ]
    return spark.createDataFrame(rows, ATTEMPT)


def test_mastery(attempts):
    got = {r.topic: (r.mastery, r.level) for r in analytics.topic_mastery(analytics.topic_breakdown(attempts, "user_id")).collect()}
    assert got["Deadlock"] == (pytest.approx(200 / 7), "beginner") and got["Paging"] == (0.0, "novice")


def test_difficulty_and_timing(spark, attempts):
    known = spark.createDataFrame([("q1", "Easy"), ("q2", "Easy"), ("q3", "hard"), ("q4", "hard")], "question_id string, difficulty string")
    got = {r.difficulty: (r.accuracy, r.mean_seconds) for r in analytics.difficulty_stats(analytics.with_difficulty(attempts, known)).collect()}
    assert got == {"easy": (100.0, 35.0), "hard": (0.0, 90.0)}
    t = analytics.timing(attempts).first()
    assert (t["mean"], t["median"], t["p90"]) == (62.5, 50.0, 120.0)


def test_readiness(attempts):
    r = analytics.readiness(attempts, F.lit("2026-09-22 10:00:00").cast("timestamp"), 4).first()
    assert (r.accuracy, r.coverage, r.recency, r.band) == (50, 50, 100, "developing") and r.score == pytest.approx(43.21, abs=0.01)


def test_schedule(spark):
    now = datetime(2026, 3, 1, 12)
    log = [("q1", True, 1), ("q2", True, 72), ("q2", True, 48), ("q2", True, 24), ("q3", True, 72), ("q3", True, 48), ("q3", False, 24), (" ", True, 5), (None, True, 6)]
    rows = [(i, 1, "s", q, "src-only" if q == " " else None, "t", ok, 1.0, now - timedelta(hours=h)) for i, (q, ok, h) in enumerate(log)]
    df = spark.createDataFrame(rows, ATTEMPT)
    for form in (review.schedule, review.schedule_fold):
        got = {r.key: (r.repetitions, round(r.interval_days, 6), round(r.easiness, 6)) for r in form(df).collect()}
        assert got == {"q1": (1, 1.0, 2.5), "q2": (3, 15.0, 2.5), "q3": (0, 1.0, 2.3), "src-only": (1, 1.0, 2.5)}


def test_difficulty_levels(spark):
    rows = [("What is paging?", 2, 95.0, "easy"), ("What is paging?", 2, 10.0, "medium"), ("x" * 1500, 5, 20.0, "hard"), ("x" * 300, 4, -1.0, "medium"), ("", 0, -1.0, "easy")]
    df = spark.createDataFrame(rows, "t string, n int, a double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", quiz.estimate_difficulty(F.col("t"), F.col("n"), F.col("a"))).collect())
    steps = [("easy", 90, "medium"), ("hard", 90, "hard"), ("hard", 30, "medium"), ("easy", 30, "easy"), ("medium", 65, "medium"), (" MEDIUM ", 95, "hard"), ("", 90, "hard"), ("", 65, "medium"), ("easy", 80, "medium"), ("hard", 49.9, "medium")]
    df = spark.createDataFrame([(a, float(b), c) for a, b, c in steps], "c string, a double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", quiz.adjust_difficulty(F.col("c"), F.col("a"))).collect())


def test_topic_names(spark):
    cases = {"Deadlocks": "Deadlock", "deadlock": "Deadlock", "Deadlock Problem": "Deadlock", "dead lock": "Deadlock", "dead-lock": "Deadlock", "Semaphores": "Semaphore", "Processes": "Processes", "  DEADLOCKS  ": "Deadlock", " ": "", "databases": "Databas", "cpu scheduling": "CPU Scheduling"}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string").withColumn("got", topics.canonical_name(F.col("raw")))
    assert {r.raw: r.got for r in df.collect()} == cases


def test_topic_merging(spark):
    t = spark.createDataFrame([("1", "Deadlocks"), ("2", "deadlock"), ("3", "Deadlock Problem"), ("4", "Paging"), ("5", "paging"), ("6", "CPU Scheduling")], "id string, name string")
    assert {r.key: r.ids for r in topics.merge_candidates(t).collect()} == {"deadlock": "1,2,3", "paging": "4,5"}
    labels = spark.createDataFrame([(1, 0, "Deadlocks", 0.8, "a"), (1, 1, "deadlock", 0.9, ""), (1, 2, "Deadlock Problem", 0.5, "b"), (1, 3, "Paging", 0.7, ""), (1, 4, "  paging ", 0.6, "c")], "question_id int, position int, topic string, confidence double, subject string")
    assert {r.topic: (r.confidence, r.subject) for r in topics.merge_labels(labels).collect()} == {"Deadlock": (0.9, "a"), "Paging": (0.7, "c")}


def test_merge_refuses_bad_mappings(spark):
    links = spark.createDataFrame([(1, "a", 0.5)], "question_id int, topic_id string, confidence double")
    t = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    for bad in ([("a", "b"), ("a", "c")], [("a", "b"), ("b", "c")]):
        with pytest.raises(ValueError):
            bank.merge_topics(links, t, spark.createDataFrame(bad, "source_id string, target_id string"))


def segmented(spark, *pages):
    df = spark.createDataFrame([(1, i + 1, p) for i, p in enumerate(pages)], "document_id long, page_number int, text string")
    return segmentation.describe(segmentation.segment(df)).orderBy("position").collect()


def test_segmentation(spark):
    a = segmented(spark, "Q1. What is a process?\nExplain briefly.", "Q2. Define deadlock.\nA. Resource\nB. Scheduling")
    assert len(a) == 2 and (a[0].start_page, a[0].end_page) == (1, 1) and a[1].question_type == "MCQ"
    b = segmented(spark, "Q7. Explain deadlock in operating systems and describe resource allocation graph", "which shows circular wait condition. Also discuss prevention.")
    assert len(b) == 1 and (b[0].start_page, b[0].end_page) == (1, 2)
    c = segmented(spark, "Q1. What is a process? Explain states.\nQ2. Define deadlock.", "Q3. What is paging?\nExplain virtual memory.")
    assert [x.start_page for x in c] == [1, 1, 2]
    d = segmented(spark, "Q1. Which is correct?\nA. Process is program\nB) Thread is lightweight\nC. Deadlock is unsafe\nD) None")
    assert len(d[0].options) == 4 and d[0].confidence >= 0.6
    assert segmented(spark, "Q5. Calculate the page fault rate given references 1,2,3,4. Evaluate the value.")[0].question_type == "numerical"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.normalize(F.lit("\n\nIntro\n\n\n\nBody\n\n"))) == "Intro\n\nBody"
    assert one(text.normalize(F.lit("one\r\ntwo\rthree\t\tx"))) == "one\ntwo\nthree x"
    assert one(text.diagram_kind(F.lit("diagram"), F.lit("fig.png"), F.lit("Flowchart of the login process."))) == "flowchart"
    assert one(text.diagram_kind(F.lit("photo"), F.lit("lab.png"), F.lit("Photograph of the laboratory setup."))) == "photo"
    assert one(text.diagram_kind(F.lit(""), F.lit(""), F.lit(""))) == "unknown"
    assert one(F.size(text.table_rows(F.lit("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |")))) == 3
    assert one(text.math_expressions(F.lit("$x+1$ and $x+1$"))) == ["$x+1$"] and one(text.math_expressions(F.lit("plain prose"))) == []
    rows = F.array(F.array(F.lit("Process"), F.lit(" ")), F.array(F.lit("P1"), F.lit("5")), F.array(F.lit("P2"), F.lit("x" * 50)))
    assert one(text.table_summary(rows)) == "Table with 3 rows x 2 columns. Headers: Process, (blank). First row: P1, 5. (+1 more row.)"
    assert one(text.table_summary(F.array(F.array(F.lit("y" * 41))))) == f"Table with 1 row x 1 column. Headers: {'y' * 37}...."
    assert one(text.table_summary(F.array().cast("array<array<string>>"))) == "Empty table."
    assert one(text.redact(F.lit("write to (a.b@c.org),  now"))) == "write to ([redacted-email]), now"
    assert one(text.redact(F.lit("x" * 600))).endswith("…[truncated]")


def test_fusion(spark):
    ranks = "query_id long, id long, score double, rank int"
    vector, keyword = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.1, 2)], ranks), spark.createDataFrame([(1, 2, 0.9, 1), (1, 1, 0.1, 2)], ranks)
    first = lambda w: retrieval.fuse(vector, keyword, 10, weights=w).orderBy("rank").first()
    assert (first((0.8, 0.2)).id, first((0.8, 0.2)).score) == (1, 0.74) and first((0.2, 0.8)).id == 2
    lists = spark.createDataFrame([(1, 0, "v", 1, 1), (1, 0, "v", 2, 2), (1, 1, "k", 2, 1), (1, 1, "k", 3, 2)], "query_id long, variant int, source string, id long, rank int")
    fused = retrieval.fuse_lists(lists, 60).orderBy("rank").collect()
    assert len(fused) == 3 and fused[0].id == 2 and fused[0].lists == 2


def test_metrics(spark):
    hits = spark.createDataFrame([("s", 1, 1, 1), ("s", 1, 2, 2), ("s", 1, 9, 3)], "strategy string, query_id long, id long, rank int")
    rel = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, id long")
    r = retrieval.evaluate(hits, rel, spark.createDataFrame([(1,), (2,)], "query_id long"), ["s"], (1, 3)).orderBy("query_id").collect()
    assert (r[0].recall, r[0].precision, r[0].hit3) == (pytest.approx(2 / 3), pytest.approx(2 / 3), True) and (r[1].recall, r[1].precision) == (0, 0)


def test_failing_model(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[1.0] for _ in texts]

    inputs = spark.createDataFrame([("a", "ok"), ("b", "bad"), ("c", "ok2")], "hash string, input string").coalesce(1)
    got = {r.hash: (r.vector, r.error) for r in embedding.call_model(inputs, model, batch=1, backoff=0.0).collect()}
    assert got["a"] == ([1.0], None) and got["b"] == (None, "ValueError: no")


def test_first_items(spark):
    items = spark.createDataFrame([("z", 0, "s1", "A"), ("z", 1, "s1", "B"), ("z", 2, "s2", "b "), ("z", 3, "s3", " a")], "quiz_id string, position long, source_question_id string, question string")
    # The second item is dropped for its source, so its text is free for the third.
    assert [r.position for r in quiz.first_items(items).orderBy("position").collect()] == [0, 2]


@pytest.mark.parametrize("stream, batch, keys", [("T4_review_schedule", "W6_review_schedule", ("user_id", "key")), ("T5_throttle", "W13_throttle", ("id",))])
def test_stream_equals_batch(spark, stream, batch, keys):
    columns = [*keys, "allowed"] if stream == "T5_throttle" else [*keys, "repetitions", "interval_days", "easiness"]
    rows = [sorted(tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in registry.QUERIES[n](spark, "/root/testdata/sf0.001").select(*columns).collect()) for n in (stream, batch)]
    assert rows[0] == rows[1]


def test_order_of_rows_does_not_matter(spark, attempts):
    many = attempts.unionByName(attempts.withColumn("id", F.col("id") + 10))
    forms = [review.schedule(many.orderBy(F.col("id").desc() if d else F.col("id"))).orderBy("key").collect() for d in (0, 1)]
    assert forms[0] == forms[1]


def test_redact_returns_every_row(spark, tmp_path):
    from lectern.plans.registry import QUERIES

    texts = ["plain words", "write to me@x.org now", "me@x.org", "a @ b stays", None]
    spark.createDataFrame([(k, x, "en", "a", len(x or "")) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = {0: "plain words", 1: "write to [redacted-email] now", 2: "[redacted-email]", 3: "a @ b stays", 4: ""}
    assert dict(tuple(r) for r in QUERIES["X25_redact"](spark, str(tmp_path)).collect()) == want
