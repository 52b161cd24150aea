"""Hosts of very many labels, sources of low weight, and many equal rows."""

from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.llm import mixing, url_filter


def test_host_of_very_many_labels(spark):
    long = ".".join(["a"] * 100_000)
    urls = [f"http://{long}.example.com/en/7", f"http://{long}.com/en/x", f"http://{long}/en/", "http://com/en/", "http://example.com/en/", None, "http:///en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, len(r.host)) for r in url_filter.judge(pages, url_filter.rules_table(spark)).collect()}
    assert got == {
        0: ("example.com/en/7", "allow", len(long) + 12), 1: ("com/en/", "block", len(long) + 4), 2: (None, "allow", len(long)), 3: ("com/en/", "block", 3), 4: ("com/en/", "block", 11), 5: (None, "allow", 0), 6: (None, "allow", 0),
    }


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages, url_filter.rules_table(spark).limit(0), default="block").collect()] == ["block"]


def test_ranges_are_even_whatever_the_weight(spark):
    n = 100_000
    for weight in (0.05, 1.0, 20.0):
        key = -F.log(mixing.uniform(F.col("id"), F.lit("x"))) / weight
        most = spark.range(n).groupBy(F.floor(F.log(key) * F.sqrt(F.lit(n)))).count().agg(F.max("count")).first()[0]
        assert most < 300


def plain_mix(rows, limit=3):
    """doc_id, text, source, weight -> how often each (doc_id, text, source) is taken, by one sort."""
    import hashlib
    from math import log

    own = Counter()
    for _, t, s, _ in rows:
        own[s] += len(t.split())
    names = sorted(own)
    share, goal, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, sum(own.values())
    free = set(names)
    while free:
        level = left / sum(share[s] for s in free)
        over = {s for s in free if share[s] * level > limit * own[s]}
        goal |= {s: limit * own[s] for s in over} if over else {s: share[s] * level for s in free}
        left -= sum(limit * own[s] for s in over)
        free = free - over if over else set()

    def key(row):
        i, t, _, w = row
        name = f"{'' if i is None else i}/{hashlib.md5(t.encode()).hexdigest()}"
        return -log((int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / max(0.05, w), i is not None, i or 0

    taken, upto = Counter(), Counter()
    for row in sorted(rows, key=key):
        i, t, s, _ = row
        n = len(t.split())
        whole = int(goal[s] / own[s] + 1e-12)
        upto[s] += n
        rest = goal[s] - whole * own[s]
        taken[i, t, s] += n * (whole + (rest > 1e-9 and n > 0 and upto[s] - n / 2 <= rest))
    return taken


def test_mix_equals_one_sort(spark):
    rows = [(k, "w " * (1 + k % 7), "abc"[k % 3], (0.05, 1.0, 9.0)[k % 3]) for k in range(3000)]
    rows += [(None, "same text here", "c", 1.0)] * 2000 + [(None, "", "c", 1.0)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double").repartition(5)
    out = mixing.mix(docs, keep=("text",), weight=F.col("weight"))
    got = Counter()
    for r in out.collect():
        got[r.doc_id, r.text, r.source] += r.taken
    assert out.count() == len(rows) and got == plain_mix(rows)


def test_equal_rows_lie_in_many_places_before_they_are_told_apart(spark):
    docs = spark.createDataFrame([(None, "same text", "a")] * 1000 + [(k, "other", "a") for k in range(10)], "doc_id long, text string, source string")
    out = mixing.mix(docs).withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "taken")))
    assert out.count() == 1010 and {r.taken for r in out.collect()} <= {0, 1, 2, 3, 4, 6}
