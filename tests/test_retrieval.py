"""Searches against brute force on small tables: stems, substrings, vectors in a grid of blocks, relevance by class."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import stemming
from lectern.operators import retrieval
from lectern.plans import registry

V = "aeiouy"


def stem(w):
    """The published rules, letter by letter."""
    if w in stemming.FORMS:
        return stemming.FORMS[w]
    if len(w) <= 2 or w in stemming.UNCHANGED:
        return w
    letters = list(w)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in V):
            letters[i] = "Y"
    w = "".join(letters)

    def region(start):
        return next((i + 1 for i in range(start + 1, len(w)) if w[i] not in V and w[i - 1] in V), len(w))

    def short(x):
        if len(x) >= 3 and x[-3] not in V and x[-2] in V and x[-1] not in V + "wxY":
            return True
        return len(x) == 2 and x[0] in V and x[1] not in V

    def longest(suffixes):
        return max((x for x in suffixes if w.endswith(x)), key=len, default=None)

    r1 = next((len(h) for h in ("gener", "commun", "arsen") if w.startswith(h)), None) or region(0)
    r2 = region(r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in V for c in w[:-2]):
        w = w[:-1]
    if w in stemming.UNCHANGED_AFTER_PLURAL:
        return w.lower()
    suffix = longest(["eedly", "ingly", "edly", "eed", "ing", "ed"])
    if suffix in ("eed", "eedly"):
        w = w[: -len(suffix)] + "ee" if len(w) - len(suffix) >= r1 else w
    elif suffix and any(c in V for c in w[: -len(suffix)]):
        w = w[: -len(suffix)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif short(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    for table in (stemming.STEP_2, stemming.STEP_3):
        suffix = longest(table)
        if suffix and len(w) - len(suffix) >= r1:
            before = w[: -len(suffix)]
            fits = {"ogi": before.endswith("l"), "li": before[-1:] in tuple("cdeghkmnrt"), "ative": len(before) >= r2}
            w = before + table[suffix] if fits.get(suffix, True) else w
    suffix = longest(stemming.STEP_4)
    if suffix and len(w) - len(suffix) >= r2 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(suffix)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def many_words():
    r = random.Random(1)
    ends = [*stemming.STEP_2, *stemming.STEP_3, *stemming.STEP_4, "s", "es", "ed", "ing", "edly", "ingly", "eed", "eedly", "y", "e", "ies", "ied", "sses", "ying"]
    words = {"".join(r.choice("abcdefgilmnoprstuvwxy") for _ in range(r.randrange(7))) + r.choice(ends) + r.choice(["", "", "s", "ly", "ed"]) for _ in range(20_000)}
    return sorted(words | {*stemming.FORMS, *stemming.UNCHANGED, *stemming.UNCHANGED_AFTER_PLURAL, "generously", "commune", "arsenal", "2nd", "y", "yyy", "sayyid"})


def test_stemmer(spark):
    words = many_words()
    got = {r.word: r.stem for r in stemming.stemmed(spark.createDataFrame([(w,) for w in [*words, None]], "word string")).collect()}
    assert got.pop(None) is None
    assert {w: got[w] for w in words} == {w: stem(w) for w in words}
    known = {"processes": "process", "generously": "generous", "communication": "communic", "skies": "sky", "abilities": "abil", "knightly": "knight", "hoping": "hope", "relational": "relat", "dying": "die", "ties": "tie", "gas": "gas", "gaps": "gap", "proceeding": "proceed"}
    assert {w: stem(w) for w in known} == known


def test_words_begin_with_the_heads_of_their_stems(spark):
    stems = {w: stem(w) for w in many_words()}
    rows = spark.createDataFrame([(x,) for x in sorted(set(stems.values()))], "stem string").select("stem", stemming.stem_head(F.col("stem")).alias("head")).collect()
    heads = {r.stem: r.head for r in rows}
    assert all(w.startswith(heads[x]) for w, x in stems.items()) and max(map(len, heads.values())) > 5


def expected(texts, queries):
    """(query_id, id) -> score, text by text."""
    out = {}
    for q, query in queries.items():
        asked = re.sub("^[ \t-\r]+|[ \t-\r]+$", "", query or "").lower()
        stems = {stem(w) for w in re.findall("[a-z0-9]+", asked) if w not in stemming.STOP_WORDS}
        for i, text in texts.items():
            text = (text or "").lower()
            found = [stem(w) for w in re.findall("[a-z0-9]+", text) if w not in stemming.STOP_WORDS]
            tf = [found.count(s) for s in stems]
            score = sum(n / (n + 1) for n in tf) / len(tf) if tf and all(tf) else None
            if asked and asked in text:
                score = max(score or 0, 0.05)
            if score is not None:
                out[q, i] = round(score, 6)
    return out


def test_keyword_search_against_every_text(spark):
    r = random.Random(5)
    bits = ["process", "Processes", "processing", "dead-lock", "deadlock", "the", "of", "é", "日本", "a", "b?", "x.y", "generated", "general", "50%", "c_d", "running"]
    texts = {i: r.choice([" ", "  ", "\n"]).join(r.choice(bits) for _ in range(r.randrange(1, 12))) for i in range(150)} | {900: None, 901: "", 902: "pad " * 5000 + "deadlock the"}
    queries = ["process", "PROCESS deadlock", "the of", "the", "of the", "a", "e", "dead", "lock", "lock the", "k t", "x.y", ".", "日", "日本 a", "b? x", "50%", "%", "c_d", "_", "", "  ", None, " running\n", "generation", "general  process", "ock", "zzz", "zzz the", "a  b?"]
    queries = dict(enumerate(queries)) | {100 + k: " ".join(r.choice(bits) for _ in range(r.randrange(1, 4))) for k in range(60)}
    corpus = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    got = retrieval.keyword_search(corpus, spark.createDataFrame(list(queries.items()), "query_id long, query string"), None)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert {(x.query_id, x.id): x.score for x in got.collect()} == pytest.approx(expected(texts, queries))


@pytest.mark.parametrize("postings, block, words", [(2_000_000, 20_000, 500_000), (40, 7, 0)])
def test_best_texts_of_each_query(spark, monkeypatch, postings, block, words):
    for name, n in (("POSTINGS", postings), ("KEYWORD_BLOCK", block), ("WORDS", words), ("GROUP_BYTES", 100 if words == 0 else 10**7)):
        monkeypatch.setattr(retrieval, name, n)
    kept = []
    monkeypatch.setattr(retrieval, "stored", lambda df, f=retrieval.stored: kept.append(f(df)) or kept[-1])
    r = random.Random(6)
    bits = ["process", "processing", "deadlock", "running", "general", "the", "of", "x.y", "rare%d"]
    day = lambda: r.choice([None, "2024-01-01", "2024-01-02", "2024-01-03"])
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randrange(1, 30))).replace("%d", str(r.randrange(40))), day()) for i in range(300)]
    asked = ["process", "general deadlock", "running process", "deadlock the", "of the", "the", "x.y of", "rare1", "rare2 general", "general running deadlock", "rare1 rare2 rare3", "zzz", "ock"]
    queries = {f"q{n}-{i}": a for i, a in enumerate(asked) for n in range(4)}
    corpus = spark.createDataFrame(rows, "id long, text string, created_at string").repartition(5)
    got = {}
    for x in retrieval.keyword_search(corpus, spark.createDataFrame(list(queries.items()), "query_id string, query string"), 4).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.id, pytest.approx(x.score, abs=2e-6))
    dates, score = {i: d for i, _, d in rows}, {}
    for (q, i), n in expected({i: t for i, t, _ in rows}, dict(enumerate(asked))).items():
        score.setdefault(asked[q], []).append((i, n))
    newest = lambda h: (-h[1], *[-int(c) for c in (dates[h[0]] or "0-0-0").split("-")], h[0])
    want = {q: dict(enumerate(sorted(score[a], key=newest)[:4], 1)) for q, a in queries.items() if a in score}
    assert want == got and len(want) > 40
    # What goes on from the texts is the best of each different query, not every pair.
    pairs = [df for df in kept if {"no", "id"} <= set(df.columns)]
    assert len(pairs) == 1 and pairs[0].count() <= 4 * len(asked)


def test_ties_go_to_the_newest(spark):
    rows = [(1, "alpha", "2024-01-01"), (2, "alpha", "2024-01-03"), (3, "alpha", None), (4, "alpha", "2024-01-03")]
    corpus = spark.createDataFrame(rows, "id long, text string, created_at string")
    hits = retrieval.keyword_search(corpus, spark.createDataFrame([("q", "alpha")], "query_id string, query string"), 3)
    assert [x.id for x in hits.orderBy("rank").collect()] == [2, 4, 1]


@pytest.mark.parametrize("block", [2000, 7])
@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_vectors_against_all_pairs(spark, monkeypatch, block, metric):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "BLOCK", min(block, 50))
    r = np.random.default_rng(2)
    x = [[0.0] * 5, *r.integers(-3, 4, (300, 5)).tolist()]
    q = [[0.0] * 5, *r.integers(-3, 4, (40, 5)).tolist()]
    name = lambda i: f"v{i:04d}"
    corpus = spark.createDataFrame([(name(i), [float(c) for c in v]) for i, v in enumerate(x)], "id string, vector array<float>").repartition(4)
    queries = spark.createDataFrame([(name(i), [float(c) for c in v]) for i, v in enumerate(q)], "query_id string, vector array<float>").repartition(3)
    got = retrieval.vector_search(corpus, queries, 6, metric)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    rows = {}
    for h in got.collect():
        rows.setdefault(h.query_id, {})[h.rank] = (h.id, h.score)
    for i, a in enumerate(np.array(q, dtype=float)):
        with np.errstate(all="ignore"):
            b = np.array(x, dtype=float)
            score = {"dot": b @ a, "l2": 1 / (1 + np.linalg.norm(b - a, axis=1)), "cosine": b @ a / np.linalg.norm(a) / np.linalg.norm(b, axis=1)}[metric]
        order = sorted(range(len(x)), key=lambda k: (np.isnan(score[k]), -round(score[k], 6) if not np.isnan(score[k]) else 0, name(k)))[:6]
        assert [rows[name(i)][k + 1][0] for k in range(6)] == [name(k) for k in order]
        assert [rows[name(i)][k + 1][1] for k in range(6)] == [None if np.isnan(score[k]) else pytest.approx(score[k], abs=1e-5) for k in order]


def test_blocks_of_queries_go_out_in_groups_and_are_not_repeated(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    monkeypatch.setattr(retrieval, "BLOCK", 5)
    r = np.random.default_rng(4)
    corpus = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(90)], "id long, vector array<double>").repartition(3)
    queries = corpus.filter("id % 3 = 0").select(F.col("id").alias("query_id"), "vector")
    want = sorted(map(tuple, retrieval.vector_search(corpus, queries, 4).collect()))
    plan = retrieval.vector_search(corpus, queries, 4)._jdf.queryExecution().toString()
    assert len(want) == 120 and "Generate" not in plan and "Exchange hashpartitioning(part" not in plan
    monkeypatch.setattr(retrieval, "GROUP_BYTES", 500)
    few = retrieval.vector_search(corpus, queries, 4)
    assert few._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") > 2
    assert sorted(map(tuple, few.collect())) == want


def test_reranking_reads_texts_of_hits_alone(spark):
    corpus = spark.createDataFrame([(i, f"text {i} alpha") for i in range(50)], "id long, text string")
    queries = spark.createDataFrame([("a", "alpha"), ("b", "beta")], "query_id string, query string")
    hits = spark.createDataFrame([("a", 3, 0.5, 2), ("a", 4, 0.55, 1), ("a", 99, 0.52, 3), ("b", 3, 0.1, 1)], "query_id string, id long, score double, rank int")
    out = retrieval.rerank(hits, queries, corpus, retrieval.exact_boost())
    assert sorted((x.query_id, x.rank, x.id, x.score) for x in out.collect()) == [("a", 1, 4, 0.65), ("a", 2, 3, 0.6), ("a", 3, 99, 0.52), ("b", 1, 3, 0.1)]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_no_vectors(spark):
    one = spark.createDataFrame([(1, [1.0])], "id long, vector array<float>")
    asked = one.withColumnRenamed("id", "query_id")
    assert retrieval.vector_search(one.limit(0), asked, 3).collect() == retrieval.vector_search(one, asked.limit(0), 3).collect() == []
    assert [(h.query_id, h.id, h.score) for h in retrieval.vector_search(one, asked, 3).collect()] == [(1, 1, 1.0)]


def test_relevance_by_class_equals_listed_pairs(spark):
    r = random.Random(8)
    classes = spark.createDataFrame([(i, r.randrange(5)) for i in range(80)] + [(3, 4), (81, None)], "id long, label int")
    queries = spark.createDataFrame([(q, r.choice([0, 1, 2, 3, 4, 9, None])) for q in range(30)], "query_id long, label int")
    hits = spark.createDataFrame([(s, q, i, k + 1) for s in "ab" for q in range(28) for k, i in enumerate(r.sample(range(90), 10))], "strategy string, query_id long, id long, rank int")
    pairs = classes.distinct().join(queries, "label").select("query_id", "id")
    both = [retrieval.evaluate(hits, pairs, queries, ["a", "b", "c"]), retrieval.evaluate_by_class(hits, classes, queries, ["a", "b", "c"])]
    want, got = (sorted(map(tuple, df.collect())) for df in both)
    assert want == got and len(got) == 90
    by = retrieval.by_category(both[1], queries.select("query_id", F.coalesce(F.col("label"), F.lit(-1)).alias("category"))).collect()
    assert sum(x.queries for x in by) == 90


def test_relevance_lists_every_row_of_a_class(spark):
    r = random.Random(9)
    classes = [(i, r.choice([0, 0, 0, 1, 2])) for i in range(300)] + [(3, 4), (300, None), (301, 7)]
    queries = [(q, r.choice([0, 1, 2, 4, 9, None])) for q in range(40)]
    got = retrieval.relevant_rows(spark.createDataFrame(classes, "id long, label int"), spark.createDataFrame(queries, "query_id long, label int"), 8)
    assert got.columns == ["query_id", "id"]
    assert sorted(map(tuple, got.collect())) == sorted((q, i) for q, a in queries for i, b in classes if a is not None and a == b)


def test_relevance_query_lists_ids(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()
    got = registry.QUERIES["S9_relevance"](spark, sf).collect()
    assert sorted((x.query_id, x.id) for x in got) == sorted((q.vec_id, v.vec_id) for q in rows if q.vec_id % 100 == 0 for v in rows if v.label is not None and q.label == v.label)


def test_sources_of_fused_lists(spark):
    lists = spark.createDataFrame([("x", 0, "vector", "q1", 1), ("x", 0, "vector", "q2", 2), ("x", 1, "keyword", "q2", 1), ("x", 1, "keyword", "q3", 2)], "query_id string, variant int, source string, id string, rank int")
    rows = retrieval.fuse_lists(lists, 60).orderBy("rank").collect()
    assert [(x.id, x.lists, x.sources) for x in rows] == [("q2", 2, "keyword,vector"), ("q1", 1, "vector"), ("q3", 1, "keyword")]
