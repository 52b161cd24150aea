"""Language identification: expectation maximisation in plain Python, mixtures, held-out accuracy, odd tables."""

import math
import random
import re
from collections import Counter

import pytest

from lectern.llm import language_id as li

KIND = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return li.fit(docs.filter(~li.held_out()))


def grams(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    joined = f" {' '.join(words)} "
    return Counter(joined[k : k + 3] for k in range(len(joined) - 2))


def by_hand(samples, text):
    """The whole method on plain dictionaries of trigrams: learning, expectation maximisation and the language set."""
    learnt = {lang: sum((grams(t) for t in set(texts)), Counter()) for lang, texts in samples.items()}
    p = lambda lang, g: (learnt[lang][g] + li.SMOOTHING) / (sum(learnt[lang].values()) + li.SMOOTHING * li.BUCKETS)
    own = grams(text)
    n = sum(own.values())

    def em(langs):
        share = {x: 1 / len(langs) for x in langs}
        for _ in range(li.ROUNDS if len(langs) > 1 else 0):
            new = dict.fromkeys(langs, 0.0)
            for g, c in own.items():
                total = sum(share[x] * p(x, g) for x in langs)
                for x in langs:
                    new[x] += c * share[x] * p(x, g) / total / n
            moved = max(abs(new[x] - share[x]) for x in langs)
            share = new
            if moved < li.SETTLED:
                break
        return share, sum(c * math.log(sum(share[x] * p(x, g) for x in langs)) for g, c in own.items())

    langs, tried = sorted(samples), []
    while langs:
        share, fit = em(langs)
        tried.append((fit - li.PENALTY * math.log(1 + n) * len(langs), -len(langs), share))
        langs = [x for x in langs if x != min(langs, key=lambda x: share[x])]
    best = max(tried, key=lambda x: x[:2])[2]
    return sorted(((x, s) for x, s in best.items()), key=lambda y: (-y[1], y[0]))


def test_against_plain_python(spark):
    r = random.Random(3)
    by = {}
    for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").collect():
        by.setdefault(x.lang, []).append(x.text[:1500])
    samples = {lang: texts[:6] for lang, texts in by.items()}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, texts in samples.items() for t in texts)]
    model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert model.languages == sorted(samples)
    texts = [texts[k] for texts in by.values() for k in (7, 8)] + [r.choice(by["en"])[:400] + r.choice(by["fr"])[:400] for _ in range(4)] + ["der", "the la"]
    for text in texts:
        want, got = by_hand(samples, text), model.mixture(text)
        # Buckets are shared by few trigrams of so few texts.
        assert [x[0] for x in got] == [x[0] for x in want] and [x[1] for x in got] == pytest.approx([x[1] for x in want], abs=0.02), text


def test_held_out_accuracy(spark):
    rows = li.op13_language_id(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures_are_taken_apart(spark, model):
    r, by = random.Random(1), {}
    for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(li.held_out()).select("text", "lang").collect():
        by.setdefault(x.lang, []).append(x.text)
    right = tried = 0
    for _ in range(100):
        a, b = r.sample(sorted(by), 2)
        x, y = r.choice(by[a])[:3000], r.choice(by[b])[:3000]
        if min(len(x), len(y)) > 500:
            tried += 1
            got = dict(model.mixture(x + "\n" + y))
            right += set(got) == {a, b} and abs(got[a] - len(x) / (len(x) + len(y))) < 0.15
    assert tried > 50 and right >= 0.9 * tried


def test_odd_texts(spark, model):
    long = "the winter and the garden " * 100_000
    texts = [None, "", " \n", "12 ²½ ⅷ _ 🙂", "é", long, "THE!! " * 50, "日本語", "a"]
    got = li.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).select("doc_id", "language.*").orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score, r.languages) for r in got[:4]] == [("und", 0.0, [])] * 4
    assert all(r.lang_pred in model.languages and r.score > 0 and sum(x.share for x in r.languages) == pytest.approx(1, abs=1e-4) for r in got[4:])
    assert model.mixture(long) == model.mixture(long[:26] * 100_000)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a"), (2, "12", "en", "a"), (None, None, "fr", None)], KIND)
    model = li.fit(docs)
    assert model.languages == []
    assert [(r.lang_pred, r.score) for r in li.identify(docs, model).select("language.*").collect()] == [("und", 0.0)] * 3


def test_copies_count_once_and_order_does_not_matter(spark):
    rows = [(k, t, lang, "s") for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("und der hund", "de")])]
    one = li.fit(spark.createDataFrame(rows, KIND))
    many = li.fit(spark.createDataFrame(rows[::-1] + [(None, *rows[0][1:])] * 500, KIND).repartition(5))
    assert one.languages == many.languages == ["de", "en", "fr"] and (one.p == many.p).all()
    few = li.fit(spark.createDataFrame(rows + [(9, "the end", "en", "s")], KIND), languages=1, rows=1)
    assert few.languages == ["en"]
