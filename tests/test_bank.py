"""Filters of every form against every question."""

import random

from lectern.operators import bank


def test_filters_against_every_question(spark):
    r = random.Random(7)
    questions = [(i, r.choice(["en", "de", None]), r.choice([None, 2015, 2018, 2020, 2022]), r.choice(["easy", "hard", None])) for i in range(120)]
    filters = [(k, r.choice(["en", "fr", None, None]), r.choice([None, 2016, 2020]), r.choice([None, 2019, 2021]), r.choice(["easy", None, None])) for k in range(60)]
    got = bank.metadata_filters(spark.createDataFrame(questions, "id long, subject string, year int, difficulty string"), spark.createDataFrame(filters, "query_id long, subject string, year_min int, year_max int, difficulty string"))
    want = [
        (k, i) for k, s, a, b, d in filters for i, s2, y, d2 in questions
        if (s is None or s == s2) and (d is None or d == d2) and (a is None or (y is not None and y >= a)) and (b is None or (y is not None and y <= b))
    ]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500
