"""Original quizzes, prompts of bounded size, strict replies and formulas against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import replies, text
from lectern.operators import quiz


def test_original_quiz(spark):
    kind = "quiz_id string, position long, id string, document_id string, question_number string, text string, options_json string, images_json string"
    rows = [
        ("z", 0, "q1", "d1", " 4 ", " What is $a  = b$? ", '["w","x","y","z"]', '[{"name":"f.png","type":"Diagrams","description":"Flowchart of a login"}]'),
        ("z", 1, "q1", "d1", None, "again", None, None),
        ("z", 2, "q2", "d2", None, " \n", None, None),
        ("z", 3, "q3", "d3", None, "Plain", '["only","two"]', '["p.png", " "]'),
        ("y", 0, "q1", "d1", "", "x" * 6000, "not json", "not json"),
        ("z", 9, "q4", None, None, None, None, None),
    ]
    got = {(r.quiz_id, r.position): r for r in quiz.build_quiz(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {("z", 0), ("z", 3), ("y", 0)}
    one = got["z", 0]
    assert (one.item_id, one.source_question_id, one.document_id, one.options, one.correct_answer) == ("quiz-q1", "q1", "d1", ["w", "x", "y", "z"], 0)
    assert one.question == "What is $a  = b$? [Figure: f.png (diagram): Flowchart of a login [kind: flowchart]]"
    assert one.explanation == "Original PYQ q1 (question 4) from document d1 (deterministic fallback; LLM unavailable). Visual reference(s): f.png (diagram). Math expression(s): a = b."
    assert (got["z", 3].question, got["z", 3].options) == ("Plain [Figure: p.png]", ["Option A", "Option B", "Option C", "Option D"])
    assert got["y", 0].question == "x" * 6000 and got["y", 0].explanation.endswith("unavailable).")


@pytest.mark.parametrize("partitions", [1, 9])
def test_prompts_are_cut_by_size(spark, partitions):
    r = random.Random(2)
    sources = [("hot", k, f"s{k}", "w" * r.randrange(1, 300)) for k in range(2000)] + [("one", 5, "a", "short"), ("big", 0, "b", "x" * 5000), ("big", 1, "c", "y"), ("lost", 0, "d", "no request")]
    requests = [("hot", " Similar", 3), ("one", "original", None), ("big", "mixed", 1), ("none", "mcq", 1), ("odd", "unheard of", 1)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        rows = quiz.prompts(spark.createDataFrame(requests, "request_id string, mode string, n int"), spark.createDataFrame(sources, "request_id string, position long, id string, text string").repartition(4), budget=1000).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want, at = {}, {}
    for request, _, i, t in sources:
        if request != "lost":
            block = f"id: {i}\ntext: {t}"
            no = at.get(request, 0) // 1000
            at[request] = at.get(request, 0) + len(block)
            want.setdefault((request, no), []).append(block)
    heads = {"hot": f"Mode: similar\n{quiz.MODES['similar']}\n- questions: 3", "one": f"Mode: original\n{quiz.MODES['original']}", "big": f"Mode: mixed\n{quiz.MODES['mixed']}\n- questions: 1"}
    made = {k: "\n\n".join([heads[k[0]], *[f"[Source {n}]\n{b}" for n, b in enumerate(blocks, 1)]]) for k, blocks in want.items()}
    assert {(r.request_id, r.prompt_no): r.prompt for r in rows} == made and len(made) > 200


def test_replies(spark):
    good = '{"subject": "os", "topics": [{"topic": "a", "confidence": 0.5, "subject": "s"}, {"topic": "b"}]}'
    cases = [
        (good, None), (f"```json\n{good}\n```", None), (f"```JSON {good}", None), (f"```{good}```", None), (f"  Here: {good} Bye", None), (f"```\n{good}\n``` and ``` more", "trailing data"), (f"```\n{good}\n``` and more", None), ('{"subject": "}{", "topics": []}', None),
        (good + " {}", "trailing data"), (good + "x", "trailing data"), (good[:-1], "invalid JSON"), ("", "invalid JSON"), (None, "invalid JSON"), ("[1]", "invalid JSON"), ("{} {}", "trailing data"),
        ('{"subject": "x", "topics": [], "extra": null}', "unknown field"), ('{"subject": "x", "topics": [{"topic": "t", "weight": 1}]}', "unknown field"),
        ('{"subject": "x", "topics": {}}', "wrong type"), ('{"subject": ["x"], "topics": []}', "wrong type"), ('{"subject": "x", "topics": ["t"]}', "wrong type"), ('{"subject": "x", "topics": [{"topic": 1}]}', "wrong type"), ('{"subject": "x", "topics": [{"topic": "t", "confidence": "1"}]}', "wrong type"),
        ('{"topics": []}', "subject is required"), ('{"subject": " ", "topics": []}', "subject is required"), ('{"subject": "x"}', "topics is required"), ('{"subject": "x", "topics": null}', "topics is required"),
        ('{"subject": "x", "topics": [' + ",".join(['{"topic": "t"}'] * 11) + "]}", "too many topics"), ('{"subject": "x", "topics": [{"topic": " "}]}', "topic name is required"), ('{"subject": "x", "topics": [{"topic": "t", "confidence": -0.1}]}', "confidence out of range"),
        ('{"subject": "x", "topics": [{"topic": "t", "subject": " "}]}', "subject must not be whitespace"),
    ]
    rows = replies.classified(spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "id int, reply string"))
    got = {r.id: r for r in rows.collect()}
    assert {i: got[i].error for i in got} == {i: e for i, (_, e) in enumerate(cases)}
    assert [tuple(t) for t in got[0].topics] == [("a", 0.5, "s"), ("b", 0.0, "")] and got[0].subject == "os" and got[8].topics is None
    kept, rejects = replies.split_rejects(rows)
    assert kept.count() == sum(e is None for _, e in cases) and rejects.columns == ["id", "reply", "error"]


def formulas(t):
    """The rules, one after another, on Python lists."""
    pattern = text.MATH.replace("(?s:.+?)", "[\\s\\S]+?")

    def normal(x):
        x = x.strip()
        if x.startswith("\\begin") and "}" in x and x.rfind("\\end") > x.find("}"):
            x = x[x.find("}") + 1 : x.rfind("\\end")].strip() or x
        for a, b in (("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)"), ("$", "$")):
            if len(x) > 2 * len(a) and x.startswith(a) and x.endswith(b):
                x = x[len(a) : -len(b)].strip()
                break
        return " ".join(x.split())

    out = []
    for m in re.finditer(pattern, t):
        if normal(m[0]) and normal(m[0]) not in map(normal, out):
            out.append(m[0].strip())
    for line in map(str.strip, t.split("\n")):
        if "=" in line and len(line.encode()) <= 300 and re.search(text.MATH_HINT, line) and not any(line in x or x in line for x in out) and normal(line) not in map(normal, out):
            out.append(line)
    return out


def test_formulas(spark):
    r = random.Random(3)
    bits = ["$x+1$", "$$a\n=2$$", "$", "\\[ b = 3 \\]", "\\(c\\)", "\\begin{align*} p\n= q \\end{align*}", "\\frac{1}{2}", "\\sqrt", "\\alphabet", "y = 2", "name = value", "a < b = c", "\n", "\n", " ", "words", "$ x+1 $", "= 5", "é = 1", "z" * 290 + " = 1", "z" * 299 + " = 1", "\\{", "\\begin{x}\\end{x}"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(400)] + ["", "$x+1$ and $x+1$"]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "id int, t string").select("id", text.math_expressions(F.col("t")).alias("m")).collect()
    got = {x.id: x.m for x in rows}
    assert got.pop(len(texts)) == []
    assert got == {i: formulas(t) for i, t in enumerate(texts)}


def test_study_guide(spark):
    kind = "topic string, id long, document_id string, text string, year int, question_number string, options_json string, images_json string"
    rows = [
        ("t", 1, "d", "Old $a=1$ paging", 2001, None, None, None),
        ("t", 2, "d", "New $b = 2$ and $b  =  2$ and $c$ paging", 2020, "7", '["w","x","y","z"]', '["f.png"]'),
        ("t", 3, "d", "a | b\n1 | 2\n3 | 4", 2010, None, None, " "),
        ("t", 4, "d", " ", 2022, None, None, '["lost.png"]'),
        ("t", 5, "d", "$a=1$ $d$ $e$", 1999, None, None, None),
        ("u", 9, "d", "Alone", None, None, None, None),
    ]
    got = {r.topic: r for r in quiz.study_guide(spark.createDataFrame(rows, kind), spark.createDataFrame([("t",)], "topic string")).collect()}
    t = got["t"]
    assert (t.questions, t.first_year, t.last_year, t.references, t.figures, t.formulas) == (4, 1999, 2020, "2,3,1,5", 1, ["b = 2", "c", "a=1"])
    assert t.table == "Table with 3 rows x 2 columns. Headers: a, b. First row: 1, 2. (+1 more row.)"
    assert t.explanation == "t: 4 past questions. A weak topic: take more time for it." and got["u"].explanation == "u: 1 past question."
    assert [x.item_id for x in t.practice] == ["quiz-2", "quiz-3", "quiz-1", "quiz-5"] and t.practice[0].options == ["w", "x", "y", "z"] and "paging" in t.key_points
    assert (got["u"].formulas, got["u"].figures, got["u"].table, len(got["u"].practice)) == ([], 0, None, 1)
