"""Segmentation over ranges of pages against a fold that reads a document line by line."""

import random
import re

import pytest

from lectern.operators import segmentation as s

PAGES = "document_id long, page_number long, text string"
BITS = [
    "Q1. What is a process?", "Q2. Define deadlock and", "Q3: Say", "1) foo bar", "2. Explain paging in detail because it is long and goes on for quite a while without any end", "(a) option one", "A. yes", "", "", "Section B",
    "Section B: a header that is rather long for a header, over forty", "2021", "lower case line that continues the text before it and is long", "Short", "What is this? tell", "3", "4 plain words after the number", "Note",
    "unnumbered question about deadlock which is long enough", "é.", "ends here.", "  padded  ", "SHOUTED LINE OF WORDS",
]
COLUMNS = ["position", "number", "text", "start_page", "end_page", "how"]


def goes_on(text, line):
    before = text.strip()
    if not before or before[-1] in ".?!:":
        return False
    if re.match(s.OPTION, line) or re.match(s.PART, line):
        return True
    n = len(before.encode())
    return (n > 50 and "a" <= line[:1] <= "z") or bool(re.match(s.START, line) and not re.match(s.STRICT, line) and n > 80)


def fold(pages):
    """Questions of one document: [number, start, end, how, lines]."""
    done, now, numbered = [], None, False
    for page, raw in ((p, x) for p, text in sorted(pages) for x in text.split("\n")):
        line, full = raw.strip(), bool(now and now[4])
        m = re.match(s.START, line)
        if not line:
            if full:
                now[4].append("")
            continue
        new = None
        if re.match(s.HEADER, line):
            if full and len(line.encode()) >= 40:
                done.append(now)
                now = None
                continue
            if not full:
                continue
        elif m and len(m[1]) == 4 and m[1].startswith("20") and not m[2].strip():
            if not full:
                continue
        elif m and not (full and goes_on("\n".join(now[4]), line)):
            numbered, new = True, [m[1], page, page, "strict" if re.match(s.STRICT, line) else m[1], [m[2].strip()] if m[2].strip() else []]
        elif not m and now is None and numbered:
            if goes_on("\n".join(done[-1][4]), line):
                done[-1][4].append(line)
                done[-1][2] = page
                continue
            new = [None, page, page, "unnumbered-after-numbered", [line]]
        elif not m and now is None:
            if len(line.encode()) <= 15 or s.looks_like_title(line) or not s.looks_like_question(line):
                continue
            new = [None, page, page, "unnumbered-start", [line]]
        if new:
            done += [now] if full else []
            now = new
        else:
            now[4].append(line)
            now[2] = page
    done += [now] if now and now[4] else []
    return [(k, n, "\n".join(lines).strip(), a, b, how) for k, (n, a, b, how, lines) in enumerate(done)]


def pages():
    r = random.Random(3)
    page = lambda most: "\n".join(r.choice(BITS) for _ in range(r.randrange(most)))
    rows = [(d, p, page(6)) for d in range(60) for p in range(r.randrange(1, 6))]
    rows += [(99, p, page(4)) for p in range(1500)]
    # A document without anything that settles the state, and one that is empty for long.
    rows += [(98, p, r.choice(["", "short words", "more", "more words. "])) for p in range(400)]
    return rows + [(97, 0, "Q1. Begin")] + [(97, p, "") for p in range(1, 200)] + [(97, 200, "and the end"), (96, 0, "")]


@pytest.mark.parametrize("ranges", [1, 31])
def test_ranges_equal_the_fold(spark, ranges):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        got = s.segment(spark.createDataFrame(pages(), PAGES).repartition(5)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    by = {}
    for d, p, text in pages():
        by.setdefault(d, []).append((p, text))
    want = {(d, *q) for d, x in by.items() for q in fold(x)}
    assert {(r.document_id, *[r[c] for c in COLUMNS]) for r in got} == want and len(got) == len(want) > 500


def test_tables_of_states():
    r = random.Random(5)
    for _ in range(200):
        lines = [r.choice(BITS).strip() for _ in range(r.randrange(40))]
        cut = r.randrange(len(lines) + 1)
        s0 = s.State()
        for line in lines[:cut]:
            s0, _ = s.step(s0, line, 0)
        one = s0 = s0._replace(start=-1)
        for k, line in enumerate(lines[cut:]):
            one, _ = s.step(one, line, k)
        two = s._transitions([{"page_number": 1, "text": "\n".join(lines[cut:])}] if lines[cut:] else [])[s.CLASSES.index(s._class(s0))]
        if lines[cut:] and any(lines[cut:]):
            assert s._class(one) == s._class(two) and one.start == two.start


def test_odd_pages(spark):
    rows = [("a", 2, None), ("a", 1, "Q1. What is\n\n"), ("a", 3, "left?"), (None, 1, "Q1. lost"), ("b", 1, "")]
    df = spark.createDataFrame(rows, "document_id string, page_number long, text string").selectExpr("*", "1 as range", "'x' as question")
    assert [tuple(r) for r in s.segment(df).collect()] == [("a", 0, "1", "What is\n\n\n\nleft?", 1, 3, "strict")]
    assert s.segment(df.limit(0)).collect() == []


def test_pairs_of_weak_pieces(spark):
    r = random.Random(6)
    kind = "document_id long, position int, number string, text string, start_page int, end_page int, question_type string, confidence double"
    rows = []
    for d in range(4):
        page = 1
        for k in range(3000 if d == 0 else 40):
            page += r.choice([0, 0, 0, 1, 2])
            text = r.choice(["a text that doesn't end and is rather long, over fifty bytes", "lower words that go on and on until there are fifty bytes", "It ends.", "B. option"])
            rows.append((d, k, r.choice([None, "", "7"]), text, page, page, r.choice(["unknown", "MCQ"]), r.choice([0.4, 0.45, 0.55, 0.7])))
    want = []
    for d in range(4):
        own, k = [dict(zip(COLUMN_NAMES, x)) for x in rows if x[0] == d], 0
        while k < len(own):
            a, b = own[k], own[k + 1] if k + 1 < len(own) else None
            if b and b["start_page"] - a["end_page"] in (0, 1) and a["confidence"] < 0.6 and b["confidence"] < 0.5 and goes_on(a["text"], b["text"]):
                kind_of = b["question_type"] if a["question_type"] == "unknown" else a["question_type"]
                a = a | {"text": a["text"] + "\n" + b["text"], "end_page": b["end_page"], "confidence": (a["confidence"] + b["confidence"]) / 2, "question_type": kind_of, "number": a["number"] or b["number"]}
                k += 1
            want.append(a)
            k += 1
    monkey, s.BUCKET = s.BUCKET, 50
    try:
        got = [x.asDict() for x in s.merge_weak(spark.createDataFrame(rows, kind)).collect()]
    finally:
        s.BUCKET = monkey
    order = lambda x: (x["document_id"], x["position"])
    assert sorted(got, key=order) == sorted(want, key=order) and len(want) < len(rows)


COLUMN_NAMES = ["document_id", "position", "number", "text", "start_page", "end_page", "question_type", "confidence"]


def placed_by_hand(questions, images, pages):
    """Every image tried against every question of its page: (document, page, name, x, y, position, note)."""
    out = []
    for d, page, name, x, y in images:
        on = sorted((q for q in questions if q[0] == d and q[4] <= page <= max(q[4], q[5])), key=lambda q: q[1])
        if not on:
            continue
        height, lines = {}, pages.get((d, page), "").split("\n")
        for k, q in enumerate([q for q in on if q[4] == page]):
            height[q[1]] = 700.0 - 160 * k
            anchor = next((w.strip() for w in q[3].split("\n") if w.strip()), None)
            at = None
            if pages.get((d, page)) and anchor:
                at = next((i for i, w in enumerate(lines) if anchor[:40] in w or w.strip() in anchor[:40]), None)
                if at is None and q[2]:
                    at = next((i for i, w in enumerate(lines) if q[2] in w), None)
            if at is not None:
                height[q[1]] = 0.7 * height[q[1]] + 0.3 * (720.0 - 14 * at)
        height |= {q[1]: 400.0 for q in on if q[4] < page}
        note = f"image-associated:{name}@page{page}:y{y:.0f}"
        if len(on) == 1 or (x == 0 and y == 0):
            out.append((d, page, name, x, y, on[0][1], note if len(on) > 1 and (x or y) else None))
            continue
        above = [(h - y, p) for p, h in height.items() if h >= y]
        out.append((d, page, name, x, y, min(above)[1] if above else max(height.items(), key=lambda t: (t[1], -t[0]))[0], note))
    return out


def test_images_against_every_question(spark):
    r = random.Random(4)
    questions, images, texts = [], [], {}
    for d in range(25):
        page = 1
        for k in range(r.randrange(1, 9)):
            page += r.choice([0, 0, 1])
            first = r.choice(["What is paging?", "Explain the way in which deadlocks come about in detail", "x"])
            questions.append((d, k, r.choice([None, "4", "7"]), f"{first} {k}\nmore", page, page + r.choice([0, 0, 0, 1, 3])))
        for p in range(1, page + 5):
            texts[d, p] = "\n".join(r.choice(["7. or so", "", "What is paging? 1", "other", "Explain the way in which deadlocks come about in detail 2"]) for _ in range(r.randrange(5)))
            images += [(d, p, f"i{k}", *r.choice([(0.0, 0.0), (5.0, float(r.randrange(800))), (0.0, 700.0), (3.0, 540.0)])) for k in range(r.randrange(3))]
    q = spark.createDataFrame(questions, "document_id long, position int, number string, text string, start_page int, end_page int")
    i = spark.createDataFrame(images, "document_id long, page_number int, name string, x double, y double")
    p = spark.createDataFrame([(*k, t) for k, t in texts.items()], PAGES.replace("page_number long", "page_number int"))
    got = [tuple(x) for x in s.image_questions(q, i, p).collect()]
    assert sorted(got, key=repr) == sorted(placed_by_hand(questions, images, texts), key=repr) and len(got) > 50


def test_notes_of_images(spark):
    found = spark.createDataFrame([(1, 1, "b", 0.0, 1.0, 0, "image-associated:b@page1:y1"), (1, 2, "a", 0.0, 1.0, 0, None), (1, 2, "b", 0.0, 1.0, 0, None), (1, 3, "c", 0.0, 1.0, 1, None)], "document_id long, page_number int, name string, x double, y double, position int, note string")
    images = spark.createDataFrame([(1, 1, "b", 0.0, 1.0, "Plots", " "), (1, 2, "b", 0.0, 1.0, "Diagrams", "Circuit with a resistor"), (1, 2, "a", 0.0, 1.0, "photo", None)], "document_id long, page_number int, name string, x double, y double, figure_type string, description string")
    rows = {r.position: (r.images, r.notes) for r in s.image_details(found, images).collect()}
    assert [tuple(x) for x in rows[0][0]] == [("b", "Diagrams", "Circuit with a resistor"), ("a", "photo", "")]
    assert rows[0][1] == ["image-associated:b@page1:y1", "visual:has_image", "visual:figure-diagram", "visual:figure-photo", "visual:diagram-circuit", "visual:described:b", "visual:undescribed:a", "vision:described"]
    assert rows[1] == ([("c", "", "")], ["visual:has_image", "visual:undescribed:c", "vision:unavailable"])
