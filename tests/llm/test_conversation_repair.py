"""Conversation repair against a program that keeps whole audits, within one range and over several."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from lectern.llm import conversation_repair as cr

KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLES = (("u", "user"), ("a", "assistant"))


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            out += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (1 + (k == 3))
    return out


def by_hand(turns):
    """The report of one conversation: best edits from each row on, with whole audits."""
    made = sorted((t for t in turns), key=lambda q: (q[1] is not None, q[1] or 0, q[2], hashlib.md5(q[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, r, x in made:
        y = x.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not y else "duplicate" if (r, x) in seen else "truncated" if y[-1] not in ".!?" else "")
        seen.add((r, x))
    numbers = [t for _, t, _, _ in made if t is not None]
    initials = [r[:1] for _, _, r, _ in made]

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(made) and state in (0, 3) else []
        for initial, role in ROLES:
            if inserted < 3 and initial in AFTER[state]:
                q = best(i, AFTER[state][initial], inserted + 1)
                ways += [(q[0] + 2, "I" + q[1], ((role, ""),) + q[2])] if q else []
        if i < len(made):
            _, _, r, x = made[i]
            moves = [(3, "D", state, None)]
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                moves += [(more, "K", AFTER[state].get(r[:1]), r)] + [(2 + more, "R", AFTER[state].get(z), role) for z, role in ROLES]
            for cost, letter, to, role in moves:
                q = None if to is None else best(i + 1, to, 0)
                ways += [(q[0] + cost, letter + q[1], (((role, x),) if role is not None else ()) + q[2])] if q else []
        return min(ways) if ways else None

    for i in range(len(made), -1, -1):  # from the end, so that calls stay shallow
        for state in AFTER:
            best(i, state, 0)
    cost, audit, said = best(0, 0, 0)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest()
    return (gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)


def grouped(turns):
    out = {}
    for t in turns:
        out.setdefault(t[0], []).append(t)
    return out


def odd_rows():
    r = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(r.randrange(1, 25)):
            turn = r.choice([t, t, t, t, None, 3, -t])
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "umpire"])
            text = r.choice(["Hello.", "yes", "yes", "", " \t\n", None, f"number {t}!", f"no end {t}", "é ", "a.b?c!  ", "x" * 50_000 + "."])
            rows.append((c, turn, role, text))
    return rows + [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (-7, 1, "user", "Hi.")] + [(5, 2, "user", "Same.")] * 40


def found(df):
    rows = df.select("conv_id", *COLUMNS).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repair")
    full = spark.createDataFrame(odd_rows(), KIND)
    clash = full.selectExpr("*", "'x' as key", "1 as range", "'y' as fault", "0 as place", "true as ends", "'q' as last", "1 as copies")
    for name, df in {"full": full, "empty": full.limit(0), "clash": clash}.items():
        df.repartition(3).write.parquet(f"{root}/{name}/conversations.parquet")
    return root


@pytest.mark.parametrize("name", ["full", "clash"])
def test_odd_conversations(spark, folder, name):
    kept = grouped(damaged(odd_rows()))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: by_hand(kept[c]) if c in kept else nothing for c in grouped(odd_rows())}
    assert found(cr.op12_conversation_repair(spark, f"{folder}/{name}")) == want
    # The SQL form holds on odd tables as well.
    duck = duckdb.sql(cr.OP12_SQL.replace("from conversations", f"from '{folder}/{name}/conversations.parquet/*.parquet'"))
    assert {r[0]: r[1:] for r in duck.fetchall()} == want


def test_empty(spark, folder):
    assert cr.op12_conversation_repair(spark, f"{folder}/empty").collect() == []


def test_dropped_conversation_is_returned(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in cr.op12_conversation_repair(spark, str(tmp_path)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_conversation_over_many_ranges(spark):
    r = random.Random(9)
    rows = [(1, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["One.", "two", "", f"text {t}.", f"text {t}"])) for t in range(600)]
    rows += [(c, t, r.choice(["user", "assistant"]), f"text {t}.") for c in (0, 2, 3) for t in range(4)] + [(1, 600, "user", "Again.")] * 50
    want = {c: by_hand(x) for c, x in grouped(rows).items()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        turns = spark.createDataFrame(rows, KIND).repartition(5)
        edits = cr.stored(cr.repair(turns), "edits")
        assert edits.filter("conv_id = 1").select("range").distinct().count() > 10
        got = found(cr.report(turns, edits))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    # A row for each different turn and one for each conversation's end; copies are counted.
    assert edits.filter("role is null").count() == len(want)
    assert edits.groupBy().sum("copies").first()[0] == len(rows)


def test_tables_compose_to_the_whole():
    r = random.Random(1)
    for _ in range(300):
        kinds = [cr.kind_of(r.choice("suat"), r.choice(["", "", "truncated", "blank"])) for _ in range(r.randrange(0, 14))]
        layer, links = cr.forward(kinds, cr.START)
        whole = "".join(e[1] for e in cr.backward(kinds, links, cr.finish(layer)))
        cuts = sorted(r.randrange(len(kinds) + 1) for _ in range(r.randrange(4)))
        pieces = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(kinds)])]
        pieces = [p for p in pieces if p] or [[]]
        plan = cr.compose([[cr.forward(p, a)[0] for a in range(len(cr.TOPS))] for p in pieces])
        parts = ["".join(e[1] for e in cr.backward(p, cr.forward(p, a)[1], b)) for p, (a, b) in zip(pieces, plan)]
        assert "".join(parts) == whole and plan[-1][1] == cr.finish(layer)


def test_automaton_knows_the_grammar():
    for n in range(7):
        for k in range(3**n):
            word = "".join("sua"[k // 3**i % 3] for i in range(n))
            stack = (0,)
            for token in word:
                stack = stack and cr.advance(stack, token)
            assert bool(stack and stack[-1] in cr.ACCEPT) == bool(re.fullmatch("(s?(ua)+)?", word)), word
