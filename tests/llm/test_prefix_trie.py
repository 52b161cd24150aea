"""The prefix trie against nested dictionaries, with few and with many shards, and its SQL form on odd tables."""

import hashlib
import math
import random
import zlib

import duckdb
import pytest

from lectern.llm import prefix_trie as pt

KIND = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t, r or "", x or ""))

    def order(q):
        return q[0] is not None, q[0] or 0, q[1], hashlib.md5(f"{len(q[1])}:{q[1]}:{q[2]}".encode()).digest()

    own = {c: [q[1:] for q in sorted(v, key=order)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    nodes, below = {}, {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    for p in nodes:
        if p:
            below.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in below.get(p, [])) or 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in below.get(p, []))
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(paths[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows():
    r = random.Random(7)
    rows = []
    for c in [*range(0, 230), *range(-130, -90), 1 << 40]:
        if c % 100 == 0 and r.random() < 0.4:
            continue
        for t in range(r.randrange(1, 9)):
            rows.append((c, r.choice([t, t, t, None, 2]), r.choice(["user", "assistant", None, ""]), r.choice(["a", "b", None, "", "é🙂", "long " * 3000])))
    # Hot paths: one conversation under many ids, and a deep beginning that many share.
    deep = [("user" if k % 2 else "assistant", f"turn {k}") for k in range(40)]
    for c in range(1000, 1400):
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    for c in range(2000, 2060):
        rows += [(c, t, *x) for t, x in enumerate(deep)] + [(c, 50, "user", f"end {c % 7}")]
    return rows + [(None, 1, "user", "lost"), (None, None, None, None)] + [rows[5]] * 3


def found(df):
    return sorted(map(tuple, df.select(*pt.NODE).collect()), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("trie")
    full = spark.createDataFrame(odd_rows(), KIND)
    clash = full.selectExpr("*", "'x' as key", "1 as base", "'y' as own", "0 as shard", "true as h", "'q' as node")
    for name, df in {"full": full, "empty": full.limit(0), "clash": clash, "nulls": full.filter("conv_id is null")}.items():
        df.repartition(3).write.parquet(f"{root}/{name}/conversations.parquet")
    return root


@pytest.mark.parametrize("name", ["full", "clash"])
@pytest.mark.parametrize("shards", [1, 40])
def test_odd_conversations(spark, folder, name, shards, monkeypatch):
    if shards > 1:
        monkeypatch.setattr(pt, "SHARD_TURNS", 100)
        bones = pt.splitters(pt.stored(pt.rebuild(spark.read.parquet(f"{folder}/{name}/conversations.parquet")), "paths"))
        assert len(bones.splitters) > 20
        # The hot conversation is split between its members, the deep beginning behind it.
        assert any(c != pt.FIRST for _, c in bones.splitters) and max(d for _, d, _ in bones.nodes) > 35
        assert bones.splitters == sorted(bones.splitters)
    else:
        monkeypatch.setattr(pt, "LEAST_TURNS", 1_000_000)
    assert found(pt.op11_prefix_trie(spark, f"{folder}/{name}")) == by_hand(odd_rows())


def test_sql_on_odd_conversations(folder):
    sql = pt.OP11_SQL.replace("from conversations", f"from '{folder}/full/conversations.parquet/*.parquet'")
    assert sorted(duckdb.sql(sql).fetchall(), key=repr) == by_hand(odd_rows())


@pytest.mark.parametrize("name", ["empty", "nulls"])
def test_no_conversations(spark, folder, name):
    assert pt.op11_prefix_trie(spark, f"{folder}/{name}").collect() == []


def test_turnless_conversation_belongs_to_the_root(spark, tmp_path):
    # Without its base, a conversation of fewer turns than it takes over is rebuilt without any.
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    spark.createDataFrame([(c, 0, "user", "a"), (c, 1, "user", "b")], KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(pt.op11_prefix_trie(spark, str(tmp_path))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_splitters_are_short():
    a, b, c = ([bytes([x])] * n for x, n in ((1, 9), (2, 9), (2, 5)))
    bones = pt.skeleton([(a, False, 1, 9), (b, False, 2, 9), (b, False, 3, 9), (c, False, 4, 5)], 9)
    assert bones.splitters == [([b"\x02"], pt.FIRST), (b[:6], pt.FIRST), (b, 3)]
    assert [d for _, d, _ in bones.nodes] == list(range(10))
    assert [bones.shard(a, 9), bones.shard(c, -5), bones.shard(b, 2), bones.shard(b, 3), bones.shard([], 0)] == [0, 1, 2, 3, 0]
