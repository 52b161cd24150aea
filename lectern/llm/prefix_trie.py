"""Conversation prefix trie by a splitter skeleton.

A conversation is a path of turn keys, 128-bit hashes of role and text. Paths are sorted in shards between splitters, quantiles of a sample. A
splitter is cut to the first turn that sets it apart from the path before it; only where a whole path repeats does
it go on to the conversation's id, so that a node with any number of equal conversations is split as well. The nodes that a splitter cuts are its own
beginnings. They form the skeleton, a small trie that is broadcast. Every other node lies within one shard,
which finishes it in one pass over its sorted paths; of skeleton nodes a shard gives partial counts, which are summed by node
and then added up along the skeleton.

Bounds: ``SHARDS`` splitters at most, from ``OVERSAMPLE`` paths each; sampled paths are read to ``DEPTH`` turns, and deeper only while splitters meet and no more than
``SAMPLED_KEYS`` keys come of it; the skeleton has no more nodes than the sample has keys. A shard holds about ``SHARD_TURNS`` turns, or more beyond ``SHARDS`` shards. A path is one row
of about 28 bytes a turn. The digest of the ids that end at a skeleton node reads them as a sorted stream.

Defined results: null roles and texts are empty; null turns come first; turns of one number go by role, then by their hash; a repeated row is
a turn of its own; rows without a conv_id belong to no conversation and are left out; a long text enters with its hash and length alone; the remainder of a
negative conv_id is negative, as in SQL; an empty table gives no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD_TURNS, LEAST_TURNS, SHARDS, OVERSAMPLE = 250_000, 2_000, 10_000, 20
DEPTH, SAMPLED_KEYS = 8, 4_000_000
#: A conversation's first turns come from the one whose id is the last multiple of GROUP.
GROUP, SHARED = 100, 5


def rebuild(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, keys, sizes (code points of the texts) of every rebuilt conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text)))
    turns = conversations.filter("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), "conv_id", F.struct(F.col("turn"), role.alias("role"), key.alias("key"), F.length(text).alias("size")).alias("t"))
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    # At most GROUP conversations share a base.
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, SHARED))).over(Window.partitionBy("base"))
    rows = own.withColumn("head", F.coalesce(head, F.expr("slice(own, 1, 0)"))).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1)).cast("int"))
    path = F.concat(F.expr("slice(head, 1, h)"), F.expr("slice(own, h + 1, greatest(size(own) - h, 0))"))
    return rows.select("conv_id", path.alias("path")).select("conv_id", F.col("path.key").alias("keys"), F.col("path.size").alias("sizes"))


@dataclass
class Skeleton:
    splitters: list[tuple[list[bytes], int]] = field(default_factory=list)
    #: A node is its place in this list: (parent, depth, children by key). The root is 0.
    nodes: list[tuple[int, int, dict[bytes, int]]] = field(default_factory=lambda: [(-1, 0, {})])

    def add(self, keys: list[bytes]) -> None:
        at = 0
        for depth, key in enumerate(keys, 1):
            _, _, children = self.nodes[at]
            if key not in children:
                children[key] = len(self.nodes)
                self.nodes.append((at, depth, {}))
            at = children[key]

    def shard(self, keys: list[bytes], conv_id: int) -> int:
        return bisect.bisect_right(self.splitters, (keys, conv_id))


#: Less than any conv_id: a splitter with it stands before all conversations of its path.
FIRST = -(1 << 63)


def skeleton(sample: list[tuple[list[bytes], bool, int, int]], shards: int) -> Skeleton:
    """Sampled (first keys, whether more follow, conv_id, turns) -> splitters of about even numbers of turns and the nodes they cut."""
    out = Skeleton()
    sample = sorted(sample)
    total, seen, placed = sum(x[3] + 1 for x in sample), 0, 0
    for before, now in zip(sample, sample[1:]):
        seen += before[3] + 1
        if seen * shards < (placed + 1) * total:
            continue
        if before[0] != now[0]:
            same = next((k for k, (a, b) in enumerate(zip(before[0], now[0])) if a != b), min(len(before[0]), len(now[0])))
            splitter, cut = (now[0][: same + 1], FIRST), now[0][:same]
        elif not before[1] and not now[1] and before[2] < now[2]:
            splitter, cut = (now[0], now[2]), now[0]
        else:
            continue  # their keys are alike as far as they were read
        out.splitters.append(splitter)
        out.add(cut)
        placed = seen * shards // total
    return out


def splitters(paths: DataFrame) -> Skeleton:
    """The skeleton for stored paths; what comes to the driver is a sample of bounded size."""
    n, turns = paths.agg(F.count("*"), F.sum(F.size("keys"))).first()
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(SHARDS, max(-(-(turns or 0) // SHARD_TURNS), min(tasks, (turns or 0) // LEAST_TURNS)))
    if shards < 2:
        return Skeleton()
    some = paths.filter(F.pmod(F.xxhash64("conv_id"), F.lit(n)) < OVERSAMPLE * shards)
    depth = DEPTH
    while True:
        read = [(r.keys, r.more, r.conv_id, r.turns) for r in some.select(F.slice("keys", 1, depth).alias("keys"), (F.size("keys") > depth).alias("more"), "conv_id", F.size("keys").alias("turns")).collect()]
        read = [([bytes(k) for k in keys], *rest) for keys, *rest in read]
        cut = [tuple(r[0]) for r in read if r[1]]
        if len(set(cut)) == len(cut) or 4 * depth * len(read) > SAMPLED_KEYS:
            return skeleton(read, shards)
        depth *= 4


_NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
_PIECE = pa.schema([*_NODE, ("parent", pa.int64()), ("node", pa.int64()), ("shard", pa.int64()), ("size", pa.int64()), ("ends", pa.string())])
PIECE = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _PIECE)
NODE = [n for n, _ in _NODE]


class _Open:
    """A node on the path to the present conversation."""

    __slots__ = ("node", "depth", "size", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, node: int | None, depth: int, size: int):
        self.node, self.depth, self.size = node, depth, size
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.waiting = [], []

    def member(self, n: int, conv_id: int) -> None:
        self.n += n
        self.least = conv_id if self.least is None else min(self.least, conv_id)


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def finish_shards(skeleton: Skeleton):
    """Sorted (shard, conv_id, keys, sizes) -> finished nodes, and partial counts of skeleton nodes."""

    def close(stack: list[_Open], shard: int, out: list[dict]) -> None:
        x = stack.pop()
        above = stack[-1] if stack else None
        if above:
            above.member(x.n, x.least)
        if x.node is not None:
            out.append({"node": x.node, "shard": shard, "conv_id": x.least, "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "size": x.size, "ends": ",".join(map(str, x.ends))})
            return
        # Its children waited for its smallest member.
        out += [r | {"parent_conv_id": x.least} for r in x.waiting]
        leaves, saved = x.leaves or 1, x.saved + (x.n - 1) * x.size
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        row = {"conv_id": x.least, "depth": x.depth, "n_convs": x.n, "n_children": x.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": _digest(x.ends)}
        if above.node is None:
            above.waiting.append(row)
        else:
            out.append(row | {"parent": above.node})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Open] = []
        shard, path, out = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                keys = r["keys"]
                same = next((k for k, (a, b) in enumerate(zip(path, keys)) if a != b), min(len(path), len(keys)))
                if r["shard"] != shard:
                    while stack:
                        close(stack, shard, out)
                    shard, same = r["shard"], 0
                    stack = [_Open(0, 0, 0)]
                while len(stack) > same + 1:
                    close(stack, shard, out)
                for key, size in zip(keys[same:], r["sizes"][same:]):
                    above = stack[-1].node
                    stack.append(_Open(None if above is None else skeleton.nodes[above][2].get(key), len(stack), size))
                stack[-1].member(1, r["conv_id"])
                stack[-1].ends.append(r["conv_id"])
                path = keys
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, _PIECE)
                    out = []
        while stack:
            close(stack, shard, out)
        if out:
            yield pa.RecordBatch.from_pylist(out, _PIECE)

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, shard, ends) -> the digest of each node's ids, one after another."""
    kind = pa.schema([("node", pa.int64()), ("ends_sha256", pa.string())])
    node, sha = None, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["node"] != node:
                out += [{"node": node, "ends_sha256": sha.hexdigest()}] if sha else []
                node, sha = r["node"], hashlib.sha256()
                sha.update(r["ends"].encode())
            else:
                sha.update(f",{r['ends']}".encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)
    if sha:
        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": sha.hexdigest()}], kind)


def _reduced(skeleton: Skeleton, parts: list) -> list[tuple]:
    """Sums of each skeleton node -> node, and its numbers with those of the skeleton below it. A parent stands before its children."""
    by = {r.node: r for r in parts}
    children, leaves, saved = ({k: r[c] for k, r in by.items()} for c in ("n_children", "n_leaves", "saved_tokens"))
    out = []
    for k in sorted(by, reverse=True):
        r, (parent, depth, _) = by[k], skeleton.nodes[k]
        leaves[k] += not children[k]
        saved[k] += (r.n_convs - 1) * r.size
        if parent >= 0:
            children[parent] += 1
            leaves[parent] += leaves[k]
            saved[parent] += saved[k]
        out.append((k, r.conv_id, depth, by[parent].conv_id if parent >= 0 else None, r.n_convs, children[k], leaves[k], saved[k]))
    return out


def trie(paths: DataFrame) -> DataFrame:
    """conv_id, keys, sizes -> a row for each node: NODE."""
    spark = paths.sparkSession
    paths = stored(paths, "trie-paths")
    bones = splitters(paths)
    sent = spark.sparkContext.broadcast(bones)
    deal = F.udf(lambda keys, conv_id: sent.value.shard([bytes(k) for k in keys], conv_id), "long", useArrow=True)
    dealt = paths.withColumn("shard", deal("keys", "conv_id") if bones.splitters else F.lit(0).cast("long"))
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", "keys", "conv_id")
    pieces = stored(ordered.mapInArrow(lambda batches: finish_shards(sent.value)(batches), PIECE), "trie-pieces")
    parts = pieces.filter("node is not null")
    sums = parts.groupBy("node").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("size").alias("size"))
    # No more rows than the skeleton has nodes.
    rows = _reduced(bones, sums.collect())
    whole = spark.createDataFrame(rows, "node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = parts.filter("ends <> ''").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard").mapInArrow(_ends, "node long, ends_sha256 string")
    top = whole.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    parents = F.broadcast(whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("own_parent")))
    rest = pieces.filter("node is null").drop("node").join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("own_parent", "parent_conv_id"))
    return top.select(*NODE).unionByName(rest.select(*NODE))


def op11_prefix_trie(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return trie(rebuild(conversations))


OP11_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) as key, length(coalesce(text, '')) as size
  from conversations where conv_id is not null),
own as (select conv_id, list({'key': key, 'size': size} order by turn nulls first, role, key) as own from turns group by conv_id),
hashed as (
  -- h is the CRC-32 of the decimal id, byte by byte and bit by bit, modulo 6.
  select conv_id, own,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
                         lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 as h
  from own),
paths as (
  select c.conv_id, coalesce(b.own, [])[1:c.h] || c.own[c.h + 1:] as path
  from hashed c left join own b on b.conv_id = c.conv_id - c.conv_id % 100),
members as (
  select conv_id, d, len(path) = d as ends, array_to_string(list_transform(path[1:d], lambda x: x.key), '') as node, coalesce(path[d].size, 0) as size
  from (select *, unnest(range(len(path) + 1)) as d from paths)),
nodes as (
  select node, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from members group by node, d),
-- Keys are 32 characters long, so a node's ancestors and the node itself are its first 32 * k characters.
below as (select n.*, unnest(range(d + 1)) as k from nodes n),
sums as (
  select left(b.node, 32 * b.k) as node, sum((b.n_convs - 1) * b.size) as saved_tokens,
         sum((not exists (select 1 from nodes x where x.d = b.d + 1 and left(x.node, 32 * b.d) = b.node))::int) as n_leaves, sum((b.d = b.k + 1)::int) as n_children
  from below b group by 1)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, s.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves,
       s.saved_tokens::bigint as saved_tokens, n.ends_sha256
from nodes n join sums s on s.node = n.node left join nodes p on n.d > 0 and p.d = n.d - 1 and p.node = left(n.node, 32 * (n.d - 1))
"""
