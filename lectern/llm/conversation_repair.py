"""Conversation structure repair: generalised LR parsing of role initials with weighted edits.

A conversation is well formed if its role initials are ``(s?(ua)+)?``. The grammar is

    C -> empty | E      E -> B u a | E u a      B -> empty | s

and its LR automaton is ``SHIFT``, ``REDUCE`` and ``GOTO``. Every turn is kept, reroled or deleted, and turns can be inserted
before any turn and at the end; all of these are followed at once in a graph-structured stack. Its layer behind a turn has one node for each state on
top, linked to the node of the layer before and to the edits between them; where several stacks reach the same top, the one of
least (cost, audit) stays. Audits needn't be compared as strings: those of one layer all end with an edit of the same turn, so none begins another, and their order follows
from the order of the layer before and the new letters. A node so costs two small numbers, and links take ``len(TOPS)`` bytes a turn.

No conversation is gathered in one task. Turns are cut into ranges by conversation and order, from a sample that Spark takes; equal turns are
counted before. A conversation that lies within one range is repaired there. One that goes over several gets a table for each range,
from each top to each top (cost and order of audits), these tables are composed along the conversation, and each range is then repaired
between the tops found. Only the digest of a repaired conversation, which is sequential, reads its rows one after another, as a sorted stream.

Defined results: null roles and texts count as one space; a null conv_id is a conversation of its own; null turns come first; turns of one
number go by role, then by the MD5 of the text; a repeated row is a duplicate, also where it differs in other columns, which are
ignored; very long texts enter whole and are moved once; a conversation without rows left has zeros and an empty audit; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Initials that a turn can be given or inserted with, and the role for each.
ROLES = {"u": "user", "a": "assistant"}
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"

SHIFT = {(0, "s"): 3, (1, "u"): 4, (2, "u"): 5, (4, "a"): 6, (5, "a"): 7}
#: Reductions: left side and length. Those without a look-ahead are made at once.
REDUCE = {(0, "u"): ("B", 0), (3, None): ("B", 1), (6, None): ("E", 3), (7, None): ("E", 3)}
GOTO = {(0, "E"): 1, (0, "B"): 2}
ACCEPT = {0, 1}


def advance(stack: tuple[int, ...], token: str) -> tuple[int, ...] | None:
    """The stack after a token and the reductions that follow it, None if the token can't come."""

    def reduced(stack: tuple[int, ...], look: str | None) -> tuple[int, ...]:
        while (stack[-1], look) in REDUCE:
            left, n = REDUCE[stack[-1], look]
            stack = stack[: len(stack) - n]
            stack += (GOTO[stack[-1], left],)
        return stack

    stack = reduced(stack, token)
    return reduced((*stack, SHIFT[stack[-1], token]), None) if (stack[-1], token) in SHIFT else None


def _stacks() -> dict[int, tuple[int, ...]]:
    """All stacks between turns. The top of each tells the whole stack, so equal tops are equal stacks."""
    found, todo = {}, [(0,)]
    while todo:
        stack = todo.pop()
        if found.setdefault(stack[-1], stack) != stack:
            raise ValueError("two stacks have one top")
        todo += [x for t in "sua" if (x := advance(stack, t)) and x[-1] not in found]
    return found


STACKS = _stacks()
TOPS = sorted(STACKS)
START = TOPS.index(0)


def _inserts(top: int) -> dict[int, str]:
    """The tops that inserted turns lead to, each with the shortest row of initials."""
    found, todo = {top: ""}, [top]
    for t in todo:
        for initial in sorted(ROLES):
            x = advance(STACKS[t], initial)
            if x and x[-1] not in found:
                found[x[-1]] = found[t] + initial
                todo.append(x[-1])
    return found


def _edits(initial: str, forced: bool, truncated: bool) -> list[list[tuple[int, str, int, str, str]]]:
    """For each top: (cost, letters, next top, inserted initials, new initial), the least for each next top. Tops by their place in TOPS."""
    out = []
    for top in TOPS:
        least: dict[int, tuple] = {}
        for at, inserted in _inserts(top).items():
            price, letters = INSERT * len(inserted), "I" * len(inserted)
            moves = [(DELETE, "D", at, "")]
            if not forced:
                moves += [(KEEP + TRUNCATED * truncated, "K", x[-1], initial) for x in [advance(STACKS[at], initial)] if x]
                moves += [(REROLE + TRUNCATED * truncated, "R", x[-1], r) for r in ROLES for x in [advance(STACKS[at], r)] if x]
            for cost, letter, to, new in moves:
                way = (price + cost, letters + letter, TOPS.index(to), inserted, new)
                least[to] = min(least.get(to, way), way)
        out.append(sorted(least.values()))
    return out


#: By initial ("" for any other), whether the turn must go, whether it is truncated.
EDITS = {(i, f, t): _edits(i, f, t) for i in ("s", "u", "a", "") for f in (False, True) for t in (False, True)}
#: By top: what ends a conversation there. (cost, letters, inserted initials)
FINISH = [min((INSERT * len(w), "I" * len(w), w) for at, w in _inserts(top).items() if at in ACCEPT) for top in TOPS]
#: A link is one byte: the top it comes from and the number of the way there.
WAYS, NONE = 16, 255


def kind_of(initial: str, fault: str) -> tuple[str, bool, bool]:
    return (initial if initial in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated")


def forward(kinds: list[tuple[str, bool, bool]], start: int) -> tuple[dict[int, tuple[int, int]], bytearray]:
    """The graph-structured stack over turns from one top. -> last layer: top -> (cost, order of its audit), links."""
    layer, links = {start: (0, 0)}, bytearray()
    for kind in kinds:
        ways, least = EDITS[kind], {}
        for top, (cost, order) in layer.items():
            for k, (more, letters, to, _, _) in enumerate(ways[top]):
                way = (cost + more, order, letters, top * WAYS + k)
                if to not in least or way < least[to]:
                    least[to] = way
        back = bytearray([NONE]) * len(TOPS)
        for to, way in least.items():
            back[to] = way[3]
        links += back
        layer = {to: (least[to][0], k) for k, to in enumerate(sorted(least, key=lambda x: least[x][1:3]))}
    return layer, links


def finish(layer: dict[int, tuple[int, int]]) -> int:
    """The top of the last layer that ends at least (cost, audit)."""
    return min(layer, key=lambda top: (layer[top][0] + FINISH[top][0], layer[top][1], FINISH[top][1]))


def backward(kinds: list[tuple[str, bool, bool]], links: bytearray, top: int) -> list[tuple[int, str, int, str, str]]:
    """The edits of each turn on the way that ends at ``top``."""
    out = []
    for i in range(len(kinds) - 1, -1, -1):
        top, k = divmod(links[i * len(TOPS) + top], WAYS)
        out.append(EDITS[kinds[i]][top][k])
    return out[::-1]


def compose(pieces: list[list[dict[int, tuple[int, int]]]]) -> list[tuple[int, int]]:
    """Tables of the pieces of a conversation, by first top -> the tops before and behind each piece."""
    layer, links = {START: (0, 0)}, []
    for piece in pieces:
        least: dict[int, tuple] = {}
        for top, (cost, order) in layer.items():
            for to, (more, inner) in piece[top].items():
                way = (cost + more, order, inner, top)
                least[to] = min(least.get(to, way), way)
        links.append({to: way[3] for to, way in least.items()})
        layer = {to: (least[to][0], k) for k, to in enumerate(sorted(least, key=lambda x: least[x][1:3]))}
    out, top = [], finish(layer)
    for link in reversed(links):
        out.append((link[top], top))
        top = link[top]
    return out[::-1]


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, turn, role, key (of the text), copies, fault of the first copy, fault of the others. One row for equal turns."""
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    slim = turns.select("conv_id", "turn", "role", text_key(F.col("text")).alias("key"), last.alias("last")).groupBy("conv_id", "turn", "role", "key", "last").agg(F.count("*").alias("copies"))
    slim = stored(slim, "repair-turns")
    # The first turn of texts that occur in several turns of a conversation.
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"))
    again = slim.filter("last <> ''").groupBy("conv_id", "role", "key").agg(F.min(place)["turn"].alias("first_turn"), F.count("*").alias("turns")).filter("turns > 1")
    rows = slim.alias("s").join(again.alias("f"), F.expr("s.conv_id <=> f.conv_id and s.role = f.role and s.key = f.key"), "left")
    later = F.expr("f.turns is not null and not (s.turn <=> f.first_turn)")
    fault = F.when(F.col("last") == "", "blank").when(later, "duplicate").when(~F.col("last").isin(*ENDS), "truncated").otherwise("")
    return rows.select("s.*", fault.alias("fault"), F.when(F.col("last") == "", "blank").otherwise("duplicate").alias("other_fault")).drop("last")


def _kinds(rows: list[dict]) -> list[tuple[str, bool, bool]]:
    """Of every turn, copies included."""
    return [kind_of(r["role"][:1], f) for r in rows for f in (r["fault"], *[r["other_fault"]] * (r["copies"] - 1))]


def _runs(table: pa.Table) -> Iterator[list[dict]]:
    """The rows of each conversation of a range, in order."""
    table, run = table.sort_by([(c, "ascending") for c in ("numbered_conv", "conv_id", "numbered", "turn", "role", "key")]), []
    for batch in table.to_batches(max_chunksize=4096):
        for r in batch.to_pylist():
            if run and r["conv_id"] != run[0]["conv_id"]:
                yield run
                run = []
            run.append(r)
    if run:
        yield run


PLAN = "conv_id long, range int, before int, behind int, ends boolean"


def _tables(table: pa.Table) -> pa.Table:
    """For a conversation's rows in one range: cost and order from each top to each top."""
    out = []
    for run in _runs(table):
        kinds = _kinds(run)
        out += [(run[0]["conv_id"], run[0]["range"], a, b, cost, order) for a in range(len(TOPS)) for b, (cost, order) in forward(kinds, a)[0].items()]
    names = ["conv_id", "range", "before", "behind", "cost", "place"]
    return pa.Table.from_pylist([dict(zip(names, r)) for r in out], pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]))))


def _plans(table: pa.Table) -> pa.Table:
    by: dict[int, list] = {}
    for r in table.to_pylist():
        by.setdefault(r["range"], [{} for _ in TOPS])[r["before"]][r["behind"]] = (r["cost"], r["place"])
    conv, ranges = table["conv_id"][0].as_py(), sorted(by)
    found = compose([by[k] for k in ranges])
    rows = [{"conv_id": conv, "range": k, "before": a, "behind": b, "ends": k == ranges[-1]} for k, (a, b) in zip(ranges, found)]
    return pa.Table.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("range", pa.int32()), ("before", pa.int32()), ("behind", pa.int32()), ("ends", pa.bool_())]))


REPAIRED = "conv_id long, range int, place long, turn long, role string, key binary, copies long, fault string, other_fault string, edits string, cost long, inserted string, new_role string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
_REPAIRED = pa.schema([(c, _ARROW[t]) for c, t in (x.split() for x in REPAIRED.split(", "))])


def _repair(table: pa.Table) -> pa.Table:
    """The edits of a range's rows, and a row without a key for what is inserted at a conversation's end."""
    out, at = [], 0
    for run in _runs(table):
        kinds, start, ends = _kinds(run), run[0]["before"], run[0]["ends"]
        layer, links = forward(kinds, START if start is None else start)
        top = finish(layer) if start is None else run[0]["behind"]
        edits = iter(backward(kinds, links, top))
        for r in run:
            cost, letters, _, inserted, new = next(edits)
            # Copies of a turn must all go, and nothing is inserted before a turn that goes: after it, the audit is less.
            letters, cost = [letters], cost + DELETE * (r["copies"] - 1)
            letters += [next(edits)[1] for _ in range(r["copies"] - 1)]
            role = None if letters[0][-1] == "D" else r["role"] if letters[0][-1] == "K" else ROLES[new]
            out.append({n: r[n] for n in ("conv_id", "range", "turn", "role", "key", "copies", "fault", "other_fault")} | {"place": at, "edits": "".join(letters), "cost": cost, "inserted": inserted, "new_role": role})
            at += 1
        if ends is None or ends:
            cost, letters, inserted = FINISH[top]
            out.append(dict.fromkeys(_REPAIRED.names) | {"conv_id": run[0]["conv_id"], "range": run[0]["range"], "place": at, "copies": 0, "edits": letters, "cost": cost, "inserted": inserted})
            at += 1
    return pa.Table.from_pylist(out, _REPAIRED)


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> the edits of every turn: REPAIRED.

    (range, place) is the order within a conversation. ``inserted`` are the initials of turns inserted before a row, ``new_role`` is
    the role it is kept with, null where it goes. Each conversation ends with a row without a role, for turns inserted at its end.
    """
    rows = with_faults(turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")))
    rows = rows.withColumns({"numbered_conv": F.col("conv_id").isNotNull(), "numbered": F.col("turn").isNotNull()})
    ranged = stored(rows.repartitionByRange("conv_id", "turn", "role", "key").withColumn("range", F.spark_partition_id()), "repair-ranges")
    # At most two conversations of a range reach into another one, so these tables grow with the number of ranges alone.
    wide = ranged.groupBy("conv_id").agg(F.min("range").alias("a"), F.max("range").alias("b")).filter("a < b").select("conv_id")
    some = ranged.join(F.broadcast(wide.withColumnRenamed("conv_id", "wide_id")), F.expr("conv_id <=> wide_id")).drop("wide_id")
    tables = some.groupBy("range", "conv_id").applyInArrow(_tables, "conv_id long, range int, before int, behind int, cost long, place int")
    plans = stored(tables.groupBy("conv_id").applyInArrow(_plans, PLAN), "repair-plans")
    planned = ranged.alias("r").join(F.broadcast(plans.alias("p")), F.expr("r.conv_id <=> p.conv_id and r.range = p.range"), "left").select("r.*", "before", "behind", "ends")
    return planned.groupBy("range").applyInArrow(_repair, REPAIRED)


def lines(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits with the text of each kept turn, whole."""
    texts = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    texts = texts.groupBy("conv_id", "turn", "role", text_key(F.col("text")).alias("key")).agg(F.first("text").alias("text"))
    same = F.expr("e.conv_id <=> t.conv_id and e.turn <=> t.turn and e.role = t.role and e.key = t.key and e.new_role is not null")
    return edits.alias("e").join(texts.alias("t"), same, "left").select("e.*", "t.text")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT = pa.schema([(c, _ARROW[t]) for c, t in (x.split() for x in REPORT.split(", "))])
LEGAL = {"su", "ua", "au"}


class _Report:
    """What is summed up of one conversation while its rows go by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.counts, self.cost, self.illegal = conv_id, dict.fromkeys(("", "blank", "duplicate", "truncated"), 0), 0, 0
        self.turns, self.least, self.most, self.initial = 0, None, None, None
        self.audit, self.sha, self.first = [], hashlib.sha256(), True

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def add(self, r: dict) -> None:
        self.cost += r["cost"]
        self.audit.append(r["edits"])
        for x in r["inserted"]:
            self.line(ROLES[x], "")
        if not r["copies"]:
            return
        self.counts[r["fault"]] += 1
        self.counts[r["other_fault"]] += r["copies"] - 1
        initial = r["role"][:1]
        self.illegal += (self.initial is not None and self.initial + initial not in LEGAL) + r["copies"] - 1
        self.initial = initial
        if r["turn"] is not None:
            self.turns += r["turn"] != self.most
            self.least, self.most = r["turn"] if self.least is None else self.least, r["turn"]
        if r["new_role"] is not None:
            self.line(r["new_role"], r["text"])

    def row(self) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        found = {k: v for k, v in self.counts.items() if k}
        return {"conv_id": self.conv_id, "gaps": gaps, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()} | found


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if now is None or r["conv_id"] != now.conv_id:
                done += [now.row()] if now else []
                now = _Report(r["conv_id"])
            now.add(r)
        if done:
            yield pa.RecordBatch.from_pylist(done, _REPORT)
            done = []
    if now:
        yield pa.RecordBatch.from_pylist([now.row()], _REPORT)


def report(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """REPORT for each conversation with a row. A conversation's rows go by as a sorted stream; none is held as a whole."""
    rows = lines(turns, edits).select("conv_id", "range", "place", "turn", "role", "copies", "fault", "other_fault", "edits", "cost", "inserted", "new_role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "range", "place").mapInArrow(_reports, REPORT)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, damaged by a hash of conversation and turn; null roles and texts become one space."""
    number = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), number.alias("number")).filter("number <> 0")
    text = F.when(F.col("number") == 1, "").when(F.col("number") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("number") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "number")
    return rows.withColumn("copy", F.explode(F.expr("sequence(1, if(number = 3, 2, 1))"))).select("conv_id", "turn", "role", "text")


def op12_conversation_repair(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    turns = damage(conversations)
    found = report(turns, repair(turns)).withColumnRenamed("conv_id", "repaired_id")
    every = conversations.select("conv_id").distinct().join(found, F.expr("conv_id <=> repaired_id"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP12_SQL = r"""
with recursive
hashed as (
  -- The CRC-32 of "conv_id:turn", byte by byte and bit by bit.
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
                     lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) as crc
  from conversations),
marked as (select conv_id, turn, role, text, xor(crc, 4294967295) % 20 as number from hashed),
damaged as (
  select conv_id, turn, case when number = 4 then 'user' else role end as role,
         case when number = 1 then '' when number = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when number = 3 then 2 else 1 end)) as copy
  from marked where number <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i, left(role, 1) as initial,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last
  from damaged),
faulty as (
  select *, case when last = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                 when last not in ('.', '!', '?') then 'truncated' else '' end as fault,
         case when lag(initial) over (partition by conv_id order by i) || initial not in ('su', 'ua', 'au') then 1 else 0 end as illegal
  from placed),
-- States: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a.
go(a, t, b) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(a, w, said, b) as (values (0, '', []::varchar[], 0), (0, 'I', ['user:'], 2), (0, 'II', ['user:', 'assistant:'], 3), (1, '', [], 1), (1, 'I', ['user:'], 2), (1, 'II', ['user:', 'assistant:'], 3),
                              (2, '', [], 2), (2, 'I', ['assistant:'], 3), (3, '', [], 3), (3, 'I', ['user:'], 2)),
names(t, role) as (values ('u', 'user'), ('a', 'assistant')),
ways as (
  select f.conv_id, f.i, n.a, n.w || 'D' as letters, n.b, 3 + 2 * len(n.w) as cost, n.said from faulty f, ins n
  union all
  select f.conv_id, f.i, n.a, n.w || 'K', g.b, 2 * len(n.w) + (f.fault = 'truncated')::int, list_append(n.said, f.role || ':' || f.text)
  from faulty f join ins n on true join go g on g.a = n.b and g.t = f.initial where f.fault not in ('blank', 'duplicate')
  union all
  select f.conv_id, f.i, n.a, n.w || 'R', g.b, 2 + 2 * len(n.w) + (f.fault = 'truncated')::int, list_append(n.said, r.role || ':' || f.text)
  from faulty f join ins n on true join names r on true join go g on g.a = n.b and g.t = r.t where f.fault not in ('blank', 'duplicate')),
tops as (
  select conv_id, 0::bigint as i, 0 as state, 0::bigint as cost, '' as audit, []::varchar[] as said from (select distinct conv_id from damaged)
  union all
  select conv_id, i, state, cost, audit, said from (
    select w.conv_id, w.i, w.b as state, t.cost + w.cost as cost, t.audit || w.letters as audit, t.said || w.said as said,
           row_number() over (partition by w.conv_id, w.b order by t.cost + w.cost, t.audit || w.letters) as k
    from tops t join ways w on w.conv_id is not distinct from t.conv_id and w.i = t.i + 1 and w.a = t.state)
  where k = 1),
ends(a, w, said) as (values (0, '', []::varchar[]), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', [])),
sums as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum((fault = 'blank')::int) as blank,
         sum((fault = 'duplicate')::int) as duplicate, sum((fault = 'truncated')::int) as truncated, sum(illegal) as illegal
  from faulty group by conv_id),
done as (
  select s.*, t.cost + 2 * len(e.w) as cost, t.audit || e.w as audit, sha256(array_to_string(t.said || e.said, chr(10))) as repaired_sha256,
         row_number() over (partition by s.conv_id order by t.cost + 2 * len(e.w), t.audit || e.w) as k
  from sums s join tops t on t.conv_id is not distinct from s.conv_id and t.i = s.n join ends e on e.a = t.state)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join done d on d.conv_id is not distinct from c.conv_id and d.k = 1
"""
