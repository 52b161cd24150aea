"""URL filters by a sort-merge range join on reversed-host keys.

A rule (action, host, path) fits its host and all subdomains where the url's path starts with the rule's
path. A canonical key is the host's labels from last to first, each closed by U+0001, then U+0002 and the path;
then the urls that a rule fits at one host are exactly those with keys, as UTF-8 bytes, from the rule's key up to that
key plus a byte 255: an interval. Intervals nest or are apart. A url has one key for each number of labels that some rule's host has, so a
host of very many labels has no more keys than others.

Keys and intervals are dealt to ranges by sampled keys: each range has the keys and interval ends that lie in it, and gets the
rules that are open where it begins (nested ones, so as many as rules nest at that place). A range with more than its
share of keys, under a hot host, is cut into slices by a hash of the row, and only its own rules are repeated in them.
Each slice is sorted and swept once: a start pushes its rule, an end pops it. The running sum of pushes and pops is the
height of the stack, and what lies at a height is the last rule pushed to it, so the top at a key is the innermost
rule there.

Of the rules that fit at the url's host suffixes, the longest host plus path wins, then the longer host.
Defined results: null url or no ``://`` gives an empty host and path, fits no rule and gets ``default``;
repeated rows stay; an empty table gives an empty result; other columns are ignored. A rule given twice
counts once, and block wins over allow for the same host and path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, stored

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
LABEL, PATH = "\u0001", "\u0002"
#: Ranges at most, keys sampled for each, and bytes of a sampled key that count.
MAX_RANGES, SAMPLED, BOUND_BYTES = 4096, 20, 48


def host_of(url):
    rest = F.substring_index(url, "://", 1)
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.length(rest) + 4, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url):
    rest = F.substring_index(url, "://", 1)
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.length(rest) + 4, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host, path):
    labels = F.reverse(F.split(F.translate(host, LABEL + PATH, "  "), r"\."))
    return F.concat(F.array_join(labels, LABEL), F.lit(LABEL + PATH), path)


def bounds_of(keys: DataFrame, total: int, ranges: int) -> list[str]:
    """Where each range but the first begins, as hexadecimal digits: quantiles of about SAMPLED keys for each range, picked by hash."""
    if ranges < 2 or not total:
        return []
    share = min(1.0, SAMPLED * ranges / total)
    picked = keys.filter(F.pmod(F.xxhash64("row", "key"), F.lit(1_000_000)) < max(1, int(share * 1_000_000)))
    seen = sorted(r[0] for r in picked.select(F.hex(F.substring("key", 1, BOUND_BYTES))).collect())
    return sorted({seen[len(seen) * k // ranges] for k in range(1, ranges)}) if seen else []


def range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are at or below a binary key, by halving."""
    if not bounds:
        return F.lit(0)
    table, first = F.split(F.lit(",".join(bounds)), ","), F.struct(F.lit(0).alias("a"), F.lit(len(bounds)).alias("b"))

    def halve(x: Column, at: Column) -> Column:
        below = (x["a"] < x["b"]) & (F.get(table, F.shiftright(x["a"] + x["b"], 1)) <= at)
        middle = F.shiftright(x["a"] + x["b"], 1)
        return F.when(below, F.struct((middle + 1).alias("a"), x["b"].alias("b"))).otherwise(F.struct(x["a"].alias("a"), middle.alias("b")))

    steps = F.array(*[F.lit(0)] * len(bounds).bit_length())
    return let(F.hex(key), lambda at: F.aggregate(steps, first, lambda x, _: halve(x, at), lambda x: x["a"]))


def events_of(rules: DataFrame, bounds: list[str]) -> DataFrame:
    """rules (action, host, path) -> sweep events: range, key, side (0 end, 1 start), length of the rule's key, step (up or down), found.

    A rule that is open where a range begins starts there with an empty key, the outer ones first.
    """
    rules = rules.groupBy("host", "path").agg(F.max("action").alias("action"))
    start = key_of(F.col("host"), F.col("path")).cast("binary")
    found = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "action")
    r = rules.select(start.alias("start"), F.concat(start, F.unhex(F.lit("FF"))).alias("end"), found.alias("found"))
    r = r.withColumns({"from": range_of(F.col("start"), bounds), "to": range_of(F.col("end"), bounds)})
    begins = r.withColumn("range", F.explode(F.sequence("from", "to"))).select(
        "range", F.when(F.col("range") == F.col("from"), F.col("start")).otherwise(F.unhex(F.lit(""))).alias("key"), F.lit(1).alias("side"), F.length("start").alias("depth"), F.lit(1).alias("step"), "found")
    ends = r.select(F.col("to").alias("range"), F.col("end").alias("key"), F.lit(0).alias("side"), (-F.length("start")).alias("depth"), F.lit(-1).alias("step"), F.lit(None).cast(begins.schema["found"].dataType).alias("found"))
    return begins.unionByName(ends)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", default: str = "allow", rows_per_slice: int = 1_000_000) -> DataFrame:
    """id, url -> id, host, path, rule, verdict."""
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).alias("id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    p = stored(p.withColumns({"row": F.monotonically_increasing_id(), "labels": labels(F.col("host"))}), "url-rows")
    # A rule fits a suffix of as many labels as its own host has, so a url needs no other keys, however long its host.
    depths = sorted(r[0] for r in rules.select(labels(F.col("host"))).distinct().collect())
    at = F.explode(F.filter(F.array(*[F.lit(n) for n in depths]).cast("array<int>"), lambda n: n <= F.col("labels")))
    keys = p.select("row", "host", "path", at.alias("n")).select("row", key_of(F.expr("substring_index(host, '.', -n)"), F.col("path")).cast("binary").alias("key"))
    total = p.agg(F.sum(sum((F.col("labels") >= n).cast("long") for n in depths) if depths else F.lit(0))).first()[0] or 0
    ranges = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_slice)))
    bounds = bounds_of(keys, total, ranges)
    keys = keys.withColumn("range", range_of(F.col("key"), bounds))
    full = {r["range"]: -(-r["count"] // rows_per_slice) for r in keys.groupBy("range").count().collect()}
    slices = F.get(F.split(F.lit(",".join(str(full.get(k, 0)) for k in range(len(bounds) + 1))), ",").cast("array<int>"), F.col("range"))
    events = events_of(rules, bounds).filter(slices > 0).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    keys = keys.select("range", "key", F.lit(2).alias("side"), F.lit(0).alias("depth"), F.lit(0).alias("step"), F.pmod(F.xxhash64("row"), slices).cast("int").alias("slice"), "row")
    slice_of, order = ("range", "slice"), ("key", "side", "depth")
    swept = events.unionByName(keys, allowMissingColumns=True)
    swept = swept.withColumn("height", F.sum("step").over(Window.partitionBy(*slice_of).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    swept = swept.filter("height > 0 and side > 0")
    top = Window.partitionBy(*slice_of, "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumn("top", F.last("found", ignorenulls=True).over(top)).filter("side = 2")
    best = swept.groupBy("row").agg(F.max("top").alias("found"))
    return p.join(best, "row", "left").select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.action", F.lit(default)).alias("verdict"))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    each = [F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*each)))


def op7_url_filter(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules_table(spark))


OP7_SQL = r"""
with rest as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end as r from pages),
parts as (
  select page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') as path from rest),
rules(action, rhost, rpath) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
numbered as (select row_number() over () as n, * from parts),
hit as (
  select n, max(struct_pack(size := length(rhost || rpath), host_size := length(rhost), rule := rhost || rpath, action := action)) as f
  from numbered join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by n)
select page_id, host, path, f.rule as rule, coalesce(f.action, 'allow') as verdict from numbered left join hit using (n)
"""
