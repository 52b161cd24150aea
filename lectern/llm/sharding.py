"""Sharding by extendible hashing.

A document's key is hashed to 60 bits. The directory is indexed by leading bits of the hash; one bucket for all
rows is split on one more bit wherever it holds more than ``limit`` bytes, until each bucket fits. Buckets
keep their own depth, so only oversized ones split. Directory cells are a few bits finer than the expected depth:
rows are summed into cells once (map-side first), all splits are worked out on the cells, and only rows in cells
that are still too large are summed again with more bits.

The first 40 bits hash the key alone; the last 20 hash a row number, so rows of one key are split as well, but only
where that key by itself is too large. A document larger than the limit ends alone in its bucket; rows that share all
bits share one, whatever its size.

Defined results: null text has 0 bytes; a null key hashes like an empty one; repeated rows count each; an empty
table gives an empty result; other columns are kept by ``write_shards`` and ignored by ``assign``.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LIMIT = 256 * 1024
KEY_BITS, BITS = 40, 60
#: Cells are so many bits finer than an even spread needs; beyond so many cells they aren't broadcast.
SPARE_BITS, BROADCAST_CELLS = 4, 100_000


def _bits(value, digits: int):
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def hashed(key, row):
    """40 bits of the key, then 20 bits of the row number."""
    return F.shiftleft(_bits(F.coalesce(key.cast("string"), F.lit("")), KEY_BITS // 4), BITS - KEY_BITS).bitwiseOR(_bits(row.cast("string"), (BITS - KEY_BITS) // 4))


def directory(rows: DataFrame, limit: int, top: int, depth: int) -> DataFrame:
    """h, n_bytes -> cell (the first ``depth`` bits), local_depth (null where still too large), shard_bytes, shard_rows.

    ``top`` is the depth of the buckets that are being split.
    """
    cells = rows.groupBy(F.shiftright("h", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"))
    each = cells.withColumn("d", F.explode(F.sequence(F.lit(top), F.lit(depth)))).withColumn("node", F.expr(f"shiftright(cell, {depth} - d)"))
    fits = each.groupBy("d", "node").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows")).filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("d") == BITS))
    found = each.join(fits, ["d", "node"], "left").groupBy("cell").agg(F.min(F.when(F.col("shard_rows").isNotNull(), F.struct(F.col("d").alias("local_depth"), "shard_bytes", "shard_rows"))).alias("leaf"))
    return found.select("cell", "leaf.*")


def assign(docs: DataFrame, key: str = "doc_id", limit: int = LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents -> key, n_bytes, shard (the bucket's bits), local_depth, shard_bytes, shard_rows, and ``kept``: a struct of the columns of ``keep``.

    Every row goes through with its own hash, so null and repeated keys stay as they are.
    """
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    kept = [F.struct(*keep).alias("kept")] if keep else []
    rows = docs.select(F.col(key).alias("key"), n_bytes.alias("n_bytes"), hashed(F.col(key), F.monotonically_increasing_id()).alias("h"), *kept)
    rows = stored(rows, "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    out, left, top = None, rows, 0
    depth = min(BITS, max(1, ceil(log2(max(1, total / limit)))) + SPARE_BITS)
    while True:
        cells = stored(directory(left, limit, top, depth), "shard-cells")
        side = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
        placed = left.withColumn("cell", F.shiftright("h", BITS - depth)).join(side, "cell")
        done = placed.filter("local_depth is not null") if depth < BITS else placed
        done = done.withColumn("local_depth", F.coalesce("local_depth", F.lit(depth)))
        done = done.withColumn("shard", F.expr(f"if(local_depth = 0, '', lpad(bin(shiftright(h, {BITS} - local_depth)), local_depth, '0'))"))
        done = done.select("key", "n_bytes", "shard", "local_depth", "shard_bytes", "shard_rows", *["kept"] * bool(keep))
        out = done if out is None else out.unionByName(done)
        if depth == BITS or cells.filter("local_depth is null").isEmpty():
            return out.withColumnRenamed("key", key)
        left = stored(placed.filter("local_depth is null").select("key", "n_bytes", "h", *["kept"] * bool(keep)), "shard-rows")
        top, depth = depth, min(BITS, depth + 8)


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", limit: int = LIMIT) -> None:
    """Writes whole documents as Parquet, one folder for each shard, in place of any column of that name. Each row is written once, whatever its key."""
    columns = tuple(c for c in docs.columns if c != "shard")
    placed = assign(docs, key, limit, columns)
    placed.select("kept.*", F.concat(F.lit("b"), "shard").alias("shard")).repartition("shard").write.partitionBy("shard").parquet(folder)


def op1_sharding(spark, sf_dir):
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The row number stands for Spark's, which is the same where the table comes in one piece; it matters only where one key alone is too large.
OP1_SQL = f"""
with slim as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes,
         (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, {KEY_BITS // 4}))::bigint << {BITS - KEY_BITS})
         + ('0x' || substr(md5((row_number() over () - 1)::varchar), 1, {(BITS - KEY_BITS) // 4}))::bigint as h
  from documents),
nodes as (select d, h >> ({BITS} - d) as node, sum(n_bytes)::bigint as shard_bytes, count(*) as shard_rows
          from slim, range(0, {BITS + 1}) r(d) group by all having sum(n_bytes) <= {LIMIT} or count(*) = 1 or d = {BITS}),
leaf as (select s.doc_id, s.n_bytes, s.h, min(n.d) as d from slim s join nodes n on s.h >> ({BITS} - n.d) = n.node group by all)
select doc_id, n_bytes, case when l.d = 0 then '' else lpad(bin(l.h >> ({BITS} - l.d)), l.d::int, '0') end as shard,
       l.d::int as local_depth, shard_bytes, shard_rows
from leaf l join nodes n on n.d = l.d and n.node = l.h >> ({BITS} - l.d)
"""
