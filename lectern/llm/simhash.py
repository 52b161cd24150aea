"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has a bit set where over half of the text's word shingles have it set in their XXH64 hash.
64 bits are cut into six blocks of even width; two fingerprints that differ in at most three bits agree in at least three
blocks, so each fingerprint goes to one bucket for each of the 20 choices of three blocks (31 to 33 bits), and pairs
within a bucket are verified by their Hamming distance. Only distinct fingerprints take part; equal ones
are one node.

A bucket of more than ``bucket_rows`` fingerprints isn't paired but split: its members differ in the other bits only,
which are cut into six blocks again, so that close ones agree in three of these and meet in one of 20 smaller buckets of about 48
bits. Where such a bucket is still too large, its members (they differ in about 16 bits only) meet, exactly and in
linear work, at the values they reach by flipping those bits: two fingerprints that differ in at most three bits share a
value that is one flip from the first and two from the second. At each value, all that are within two flips are
linked to the smallest that is within one: each such link is a true one, and no linked pair is left apart.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; fewer words
than a shingle give one shingle of all words; repeated rows and equal texts share a component; the component is
named by its smallest doc_id, nulls aside; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
BUCKET_ROWS = 200


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        hashes = [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])]
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        bits = np.unpackbits(np.array(hashes[k : k + 65_536], dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(bits: list[int], blocks: int = 6, agree: int = 3) -> list[list[int]]:
    """The given bits in ``blocks`` blocks of even width: the bits of each choice of ``agree`` of them."""
    cut = [bits[len(bits) * k // blocks : len(bits) * (k + 1) // blocks] for k in range(blocks)]
    return [sorted(sum(c, [])) for c in combinations(cut, agree)]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


ALL = list(range(64))
TABLES = masks(ALL)
#: For each table, the bits of its 20 finer tables: its own and three of six blocks of the others.
FINER = [[sorted(own + some) for some in masks([b for b in ALL if b not in own])] for own in TABLES]
#: For each finer table, the 16 or so bits outside it.
FREE = [[[b for b in ALL if b not in bits] for bits in finer] for finer in FINER]


def _near(distance: int) -> str:
    return f"bit_count(u ^ v) <= {distance}"


def _pairs(spread: DataFrame, key: list[str], distance: int, bucket_rows: int, label: str) -> tuple[DataFrame, DataFrame]:
    """fp in buckets (key) -> close pairs (u, v) within buckets of at most ``bucket_rows``, and the members of the larger ones."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("fp"))
    buckets = spread.withColumn("rank", rank).filter(F.col("rank") <= bucket_rows + 1).groupBy(*key).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    buckets = stored(buckets, label)
    pairs = buckets.filter(F.size("fps") <= bucket_rows).select(F.posexplode("fps").alias("k", "u"), "fps").select("u", F.explode(F.expr(f"filter(slice(fps, k + 2, size(fps)), v -> {_near(distance)})")).alias("v"))
    # A table of their keys alone: where there are few, Spark sees that from its size and broadcasts them in place of shuffling all members.
    hot = stored(buckets.filter(F.size("fps") > bucket_rows).select(*key), label + "-hot")
    return pairs, spread.join(hot, key, "left_semi")


def close_pairs(nodes: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect whatever pairs at ``distance`` or less connect. ``distance`` is 3 at most."""
    table = lambda rows: F.array(*[F.lit(x) for x in rows])
    spread = nodes.select("fp", F.posexplode(table([_mask(m) for m in TABLES])).alias("table", "mask")).select("fp", "table", F.expr("fp & mask").alias("key"))
    pairs, hot = _pairs(spread, ["table", "key"], distance, bucket_rows, "simhash-buckets")
    # Members of large buckets, by 48 bits.
    finer = F.get(F.array(*[table([_mask(m) for m in finer]) for finer in FINER]), F.col("table"))
    spread = hot.select("fp", "table", F.posexplode(finer).alias("part", "mask")).select("fp", "table", "part", F.expr("fp & mask").alias("key"))
    more, hot = _pairs(spread, ["table", "part", "key"], distance, bucket_rows, "simhash-parts")
    # Members of what is still large, by flips of the 16 bits left. Flips are masks of one or two of them.
    free = F.get(F.get(F.array(*[F.array(*[table([_signed(1 << b) for b in bits]) for bits in parts]) for parts in FREE]), F.col("table")), F.col("part"))
    at = ["table", "part", "value"]
    members = hot.select("fp", "table", "part", free.alias("bits"))
    flips = F.expr("concat(array(fp), flatten(transform(bits, (b, i) -> transform(slice(bits, i + 1, size(bits)), c -> if(b = c, fp ^ b, fp ^ b ^ c)))))")
    values = members.select("fp", "table", "part", F.explode(flips).alias("value"))
    centres = values.filter("bit_count(fp ^ value) <= 1").groupBy(*at).agg(F.min("fp").alias("centre"))
    stars = values.join(centres, at).filter(f"fp <> centre and bit_count(fp ^ centre) <= {distance}").select(F.col("fp").alias("u"), F.col("centre").alias("v"))
    return pairs.unionByName(more).unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, fp, component_id."""
    fps = stored(docs.select("doc_id", F.pandas_udf(_fingerprints, "long")("text").alias("fp")), "simhash")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    linked = components(close_pairs(nodes.select("fp")), "simhash-links")
    named = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(ids, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
