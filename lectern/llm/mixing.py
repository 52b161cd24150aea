"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words: its share of all words by weight, never more than ``limit``
times its own words; what it can't take is shared again by weight. A source takes floor(target / own words)
complete epochs of all its documents. The rest of its target is filled with documents in the order of
exponential keys -ln(u) / quality weight, prefix-summed up to the budget. The weight is any positive column, by default
one that reads the whole text (``text_weight``); u comes from a hash of doc_id and text.

The order within a source is cut into ranges of the key's logarithm of width 1 / sqrt(documents), so that a hot source is sorted and
summed by many tasks, whatever its weights: range totals are summed first, then each range adds its own prefix sums.

Defined results: null text is empty (size 0, taken 0); a null source is a source of its own, last in order;
repeated rows with one doc_id each count as a document, and are counted before they are dealt out; documents without an id differ by their texts; ties of the key go by
doc_id, then size; a null weight counts as the least one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, words

WEIGHTS = (5, 2, 1)
LIMIT = 3
LEAST_WEIGHT = 0.05


def targets(sources: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, docs -> the same with ``target``. One row per source: only this small table is ordered as a whole.

    With caps sorted by limit * size / weight, the water level is the first one at which the sources
    capped so far leave a level that no other source's cap is under.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1))
    s = s.withColumn("ratio", limit * F.col("source_size") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "left_words": F.sum("source_size").over(everything) - F.coalesce(F.sum(limit * F.col("source_size")).over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    s = s.withColumn("level", F.col("left_words") / F.col("left_weight"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    s = s.withColumn("water", level)
    return s.select("source", "source_size", "docs", F.least(limit * F.col("source_size").cast("double"), F.col("weight") * F.col("water")).alias("target"))


def uniform(doc_id: Column, text: Column) -> Column:
    """A reproducible number strictly between 0 and 1 for a document."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def text_weight(text: Column) -> Column:
    """Between LEAST_WEIGHT and 1, from the whole text: the share of lines that aren't repeats, times the share of characters that aren't markup, to the fourth power, times the number of distinct words against twice the square root of the number of words (or that number, if less), 1 at most."""
    text = F.coalesce(text, F.lit(""))
    lines, w = F.split(text, "\n"), words(text)
    fresh = F.size(F.array_distinct(lines)) / F.size(lines)
    plain = 1 - F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / F.greatest(F.length(text), F.lit(1))
    variety = F.least(F.lit(1.0), F.size(F.array_distinct(w)) / F.greatest(F.lit(1.0), F.least(F.size(w).cast("double"), 2 * F.sqrt(F.size(w)))))
    return F.greatest(F.lit(LEAST_WEIGHT), fresh * plain * plain * plain * plain * variety)


def mix(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT, keep: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """doc_id, text, source and a column of quality weights -> doc_id, source, size, source_size, target, epochs, taken (words, repeats counted), and the columns of keep, which settle the last ties."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    weight = F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(text_weight(F.col("text")) if weight is None else weight, F.lit(LEAST_WEIGHT)))
    slim = docs.select("doc_id", "source", size.alias("size"), (-F.log(uniform(F.col("doc_id"), F.col("text"))) / weight).alias("key"), *keep)
    # Equal rows have one key: they are counted before they are dealt out, and told apart again by their number.
    slim = stored(slim.groupBy("doc_id", "source", "size", "key", *keep).agg(F.count("*").alias("copies")), "mix")
    words = F.col("size") * F.col("copies")
    sources = targets(slim.groupBy("source").agg(F.sum(words).alias("source_size"), F.sum("copies").alias("docs")), weights, limit)
    sources = stored(sources, "mix-sources")
    rows = slim.alias("d").join(F.broadcast(sources.alias("s")) if sources.count() <= 10_000 else sources.alias("s"), F.expr("d.source <=> s.source")).select("d.*", "source_size", "docs", "target")
    # No more than 0.37 / width of the logarithms of exponential keys lie within a width, whatever their weights.
    rows = rows.withColumn("range", F.floor(F.log("key") * F.sqrt("docs")))
    each = rows.groupBy("source", "range").agg(F.sum(words).alias("words"))
    offsets = each.select("source", "range", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(words).over(inside))
    rows = rows.alias("d").join(offsets.alias("o"), F.expr("d.source <=> o.source and d.range = o.range")).select("d.*", "offset")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("upto", F.col("upto") - F.col("size") * (F.col("copies") - F.col("copy")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("full", epochs)
    rest = F.col("target") - F.col("full") * F.col("source_size")
    extra = (F.col("offset") + F.col("upto") - F.col("size") / 2 <= rest) & (rest > 0) & (F.col("size") > 0)
    rows = rows.withColumn("epochs", F.col("full") + F.when(extra, 1).otherwise(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).cast("long").alias("taken"), *keep)


def op6_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
with slim as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         (('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/' || md5(coalesce(text, ''))), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u,
         len(list_distinct(string_split(coalesce(text, ''), chr(10)))) / len(string_split(coalesce(text, ''), chr(10))) as fresh,
         1 - len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) / greatest(length(coalesce(text, '')), 1) as plain,
         len(list_distinct(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) as kinds
  from documents),
keyed as (
  select doc_id, source, size, -ln(u) / greatest(0.05, fresh * plain * plain * plain * plain * least(1.0, kinds / greatest(1.0, least(size, 2 * sqrt(size))))) as key
  from slim),
src as (select source, sum(size)::bigint as source_size from keyed group by source),
weighed as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3) + 1] as weight from src),
ratios as (select *, 3 * source_size / weight::double as ratio from weighed),
lefts as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
            / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))::double as level
  from ratios),
goal as (
  select source, source_size, least(3 * source_size::double, weight * (select arg_min(level, ratio) from lefts where level <= ratio)) as target from lefts),
summed as (
  select k.*, g.source_size, g.target,
         sum(k.size) over (partition by k.source order by key, doc_id, k.size rows unbounded preceding) as upto,
         case when g.source_size > 0 then floor(g.target / g.source_size) else 0 end as epochs
  from keyed k join goal g on k.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (size * (epochs + case when upto - size / 2.0 <= target - epochs * source_size and target - epochs * source_size > 0 and size > 0 then 1 else 0 end))::bigint as taken
from summed
"""
