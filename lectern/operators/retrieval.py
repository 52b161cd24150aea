"""Retrieval for whole query tables: vector, keyword and hybrid branches, reranking, fusion and evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from lectern.functions.stemming import STOP_WORDS as STEM_STOP_WORDS
from lectern.functions.stemming import stem_head, stemmed
from lectern.functions.text import tokens
from lectern.sources.shared import stored

#: Vectors in a block of corpus or queries (with 64 to 1536 numbers each: at most a few dozen megabytes).
BLOCK = QUERY_BLOCK = 2_000
#: Bytes of queries that are broadcast at once.
GROUP_BYTES = 32_000_000
#: Words that a block of postings is made of, and keyword queries in a block.
POSTINGS, KEYWORD_BLOCK = 1_000_000, 20_000
#: Words and ids that are broadcast at most.
WORDS, IDS = 500_000, 1_000_000
#: Expansions of query tokens, and words that the keyword form of a query leaves out.
SYNONYMS = {
    "os": "operating systems",
    "db": "database",
    "dbms": "database management system",
    "cpu": "central processing unit",
    "ml": "machine learning",
    "ai": "artificial intelligence",
    "cn": "computer networks",
    "mcq": "multiple choice question",
}
STOP_WORDS = "the a an is are was were what how why when where which who whom of in on for to and or with about explain describe discuss give tell".split()


def ranked(hits: DataFrame, k: int | None = None, offset: int = 0, *partition: str) -> DataFrame:
    """W2, K1-K4. A 1-based rank for each query by score, nulls last, then newest first where hits have created_at, then id; kept between offset and offset + k."""
    newest = [F.col("created_at").desc_nulls_last()] if "created_at" in hits.columns else []
    order = Window.partitionBy("query_id", *partition).orderBy(F.col("score").desc_nulls_last(), *newest, "id")
    out = hits.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def _packed(id_type: pa.DataType, id_name: str):
    """Rows (id, vector) -> one row for each BLOCK of them: ids, their vectors as a matrix of doubles, and one, by which blocks are joined."""
    schema = pa.schema([(f"{id_name}s", pa.list_(id_type)), (f"{id_name}_matrix", pa.binary()), ("one", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                ids, vectors = batch.slice(k, BLOCK).columns
                matrix = np.array(vectors.to_pylist(), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], schema[0].type), pa.array([matrix.tobytes()], pa.binary()), pa.array([1], pa.int64())], schema=schema)

    return run


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    with np.errstate(all="ignore"):
        if metric == "l2":
            square = (x * x).sum(1)[None, :] - 2 * (q @ x.T) + (q * q).sum(1)[:, None]
            return np.round(1 / (1 + np.sqrt(np.maximum(square, 0))), 6)
        score = q @ x.T
        if metric == "cosine":
            score /= np.linalg.norm(x, axis=1)[None, :]
            score /= np.linalg.norm(q, axis=1)[:, None]
    return np.round(score, 6, out=score)


def _nearest(k: int, metric: str, schema: pa.Schema):
    """Pairs of blocks -> the k nearest of each query that this task has seen. Only k rows a query are held, for the blocks of queries of one broadcast, and given out at the end."""

    def merged(best: list, least: np.ndarray, ids: list, score: np.ndarray) -> None:
        n = min(k, score.shape[1])
        for a, row in enumerate(score):  # row by row, as copies of all scores take memory
            key = np.where(np.isnan(row), -np.inf, row)
            if key.max() < least[a]:
                continue
            at = np.flatnonzero(key >= max(least[a], np.partition(key, -n)[-n]))
            best[a] = sorted([*best[a], *[(-key[c], ids[c], row[c]) for c in at]], key=lambda t: t[:2])[:k]
            if len(best[a]) == k:
                least[a] = -best[a][-1][0]

    def rows(query_ids: list, best: list) -> pa.RecordBatch:
        flat = [(q, i, None if np.isnan(s) else float(s)) for q, found in zip(query_ids, best) for _, i, s in found]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat) if flat else ([], [], []), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for at in range(len(batch)):
                r = batch.slice(at, 1).to_pylist()[0]
                if r["part"] not in held:
                    held[r["part"]] = r["query_ids"], [[] for _ in r["query_ids"]], np.full(len(r["query_ids"]), -np.inf)
                query_ids, best, least = held[r["part"]]
                q = np.frombuffer(r["query_id_matrix"]).reshape(len(query_ids), -1)
                merged(best, least, r["ids"], _scores(np.frombuffer(r["id_matrix"]).reshape(len(r["ids"]), -1), q, metric))
        for query_ids, best, _ in held.values():
            yield rows(query_ids, best)

    return run


def _meet(blocks: DataFrame, asked: DataFrame, size: Column) -> DataFrame:
    """Blocks of a corpus, each beside all blocks of queries (part, and columns of the given size in bytes): both have a column ``one``.

    Blocks of queries are broadcast, as many at once as GROUP_BYTES holds and one at least; the corpus is read once for each such group and never shuffled or repeated.
    """
    asked = stored(asked)
    groups, room = [], 0
    for r in asked.select("part", size.alias("size")).orderBy("part").collect():  # a row for each block of queries
        if not groups or r.size > room:
            groups, room = [*groups, []], GROUP_BYTES
        groups[-1].append(r.part)
        room -= r.size
    out = [blocks.join(F.broadcast(asked.filter(F.col("part").between(g[0], g[-1]))), "one") for g in groups or [[0]]]
    return reduce(DataFrame.unionByName, out)


def vector_search(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """R1-R4, K1, F4. The k nearest corpus vectors of each query: query_id, id, score, rank. Ids of any type.

    Vectors of corpus and queries become rows of two tables of blocks, which are joined and multiplied. Blocks of queries
    are broadcast, up to QUERY_BLOCK of them as one, more in groups of GROUP_BYTES, and the corpus is read once for each group
    (65,000 queries of 64 numbers). What is shuffled and ranked is k rows for each query and task. Scores are rounded to six
    digits first. A zero vector has no cosine and ranks last.
    """
    n = queries.count()
    id_kind, query_kind = corpus.schema["id"].dataType, queries.schema["query_id"].dataType
    kind = f"query_id {query_kind.simpleString()}, id {id_kind.simpleString()}, score double"
    schema = to_arrow_schema(StructType([StructField("query_id", query_kind), StructField("id", id_kind), StructField("score", DoubleType())]))
    blocks = corpus.select("id", "vector").mapInArrow(_packed(schema.field("id").type, "id"), f"ids array<{id_kind.simpleString()}>, id_matrix binary, one long")
    pack = _packed(schema.field("query_id").type, "query_id")
    asked = queries.select("query_id", "vector")
    asked_kind = f"query_ids array<{query_kind.simpleString()}>, query_id_matrix binary, one long"
    if n <= QUERY_BLOCK:
        # One block, of a size that has just been checked.
        asked = asked.coalesce(1).mapInArrow(lambda batches: pack(_whole(batches)), asked_kind).withColumn("part", F.lit(0))
        pairs = blocks.join(F.broadcast(asked), "one")
    else:
        asked = asked.repartition(-(-n // QUERY_BLOCK)).mapInArrow(pack, asked_kind).withColumn("part", F.monotonically_increasing_id())
        pairs = _meet(blocks, asked, F.octet_length("query_id_matrix"))
    found = pairs.select("part", "ids", "id_matrix", "query_ids", "query_id_matrix").mapInArrow(_nearest(k, metric, schema), kind)
    if metric == "dot":
        found = found.withColumn("reference_form", 1 + F.col("score"))
    return ranked(found if threshold is None else found.filter(F.col("score") >= threshold), k)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a bounded table as one batch."""
    if found := list(batches):
        yield pa.Table.from_batches(found).combine_chunks().to_batches(max_chunksize=QUERY_BLOCK)[0]


#: Words of a text for the substring branch: runs without blanks, lower-cased. A border is marked by a blank, which no word has.
BLANKS, BORDER = r"[\x20\x09-\x0D]+", "\n"
GRAM = 3


def _runs(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS), "")


def _grams(text: Column, n: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substr(text, k, n)))


def _stem_words(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """Tokens in words of the vocabulary that have an asked stem: word, stem.

    A stem but for its last letter begins every word that it comes from, or its first letter does; with ``ble`` at its end, or as one of the stemmer's own forms, it
    is so but for two letters (a test holds this against many words). Only tokens with such a beginning are stemmed.
    """
    inside = vocabulary.select(F.explode(tokens(F.col("word"))).alias("word")).distinct().filter(~F.col("word").isin(STEM_STOP_WORDS))
    heads = stored(asked.select(stem_head(F.col("stem")).alias("head")).distinct())
    lengths = F.array(*[F.lit(r.n) for r in heads.select(F.length("head").alias("n")).distinct().orderBy("n").collect()]).cast("array<int>")
    begun = inside.select("word", F.explode(lengths).alias("n")).select("word", F.expr("left(word, n)").alias("head")).join(heads, "head", "left_semi").select("word").distinct()
    return stemmed(begun).join(asked.select("stem").distinct(), "stem", "left_semi").select("word", "stem")


def _part_words(vocabulary: DataFrame, patterns: DataFrame) -> DataFrame:
    """Words of the vocabulary, between borders, that contain a pattern: pattern, word, uses.

    Words are looked up by n-grams, of three characters or as long as the pattern. Each pattern goes by its
    rarest, and the words found are compared as a whole.
    """
    wanted = patterns.select("pattern", F.least(F.lit(GRAM), F.length("pattern")).alias("n"))
    lengths = [r.n for r in wanted.select("n").distinct().collect()]
    wanted = wanted.select("pattern", F.explode(_grams(F.col("pattern"), F.col("n"))).alias("gram"))
    marked = F.concat(F.lit(BORDER), "word", F.lit(BORDER))
    posted = vocabulary.select("word", "uses", F.explode(F.concat(F.array().cast("array<string>"), *[_grams(marked, F.lit(n)) for n in lengths])).alias("gram"))
    posted = stored(posted.join(F.broadcast(stored(wanted.select("gram").distinct())), "gram", "left_semi"))  # three characters each, so they are few
    rarity = posted.groupBy("gram").agg(F.count("*").alias("words"))
    # A pattern with a gram that no word has is in no word.
    rarest = wanted.join(rarity, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("words", F.lit(0)).alias("words"), "gram"))["gram"].alias("gram"))
    return posted.join(stored(rarest), "gram").filter(F.contains(marked, F.col("pattern"))).select("pattern", "word", "uses")


def _postings(id_type: pa.DataType, newest_type: pa.DataType):
    """Rows (id, newest, stem), one for each time and those of a document together -> one row for each block of whole documents.

    Documents of a block are numbered from the newest on, then by id, so that a smaller number wins a tie. For each stem, in order: where its documents begin, their numbers, and tf / (tf + 1).
    """
    schema = pa.schema([("ids", pa.list_(id_type)), ("newest", pa.list_(newest_type)), *[(c, pa.binary()) for c in ("stems", "starts", "documents", "weights")], ("one", pa.int64())])

    def block(rows: pa.Table) -> pa.RecordBatch:
        known = rows["id"].combine_chunks().dictionary_encode()
        at = known.indices.to_numpy(zero_copy_only=False)
        order = pc.sort_indices(pa.table({"newest": rows["newest"].take(pa.array(np.unique(at, return_index=True)[1])), "id": known.dictionary}), sort_keys=[("newest", "descending"), ("id", "ascending")])
        place = np.empty(len(order), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        document, stem = place[at], rows["stem"].to_numpy()
        by = np.lexsort((document, stem))
        document, stem = document[by], stem[by]
        new = np.flatnonzero(np.r_[True, (stem[1:] != stem[:-1]) | (document[1:] != document[:-1])])
        tf = np.diff(np.r_[new, len(stem)]).astype(np.float64)
        stems, starts = np.unique(stem[new], return_index=True)
        newest = rows["newest"].take(pa.array(np.unique(at, return_index=True)[1])).take(order)
        parts = [stems, np.r_[starts, len(new)].astype(np.int64), document[new].astype(np.int32), tf / (tf + 1)]
        return pa.RecordBatch.from_arrays([pa.array([known.dictionary.take(order).to_pylist()], schema[0].type), pa.array([newest.to_pylist()], schema[1].type), *[pa.array([x.tobytes()], pa.binary()) for x in parts], pa.array([1], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held, n = [*held, batch], n + len(batch)
            if n >= POSTINGS:
                rows = pa.Table.from_batches(held)
                # The last document may go on.
                rest = int(pc.sum(pc.equal(rows["id"], rows["id"][-1]).cast(pa.int64())).as_py())
                if rest < n:
                    yield block(rows.slice(0, n - rest))
                held, n = rows.slice(n - rest).to_batches(), rest
        if n:
            yield block(pa.Table.from_batches(held))

    return run


def _asked_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (no, stems) -> one row for each KEYWORD_BLOCK of them: their numbers, where their stems begin, and the stems."""

    def block(rows: list) -> pa.RecordBatch:
        starts = np.cumsum([0, *[len(x) for _, x in rows]])
        parts = [np.array([no for no, _ in rows], dtype=np.int64), starts.astype(np.int64), np.array([x for _, xs in rows for x in xs], dtype=np.int64)]
        return pa.RecordBatch.from_arrays([*[pa.array([x.tobytes()], pa.binary()) for x in parts], pa.array([1], pa.int64())], names=["nos", "asked_starts", "asked_stems", "one"])

    held = []
    for batch in batches:
        held += zip(batch["no"].to_pylist(), batch["stems"].to_pylist())
        while len(held) >= KEYWORD_BLOCK:
            yield block(held[:KEYWORD_BLOCK])
            held = held[KEYWORD_BLOCK:]
    if held:
        yield block(held)


def _keyword_hits(k: int | None, id_type: pa.DataType, newest_type: pa.DataType):
    """Blocks of postings beside blocks of queries -> documents with all stems of a query: no, id, newest, score. Of each query and block the best k, and none that is under k that this task has seen; all if k is None."""
    schema = pa.schema([("no", pa.int64()), ("id", id_type), ("newest", newest_type), ("score", pa.float64())])

    def hits(r: dict, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Query by query: its place in the block, and its documents with their scores."""
        starts, documents, weights = (np.frombuffer(r[c], dtype=t) for c, t in (("starts", np.int64), ("documents", np.int32), ("weights", np.float64)))
        stems, first, wanted = (np.frombuffer(r[c], dtype=np.int64) for c in ("stems", "asked_starts", "asked_stems"))
        at = np.minimum(np.searchsorted(stems, wanted), len(stems) - 1)
        whole = np.flatnonzero(np.logical_and.reduceat(stems[at] == wanted, first[:-1]))
        sizes = np.diff(starts)
        asked = sorted((sorted(at[first[a] : first[a + 1]], key=lambda x: -sizes[x]), a) for a in whole)
        dense, of = np.zeros(len(r["ids"])), None
        for (most, *others), a in asked:
            one = slice(starts[most], starts[most + 1])
            found, score = documents[one], weights[one]
            if others:
                if most != of:  # queries with the same most frequent stem come one after another
                    dense[:], of = 0, most
                    dense[found] = score
                rarest = slice(starts[others[-1]], starts[others[-1] + 1])
                found, score = documents[rarest], weights[rarest]
                score, kept = score + dense[found], dense[found] > 0
                found, score = found[kept], score[kept]
                for x in others[:-1]:
                    one = slice(starts[x], starts[x + 1])
                    place = np.minimum(np.searchsorted(documents[one], found), sizes[x] - 1)
                    kept = documents[one][place] == found
                    found, score = found[kept], score[kept] + weights[one][place[kept]]
            score = np.floor(score / (1 + len(others)) * 1e6 + 0.5) / 1e6
            if k is not None:
                kept = score >= least[a]
                found, score = found[kept], score[kept]
                if len(found) >= k:
                    least[a] = last = np.partition(score, -k)[-k]
                    kept = score > last
                    kept[np.flatnonzero(score == last)[: k - kept.sum()]] = True  # the newest, as documents are in order
                    found, score = found[kept], score[kept]
            if len(found):
                yield a, found, score

    def rows(r: dict, some: list) -> pa.RecordBatch:
        nos, ids, newest = np.frombuffer(r["nos"], dtype=np.int64), pa.array(r["ids"], id_type), pa.array(r["newest"], newest_type)
        found = pa.array(np.concatenate([x for _, x, _ in some]))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(nos[[a for a, _, _ in some]], [len(x) for _, x, _ in some])), ids.take(found), newest.take(found), pa.array(np.concatenate([x for _, _, x in some]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {}
        for batch in batches:
            for at in range(len(batch)):
                r = batch.slice(at, 1).to_pylist()[0]
                floor = least.setdefault(r["part"], np.full(len(r["nos"]) // 8, -np.inf))
                some, n = [], 0
                for hit in hits(r, floor):
                    some.append(hit)
                    n += len(hit[1])
                    if n >= 100_000:
                        yield rows(r, some)
                        some, n = [], 0
                if some:
                    yield rows(r, some)

    return run


def keyword_search(corpus: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    """R5, R6, K2. Texts that hold all stems of a query, or the query itself whatever the case: query_id, id, score, distance, rank.

    Equal queries are asked once. Both branches ask the distinct words of the corpus first, so that stems are worked out, and n-grams matched, once a word and not once a
    text; only the words found are then looked for in the texts. Their stems go into blocks of postings, which meet all queries; what leaves a task are the k best of
    each query and block, so neither texts nor pairs of queries and texts are shuffled. A text with all stems has 0.5 or more, so only queries with less than k such texts are looked for as they are: one
    within one word is answered by the words alone; of a longer one, its rarest word gives the candidates, and their texts are searched. No text meets a query that it shares no word with.

    The score is the mean of tf / (tf + 1) over the query's stems, 0.05 at least where the query stands in the
    text as it is. Stop words don't count; a query of stop words alone is looked for as it is. Ties go to
    the newest, if the corpus has created_at, then by id.
    """
    dated, kinds = "created_at" in corpus.columns, dict(corpus.dtypes)
    newest = F.lit(0).cast("long") if not dated else F.unix_micros("created_at") if kinds["created_at"] == "timestamp" else F.col("created_at")
    corpus = corpus.select("id", "text", newest.alias("newest"))
    unique = corpus.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    kind = f"no long, id {kinds['id']}, newest {dict(corpus.dtypes)['newest']}, score double"
    id_type, newest_type = (to_arrow_schema(corpus.schema).field(c).type for c in ("id", "newest"))
    q = queries.select("query_id", F.lower(F.regexp_replace("query", f"^{BLANKS}|{BLANKS}$", "")).alias("asked"))
    q = stored(q.filter("asked <> ''"))
    asked = stored(q.select("asked").distinct().withColumn("no", F.monotonically_increasing_id()))
    runs = corpus.select("id", "newest", F.explode(_runs(F.col("text"))).alias("word"))
    vocabulary = stored(runs.groupBy("word").agg(F.count("*").alias("uses")))

    words = asked.select("no", F.explode(F.array_distinct(tokens(F.col("asked")))).alias("word")).filter(~F.col("word").isin(STEM_STOP_WORDS))
    stems = stored(words.join(stemmed(words.select("word").distinct()), "word").select("no", "stem").distinct())
    numbers = stored(stems.select("stem").distinct().withColumn("number", F.monotonically_increasing_id()))
    by_stem = stored(_stem_words(vocabulary, stems).join(numbers, "stem").select("word", F.col("number").alias("stem")))
    few = by_stem.count() <= WORDS
    rows = corpus.select("id", "newest", F.explode(tokens(F.col("text"))).alias("word")).join(F.broadcast(by_stem) if few else by_stem, "word").select("id", "newest", "stem")
    if not unique or not few:  # else the rows of a document are together, as it was read
        rows = rows.repartition("id").sortWithinPartitions("id", F.desc("newest"))
    blocks = rows.mapInArrow(_postings(id_type, newest_type), f"ids array<{kinds['id']}>, newest array<{dict(corpus.dtypes)['newest']}>, stems binary, starts binary, documents binary, weights binary, one long")
    n = asked.count()
    lists = stems.join(numbers, "stem").groupBy("no").agg(F.collect_list("number").alias("stems"))
    lists = lists.repartition(-(-max(1, n) // KEYWORD_BLOCK)).mapInArrow(_asked_stems, "nos binary, asked_starts binary, asked_stems binary, one long").withColumn("part", F.monotonically_increasing_id())
    met = _meet(blocks, lists, F.octet_length("nos") + F.octet_length("asked_starts") + F.octet_length("asked_stems"))
    hits = met.select("part", "ids", "newest", "stems", "starts", "documents", "weights", "nos", "asked_starts", "asked_stems").mapInArrow(_keyword_hits(k, id_type, newest_type), kind)
    if k is not None:
        place = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.col("newest").desc_nulls_last(), "id"))
        hits = hits.withColumn("place", place).filter(F.col("place") <= k).drop("place")
    hits = stored(hits)

    # Parts of a query, with a border wherever it goes on.
    short = asked if k is None else asked.join(hits.groupBy("no").agg(F.count("*").alias("n")).filter(F.col("n") >= k), "no", "left_anti")
    split = short.select("no", F.split("asked", BLANKS).alias("parts")).select("no", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "part"))
    pattern = F.concat(F.when(F.col("i") > 0, BORDER).otherwise(""), "part", F.when(F.col("i") + 1 < F.col("n"), BORDER).otherwise(""))
    parts = stored(split.select("no", "n", "i", pattern.alias("pattern")))
    by_part = stored(_part_words(vocabulary, parts.select("pattern").distinct()))
    weights = by_part.groupBy("pattern").agg(F.sum("uses").alias("uses"))
    least = parts.join(weights, "pattern").groupBy("no", "n").agg(F.count("*").alias("found"), F.min(F.struct("uses", "i", "pattern"))["pattern"].alias("pattern")).filter("found = n")
    asked_words = stored(least.join(by_part.select("pattern", "word"), "pattern").select("no", "n", "word"))
    wanted = stored(asked_words.select("word").distinct())
    postings = runs.join(F.broadcast(wanted) if wanted.count() <= WORDS else wanted, "word", "left_semi").select("id", "word").distinct()
    near = postings.join(asked_words, "word").select("no", "id", "n").distinct()
    # A text meets all its queries at once.
    to_search = near.filter("n > 1").join(asked, "no").groupBy("id").agg(F.collect_list(F.struct("no", "asked")).alias("list"))
    texts = corpus.select("id", F.lower("text").alias("text")).join(to_search.hint("shuffle_hash"), "id")
    long = texts.select("id", F.explode(F.filter("list", lambda x: F.contains(F.col("text"), x["asked"]))["no"]).alias("no"))
    exact = near.filter("n = 1").select("no", "id").unionByName(long).distinct().withColumn("part_score", F.lit(0.05))

    # Of a text that is there more than once, each row counts.
    both = hits.select("no", "id", F.col("score").alias("stem_score")).join(exact, ["no", "id"], "full_outer")
    both = both.select("no", "id", F.coalesce("stem_score", "part_score").alias("score")).join(corpus.select("id", "newest"), "id")
    found = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.col("newest").desc_nulls_last(), "id"))
    both = both.withColumn("rank", found).withColumn("distance", F.greatest(F.lit(0.0), 1 - F.col("score")))
    both = both if k is None else both.filter(F.col("rank") <= k)
    return q.join(asked, "asked").join(both, "no").select("query_id", "id", "score", "distance", "rank")


def candidates(limit: int, offset: int = 0, override: int | None = None) -> int:
    """K3. Rows that each branch gives to a fusion."""
    return min(500, override or limit + offset)


def fuse(vector: DataFrame, keyword: DataFrame, k: int, method: str = "weighted", weights: tuple[float, float] = (0.5, 0.5), threshold: float = 0.0, rrf_k: int = 60) -> DataFrame:
    """R7-R9, J6, U7. Full outer join of two ranked branches: query_id, id, score, sources, rank.

    ``weighted`` scales the weights to sum 1, tests the threshold on both branches and on the sum; ``rrf``
    sums weight / (60 + rank). A branch of weight 0 isn't planned.
    """
    wv, wk = weights
    side = lambda df, name: df.filter(F.col("score") >= threshold if method == "weighted" else F.lit(True)).select("query_id", "id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))
    if not wk:
        both = side(vector, "vector").withColumns({"keyword_score": F.lit(None).cast("double"), "keyword_rank": F.lit(None).cast("int")})
    elif not wv:
        both = side(keyword, "keyword").withColumns({"vector_score": F.lit(None).cast("double"), "vector_rank": F.lit(None).cast("int")})
    else:
        both = side(vector, "vector").join(side(keyword, "keyword"), ["query_id", "id"], "full_outer")
    if method == "weighted":
        score = wv / (wv + wk) * F.coalesce("vector_score", F.lit(0.0)) + wk / (wv + wk) * F.coalesce("keyword_score", F.lit(0.0))
    else:
        score = F.coalesce(wv / (rrf_k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(wk / (rrf_k + F.col("keyword_rank")), F.lit(0.0))
    sources = F.concat_ws(",", F.when(F.col("keyword_rank").isNotNull(), "keyword"), F.when(F.col("vector_rank").isNotNull(), "vector"))
    rows = both.select("query_id", "id", F.round(score, 8).alias("score"), sources.alias("sources"))
    return ranked(rows.filter(F.col("score") >= threshold) if method == "weighted" and threshold else rows, k)


def rerank(hits: DataFrame, queries: DataFrame, corpus: DataFrame, boost: Column) -> DataFrame:
    """R12. Adds a boost to the scores, from columns query and text, and ranks anew; boosts chain. A hit without a text keeps its score.

    Only texts of hits are shuffled: the ids of up to IDS hits are broadcast.
    """
    hits = stored(hits)
    ids = stored(hits.select("id").distinct())
    texts = corpus.select("id", "text").join(F.broadcast(ids) if ids.count() <= IDS else ids, "id", "left_semi")
    rows = hits.drop("rank").join(queries.select("query_id", "query"), "query_id", "left").join(texts, "id", "left")
    return ranked(rows.withColumn("score", F.round(F.col("score") + boost, 8)).drop("query", "text"))


def exact_boost(amount: float = 0.1) -> Column:
    """R10. For texts that contain the query."""
    return F.when((F.trim("query") != "") & F.contains(F.lower("text"), F.lower(F.trim("query"))), amount).otherwise(0.0)


def overlap_boost(weight: float = 1.0) -> Column:
    """R11. The share of the query's distinct words that the text has."""
    q = F.array_distinct(tokens(F.col("query")))
    return F.when(F.size(q) > 0, weight * F.size(F.array_intersect(q, tokens(F.col("text")))) / F.size(q)).otherwise(0.0)


def rewrite(queries: DataFrame) -> DataFrame:
    """R13. Adds normalized, expanded (with synonyms of its words) and keyword (without stop words, if any are left)."""
    norm = F.trim(F.regexp_replace(F.lower("query"), r"\s+", " "))
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    words = F.split("normalized", " ")
    extra = F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.map_contains_key(table, w)), lambda w: F.split(F.element_at(table, w), " "))))
    kept = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return queries.withColumn("normalized", norm).withColumns({
        "expanded": F.when(F.size(extra) > 0, F.concat_ws(" ", "normalized", F.array_join(extra, " "))).otherwise(F.col("normalized")),
        "keyword": F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.col("normalized")),
    })


def variants(rewritten: DataFrame) -> DataFrame:
    """R14, W3. One row for each different form of a query, topics (array) included: query_id, variant, query."""
    forms = F.array_distinct(F.filter(F.concat(F.array(F.trim("query"), "expanded", "keyword"), F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.concat_ws(" ", F.trim("query"), t))), lambda x: F.trim(x) != ""))
    return rewritten.select("query_id", F.posexplode(forms).alias("variant", "form")).select("query_id", "variant", F.col("form").alias("query"))


def fuse_lists(lists: DataFrame, k: int, offset: int = 0, rrf_k: int = 60) -> DataFrame:
    """R15, U2, U7. Lists (query_id, variant, source, id, rank) -> one list by the sum of 1 / (60 + rank), with the number of lists and the sources that had it; the offset counts once, after it."""
    sources = F.array_join(F.array_sort(F.collect_set("source")), ",")
    rows = lists.groupBy("query_id", "id").agg(F.round(F.sum(1 / (rrf_k + F.col("rank"))), 8).alias("score"), F.count("*").alias("lists"), sources.alias("sources"))
    return ranked(rows, k, offset)


def union_first(lists: DataFrame, k: int) -> DataFrame:
    """U1. First-seen ids over lists in order of variant, then rank; k for each query."""
    first = lists.groupBy("query_id", "id").agg(F.min(F.struct("variant", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id"))
    return first.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "id", "place")


def _measures(judged: DataFrame, totals: DataFrame, queries: DataFrame, strategies: list[str], ks: tuple[int, ...]) -> DataFrame:
    """Hits (strategy, query_id, rank, relevant) and relevant rows of each query (query_id, total) -> the measures of each strategy and query, zero where it has no hits."""
    per = judged.groupBy("strategy", "query_id").agg(F.count("*").alias("retrieved"), F.count_if("relevant").alias("shared"), *[F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias(f"at{k}") for k in ks])
    grid = queries.select("query_id", F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"))
    rows = grid.join(per, ["strategy", "query_id"], "left").join(totals, "query_id", "left").fillna(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select("strategy", "query_id", share("shared", "total").alias("recall"), share("shared", "retrieved").alias("precision"), *[(F.col(f"at{k}") > 0).alias(f"hit{k}") for k in ks])


def evaluate(hits: DataFrame, qrels: DataFrame, queries: DataFrame, strategies: list[str], ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """A16, R16-R18. hits (strategy, query_id, id, rank), qrels (query_id, id) -> recall, precision and hit@k for each strategy and query."""
    pairs = qrels.distinct()
    judged = hits.join(pairs.withColumn("relevant", F.lit(True)), ["query_id", "id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    return _measures(judged, pairs.groupBy("query_id").agg(F.count("*").alias("total")), queries, strategies, ks)


def relevant_rows(classes: DataFrame, queries: DataFrame, cells: int = 64) -> DataFrame:
    """S9. classes (id, label), queries (query_id, label) -> query_id, id: every row of a query's class, itself included. A class is dealt over cells by id, as labels are few."""
    dealt = classes.select("id", "label").withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)))
    asked = queries.select("query_id", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"))
    return dealt.join(asked, ["label", "cell"]).select("query_id", "id")


def class_sizes(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """classes (id, label), queries (query_id, label) -> query_id, label, total: a row for each query, with the number of rows of its class."""
    sizes = classes.select("id", "label").distinct().groupBy("label").agg(F.count("*").alias("total"))
    return queries.select("query_id", "label").join(sizes, "label", "left").fillna(0, ["total"])


def evaluate_by_class(hits: DataFrame, classes: DataFrame, queries: DataFrame, strategies: list[str], ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """A16, R16-R18, where what is relevant are the rows of a query's class: hits meet classes by id, so no list of relevant pairs is made."""
    own = queries.select("query_id", F.col("label").alias("wanted"))
    found = hits.join(classes.select("id", "label").distinct(), "id", "left").join(own, "query_id", "left")
    judged = found.groupBy("strategy", "query_id", "id", "rank").agg(F.coalesce(F.bool_or(F.col("label") == F.col("wanted")), F.lit(False)).alias("relevant"))
    return _measures(judged, class_sizes(classes, queries).select("query_id", "total"), queries, strategies, ks)


def by_category(evaluation: DataFrame, categories: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """R18. Means for each strategy and category of query (query_id, category)."""
    rows = evaluation.join(categories.select("query_id", "category"), "query_id")
    return rows.groupBy("strategy", "category").agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), *[F.avg(F.col(f"hit{k}").cast("int")).alias(f"hit{k}") for k in ks])


def compare(evaluation: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """A17, R19. Means for each strategy."""
    return evaluation.groupBy("strategy").agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), *[F.avg(F.col(f"hit{k}").cast("int")).alias(f"hit{k}") for k in ks])


def best(comparison: DataFrame) -> DataFrame:
    """K9. The strategy with the best recall, then hit@5, then hit@10, then name."""
    return comparison.orderBy(F.desc("recall"), F.desc("hit5"), F.desc("hit10"), "strategy").limit(1)


def by_document(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """R20, K6. Hits grouped by document: query_id, document_id, children (ids by score), hits, top_score, rank."""
    doc = F.coalesce(F.nullif(F.trim("document_id"), F.lit("")), F.lit("(unknown)"))
    rows = hits.join(corpus.select("id", doc.alias("document_id")), "id")
    per = rows.groupBy("query_id", "document_id").agg(F.count("*").alias("hits"), F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("c"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
    return per.select("query_id", "document_id", "hits", F.col("score").alias("top_score"), F.array_join(F.transform("c", lambda x: x["id"].cast("string")), ",").alias("children"), F.row_number().over(order).alias("rank"))


def snippet(text: Column, n: int = 160) -> Column:
    """R21. The first n characters, an ellipsis where more follows; blanks collapsed."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def context_line(*parts: tuple[str, Column]) -> Column:
    """R21, R22. ``label: value`` of the parts that aren't blank, joined."""
    return F.concat_ws(" | ", *[F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in parts])


def debug_counts(vector: DataFrame, keyword: DataFrame, fused: DataFrame) -> DataFrame:
    """R23. Rows of each branch and of the fusion for each query."""
    n = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    return n(vector, "vector_rows").join(n(keyword, "keyword_rows"), "query_id", "full_outer").join(n(fused, "fused_rows"), "query_id", "full_outer").fillna(0)
