"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

A text gets a leading U+2581, its spaces become U+2581, and adjacent symbols are merged from a score-ordered
agenda: the pair whose joined piece scores highest goes first, the leftmost on a tie, and every merge offers
its two new neighbours. Left-over characters outside the vocabulary become bytes.

No piece has U+2581 behind another character (a vocabulary with such pieces is refused), so a text is cut in front of
each run of blanks and every part has an agenda of its own: results are the same, and parts that recur (words) are
taken from a bounded cache. Agendas of short parts are rows of one matrix: a row holds the costs of its pairs, and each
round merges the best pair of every row. Long parts are cut wherever no piece reaches across, and have a heap each.

Every whole text is also encoded by the sentencepiece library within its Arrow batch and must agree, so a model
whose normaliser changes texts ends in an error; ids are decoded by the library's decode(ids).

Defined results: null text is empty; an empty text has the begin and end ids only and decodes to an empty
text; U+2581 in a text decodes to a space, as in the library; repeated rows give equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
#: Parts in each of a worker's two caches, and the longest part that is kept.
CACHE_PARTS, CACHE_CHARS = 150_000, 40
#: Parts up to these lengths share a matrix; longer ones have a heap each.
WIDTHS = (6, 9, 12, 16, 24, 41)
NEVER = np.iinfo(np.int64).max


class Codec:
    """One vocabulary, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.piece_size()
        self.begin, self.end = (np.array([i], dtype="<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.id_of = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.id_of_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece has U+2581 behind another character")
        # Costs are ranks by falling score; pieces of one score share a rank.
        scores = {p: sp.get_score(i) for p, i in self.id_of.items()}
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.cost = {p: rank[s] for p, s in scores.items()}
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # Parts used lately, and those used before them: what recurs moves back, the rest goes. A key lacks the U+2581 that its part begins with.
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.inside = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        # Tables of the matrix agenda: the id of each character, and for each pair of pieces that joins to a piece its cost and id in one number.
        self.none, single = n, {p: i for p, i in self.id_of.items() if len(p) == 1}
        single |= {chr(b): i for b, i in self.id_of_byte.items() if b < 128 and not any(chr(b) in p for p in self.id_of)}
        self.alphabet = set(single)
        self.id_of_char = np.full(0x110000, n, dtype=np.int32)
        self.id_of_char[[ord(c) for c in single]] = list(single.values())
        joins = [(self.id_of[p[:k]] * (n + 1) + self.id_of[p[k:]], self.cost[p] * (n + 1) + i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of]
        # The last key is larger than any, so that every search ends on one.
        table = np.array([*sorted(joins), (NEVER, NEVER)], dtype=np.int64)
        self.pairs, self.joined = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Cost and id of each joined piece in one number; NEVER where there is none."""
        key = left.astype(np.int64) * (self.none + 1) + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at], NEVER)

    def merged_rows(self, parts: list[str], width: int) -> np.ndarray:
        """Parts of at most ``width`` characters of the alphabet -> a row of ids each after all merges, ``none`` where a symbol went into another."""
        wide = width + 1  # the last place of a row stands for both ends
        filled = np.arange(wide) < np.array([len(p) for p in parts])[:, None]
        ids = np.full((len(parts), wide), self.none, dtype=np.int32)
        ids[filled] = self.id_of_char[np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4")]
        cost = np.full(ids.shape, NEVER)
        cost[:, :-1] = self.join(ids[:, :-1], ids[:, 1:])
        after = np.tile(np.arange(1, wide + 1), (len(parts), 1))
        after[:, -1] = width
        before = np.tile(np.arange(-1, width), (len(parts), 1))
        before[:, 0] = width
        flat_ids, flat_cost, flat_after, flat_before = (x.reshape(-1) for x in (ids, cost, after, before))
        rows = np.arange(len(parts))
        while len(rows):
            agenda = cost[rows]
            left = agenda.argmin(axis=1)
            best = agenda[np.arange(len(rows)), left]
            live = best != NEVER
            rows, left, best = rows[live], left[live], best[live]
            base = rows * wide
            right = flat_after[base + left]
            behind, ahead = flat_after[base + right], flat_before[base + left]
            flat_ids[base + left] = piece = best % (self.none + 1)
            flat_ids[base + right] = self.none
            flat_cost[base + right] = NEVER
            flat_after[base + left], flat_before[base + behind] = behind, left
            flat_cost[base + left] = self.join(piece, flat_ids[base + behind])
            flat_cost[base + ahead] = self.join(flat_ids[base + ahead], piece)
        return ids

    def merged(self, part: str) -> list[str]:
        """The symbols of one part after all merges of its agenda, a heap."""
        cost, symbols, n = self.cost, list(part), len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(cost[p], i, i + 1, p) for i in range(n - 1) if (p := part[i : i + 2]) in cost]
        heapify(agenda)
        while agenda:
            _, left, right, piece = heappop(agenda)
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, ""
            behind = after[left] = after[right]
            if behind < n:
                before[behind] = left
                if (p := piece + symbols[behind]) in cost:
                    heappush(agenda, (cost[p], left, behind, p))
            if (ahead := before[left]) >= 0 and (p := symbols[ahead] + piece) in cost:
                heappush(agenda, (cost[p], ahead, left, p))
        return [s for s in symbols if s]

    def packed(self, symbols: list[str]) -> bytes:
        ids = [i for s in symbols for i in ([self.id_of[s]] if s in self.id_of else [self.id_of_byte[b] for b in s.encode()])]
        return np.array(ids, dtype="<u4").tobytes()

    def encode_keys(self, keys: set[str]) -> dict[str, bytes]:
        """Ids of distinct parts, without the U+2581 in front, as little-endian unsigned 32-bit integers."""
        out, bands = {}, {w: [] for w in WIDTHS}
        band = [bands[next(w for w in WIDTHS if n < w)].append for n in range(WIDTHS[-1])]
        for key in keys:
            if (n := len(key)) < WIDTHS[-1] and self.alphabet.issuperset(key):
                band[n](key)
                continue
            part = SPACE + key.replace(" ", SPACE)
            cuts = [0, *(k for k in range(1, len(part)) if part[k - 1 : k + 1] not in self.inside), len(part)]
            out[key] = self.packed([s for a, b in zip(cuts, cuts[1:]) for s in self.merged(part[a:b])])
        for width, some in bands.items():
            if some:
                ids = self.merged_rows([SPACE + key.replace(" ", SPACE) for key in some], width)
                found = ids != self.none
                flat, ends = ids[found].astype("<u4").tobytes(), np.cumsum(4 * found.sum(axis=1)).tolist()
                out.update(zip(some, map(flat.__getitem__, map(slice, [0, *ends], ends))))
        return out

    def keys(self, text: str) -> list[str]:
        """The parts of a text, each without the U+2581 that it begins with."""
        if not text:
            return []
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [p[1:].replace(SPACE, " ") for p in self.parts.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text with begin and end. Every text is checked against the library."""
        split = [self.keys(t) for t in texts]
        if len(self.recent) > CACHE_PARTS:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        needed = set().union(*split).difference(recent)
        back = [p for p in needed if p in older]
        recent.update(zip(back, map(older.__getitem__, back)))
        recent.update(self.encode_keys(needed.difference(back)))
        out = [b"".join([self.begin, *map(recent.__getitem__, parts), self.end]) for parts in split]
        for p in needed:
            if len(p) > CACHE_CHARS:
                del recent[p]
        theirs = self.library.encode_as_numpy(texts, add_bos=True, add_eos=True, num_threads=1)
        for text, ids, check in zip(texts, out, theirs):
            if ids != check.astype("<u4", copy=False).tobytes():
                raise ValueError(f"the agenda and the library differ on {text[:2000]!r}")
        return out

    def decode_batch(self, packed: list[bytes]) -> list[str]:
        """The library's decode(ids) of each text."""
        return self.library.decode([np.frombuffer(x, dtype="<i4") for x in packed], num_threads=1)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker and model."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of ``text``, begin and end included, as array<int>."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for batch in batches:
            for some in slices(batch.fillna("").tolist()):
                yield pd.Series([np.frombuffer(x, dtype="<i4") for x in c.encode_batch(some)])

    return docs.withColumn(ids, F.pandas_udf(run, "array<int>")(F.col(text)))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of an id column; null ids give an empty text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for batch in batches:
            yield pd.Series(c.decode_batch([b"" if x is None else np.asarray(x, dtype="<i4").tobytes() for x in batch]), dtype=object)

    return encoded.withColumn(text, F.pandas_udf(run, "string")(F.col(ids)))


def digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The columns of ``keep``, n_tokens, ids_sha256, decoded_sha256, round_trip (whether decoding gives the text back), and the ids if asked for."""

    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            # Each slice goes out by itself, so that the ids of a whole Arrow batch are never held at once.
            for some in slices(batch.fillna("").tolist()):
                packed = c.encode_batch(some)
                rows = [
                    (len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text)
                    for text, x, decoded in zip(some, packed, c.decode_batch(packed))
                ]
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
                yield out.assign(ids=[np.frombuffer(x, dtype="<i4") for x in packed]) if with_ids else out

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(*keep, F.pandas_udf(digest, kind)("text").alias("x")).select(*keep, "x.*")


def op3_sentencepiece(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), model_path())
