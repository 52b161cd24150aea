"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans.

Fixed kinds (email, ip, card, phone) are found leftmost and non-overlapping in whole texts; matches that fail their
rule are dropped. The field labels every word with a digit or an at sign, and the words within two of such a word (others
are fixed at none). A word's own potential comes from its shape and its neighbours' forms; words side by side share a chain
potential. Similar words of a document, however far apart, are tied to one hub by a skip potential each: words are
similar if they have six or more digits, and the same last seven, or else the same six or more letters and digits whatever
the case, where an email's local part counts as well. Labels come from loopy sum-product messages, until they settle; words within fixed spans
are held at their kind, so their label reaches every similar word in two steps. Words that get a kind with a marginal
of ``SURE`` or more and touch no fixed span become added spans.

The field is fitted by pseudo-likelihood to the fixed spans of a bounded sample of documents: ``FIT_DOCS``, smallest hash
first, among those with at most ``FIT_WORDS`` words with digits or at signs and ``FIT_CHARS`` characters. Every such word takes
part twice, as itself and as a mention elsewhere among plain words, in another form (half of them with their shape hidden) and
tied to a hub of its kind, so that the skip potential learns what a known mention says about another; a part of the other
shapes is hidden, too, for the chain's sake.

Defined results: null text is empty; texts without a find have zero counts, the digest of an empty string and empty
spans; repeated rows give equal results; with nothing to learn from, no spans are added; an empty
table gives an empty result; other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
FIT_DOCS, FIT_WORDS, FIT_CHARS, FEATURES, SURE = 2000, 200, 100_000, 4096, 0.9
#: Messages count as settled at this change; a loop that doesn't settle ends after so many rounds.
SETTLED, ROUNDS, HELD, SIMILAR = 1e-3, 200, 20.0, 6

Span = tuple[int, int, int]  # start, place of the kind, end

# The patterns start where a run starts: a run that fails from its start fails from within as well.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@0-9]*+[@0-9][^\x20\x09-\x0D]*+")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: The word before and the word after a place, up to two blanks away.
BEFORE = re.compile(r"(?:^|(?<=[\x20\x09-\x0D]))([^\x20\x09-\x0D]++)[\x20\x09-\x0D]{1,2}\Z")
AFTER = re.compile(r"[\x20\x09-\x0D]{1,2}([^\x20\x09-\x0D]++)")
TRIM = ".,;:!?*$%&#|\"'<>"


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The fixed spans of a text by start, then kind as listed."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(d := x.lstrip("0")) <= 3 and int(d or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an at sign."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def nodes_of(text: str) -> tuple[list[tuple[int, int]], list[str]]:
    """The words that the field labels, and the words next to each: candidates with two words on either side."""
    spans: set[tuple[int, int]] = set()
    for a, b in candidates(text):
        spans.add((a, b))
        for _ in range(2):
            if not (m := BEFORE.search(text, max(0, a - 100), a)):
                break
            spans.add(m.span(1))
            a = m.start(1)
        for _ in range(2):
            if not (m := AFTER.match(text, b, b + 100)) or m.end(1) == b + 100 < len(text):  # words of a hundred characters are no neighbours
                break
            spans.add(m.span(1))
            b = m.end(1)
    kept = sorted(spans)
    return kept, [text[a:b] for a, b in kept]


def shape(word: str) -> list[int]:
    """Feature numbers of a word's shape."""
    digits = NOT_DIGIT.sub("", word)
    n, dots = min(len(digits), 20), min(word.count("."), 4)
    card = 14 <= len(digits) <= 19 and luhn(digits)
    parts = word.strip(".,;:!?*$%&#()").split(".")
    ip = len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) <= 255 for p in parts)
    letters, at = any(c.isalpha() for c in word), "@" in word
    seen = (f"n{n}", f"n{n}card{card}", f"at{at}dots{dots}", f"ip{ip}dots{dots}", f"plus{word[0] == '+'}n{n}", f"round{'(' in word}n{n}", f"dash{'-' in word}n{n}", f"letters{letters}at{at}n{min(n, 3)}")
    return [crc32(f.encode()) % FEATURES for f in seen]


def form(word: str, place: str) -> int:
    """The feature number of a neighbour's form: its letters, and how many digits it has."""
    return crc32(f"{place}{word.strip(TRIM).lower() if not any(c.isdigit() for c in word) else f'digits{min(len(NOT_DIGIT.sub(str(), word)), 20)}'}".encode()) % FEATURES


def features_of(words: list[str], chain: list[bool]) -> list[list[int]]:
    """Shape, and the forms of the words right before and after (chain tells whether a word is followed by the next)."""
    out = []
    for i, w in enumerate(words):
        before = words[i - 1] if i and chain[i - 1] else ""
        after = words[i + 1] if i + 1 < len(words) and chain[i] else ""
        out.append([*shape(w), form(before, "<"), form(after, ">")])
    return out


def likenesses(word: str) -> list[str]:
    """Words that have one of these in common are similar."""
    out = []
    for part in dict.fromkeys((word, word.partition("@")[0])):
        digits, plain = NOT_DIGIT.sub("", part), "".join(c for c in part.lower() if c.isalnum())
        if len(digits) >= SIMILAR:
            out.append(digits[-SIMILAR - 1 :])
        elif len(plain) >= SIMILAR:
            out.append(plain)
    return out


def hubs_of(words: list[str]) -> list[list[int]]:
    """Groups of two or more similar words of one document, each a hub of its own."""
    groups: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        for key in likenesses(w):
            groups.setdefault(key, []).append(i)
    return [g for g in groups.values() if len(g) > 1]


@dataclass
class Field:
    own: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, left to right
    skip: np.ndarray  # labels x labels, word to hub

    def marginals(self, features: np.ndarray, chain: np.ndarray, skip: np.ndarray, held: np.ndarray, hubs: int) -> np.ndarray:
        """Loopy messages over all nodes at once. features: nodes x 10; chain: pairs of nodes; skip: pairs of node and hub; held: a label for each node, or -1."""
        own = np.concatenate([self.own[features].sum(axis=1), np.zeros((hubs, len(LABELS)))])
        own[np.flatnonzero(held >= 0), held[held >= 0]] += HELD
        if not len(chain) + len(skip):
            return _softmax(own)
        skip = skip + np.array([0, len(features)])
        a = np.concatenate([chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]])
        b = np.concatenate([chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0]])
        n = len(a) // 2
        kind = np.repeat([0, 1, 2, 3], [len(chain), len(skip), len(chain), len(skip)])
        potential = np.array([self.chain, self.skip, self.chain.T, self.skip.T])[kind]
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        message = np.zeros((2 * n, len(LABELS)))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, b, message)
            rest = (belief[a] - message[back])[:, :, None] + potential
            top = rest.max(axis=1)
            new = top + np.log(np.exp(rest - top[:, None, :]).sum(axis=1))
            new = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
            moved, message = np.abs(new - message).max(), new
            if moved < SETTLED:
                break
        belief = own.copy()
        np.add.at(belief, b, message)
        return _softmax(belief)[: len(features)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pairs(x: list) -> np.ndarray:
    return np.array(x, dtype=np.int64).reshape(-1, 2)


def graph(texts: list[str], bases: list[list[Span]]):
    """Places of the nodes of each text, and features, chain, skip, held labels and number of hubs, numbered through all texts."""
    places, features, chain, skip, held, hubs = [], [], [], [], [], 0
    for text, base in zip(texts, bases):
        spans, words = nodes_of(text)
        at = len(held)
        follows = [spans[i + 1][0] - spans[i][1] <= 2 and text[spans[i][1] : spans[i + 1][0]].isspace() for i in range(len(spans) - 1)]
        chain += [(at + i, at + i + 1) for i, f in enumerate(follows) if f]
        for group in hubs_of(words):
            skip += [(at + i, hubs) for i in group]
            hubs += 1
        features += features_of(words, follows)
        held += [k - 1 if k == 0 else k for k in _gold(spans, base)]
        places.append(spans)
    return places, np.array(features, dtype=np.int64).reshape(-1, 10), _pairs(chain), _pairs(skip), np.array(held, dtype=np.int64), hubs


def _gold(spans: list[tuple[int, int]], base: list[Span]) -> list[int]:
    """The label of each word: the kind of the first fixed span that it touches, or none. Both lists are in order."""
    out, k, open_spans = [], 0, []
    for a, b in spans:
        while k < len(base) and base[k][0] < b:
            open_spans.append(base[k])
            k += 1
        open_spans = [s for s in open_spans if s[2] > a]
        out.append(open_spans[0][1] + 1 if open_spans else 0)
    return out


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_words: int = FIT_WORDS, steps: int = 200) -> Field:
    """The field that best predicts the fixed spans of a bounded sample."""
    some = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D@0-9]*[@0-9][^\\x20\\x09-\\x0D]*"))
    sample = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[@0-9]") & (F.length("text") <= FIT_CHARS)).filter(some <= fit_words)
    sample = sample.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.doc_id, b.text):
                text = text or ""
                if not 0 < len(candidates(text)) <= fit_words or len(text) > FIT_CHARS:  # another text under a sampled id
                    continue
                base = base_spans(text)
                spans, words = nodes_of(text)
                follows = [spans[i + 1][0] - spans[i][1] <= 2 and text[spans[i][1] : spans[i + 1][0]].isspace() for i in range(len(spans) - 1)]
                rows.append((doc_id, words, follows, _gold(spans, base)))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "follows", "gold"])

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInPandas(run, "doc_id long, words array<string>, follows array<boolean>, gold array<int>")
    got = found.groupBy("doc_id").agg(F.min(F.struct("words", "follows", "gold")).alias("x")).orderBy("doc_id").select("x.*").collect()
    return fit_rows([(r.words, r.follows, r.gold) for r in got], steps)


def elsewhere(word: str) -> str:
    """The form that a mention of a word takes elsewhere: an email's local part, other separators between digits."""
    return re.sub(r"[.-]", "_", word.strip(TRIM + "()").partition("@")[0]) or word


def fit_rows(rows: list[tuple[list[str], list[bool], list[int]]], steps: int = 200) -> Field:
    """Rows of words, whether each is followed by the next, and labels -> the field."""
    features, chain, skip, gold, share, hub_gold, plain = [], [], [], [], [], [], []
    for words, follows, labels in rows:
        at = len(gold)
        chain += [(at + i, at + i + 1) for i, f in enumerate(follows) if f]
        for group in hubs_of(words):
            skip += [(at + i, len(hub_gold)) for i in group]
            hub_gold.append(max(labels[i] for i in group))
        features += features_of(words, follows)
        gold += labels
        share += [0.7] * len(words)
        for w, label in zip(words, labels):
            if likenesses(w):  # the same word elsewhere, among plain words, with nothing but its mention to go by
                k = len(gold)
                skip.append((k, len(hub_gold)))
                chain += [(k + 1, k), (k, k + 2)]
                hub_gold.append(label)
                features += [[*shape(elsewhere(w)), form("", "<"), form("", ">")]] * 3
                gold += [label, 0, 0]
                share += [0.5, 0, 0]
                plain += [k + 1, k + 2]
    n = len(LABELS)
    x, y, hub = np.array(features, dtype=np.int64).reshape(-1, 10), np.array(gold, dtype=np.int64), np.array(hub_gold, dtype=np.int64)
    chain, skip = _pairs(chain), _pairs(skip)
    weights = [np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros((n, n))]
    if not len(y):
        weights[0][:, 0] = 1
        return Field(*weights)
    shown = np.random.default_rng(0).random((len(y), 1)) < np.array(share)[:, None]
    truth = np.eye(n)[y]
    speed = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    flat = np.concatenate([x[:, k] for k in range(x.shape[1])])
    for step in range(1, steps + 1):
        own, c, s = weights
        score = own[x].sum(axis=1) * shown
        np.add.at(score, chain[:, 0], c.T[y[chain[:, 1]]])
        np.add.at(score, chain[:, 1], c[y[chain[:, 0]]])
        np.add.at(score, skip[:, 0], s.T[hub[skip[:, 1]]])
        miss = truth - _softmax(score)
        miss[plain] = 0  # they only frame a mention
        grads = [np.zeros_like(w) for w in weights]
        pull = np.tile(miss * shown, (x.shape[1], 1))
        for label in range(n):
            grads[0][:, label] = np.bincount(flat, pull[:, label], minlength=FEATURES)
        grads[1] += miss[chain[:, 0]].T @ truth[chain[:, 1]] + truth[chain[:, 0]].T @ miss[chain[:, 1]]
        grads[2] += miss[skip[:, 0]].T @ np.eye(n)[hub[skip[:, 1]]]
        for w, g, (m, v) in zip(weights, grads, speed):
            g = g / len(y) - 1e-4 * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(*weights)


def added_spans(field: Field, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """For each text the spans that the field adds to the fixed ones."""
    places, *parts = graph(texts, bases)
    p = field.marginals(*parts) if any(places) else np.zeros((0, len(LABELS)))
    label, sure = p.argmax(axis=1), p.max(axis=1, initial=0)
    out, at = [], 0
    for text, spans, base in zip(texts, places, bases):
        new: list[Span] = []
        fixed = _gold(spans, base)
        last = None
        for i, (a, b) in enumerate(spans):
            kind = label[at + i] - 1
            if kind < 0 or sure[at + i] < SURE or fixed[i]:
                last = None
                continue
            word = text[a:b]
            start, end = a + len(word) - len(word.lstrip(TRIM)), b - (len(word) - len(word.rstrip(TRIM)))
            if start >= end:
                continue
            if last == (i - 1, kind) and a - spans[i - 1][1] <= 2 and kind in (2, 3):
                new[-1] = (new[-1][0], kind, end)
            else:
                new.append((start, kind, end))
            last = (i, kind)
        at += len(spans)
        out.append([(int(s), int(k), int(e)) for s, k, e in new])
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of fixed spans, base_sha256 and spans of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for texts in slices(batch.fillna("").tolist()):
                bases = [base_spans(t) for t in texts]
                for b, m in zip(bases, added_spans(sent.value, texts, bases)):
                    rows.append((*(sum(k == j for _, k, _ in b) for j in range(4)), hashlib.sha256(listed(b).encode()).hexdigest(), listed(sorted(b + m)), len(m)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", F.pandas_udf(run, kind)("text").alias("x")).select("doc_id", "x.*")


def _masked(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for s, k, e in spans:
        if s >= at:
            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """Documents with every span of ``text`` replaced by its kind in square brackets; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for texts in slices(batch.fillna("").tolist()):
                bases = [base_spans(t) for t in texts]
                out += [_masked(t, sorted(b + m)) for t, b, m in zip(texts, bases, added_spans(sent.value, texts, bases))]
            yield pd.Series(out, dtype=object).where(batch.notna().values, None)

    return docs.withColumn("text", F.pandas_udf(run, "string")("text"))


def op5_personal_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, fit(docs))
