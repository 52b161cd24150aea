"""The whole pipeline against plain Python over the smallest tables."""

import hashlib
import re
from collections import Counter
from math import log, sqrt

import numpy as np

import corpus_pipeline
from lectern.llm import personal_data, quality_classifier, sentencepiece_codec, simhash

SF = "/root/testdata/sf0.001"
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def score(model, text):
    return model.scores(np.array([quality_classifier.terms(text)]))[0]


def quality_model(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    return quality_classifier.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels.filter(~quality_classifier.held_out()))


def without_near_copies(docs):
    fps = np.array([simhash.fingerprint(d.text) for d in docs], dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    seen, out = set(), []
    for i in sorted(range(len(docs)), key=lambda k: docs[k].doc_id):
        if i in seen:
            continue
        out.append(docs[i])
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += np.flatnonzero(near[k]).tolist()
    return out


def spans_by_hand(text):
    def fits(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == 1:
            return all(int(x) <= 255 for x in s.split("."))
        return kind == 0 or (kind == 2 and 14 <= len(digits) <= 19 and personal_data.luhn(digits)) or (kind == 3 and 10 <= len(digits) <= 15)

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if fits(k, m[0]))


def redacted(spark, docs):
    field = personal_data.fit(spark.createDataFrame([(d.doc_id, d.text) for d in docs], "doc_id long, text string"))
    texts = [d.text or "" for d in docs]
    bases = [spans_by_hand(t) for t in texts]
    out = []
    for d, text, spans in zip(docs, texts, (sorted(b + m) for b, m in zip(bases, personal_data.added_spans(field, texts, bases)))):
        done, at = "", 0
        for s, k, e in spans:
            if s >= at:
                done += text[at:s] + f"[{personal_data.KINDS[k].upper()}]"
            at = max(at, e)
        out.append((d.doc_id, d.source, done + text[at:]))
    return out


def text_weight(t):
    lines, words = t.split("\n"), re.findall(r"[^\x20\x09-\x0D]+", t)
    fresh, plain = len(set(lines)) / len(lines), 1 - len(re.findall(r"[#*$%&|<>]", t)) / max(len(t), 1)
    variety = min(1.0, len(set(words)) / max(1.0, min(len(words), 2 * sqrt(len(words)))))
    return fresh * plain**4 * variety


def mixed(rows):
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, _, t in rows}
    own = Counter()
    for i, s, _ in rows:
        own[s] += sizes[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(own))}
    goal, free, left = {}, set(own), sum(own.values())
    while free:  # those above their limit stop there, the rest shares again
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * own[s]}
        if not over:
            goal |= {s: weight[s] * level for s in free}
            break
        goal |= {s: 3 * own[s] for s in over}
        left -= sum(3 * own[s] for s in over)
        free -= over

    def key(row):
        i, _, t = row
        name = f"{i}/{hashlib.md5(t.encode()).hexdigest()}"
        u = (int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return -log(u) / max(0.05, text_weight(t))

    out, upto = [], Counter()
    for row in sorted(rows, key=key):
        i, s, _ = row
        whole = int(goal[s] / own[s] + 1e-12) if own[s] else 0
        rest = goal[s] - whole * own[s]
        upto[s] += sizes[i]
        out += [row] * (whole + (rest > 1e-9 and sizes[i] > 0 and upto[s] - sizes[i] / 2 <= rest))
    return out


def test_run_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    model = quality_model(spark)
    kept = [d for d in docs if score(model, d.text) >= 0.7]
    rows = mixed(redacted(spark, without_near_copies(kept)))
    library = sentencepiece_codec.codec(sentencepiece_codec.model_path()).library
    want = Counter((i, hashlib.sha256(np.array(library.encode(t, add_bos=True, add_eos=True), dtype="<u4").tobytes()).hexdigest()) for i, _, t in rows)
    got = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
