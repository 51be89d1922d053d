"""The whole pipeline against a plain Python version of its five stages."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sparkloom.llm import _text, bpe, language, queries, substring_dedup


def known_language(docs):
    train = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 and d["lang"] is not None]
    labels = sorted({d["lang"] for d in train})
    counts = {k: np.full(language.BUCKETS, 0.5) for k in labels}
    for d in train:
        np.add.at(counts[d["lang"]], language.grams([d["text"]])[0], 1)
    prior = Counter(d["lang"] for d in train)
    out = []
    for d in docs:
        buckets, _, letters = language.grams([d["text"]])
        if letters[0]:
            logs = np.array([np.log(prior[k] / len(train)) + np.log(counts[k] / counts[k].sum())[buckets].sum() for k in labels])
            score = 1 / np.exp(logs - logs.max()).sum()
            if score >= corpus_pipeline.LEAST_SCORE:
                out.append(d | {"lang": d["lang"] or labels[int(logs.argmax())]})
    return out


def one_of_each(docs, k=5):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets, up = {d["doc_id"]: shingles(d["text"]) for d in docs}, {d["doc_id"]: d["doc_id"] for d in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [d for d in docs if root(d["doc_id"]) == d["doc_id"]]


def without_repeats(docs):
    first = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        for a, b, digest, _ in sorted(substring_dedup.units(d["text"] or "")):
            first.setdefault(digest, (d["doc_id"], a, b))
    out = []
    for d in docs:
        text = d["text"] or ""
        gone = {(a, b) for a, b, digest, _ in substring_dedup.units(text) if first[digest] != (d["doc_id"], a, b)}
        drop = {i for a, b in gone for i in range(a, b)}
        for i, ch in enumerate(text):  # the line end of a line that is gone as a whole
            if ch == "\n" and i - 1 in drop:
                start = i - 1
                while start in drop:
                    start -= 1
                if start < 0 or text[start] == "\n":
                    drop.add(i)
        left = "".join(ch for i, ch in enumerate(text) if i not in drop)
        if not gone or left.strip():
            out.append(d | {"text": left})
    return out


def mixed(docs):
    size = lambda d: len((d["text"] or "").encode().split())
    names = sorted({d["source"] for d in docs})
    total = {s: sum(size(d) for d in docs if d["source"] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, active, left = {}, set(names), sum(total.values())
    while active:
        share = {s: left * weight[s] / sum(weight[x] for x in active) for s in active}
        over = {s for s in active if share[s] > 3 * total[s]}
        target |= {s: 3 * total[s] for s in over} if over else share
        left -= sum(3 * total[s] for s in over)
        active = active - over if over else set()
    out = []
    for s in names:
        rank = lambda d: hashlib.md5(f"mix-1:{d['doc_id']}".encode()).hexdigest()
        whole, at = int(target[s] // total[s]), 0
        for d in sorted((d for d in docs if d["source"] == s), key=lambda d: (rank(d)[11:13], rank(d), d["doc_id"])):
            at += size(d)
            more = at - size(d) / 2 < target[s] - whole * total[s] and whole < 3
            out += [d] * (whole + more)
    return out


def test_pipeline_equals_plain_python(spark, sf):
    pytest.importorskip("public_tokenizers")
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    codec = bpe.Codec(open(queries.vocabulary(), encoding="utf-8").read())
    want = Counter()
    for d in mixed(without_repeats(one_of_each(known_language(docs)))):
        ids = codec.encode(d["text"] or "")
        want[d["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_workers_give_back_what_arrow_keeps():
    texts = pa.array([f"{i} " + "some words of a text " * 50 for i in range(4000)])

    def run(batches):
        for batch in batches:
            for _, part in _text.stretches(batch.column(0)):
                assert len(part) <= 256 and sum(map(len, part)) <= 250_000
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], names=["text"])

    calls = []
    pool = type("Pool", (), {"release_unused": lambda self: calls.append(1)})()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(_text.pa, "default_memory_pool", lambda: pool)
        out = list(_text.freed(run)(iter([pa.RecordBatch.from_arrays([texts], names=["text"])] * 2)))
    assert len(calls) == 3 and [x.decode() for b in out for x in b.column(0).to_pylist()] == texts.to_pylist() * 2
