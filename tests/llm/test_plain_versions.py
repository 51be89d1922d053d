"""Registered queries against plain versions that share no code with the operators."""

import hashlib
import re

import pytest

from sparkloom.llm import queries


def documents(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def sentences(line):
    """Ends of sentences: . ! ? and closing marks before white space."""
    i, out = 0, []
    while i < len(line):
        if line[i] in ".!?":
            j = i
            while j < len(line) and line[j] in ".!?":
                j += 1
            while j < len(line) and line[j] in "\"')]»”":
                j += 1
            if j < len(line) and line[j].isspace():
                out.append(j)
            i = max(j, i + 1)
        else:
            i += 1
    return out


def plain_units(text):
    at, out = 0, []
    for line in re.split(r"[\n\r]", text):
        if len(line.split()) >= 3:
            out.append((at, at + len(line)))
        cuts, begin = [], 0
        for e in sentences(line):
            if len(line[begin:e].split()) >= 5:
                cuts.append((begin, e))
                begin = e
        if cuts and begin < len(line):
            cuts.append((begin, len(line)))
        if len(cuts) > 1:
            out += [(at + a, at + b) for a, b in cuts if len(line[a:b].split()) >= 5]
        at += len(line) + 1
    return [(a, b, " ".join(text[a:b].lower().split())) for a, b in out]


def test_op7_equals_a_plain_version(spark, sf):
    texts = documents(spark, sf)
    first = {}
    for d in sorted(texts):
        for a, b, unit in sorted(plain_units(texts[d])):
            first.setdefault(unit, (d, a, b))
    got = {r.doc_id: r for r in queries.op7_substring_dedup(spark, sf).collect()}
    assert set(got) == set(texts) and any(r.n_removed for r in got.values())
    for d, text in texts.items():
        gone = set()
        for a, b, unit in plain_units(text):
            if first[unit] != (d, a, b):
                gone |= set(range(a, b))
        spans = [tuple(map(int, s.split("-"))) for s in got[d].removed.split()]
        assert {i for a, b in spans for i in range(a, b)} == gone and got[d].n_removed_chars == len(gone)
        assert "".join(c for i, c in enumerate(text) if i not in gone).replace("\n", "") == got[d].text.replace("\n", "")


def test_op9_equals_the_library_on_the_table(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    theirs = tokenizers.Tokenizer.from_file(queries.vocabulary())
    got = {r.doc_id: r for r in queries.op9_bpe(spark, sf).collect()}
    for d, text in documents(spark, sf).items():
        ids = theirs.encode(text, add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        back = theirs.decode(ids, skip_special_tokens=False)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_op1_equals_all_pairs_on_the_table(spark, sf):
    texts = documents(spark, sf)
    sets = {}
    for d, text in texts.items():
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
        sets[d] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())
    up = {d: d for d in texts}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op1_minhash_near_dup(spark, sf).collect()}
    assert got == {d: (len(sets[d]), root(d), root(d) == d) for d in texts}
