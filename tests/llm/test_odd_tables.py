"""Every query and the pipeline over tables that are empty, or hold nulls in every column and repeated rows."""

import pytest

import corpus_pipeline
from sparkloom.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"
TABLES = {"documents": DOCS, "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string, part int, edge string"}
ROWS = {
    "documents": [(None, None, None, None, None, None), (None, "some text without an id", "en", None, 5, 1), (1, "some text without an id", None, "a", 5, 1), (1, "some text without an id", None, "a", 5, 1), (2, "", "fr", "a", 0, 1), (3, "le texte est là", "fr", "b", 9, 1), (4, "other words of another text", "en", "b", 9, 1)],
    "embeddings": [(None, None, None), (None, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (51, [0.5, 0.0], None), (100, [0.0, 2.0], 1), (101, [], 1)],
    "pages": [(None, None, None), (None, "http://a.b/c", "<p>x"), (1, "http://a.b/c", "<article><p>y"), (1, "http://a.b/c", "<article><p>y"), (2, "::", "")],
    "conversations": [(None, None, None, None, None, None), (None, 1, "user", "Hi.", 1, ""), (1, 1, "user", "Hi.", 1, ""), (1, 1, "user", "Hi.", 1, ""), (1, None, "", "x", 1, ""), (2, 0, "other", "", 1, None)],
}


def folder(spark, tmp_path, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_empty(spark, tmp_path):
    place = folder(spark, tmp_path, {})
    for name, query in queries.queries().items():
        assert query(spark, place).count() == 0, name
    assert corpus_pipeline.run(spark, place).count() == 0


def test_nulls_and_repeats(spark, tmp_path):
    place = folder(spark, tmp_path, ROWS)
    counts = {name: query(spark, place).count() for name, query in queries.queries().items()}
    documents, vectors, pages = (len(ROWS[t]) for t in ("documents", "embeddings", "pages"))
    others = {"op2_exact_top_k", "op4_embedding_near_dup", "op5_html_text", "op11_url_filter", "op13_turn_repair"}
    assert {n: c for n, c in counts.items() if n not in others} == dict.fromkeys(set(counts) - others, documents)
    assert counts["op4_embedding_near_dup"] == vectors and counts["op5_html_text"] == pages == counts["op11_url_filter"] and counts["op2_exact_top_k"] > 0
    assert counts["op13_turn_repair"] == len({r[0] for r in ROWS["conversations"]})
    best = [tuple(r) for r in queries.op2_exact_top_k(spark, place).orderBy("query_id", "rank").select("query_id", "rank", "vec_id", "score").collect()]
    assert best == [(50, 1, 51, 32768), (50, 2, 100, 0), (100, 1, 50, 0), (100, 2, 50, 0), (100, 3, 51, 0)]
    links = sorted(map(str, (tuple(r) for r in queries.op4_embedding_near_dup(spark, place).select("vec_id", "n_links", "component_id", "kept").collect())))
    assert links == sorted(map(str, [(None, 0, None, True), (None, 2, 50, False), (50, 2, 50, True), (50, 2, 50, True), (51, 0, 51, True), (100, 0, 100, True), (101, 0, 101, True)]))
    texts = sorted((str(r.page_id), r.text, r.n_chars) for r in queries.op5_html_text(spark, place).collect())
    assert texts == [("1", "y", 1), ("1", "y", 1), ("2", "", 0), ("None", "", 0), ("None", "x", 1)]
    sizes = sorted((str(r.doc_id), r.size, r.source_size) for r in queries.op3_mix_sources(spark, place).collect())
    assert sizes == [("1", 5, 10), ("1", 5, 10), ("2", 0, 10), ("3", 4, 9), ("4", 5, 9), ("None", 0, 5), ("None", 5, 5)]
    first = queries.op1_minhash_near_dup(spark, place).filter("n_shingles = 0").collect()
    assert all(r.component_id == r.doc_id and r.kept for r in first)
    assert corpus_pipeline.run(spark, place).count() > 0


def test_values_of_odd_rows(spark, tmp_path):
    """What each query gives for the rows of ``ROWS``, by plain versions of the operators."""
    import hashlib

    import test_shards
    import test_urls_runs_turns as plain

    place = folder(spark, tmp_path, ROWS)
    docs = [(r[0], r[1]) for r in ROWS["documents"]]
    asked = lambda name: getattr(queries, name)(spark, place).collect()
    assert test_shards.derived(queries.op6_shard(spark, place)) == test_shards.plain(docs)
    assert sorted((str(r.doc_id), r.n_removed, r.text or "") for r in asked("op7_substring_dedup")) == sorted(
        (str(i), int(i == 1), "" if i == 1 else t or "") for i, t in docs
    )  # the text without an id is the earliest, its two copies lose it
    assert all(r.lang_pred == "und" and r.score == 0 for r in asked("op8_language_id") if not any(c.isalpha() for c in dict(docs).get(r.doc_id) or "x"))
    empty = hashlib.sha256(b"").hexdigest()
    for r in asked("op9_bpe"):
        text = [t for i, t in docs if i == r.doc_id]
        assert r.decoded_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for t in text} and (r.n_tokens == 0) == (r.ids_sha256 == empty)
    got = asked("op10_lm_score")
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len((t or "").split()) + 1) for i, t in docs) and len({r.train_tokens for r in got}) == 1
    assert sorted(map(str, map(tuple, asked("op12_periodic_runs")))) == sorted(str(plain.plain_op12(i, t)) for i, t in docs)
    urls = [r[1] for r in ROWS["pages"]]
    want = sorted(str((p[0], *x[:4])) for p, x in zip(ROWS["pages"], plain.plain_judge(urls), strict=True))
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in asked("op11_url_filter")) == want
    assert plain.rows_of(queries.op13_turn_repair(spark, place)) == plain.plain_op13([r[:4] for r in ROWS["conversations"]])


@pytest.mark.parametrize("name", ["documents", "embeddings", "pages"])
def test_one_row(spark, tmp_path, name):
    rows = {"documents": [(7, "one row of text", "en", "a", 15, 0)], "embeddings": [(50, [1.0, 2.0], 1)], "pages": [(1, "http://h/", "<main>text</main>")]}
    place = folder(spark, tmp_path, {name: rows[name]})
    want = {"documents": ("op1", "op3", "op6", "op7", "op8", "op9", "op10"), "embeddings": ("op4",), "pages": ("op5",)}[name]
    for n, query in queries.queries().items():
        if n.split("_")[0] in want:
            assert query(spark, place).count() == 1, n


def test_texts_without_an_id_or_with_a_shared_one_stay(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(20)) + "." for w in ("alpha", "beta", "gamma", "delta"))
    near = four.replace("delta19.", "delta19 more.")
    rows = [(None, one), (None, one), (None, two), (None, three), (5, three), (5, four), (5, four), (5, f"{two} tail of its own"), (9, near), (None, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 1) for i, t in rows], DOCS)
    stay = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
    got = [(r.doc_id, r.text) for r in stay.collect()]
    assert stay.columns == docs.columns and len(got) == len(set(got)) == 6
    assert {(None, one), (None, None), (7, "")} <= set(got) and sum(t == three for _, t in got) == 1
    assert sum(t == four or t == near for _, t in got) == 1 and sum((t or "").startswith(two[:-1]) for _, t in got) == 1


def test_spans_of_texts_that_share_an_id(spark):
    line, other = "a line that stands in two of the texts", "words that only one of the texts has in it"
    rows = [(None, f"{other} 1\n{line}"), (None, f"x\n{line}\n{other} 2"), (5, f"{other} 3\n{line}"), (5, f"{other} 4 of the same id")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 1) for i, t in rows], DOCS)
    got = [r.text for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()]
    assert sum(line in t for t in got) == 1 and all(sum(f"{other} {i}" in t for t in got) == 1 for i in (1, 2, 3, 4))


def test_stages_leave_other_columns_alone(spark):
    names = ["size", "source_size", "target", "copies", "taken", "score", "lang_pred", "removed", "n_removed_chars"]
    text = "the quick brown fox jumps over the lazy dog and runs away from all of them again"
    rows = [(i, f"{text} {i * 7919} {'xyz'[i % 3]} number {i}", "en", "ab"[i % 2], 1, *(f"{n}{i}" for n in names)) for i in range(1, 12)]
    docs = spark.createDataFrame(rows, DOCS.replace("extra int", ", ".join(f"{n} string" for n in names)))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names), name


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from sparkloom.llm import _store

    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        _store.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_more_labels_than_a_model_takes(spark):
    from sparkloom.llm import language

    words = ["".join(chr(97 + (i * k) % 26) for k in range(1, 9)) for i in range(40)]
    rows = spark.createDataFrame([(f"{w} {w[::-1]} word {i % 3}", f"l{i:02d}") for i, w in enumerate(words)] * 2, "text string, lang string")
    docs = spark.createDataFrame([(i, f"{w} word", "own") for i, w in enumerate([*words, "", "12", "word word"])] + [(None, None, "own")], "doc_id long, text string, _tag_best string")
    one = language.train(rows)
    whole = sorted(map(str, language.tag(docs, one).collect()))
    assert one.labels == [f"l{i:02d}" for i in range(40)] and one.more == ()
    for most in (1, 7, 39):
        cut = language.train(rows, max_labels=most)
        assert sum((m.labels for m in (cut, *cut.more)), []) == one.labels and len(cut.labels) == most
        got = language.tag(docs, cut)
        assert got.columns == ["doc_id", "text", "_tag_best", "lang_pred", "score"]
        flat = lambda rows_: sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in rows_)
        assert flat(got.collect()) == flat(language.tag(docs, one).collect()) and len(whole) == len(words) + 4


def test_equal_labels_go_to_the_first(spark):
    from sparkloom.llm import language

    rows = spark.createDataFrame([("same text here", x) for x in "bca"], "text string, lang string")
    docs = spark.createDataFrame([(1, "same text")], "doc_id long, text string")
    for most in (1, 2, 9):
        r = language.predict(docs, language.train(rows, max_labels=most)).first()
        assert r.lang_pred == "a" and abs(r.score - 1 / 3) < 1e-9


def test_language_equals_plain_counts(spark, sf):
    """Labels and scores by dictionaries of n-gram buckets, worked out character by character."""
    import zlib
    from collections import Counter

    import numpy as np

    from sparkloom.llm import language

    def buckets(text):
        out, line = [], []
        for ch in " " + (text or "").lower() + " ":
            ch = ch if ch.isalpha() else " "
            if ch != " " or not line or line[-1] != " ":
                line.append(ch)
        p = [ord(c) for c in line]
        wrap = lambda x: x % (1 << 32)

        def folded(h):
            return wrap((h ^ (h >> 15)) * 0x2C1B3C6D) >> 16

        two = [wrap(a * 0x9E3779B1 + b * 0x85EBCA77) for a, b in zip(p, p[1:])]
        out += [folded(h) for h in two]
        return out + [folded(wrap(wrap((h ^ (h >> 13)) * 0xC2B2AE3D) + p[i + 2] * 0x27D4EB2F + 1)) for i, h in enumerate(two[:-1])]

    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect() if len(r.text or "") < 3000]
    seen, n = {}, Counter()
    for r in docs:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            seen.setdefault(r.lang, Counter()).update(buckets(r.text))
            n[r.lang] += 1
    totals = {k: sum(c.values()) + 0.5 * (1 << 16) for k, c in seen.items()}
    table = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in docs], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.held_out_language(table).collect()}
    for r in docs:
        logs = {k: np.log(n[k] / sum(n.values())) + sum(np.log((c[b] + 0.5) / totals[k]) for b in buckets(r.text)) for k, c in seen.items()}
        best = max(sorted(logs), key=logs.get)
        letters = any(ch.isalpha() for ch in (r.text or "").lower())
        assert got[r.doc_id].lang_pred == (best if letters else "und")
        assert not letters or abs(got[r.doc_id].score - 1 / sum(np.exp(x - logs[best]) for x in logs.values())) < 1e-3
