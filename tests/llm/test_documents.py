"""Document operators against brute force on small tables, with the odd cases: nulls, blanks, long texts, ties, repeats, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, components, html_text, language, lm, mixing, near_dup, queries, sharding, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=""):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(200)]
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots([e for e in edges if e[0] != e[1]], {x for e in edges if e[0] != e[1] for x in e})
    assert got == want
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def copies(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=60) for _ in range(4)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    texts = [*copies(), None, "", " \t\n ", "one", "ONE", "One two", "x" * 50_000, "x" * 50_000 + " y", *copies(5)]
    sets = [shingle_set(t, k) for t in texts]
    want = roots([(i, j) for i in range(len(texts)) for j in range(i) if linked(sets[i], sets[j])], range(len(texts)))
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs.withColumn("rep", F.lit(1)).withColumn("n", F.lit("x")), k).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())
    assert near_dup.near_duplicates(docs.limit(0), k).count() == 0


def test_repeated_rows_are_one_document(spark):
    docs = documents(spark, ["a b c d e f g", "q r s t u v w"])
    twice = docs.unionByName(docs)
    assert near_dup.near_duplicates(twice).filter("kept").count() == 4
    stay = near_dup.without_duplicates(twice)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == [0, 1]


def test_open_buckets_in_small_blocks_lose_no_link(spark, monkeypatch):
    """Copies at about the threshold: buckets hold several components, some of which a pair of their members joins."""
    texts = copies(150, seed=8)
    sets = [shingle_set(t, 5) for t in texts]
    want = roots([(i, j) for i in range(len(texts)) for j in range(i) if linked(sets[i], sets[j])], range(len(texts)))
    across = near_dup._across
    calls = []
    monkeypatch.setattr(near_dup, "_across", lambda *a: calls.append(1) or across(*a, block=4))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, texts), 5).collect()}
    assert got == want and calls


@pytest.mark.parametrize("parts", [1, 5])
def test_texts_that_share_an_id_keep_their_links(spark, parts):
    """Brute force over rows: links by text, components by row, named by the smallest doc_id in them."""
    texts = copies(40, seed=11)
    rows = [((2 if i % 4 == 0 else None if i % 4 == 1 else 10 + i), t) for i, t in enumerate(texts)] + [(2, texts[0]), (None, None), (2, "")]
    sets = [shingle_set(t, 5) for _, t in rows]
    of = roots([(i, j) for i in range(len(rows)) for j in range(i) if linked(sets[i], sets[j])], range(len(rows)))
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[of[i]].append(d)
    want = Counter()
    for i, (d, _) in enumerate(rows):
        ids = [x for x in low[of[i]] if x is not None]
        c = min(ids) if ids else None
        want[d, len(sets[i]), c, d == c] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert Counter(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == want


def test_signature_estimate(spark):
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 4000
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: int(n * share)], rng.integers(0, 2**63, n - int(n * share), dtype=np.uint64)])
        true = share / (2 - share)
        a, b = (near_dup.packed(near_dup.minima(np.unique(z)), 2).tolist() for z in (x, y))
        est = spark.createDataFrame([(a, b)], "s array<long>, t array<long>").select(near_dup.estimate(F.col("s"), F.col("t"))).first()[0]
        assert abs(est - true) < 0.17


def filled(sizes, weights, top=3):
    left, active, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while active:
        share = {i: left * weights[i] / sum(weights[j] for j in active) for i in active}
        over = [i for i in active if share[i] > top * sizes[i]]
        if not over:
            for i in active:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(top * sizes[i])
            left -= top * sizes[i]
            active.discard(i)
    return out


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "c", "d", None]), "old") for i in range(400)] + [(900, None, "b", "old"), (901, "tiny text", "e", "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    out = mixing.mix(docs)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    names = sorted({r.source for r in got if r.source}) + [None]
    size = {s: sum(r.size for r in got if r.source == s) for s in names}
    want = dict(zip(names, filled([size[s] for s in names], [[5, 2, 1][i % 3] for i in range(len(names))]), strict=True))
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source]) and r.taken <= 3 * r.size
    for s in names:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= max(r.size for r in got if r.source == s)
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.mix(docs.limit(0)).count() == 0
    shared = documents(spark, []).unionByName(spark.createDataFrame([(i % 3, "w " * (1 + i * 7 % 50), "en", "ab"[i % 2], 1) for i in range(90)], DOCS))
    counts = [Counter((r.doc_id, r.text, r.taken) for r in mixing.mix(shared.repartition(n)).collect()) for n in (1, 3, 8)]
    assert counts[0] == counts[1] == counts[2]  # ids with several texts


def test_mixing_takes_some_of_equal_rows(spark):
    rows = [(1, "w w w", "en", "a", 1)] * 300 + [(2, "w " * 40, "en", "b", 1), (3, "w", "en", "b", 1)]
    for n in (1, 5):
        got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(n)).collect()
        source = {r.source: (r.source_size, r.target) for r in got}
        assert len(got) == 302 and source["a"][0] == 900 and source["b"] == (41, 123.0)
        taken = sum(r.taken for r in got if r.source == "a")
        assert abs(taken - source["a"][1]) <= 3 and all(r.taken in (0, 3) for r in got if r.source == "a")


def test_mixing_of_rows_without_ids(spark):
    import duckdb

    rng = random.Random(6)
    rows = [(None if i % 3 else i % 50, " ".join(["w"] * rng.randint(0, 9) + [f"x{rng.randint(0, 200)}"]), "en", rng.choice("abbc"), 1) for i in range(600)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    want = Counter((r[0], r[1], r[4]) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.OP3_SQL})").fetchall())
    for n in (1, 7):
        got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(n)).collect()
        assert Counter((r.doc_id, r.size, r.taken) for r in got) == want


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 1000, 4097])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).select("id", "p", sharding.permuted(F.col("p"), n, back=True).alias("b")).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.b == r.id for r in rows)


def test_shards(spark):
    texts = [f"text é {i}" for i in range(100)] + [None, "", "same", "same"]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id < 3"))
    got = sharding.shard(docs.withColumn("size", F.lit("clash"))).collect()
    assert len(got) == 107
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} <= {4, 5}
    assert sorted(map(str, sharding.shard(docs.repartition(3)).drop("row_number").collect())) == sorted(str(r) for r in sharding.shard(docs).drop("row_number").collect())
    assert sharding.shard(docs.limit(0)).count() == 0


def test_substring_dedup(spark):
    passage = "This is a long passage that stands in several documents. It has two sentences of its own, more or less. "
    texts = [f"First unique words stand here alone.\n{passage}\nEnd of one.", f"Other text before it comes now. {passage}And then some more of it follows here.", "All rights reserved.\nfresh line with enough words", "  ALL   rights RESERVED. \nanother line with enough words", None, "", "word " * 30_000, "word " * 30_000]
    docs = documents(spark, texts).withColumn("removed", F.lit("clash"))
    out = substring_dedup.dedup(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == texts[0] and got[0].removed == []
    assert "long passage" not in got[1].text and "two sentences" not in got[1].text and got[1].text.startswith("Other text before it comes now.") and got[1].text.endswith("And then some more of it follows here.")
    assert got[2].text == texts[2] and got[3].text == "another line with enough words"
    assert got[4].text is None and got[5].text == "" and got[6].text == texts[6] and got[7].text.strip() == ""
    for r in got.values():
        t, spans = texts[r.doc_id] or "", [(s.start, s.until) for s in r.removed]
        assert r.n_removed_chars == sum(b - a for a, b in spans) and all(a < b <= len(t) for a, b in spans)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "removed", "n_removed_chars"]
    assert substring_dedup.dedup(documents(spark, ["a"]).limit(0)).count() == 0
    line = "今天天气很好我们一起去公园散步吧"
    solid = {r.doc_id: r.text for r in substring_dedup.dedup(documents(spark, [f"昨天下了一整天的大雨路上很滑。{line}。", f"{line}。乙说了些别的事情。", "короткая", "短句", "短句"])).collect()}
    assert solid[0].count(line) + solid[1].count(line) == 1 and "乙说了些别的事情" in solid[1] and solid[3] == solid[4] == "短句"


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in language.held_out_language(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0} == set(held)
    assert sum(got[i].lang_pred == lang[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    model = language.train(docs.select("text", "lang"))
    odd = documents(spark, [None, "", "12345 !!", "the", "les été" * 20_000])
    out = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert [out[i].lang_pred for i in range(3)] == ["und"] * 3 and out[0].score == 0.0 and out[3].lang_pred == "en"
    alone = language.predict(odd.filter("doc_id = 4"), model).first()
    assert alone.lang_pred == out[4].lang_pred and math.isclose(alone.score, out[4].score)  # other rows of a batch have no effect
    none = language.train(docs.limit(0).select("text", "lang"))
    assert [r.lang_pred for r in language.predict(odd, none).collect()] == ["und"] * 5


def test_bpe(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    own = bpe.Codec(open(queries.vocabulary(), encoding="utf-8").read())
    theirs = tokenizers.Tokenizer.from_file(queries.vocabulary())
    rng = random.Random(3)
    pool = ["a", "B", " ", "  ", "\t", "\n", "\x1c", "\x85", "\xa0", "　", "'s", "'S", "1", "½", "é", "日本", "<|endoftext|>", "<|endo", "!!", "​", "﻿", "👍🏽", "x" * 70, "thetion" * 30, "٣", "\x00", "\r\n", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, ascii(text)
        assert own.decode(own.encode(text)) == theirs.decode(ids, skip_special_tokens=False)
    docs = documents(spark, [None, "", "hello world", "z" * 30_000, "hello world"]).withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.digests(docs, queries.vocabulary()).collect()}
    assert got[0].n_tokens == 0 and got[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and got[2].ids_sha256 == got[4].ids_sha256
    assert got[3].decoded_sha256 == hashlib.sha256(b"z" * 30_000).hexdigest()
    assert bpe.decode(bpe.encode(docs, queries.vocabulary()), queries.vocabulary()).filter("doc_id = 2").first().decoded == "hello world"


def ppm(train, docs):
    """log10 probabilities by the definition: counts of every context, escapes with exclusion, one byte at a time."""
    counts = [defaultdict(Counter) for _ in range(lm.ORDER + 1)]
    for t in train:
        x = lm.PAD + lm.normal(t)
        for i in range(lm.ORDER, len(x)):
            for n in range(lm.ORDER + 1):
                counts[n][x[i - n : i]][x[i]] += 1

    def one(context, byte):
        gone, out = set(), 0.0
        for n in range(lm.ORDER, -1, -1):
            here = {b: c for b, c in counts[n].get(context[lm.ORDER - n :], {}).items() if b not in gone}
            if here:
                total = sum(here.values())
                if byte in here:
                    return out + math.log10((here[byte] - 0.5) / total)
                out += math.log10(len(here) / (2 * total))
                gone |= set(here)
        return out - math.log10(256 - len(gone))

    assert math.isclose(sum(10 ** one(b"e the", b) for b in range(256)), 1.0)
    return [sum(one(x[i - lm.ORDER : i], x[i]) for i in range(lm.ORDER, len(x))) for x in (lm.PAD + lm.normal(d) for d in docs)]


def test_lm_scores(spark):
    texts = [*copies(30), None, "", "The the THE the", "unseen zzz qqq", "long " * 3000, "été ñ"]
    raw = [(t or "").encode() for t in texts]
    train = [r for i, r in enumerate(raw) if zlib.crc32(str(i).encode()) % 10]
    want = ppm(train, raw)
    words = Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(words.values()), len(words)
    for block, buckets in ((1000, 5), (16_000_000, 512)):
        got = {r.doc_id: r for r in lm.scores(documents(spark, texts).withColumn("block", F.lit("clash")), block_bytes=block, least_buckets=buckets).collect()}
        for i, t in enumerate(raw):
            tokens = [*t.lower().split(), None]
            assert math.isclose(got[i].score, want[i], rel_tol=1e-9) and got[i].n_tokens == len(tokens) and got[i].n_known == sum(words[w] > 0 for w in tokens)
            assert math.isclose(got[i].base_score, sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9) and got[i].train_tokens == n
    assert lm.scores(documents(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_lm_scores_of_equal_rows(spark, batch):
    few = [(3, "the same text"), (None, "the same text"), (4, "another one"), (10, "held or not"), (5, None)]
    rows = [r for i, r in enumerate(few) for _ in range(1 + 37 * (i == 0) + 11 * (i == 4))]
    train = [(t or "").encode() for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 10]
    want = dict(zip(few, ppm(train, [(t or "").encode() for _, t in few]), strict=True))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string").withColumn("times", F.lit("clash"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(math.isclose(r.score, want[next(f for f in few if f[0] == r.doc_id)], rel_tol=1e-9) for r in got)
    assert {r.train_tokens for r in got} == {sum(len(t.split()) + 1 for t in train)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a>Home</a></li></ul></nav><!-- x -->
<div class="ad">Buy</div><article><h1>Title {0}</h1><p>One &amp; two&nbsp;three<br>four <b>five</b>.<p>Six {0}</p><form>No</form><aside>Side</aside><div class="comments"><p>Nice</p></div></article><div id="cookie-notice">Ok?</div><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    texts = [PAGE.format(i) for i in range(3)] + [None, "", "<p>bare " + "w " * 20_000, "<article><p>cut off here &amp", "<body><p>Menu of the site goes here for all of its pages</p><p>own words {0}</p>"]
    rows = [(i, "http://h.example/%d" % i, t) for i, t in enumerate(texts)] + [(20 + i, "not a url", "<body><p>Menu of the site goes here for all of its pages</p><p>%d own words, which are more than those of the menu that all of them share</p>" % i) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert got[1].text == "Title 1\n\nOne & two three four five.\n\nSix 1" and got[1].n_chars == len(got[1].text)
    assert got[3].text == "" and got[4].text == "" and got[5].text.startswith("bare w w") and got[6].text == "cut off here &"
    assert [got[20 + i].text for i in range(4)] == [f"{i} own words, which are more than those of the menu that all of them share" for i in range(4)]  # a run that several pages of a host share
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n", [20, 200])
def test_html_copies_of_an_article_stay(spark, n):
    body = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4)]
    near = [(i, "http://mirror.example/%d" % i, f"<nav>Home</nav><article><h1>Copy {i}</h1>" + "".join(f"<p>{b}</p>" for b in body) + "</article>") for i in range(n)]
    same = [(1000 + i, "http://mirror.example/%d" % i, "<article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>") for i in range(n)]
    lead = [(2000 + i, "http://lead.example/%d" % i, f"<main><p>{body[0]}</p><p>{'own ' * 20}{i}</p></main>") for i in range(n)]
    bare = [(3000 + i, "http://bare.example/%d" % i, "".join(f"<p>{b}</p>" for b in body)) for i in range(n)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(near + same + lead + bare, "page_id long, url string, html string")).collect()}
    for i in range(n):
        assert got[i] == "\n\n".join([f"Copy {i}", *body]) and got[1000 + i] == got[3000 + i] == "\n\n".join(body)
        assert got[2000 + i] == f"{body[0]}\n\n{'own ' * 20}{i}"


def test_html_counts_are_of_the_whole_host(spark):
    line = "this line of the site stands on five of its many pages"
    rows = [(i, "http://hot.example/%d" % i, f"<p>{'' if i % 40 else line}</p><p>own words of page number {i} and nothing that any other page says</p>".replace("own", f"own{i}").replace("nothing", f"nothing{i}")) for i in range(200)]
    pages = spark.createDataFrame([*rows, *rows[:50]], "page_id long, url string, html string")
    for group in (1000, 8000, 600_000):
        got = html_text.extract(pages, group_chars=group).collect()
        assert len(got) == 250 and all(r.text == f"own{r.page_id} words of page number {r.page_id} and nothing{r.page_id} that any other page says" for r in got), group
    four = html_text.extract(pages.filter("page_id IN (0, 40, 1)"), group_chars=1).collect()  # two texts have the line, on four rows
    assert sum(line in r.text for r in four) == 4


def test_old_pieces_of_the_cache_are_taken_over(monkeypatch):
    codec = bpe.Codec(bpe._texts(queries.vocabulary()))
    words = [f" {a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    want = [codec.encode(w) for w in words]
    monkeypatch.setattr(bpe, "CACHED", 20)
    small, computed = bpe.Codec(bpe._texts(queries.vocabulary())), []
    plain = small.piece
    small.piece = lambda raw: computed.append(raw) or plain(raw)
    for i, w in enumerate(words):
        assert small.encode(" often") + small.encode(w) == codec.encode(" often") + want[i]
        assert len(small.cache) + len(small.cache.old) <= 20
    assert computed.count(b" often") == 1  # a cache that is emptied when full computes it anew
