"""Near-duplicate lines in order, against a plain version."""

import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sparkloom.functions.text import bigrams
from sparkloom.operators import dialogue as D
from sparkloom.operators.quality import lint
from sparkloom.sources import tables as T


def plain(rows, limit=1 << 30):
    grams = lambda s: frozenset(s[i : i + 2] for i in range(len(s) - 1)) or (frozenset([s]) if s else frozenset())
    kept = {}
    for by, pos, text in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        have, g = kept.setdefault(by, []), grams(text or "")
        if len(have) < limit and all(not g or not h or len(g & h) / len(g | h) < 0.85 for _, h in have):
            have.append((pos, g))
    return sorted((str(by), pos) for by, x in kept.items() for pos, _ in x)


def lines(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 60))) for _ in range(12)]
    rows, pos = [], 0
    for by in ("x", "y", None):
        for _ in range(70):
            text = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice("abcdefghijklmnop")
            rows.append((by, pos, rng.choice(["".join(text)] * 20 + ["", None])))
            pos += 1
    chain = "".join(rng.choice("abcdefghijklmnop") for _ in range(80))
    for i in range(30):  # each is near the next ones only
        rows.append(("chain", 1000 + i, chain[i : i + 45]))
    return rows


def test_distinct_lines_equal_a_plain_walk(spark):
    for seed in (1, 2):
        rows = lines(seed)
        table = spark.createDataFrame(rows, "g string, at int, text string")
        assert sorted((str(r.g), r["at"]) for r in D.distinct_lines(table, "g", "at", "text").collect()) == plain(rows)
    assert sorted((str(r.g), r["at"]) for r in D.distinct_lines(table, "g", "at", "text", 3).collect()) == plain(rows, 3)
    assert D.distinct_lines(table.limit(0), "g", "at", "text").count() == 0


def test_large_groups_meet_in_packs_without_a_shuffle_of_pairs(spark):
    for seed, group, size in ((1, 0, 7), (2, 64, 16), (1, 0, 1000)):
        table = spark.createDataFrame(lines(seed), "g string, at int, text string")
        assert sorted((str(r.g), r["at"]) for r in D.distinct_lines(table, "g", "at", "text", group=group, size=size).collect()) == plain(lines(seed))


def test_grams_keep_their_codes_and_digests(spark):
    texts = ["a", "ab", "ba ab", "\U0001f600x", "\U0001f600", "重庆火锅", "a\0b"]
    table = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g int, at int, text string")
    got = {r["pos"]: r for r in D._lines(table, "g", "at", "text").collect()}
    want = table.select("at", F.array_sort(bigrams(F.col("text"))).alias("grams"), F.md5(F.array_join(F.array_sort(bigrams(F.col("text"))), "\0")).alias("digest")).collect()
    for r in want:
        codes = D._unblob(bytes(got[r["at"]].grams), got[r["at"]].n)
        assert [chr(c >> 21 & 0x1FFFFF) * (c >> 42 == 2) + chr(c & 0x1FFFFF) if c >> 42 == 2 else chr(c >> 21 & 0x1FFFFF) for c in codes.tolist()] == r["grams"]
        assert got[r["at"]].digest == r["digest"]


def test_small_groups_are_walked_without_packs(spark, monkeypatch):
    monkeypatch.setattr(D, "_distinct_sets", None)
    table = spark.createDataFrame(lines(2), "g string, at int, text string")
    assert sorted((str(r.g), r["at"]) for r in D.distinct_lines(table, "g", "at", "text").collect()) == plain(lines(2))


def test_groups_over_batches_and_rows_of_one_place(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for seed in (1, 2):
            assert sorted((str(r.g), r["at"]) for r in D.distinct_lines(spark.createDataFrame(lines(seed), "g string, at int, text string"), "g", "at", "text").collect()) == plain(lines(seed))
        near = ["abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxy", "bcdefghijklmnopqrstuvwxy"]
        tied = spark.createDataFrame([("t", at, x) for at in (1, 2) for x in near] + [("u", 1, "x"), ("u", 2, "\0x"), ("u", 3, "x"), ("u", 4, "")], "g string, at int, text string")
        large, small = (sorted(map(str, D.distinct_lines(tied, "g", "at", "text", group=n).collect())) for n in (0, 512))
        assert small == large and len([x for x in small if "'u'" in x]) == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rules_of_lint_walk_the_lines_once(spark):
    rows = spark.createDataFrame([("p", 1, "user", "hello there", None), ("p", 2, "user", "hello there", "file"), (None, 1, "x", "one", "")], "profile string, pos int, style string, character string, source string")
    styles = spark.createDataFrame([("p", "user"), ("p", "zh"), ("q", "zh")], "profile string, style string")
    found = lint(rows, styles, spark.createDataFrame([], "profile string, word string, reading string"))
    assert "InArrow" not in found._jdf.queryExecution().toString()
    assert sorted((r.code.split(".")[1], r.subject) for r in found.collect()) == [
        ("duplicate_examples", "p"), ("examples_in_undeclared_styles", "x"), ("few_examples", "p"), ("latin_in_examples", "p"), ("no_examples", "q"), ("style_without_examples", "p/zh"),
    ]


def test_packs_are_bounded_by_their_grams_and_written_in_small_row_groups(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("g", i, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))) for i in range(60)]
    table = spark.createDataFrame(rows, "g string, at int, text string").repartition(1)
    packs = D._line_packs(D._lines(table, "g", "at", "text").withColumn("kept", F.lit(False)), 1000, 2000).collect()
    counts = [np.frombuffer(bytes(p.n), D.COUNTS) for p in packs]
    assert sum(map(len, counts)) == 60 and all(n.sum() <= 2000 for n in counts)  # a pack of 60 lines held 24,000 before
    monkeypatch.setitem(T.LARGE_ROWS, "parquet.block.size", 1 << 20)
    large = spark.range(12, numPartitions=1).select("id", F.expr("transform(sequence(1, 50000), x -> rand())").alias("x"))
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in T.written(large, large_rows=True).inputFiles()]
    assert sum(groups) > 3


def test_packs_meet_by_stretches_as_whole_sets_do():
    rng = random.Random(3)

    def pack(sets):
        codes, at = np.unique(np.concatenate([np.array(sorted(x), np.int64) for x in sets]), return_inverse=True)
        return np.array([len(x) for x in sets], D.COUNTS), codes, at.astype(np.uint16)

    near = 0
    for _ in range(200):
        base = [set(rng.sample(range(rng.choice([30, 200, 2000])), rng.randint(1, 30))) for _ in range(4)]
        sides = [[rng.choice(base) ^ set(rng.sample(range(2000), rng.choice([0, 0, 1, 2, 3]))) or {1} for _ in range(rng.randint(1, 12))] for _ in "ab"]
        for met in (sides, sides[:1]):
            want = [[185 * len(x & y) >= 85 * (len(x) + len(y)) for y in met[-1]] for x in met[0]]
            for stretches in ((1, 2, 3), (4,), D.STRETCHES):
                assert D._near([pack(x) for x in met], stretches).tolist() == want
            near += sum(map(sum, want))
    assert near > 500


def test_smaller_parts_leave_the_sessions_own_choices(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxBytesPerBatch"]
    own = [spark.conf.get(x) for x in names]
    try:
        for first, second, want in (("1m", "64m", [1 << 20, 1 << 23]), ("128MB", "4194304b", [1 << 25, 1 << 22])):
            spark.conf.set(names[0], first)
            spark.conf.set(names[1], second)
            kept = [spark.conf.get(x) for x in names]
            with T.small_parts(spark, 1 << 25, 1 << 23):
                assert [int(spark.conf.get(x).rstrip("b")) for x in names] == want
            assert [spark.conf.get(x) for x in names] == kept
    finally:
        for name, value in zip(names, own, strict=True):
            spark.conf.set(name, value)
