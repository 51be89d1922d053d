"""Vector operators against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import embedding_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(9001, None, 1), (9002, [], 1), (9003, [float("nan")] * 8, 1), (9004, [float("inf")] + [0.0] * 7, 1), (9005, [0.0] * 8, 1), (9006, [None] * 8, 1), (9007, [1.0, 2.0], 1)]


def vectors(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 8)).astype(np.float32)
    x[100:160] = x[100] + 0.05 * rng.standard_normal((60, 8)).astype(np.float32)
    x[200:220] = x[200]
    return [(i, [float(v) for v in x[i]], None if i % 37 == 0 else i // 250) for i in range(n)]


def test_top_k(spark):
    rows = vectors() + [(500, vectors()[100][1], 0), (501, vectors()[100][1], 0)]
    table = spark.createDataFrame(rows + ODD, SCHEMA).withColumn("shard", F.lit("clash"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, table.filter("vec_id % 50 = 0"), shard_rows=60, block_rows=3).collect())
    ints = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v, _ in rows}
    want = []
    for q in sorted(i for i in ints if i % 50 == 0):
        best = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == want
    twice = table.unionByName(table.filter("vec_id IN (50, 100, 150)"))  # repeated queries are one query, and candidates each
    more = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(twice, twice.filter("vec_id % 50 = 0"), shard_rows=60, block_rows=3).collect())
    again = []
    for q in sorted(i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q for _ in range(2 if i in (50, 100, 150) else 1))[:5]
        again += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert more == again
    two = table.filter("vec_id < 20").unionByName(spark.createDataFrame([(50, [1.0] * 8, 0, "x"), (50, [-1.0] * 8, 0, "x")], table.schema))
    assert topk.top_k(two, two.filter("vec_id = 50")).count() == 10  # two vectors of one id are two queries
    few = table.filter("vec_id IN (50, 51)")
    assert [tuple(r)[:3] for r in topk.top_k(few, few.filter("vec_id = 50")).collect()] == [(50, 1, 51)]
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_embedding_links(spark):
    rows = vectors()
    rows += [(600 + i, [2 * v for v in rows[200][1]], rows[200][2]) for i in range(3)]
    table = spark.createDataFrame(rows + ODD[:6], SCHEMA).withColumn("links", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_dedup.linked(table, block=16).collect()}
    links = {i: set() for i in got}
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v, label in rows if label is not None}
    label = {i: k for i, _, k in rows}
    for a in unit:
        for b in unit:
            if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93:
                links[a].add(b)
                links[b].add(a)
    low = {i: i for i in got}
    while True:
        new = {i: min([low[i], *(low[j] for j in links[i])]) for i in low}
        if new == low:
            break
        low = new
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r.component_id for i, r in got.items()} == low and all(r.kept == (low[i] == i) for i, r in got.items())
    assert embedding_dedup.linked(table.limit(0)).count() == 0


def test_repeated_vectors_link(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], SCHEMA)
    assert sorted((r.vec_id, r.n_links) for r in embedding_dedup.linked(table).collect()) == [(1, 1), (1, 1), (2, 0)]


def test_top_k_of_separate_clusters_meets_few_shards(spark):
    rng = np.random.default_rng(3)
    centre = 4 * rng.standard_normal((16, 8))
    rows = [(i, [float(v) for v in centre[i % 16] + 0.05 * rng.standard_normal(8)], 0) for i in range(3200)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in topk.top_k(table, table.filter("vec_id % 50 = 0"), shard_rows=200, block_rows=10).collect())
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    want = []
    for q in range(0, 3200, 50):
        best = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:5]
        want += [(q, k, i) for k, (_, i) in enumerate(best, 1)]
    assert got == want
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(500)], SCHEMA)  # one leaf of equal vectors is dealt to several shards
    got = topk.top_k(same, same.filter("vec_id % 50 = 0"), shard_rows=50, block_rows=3).collect()
    assert len(got) == 50 and all(r.vec_id == r["rank"] - 1 + (r["rank"] > r.query_id) for r in got if r.query_id in (0, 50))


@pytest.mark.parametrize("largest", [20_000.0, 1e15, 3e38])
def test_wide_components(spark, largest):
    from fractions import Fraction

    rng = random.Random(int(math.log10(largest)))
    rows = []
    for i in range(200):
        size = rng.choice([1.0, 1.0, largest])
        rows.append((i, [float(np.float32(rng.uniform(-1, 1) * size)) for _ in range(8)]))
    rows += [(50, rows[50][1]), (7, rows[8][1]), (300, [largest] * 3), (350, [1.0] * 3), (None, [1.0] * 8), (400, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(table, table.filter("vec_id % 50 = 0"), k=5).collect():
        got.setdefault((r.query_id, r.rank), []).append((r.vec_id, r.score))
    floors = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if i is not None and v is not None]
    want = {}
    for q, a in {(i, tuple(v)) for i, v in floors if i % 50 == 0}:
        best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in floors if i != q and len(b) == len(a)))[:5]
        for rank, (s, i) in enumerate(best, 1):
            want.setdefault((q, rank), []).append((i, max(-(2**63), min(2**63 - 1, -s))))
    assert got == want
