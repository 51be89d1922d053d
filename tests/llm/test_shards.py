"""Shards and slots derived a second time in plain Python, and a row that is a third of its table."""

import math
import random
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import sharding


def chained(*values):
    """The 64-bit hash of several values, each (number, struct code), null leaving it as it is; signed."""
    h = 42
    for number, code in values:
        if number is not None:
            h = xxhash.xxh64_intdigest(struct.pack(code, number), seed=h)
    return h - (1 << 64) if h >> 63 else h


def place_of(number, n, seed=11, rounds=6):
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    x = number
    while True:
        left, right = divmod(x, b)
        for r in range(rounds):
            if r % 2 == 0:
                left = (left + chained((right, "<q"), (seed, "<i"), (r, "<i")) % a) % a
            else:
                right = (right + chained((left, "<q"), (seed, "<i"), (r, "<i")) % b) % b
        x = left * b + right
        if x < n:
            return x


def plain(rows, shards=24, slices=1024):
    keyed = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        crc, size = zlib.crc32(raw), len(raw) + 8
        keyed.append((chained((doc_id, "<q"), (crc, "<q"), (size, "<q")) % slices, doc_id is not None, doc_id or 0, crc, size, doc_id))
    out = []
    for i, (*_, crc, size, doc_id) in enumerate(sorted(keyed, key=lambda k: k[:5])):
        p = place_of(i, len(rows))
        out.append((doc_id, size, crc, p % shards, p // shards))
    return sorted(out, key=str)


def derived(df):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()), key=str)


def test_shards_equal_a_plain_derivation(spark, sf):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(300)]), rng.choice([None, "", "é", "a b", "x" * 999, f"t{rng.randint(0, 50)}"])) for _ in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert derived(sharding.shard(docs)) == plain(rows)
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert derived(sharding.shard(table)) == plain([tuple(r) for r in table.collect()])


def test_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 64)
    docs = spark.range(4000).select(F.when(F.col("id") < 3000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    rows, n = sharding.numbered(docs.select("doc_id"), ["doc_id"])
    assert n == 4000 and sorted(r.row_number for r in rows.collect()) == list(range(4000))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 2 * 4000 / 4
    got = sharding.shard(docs).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in counts)
