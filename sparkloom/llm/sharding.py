"""Sharding by a Feistel permutation of global row numbers, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _div(number: Column, by: int) -> Column:
    """Whole quotient of a non-negative long, without a detour over doubles."""
    return F.call_function("div", number, F.lit(by))


def feistel(number: Column, n: int, seed: int, rounds: int, back: bool) -> Column:
    """One pass of the permutation of [0, a * b) over ``number``: the halves number div b and number mod b change in
    turn by a seeded hash of the other, added (or subtracted) modulo the half's range. The rounds are a fold over round
    numbers, so the expression stays small."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def one(pair: Column, r: Column) -> Column:
        left, right = pair["left"], pair["right"]
        hashed = lambda half: F.xxhash64(half, F.lit(seed), r)
        moved = lambda half, other, by: F.pmod((half - F.pmod(hashed(other), F.lit(by))) if back else (half + F.pmod(hashed(other), F.lit(by))), F.lit(by))
        even = r % 2 == 0
        return F.struct(F.when(even, moved(left, right, a)).otherwise(left).cast("long").alias("left"), F.when(even, right).otherwise(moved(right, left, b)).cast("long").alias("right"))

    start = F.struct(_div(number, b).alias("left"), F.pmod(number, F.lit(b)).cast("long").alias("right"))
    turns = F.sequence(F.lit(rounds - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(turns, start, one, lambda pair: pair["left"] * b + pair["right"])


def permuted(number: Column, n: int, seed: int = 11, rounds: int = 6, back: bool = False) -> Column:
    """Place of row ``number`` in a shuffle of ``n`` rows; ``back`` gives the row of a place.

    The domain a * b >= n of the Feistel network is within about sqrt(n) of n. A result of n or more is sent through
    again (cycle walking) until it is below n. A cycle has at most a * b - n such results; 64 steps cover these for n up to
    some 4,000, and beyond that a walk that long has a chance below (1 / sqrt(n)) ** 64. Should one occur, the query fails
    instead of giving a wrong place.
    """
    go = lambda x: feistel(x, n, seed, rounds, back)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), go(number), lambda x, _: F.when(x < n, x).otherwise(go(x)))
    first = go(number)
    place = F.when(first < n, first).otherwise(walked)
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


#: So many equal rows at most are made from one row of their count.
COPIES = 1 << 16


def numbered(rows: DataFrame, keys: list[str], slices: int = 1024, name: str = "row_number") -> tuple[DataFrame, int]:
    """``keys`` of all ``rows`` with global row numbers from 0, the same in every run, and their count.

    Equal rows are first counted, a map-side aggregate. Distinct ones fall into ``slices`` by a hash of ``keys``; a number is the rows of the slices before plus those with smaller
    keys inside the slice. Then each distinct row becomes as many as it stands for, in pieces of at most COPIES that are dealt to all tasks; so a row that is a third of the table is one row to
    the slices. Only the ``slices`` counts (a fixed bound) go through the driver.
    """
    alike = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int"))
    counts = dict(alike.groupBy("_slice").agg(F.sum("_n")).collect())
    starts, n = [], 0
    for s in range(slices):
        starts.append(n)
        n += counts.get(s, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_slice") + 1)
    order = W.partitionBy("_slice").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("_n") - 1, COPIES))).alias("_piece")
    cut = alike.withColumn("_start", start + before).select(*keys, "_n", "_start", pieces)
    first = F.col("_piece") * COPIES
    here = F.sequence(F.col("_start") + first, F.col("_start") + F.least(first + COPIES, F.col("_n")) - 1)
    return cut.repartition(*keys, "_piece").select(*keys, F.explode(here).alias(name)), n


def shard(docs: DataFrame, shards: int = 24, seed: int = 11, slices: int = 1024) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    Law ``rows``: a row's place p in the shuffle gives shard p mod ``shards`` and slot p div ``shards``, so the counts are at most
    one apart and slots have no gaps; both follow from the row number alone and ``permuted(..., back=True)`` inverts them. Null
    texts count as empty. Repeated rows get numbers of their own, one after the other (equal rows are interchangeable), also if they are a third of all; an empty table
    gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"], slices)
    return (
        rows.withColumn("place", permuted(F.col("row_number"), n, seed))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod(F.col("place"), F.lit(shards)).cast("int").alias("shard"),
            _div(F.col("place"), shards).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
        )
    )
