"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._store import drop, store


def _mass(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) to (id, component): the smallest id reachable from each id that has an edge.

    Each round first links the larger neighbours of every node to its smallest neighbour, then the smaller ones, until
    nothing changes; the number of rounds grows with the logarithm of the longest path. Only counts come to the driver. A node with very many
    neighbours is an aggregate (summed before the shuffle) joined back to its edges; the aggregate is dealt anew before that join (the
    rebalance hint), so that both sides come from a shuffle of the join's own and Spark can split a skewed one. Rounds are written to the shared folder. Self-links and null ends are ignored; no edges give no rows.
    """
    now = store(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mass = _mass(now)
    while mass[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        then = store(small, "edges")
        new = _mass(then)
        drop(now)
        now = then
        if new == mass:
            break
        mass = new
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
