"""Run statistics, experiment grids, blinding and derived seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def run_report(records: DataFrame, by: str, ok: Column, duration: Column, latency: Column) -> DataFrame:
    """Per ``by``: succeeded and failed records, medians of the truthy durations and latencies of succeeded ones, and the mean
    real-time factor latency / 1000 / duration per record. 0 counts as missing, as null does."""
    d, t = F.nullif(duration, F.lit(0.0)), F.nullif(latency, F.lit(0.0))
    good = lambda c: F.when(ok, c)
    return records.groupBy(by).agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.round(F.median(good(d)), 4).alias("median_duration"),
        F.round(F.median(good(t)), 4).alias("median_latency"), F.round(F.avg(good(t / 1000 / d)), 6).alias("mean_rtf"),
    )


def fallback_rate(records: DataFrame, ok: Column, fell_back: Column) -> DataFrame:
    """Share of succeeded records that fell back; 0 without any."""
    return records.filter(ok).agg(F.round(F.coalesce(F.avg(fell_back.cast("double")), F.lit(0.0)), 6).alias("fallback_rate"))


def dropped_controls(records: DataFrame, by: str, controls: Column) -> DataFrame:
    """Per ``by``, the sorted union of the dropped-control arrays as one string."""
    return records.select(by, F.explode(controls).alias("_c")).groupBy(by).agg(F.array_join(F.array_sort(F.collect_set("_c")), ",").alias("controls"))


def failure_top(records: DataFrame, by: str, error: str, pos: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent "by: error" reasons; ties go to the earliest record."""
    return (
        records.filter(F.col(error).isNotNull())
        .groupBy(F.concat_ws(": ", by, error).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos"))
        .orderBy(F.desc("n"), "first_pos").limit(n)
    )


def histogram(records: DataFrame, column: str, missing: str = "—") -> DataFrame:
    """Rows by value, null as ``missing``."""
    return records.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def grid(candidates: DataFrame, sentences: DataFrame, repeats: int, base_seed: int, index: str) -> DataFrame:
    """Every candidate with every sentence and repeat; the seed depends on sentence and repeat only. A Cartesian product of two
    design tables is what is asked for; both are small and the smaller one is broadcast by size."""
    cells = candidates.crossJoin(sentences).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return cells.withColumn("seed", (F.lit(base_seed) + F.col(index) * 100 + F.col("repeat")).cast("long"))


def seeded_order(seed: int, *key: str) -> Column:
    """A sort key that shuffles rows the same way in every run and engine."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]), 256)


def blind(generated: DataFrame, anchors: DataFrame, seed: int, cap: int, columns: list[str]) -> DataFrame:
    """Generated and anchor rows (both with kind and key) shuffled, numbered item-001.. and capped; the paths are left out.

    Only the first ``cap`` of the order are numbered, so the global sort is a top-k rather than a sort of everything.
    """
    rows = generated.select("kind", "key", *columns).unionByName(anchors.select("kind", "key", *columns))
    first = rows.withColumn("_o", seeded_order(seed, "kind", "key")).orderBy("_o", "kind", "key").limit(cap)
    n = F.row_number().over(W.orderBy("_o", "kind", "key"))
    return first.withColumn("item_id", F.format_string("item-%03d", n)).select("item_id", "kind", "key", *columns)


def derived_seed(base: int, *parts: Column) -> Column:
    """The first four bytes, big endian, of sha256 of the parts joined by "|"."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(base)), *parts), 256), 1, 8), 16, 10).cast("long")


def rotation_index(key: Column, n: Column) -> Column:
    """The first eight bytes, big endian, of sha256 of ``key``, modulo ``n``."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)"), n.cast("decimal(20,0)")).cast("int")
