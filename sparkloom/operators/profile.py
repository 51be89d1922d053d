"""Feature distributions of clips against a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The profile's features and whether a zero measurement counts as missing.
FEATURES = {"f0_mean": True, "f0_std": True, "cps": True, "pauses": False, "silence": False}


def _value(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(0.0)) if FEATURES[name] else F.col(name)


def profile(clips: DataFrame) -> DataFrame:
    """One row: clips, and mean and population deviation of each feature, to three digits."""
    stats = [f(_value(n)).alias(f"{n}_{s}") for n in FEATURES for s, f in (("avg", F.avg), ("dev", F.stddev_pop))]
    return clips.agg(F.count(F.lit(1)).alias("n_clips"), *stats).select("n_clips", *[F.round(f"{n}_{s}", 3).alias(f"{n}_{s}") for n in FEATURES for s in ("avg", "dev")])


def from_heldout(clips: DataFrame, heldout: Column, pos: str, first: int = 40) -> DataFrame:
    """The first ``first`` held-out clips by ``pos``, or of all where none is held out, with a label that says which."""
    marked = clips.withColumn("_h", F.coalesce(heldout, F.lit(False)))
    any_ = marked.agg(F.coalesce(F.bool_or("_h"), F.lit(False)).alias("_any"))
    pool = marked.crossJoin(F.broadcast(any_)).filter(F.col("_h") | ~F.col("_any"))  # one row: an aggregate without keys
    return pool.orderBy(pos).limit(first).withColumn("source", F.when(F.col("_any"), "heldout").otherwise("all")).drop("_h", "_any")


def compare(clips: DataFrame, by: str, one: DataFrame) -> DataFrame:
    """Each ``by``'s mean features against the profile ``one``: deltas, spread ratio, RMS distance over the terms present, and notes.

    Scales: pitch max(5, deviation or 20), rate max(0.2, deviation or 0.5), pauses 0.3; silence gives a note only.
    """
    m = clips.groupBy(by).agg(F.count(F.lit(1)).alias("n_clips"), *[F.round(F.avg(n), 4).alias(n) for n in FEATURES])
    truthy = lambda c: F.nullif(F.col(c), F.lit(0.0))
    x = m.crossJoin(F.broadcast(one.drop("n_clips"))).select(  # one row: an aggregate without keys
        by, "n_clips", F.round(F.col("f0_mean") - truthy("f0_mean_avg"), 2).alias("f0_delta"), F.greatest(F.lit(5.0), F.coalesce(truthy("f0_mean_dev"), F.lit(20.0))).alias("_fs"),
        F.round(F.col("f0_std") / truthy("f0_std_avg"), 3).alias("f0_ratio"), F.round(F.col("cps") - truthy("cps_avg"), 3).alias("cps_delta"),
        F.greatest(F.lit(0.2), F.coalesce(truthy("cps_dev"), F.lit(0.5))).alias("_cs"), (F.col("cps") / truthy("cps_avg")).alias("_cr"),
        F.round(F.col("pauses") - F.col("pauses_avg"), 4).alias("pause_delta"), F.round(F.col("silence") - F.col("silence_avg"), 4).alias("silence_delta"),
    )
    terms = F.array_compact(F.array(F.abs("f0_delta") / F.col("_fs"), F.abs(1 - F.col("f0_ratio")), F.abs("cps_delta") / F.col("_cs"), F.abs("pause_delta") / 0.3))
    notes = F.array_compact(
        F.array(
            F.when(F.abs("f0_delta") > 2 * F.col("_fs"), "pitch centre"), F.when(F.col("f0_ratio") < 0.6, "flat").when(F.col("f0_ratio") > 1.6, "over-acted"),
            F.when((F.col("_cr") < 0.75) | (F.col("_cr") > 1.33), "rate"), F.when(F.col("silence_delta") > 0.15, "silence"),
        )
    )
    y = x.withColumn("_t", terms)
    distance = F.when(F.size("_t") > 0, F.round(F.sqrt(F.aggregate("_t", F.lit(0.0), lambda a, t: a + t * t) / F.size("_t")), 4))
    return y.select(by, "n_clips", "f0_delta", "f0_ratio", "cps_delta", "pause_delta", "silence_delta", distance.alias("distance"), F.array_join(notes, "; ").alias("notes"))


def ranked(compared: DataFrame, by: str) -> DataFrame:
    """Nearest first, missing last."""
    return compared.orderBy(F.col("distance").asc_nulls_last(), by)


def score_run(clips: DataFrame, by: str, one: DataFrame, latency_ms: Column, duration: Column) -> DataFrame:
    """``compare`` with each candidate's mean real-time factor, one ratio a record."""
    rtf = clips.groupBy(by).agg(F.round(F.avg(latency_ms / 1000 / F.nullif(duration, F.lit(0.0))), 6).alias("rtf"))
    return compare(clips, by, one).join(rtf, by)
