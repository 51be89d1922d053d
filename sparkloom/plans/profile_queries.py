"""Feature profiles over ``events``: a user's events are clips, event types are candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import profile as P
from sparkloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}

CLIPS_SQL = """SELECT event_id, event_type, user_id, round(180 + value * 0.25, 4) AS f0_mean, CASE WHEN event_id % 13 = 0 THEN 0.0::DOUBLE ELSE round(10 + (user_id % 40), 4)::DOUBLE END AS f0_std,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(3 + value / 200, 4) END AS cps, round((event_id % 10) / 10.0::DOUBLE, 4) AS pauses, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value / 1000, 4) END AS silence, value FROM events"""


def _clips(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id", "event_type", "user_id", F.round(180 + F.col("value") * 0.25, 4).alias("f0_mean"),
        F.when(F.col("event_id") % 13 == 0, F.lit(0.0)).otherwise(F.round((10 + F.col("user_id") % 40).cast("double"), 4)).alias("f0_std"),
        F.when(F.col("event_id") % 7 != 0, F.round(3 + F.col("value") / 200, 4)).alias("cps"), F.round((F.col("event_id") % 10) / 10, 4).alias("pauses"),
        F.when(F.col("event_id") % 5 != 0, F.round(F.col("value") / 1000, 4)).alias("silence"), "value",
    )


def _cols(zero):
    return {n: (f"nullif({n}, 0.0)" if z else n) for n, z in zero.items()}


PROFILE = ", ".join(f"round(avg({e}), 3) AS {n}_avg, round(stddev_pop({e}), 3) AS {n}_dev" for n, e in _cols(P.FEATURES).items())

QUERIES["q_prosody_profile"] = lambda spark, d: P.profile(_clips(spark, d))
ORACLE["q_prosody_profile"] = f"SELECT count(*) AS n_clips, {PROFILE} FROM ({CLIPS_SQL})"

COMPARE_SQL = f"""
WITH c AS ({CLIPS_SQL}), p AS (SELECT {PROFILE} FROM c WHERE event_type = 'view'),
m AS (SELECT event_type, count(*) AS n_clips, {", ".join(f"round(avg({n}), 4) AS {n}" for n in P.FEATURES)} FROM c WHERE event_type <> 'view' GROUP BY event_type),
x AS (SELECT event_type, n_clips, round(f0_mean - nullif(f0_mean_avg, 0.0), 2) AS f0_delta, greatest(5.0, coalesce(nullif(f0_mean_dev, 0.0), 20.0)) AS fs, round(f0_std / nullif(f0_std_avg, 0.0), 3) AS f0_ratio,
  round(cps - nullif(cps_avg, 0.0), 3) AS cps_delta, greatest(0.2, coalesce(nullif(cps_dev, 0.0), 0.5)) AS cs, cps / nullif(cps_avg, 0.0) AS cr,
  round(pauses - pauses_avg, 4) AS pause_delta, round(silence - silence_avg, 4) AS silence_delta FROM m, p),
t AS (SELECT *, list_filter([abs(f0_delta) / fs, abs(1 - f0_ratio), abs(cps_delta) / cs, abs(pause_delta) / 0.3::DOUBLE], lambda v: v IS NOT NULL) AS terms FROM x)
SELECT event_type, n_clips, f0_delta, f0_ratio, cps_delta, pause_delta, silence_delta, round(sqrt(list_sum(list_transform(terms, lambda v: v * v)) / len(terms)), 4) AS distance,
  array_to_string(list_filter([CASE WHEN abs(f0_delta) > 2 * fs THEN 'pitch centre' END, CASE WHEN f0_ratio < 0.6 THEN 'flat' WHEN f0_ratio > 1.6 THEN 'over-acted' END,
    CASE WHEN cr < 0.75 OR cr > 1.33 THEN 'rate' END, CASE WHEN silence_delta > 0.15 THEN 'silence' END], lambda v: v IS NOT NULL), '; ') AS notes FROM t"""


def _one(spark, d):
    return P.profile(_clips(spark, d).filter("event_type = 'view'"))


QUERIES["q_prosody_compare"] = lambda spark, d: P.ranked(P.compare(_clips(spark, d).filter("event_type <> 'view'"), "event_type", _one(spark, d)), "event_type")
ORACLE["q_prosody_compare"] = COMPARE_SQL

QUERIES["q_score_run"] = lambda spark, d: P.score_run(_clips(spark, d).filter("event_type <> 'view'"), "event_type", _one(spark, d), F.col("value"), F.col("pauses"))
ORACLE["q_score_run"] = f"""SELECT a.*, b.rtf FROM ({COMPARE_SQL}) a JOIN (SELECT event_type, round(avg(value / 1000 / nullif(pauses, 0.0)), 6) AS rtf
FROM ({CLIPS_SQL}) WHERE event_type <> 'view' GROUP BY event_type) b ON a.event_type = b.event_type"""

QUERIES["q_profile_heldout"] = lambda spark, d: P.from_heldout(_clips(spark, d), F.col("event_id") % 97 == 0, "event_id", 40).groupBy("source").agg(
    F.count(F.lit(1)).alias("n"), F.round(F.avg("f0_mean"), 3).alias("f0_avg"), F.max("event_id").alias("last_id")
)
ORACLE["q_profile_heldout"] = f"""
WITH c AS ({CLIPS_SQL}), a AS (SELECT coalesce(bool_or(event_id % 97 = 0), false) AS h FROM c),
f AS (SELECT *, CASE WHEN h THEN 'heldout' ELSE 'all' END AS source FROM c, a WHERE event_id % 97 = 0 OR NOT h ORDER BY event_id LIMIT 40)
SELECT source, count(*) AS n, round(avg(f0_mean), 3) AS f0_avg, max(event_id) AS last_id FROM f GROUP BY source"""
