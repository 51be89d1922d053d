"""Signal queries: embeddings as sample arrays, and a user's events as frames with a level."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import signal as S
from sparkloom.operators import vad as V
from sparkloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}
c = F.col
X_SQL = "SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings"
RMS = "sqrt(list_sum(list_transform({0}, lambda v: v * v)) / len({0}))"


def _x(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", c("embedding").cast("array<double>").alias("x"))


QUERIES["q_signal_stats"] = lambda spark, d: _x(spark, d).select(
    "vec_id", F.round(S.rms(c("x")), 6).alias("rms"), F.round(S.dbfs(S.rms(c("x"))), 4).alias("level"), F.round(S.peak_dbfs(c("x")), 4).alias("peak"), F.round(S.clipping_ratio(c("x"), 0.25), 6).alias("clipping"),
    F.round(S.percentile_floor(c("x"), 0.1), 6).alias("p10"), S.trimmed_stats(F.transform("x", lambda v: 300 + 900 * v))["mean"].alias("f0"), S.trimmed_stats(F.transform("x", lambda v: 300 + 900 * v))["dev"].alias("f0_dev"),
)
ORACLE["q_signal_stats"] = f"""
WITH s AS (SELECT vec_id, x, {RMS.format("x")} AS r, list_sort(list_filter(list_transform(x, lambda v: 300 + 900 * v), lambda v: v BETWEEN 60 AND 500)) AS v FROM ({X_SQL})),
t AS (SELECT *, v[1 + greatest(1, len(v) // 10):len(v) - greatest(1, len(v) // 10)] AS i FROM s),
m AS (SELECT *, list_sum(i) / len(i) AS m FROM t)
SELECT vec_id, round(r, 6) AS rms, round(greatest(-120.0, 20 * log10(r)), 4) AS level, round(greatest(-120.0, 20 * log10(list_max(list_transform(x, lambda v: abs(v))))), 4) AS peak,
  round(len(list_filter(x, lambda v: abs(v) >= 0.25::DOUBLE)) / len(x), 6) AS clipping, round(list_sort(x)[1 + CAST(floor(0.1::DOUBLE * (len(x) - 1)) AS INT)], 6) AS p10,
  CASE WHEN len(v) >= 3 THEN round(m, 2) END AS f0, CASE WHEN len(v) >= 3 THEN round(sqrt(list_sum(list_transform(i, lambda v: (v - m) * (v - m))) / len(i)), 2) END AS f0_dev FROM m"""

QUERIES["q_loudness"] = lambda spark, d: _x(spark, d).select("vec_id", S.loudness(c("x")).alias("loudness"), S.loudness_gain(c("x"), -16.0).alias("gain"), F.round(S.rms(S.with_gain(c("x"), S.loudness_gain(c("x"), -16.0))), 6).alias("rms_after"))
ORACLE["q_loudness"] = f"""
WITH s AS (SELECT vec_id, x, round(greatest(-120.0, 20 * log10({RMS.format("x")})) - 3, 3) AS l, greatest(-120.0, 20 * log10(list_max(list_transform(x, lambda v: abs(v))))) AS p FROM ({X_SQL})),
g AS (SELECT *, least(greatest(-18.0, least(18.0, -16 - l)), -1 - p) AS g0 FROM s), h AS (SELECT *, CASE WHEN abs(g0) < 0.05 THEN 0.0 ELSE round(g0, 3) END AS g FROM g)
SELECT vec_id, l AS loudness, g AS gain, round(sqrt(list_sum(list_transform(x, lambda v: (v * pow(10.0, g / 20)) * (v * pow(10.0, g / 20)))) / len(x)), 6) AS rms_after FROM h"""

QUERIES["q_frames"] = lambda spark, d: _x(spark, d).select("vec_id", F.posexplode(S.frame_levels(c("x"), 16, 8)).alias("frame", "level")).select("vec_id", "frame", F.round("level", 4).alias("level"))
FRAMES_SQL = f"""
WITH f AS (SELECT vec_id, CAST(i AS INTEGER) AS frame, x[i * 8 + 1:i * 8 + 16] AS w FROM ({X_SQL}), unnest(range(1 + (len(x) - 16) // 8)) t(i))
SELECT vec_id, frame, greatest(-120.0, 20 * log10({RMS.format("w")})) AS level FROM f"""
ORACLE["q_frames"] = f"SELECT vec_id, frame, round(level, 4) AS level FROM ({FRAMES_SQL})"

QUERIES["q_snr"] = lambda spark, d: _x(spark, d).withColumn("v", S.frame_levels(c("x"), 4, 4)).select("vec_id", S.snr(c("v")).alias("snr"))
ORACLE["q_snr"] = f"""
WITH f AS (SELECT vec_id, greatest(-120.0, 20 * log10({RMS.format("w")})) AS l FROM (SELECT vec_id, x[i * 4 + 1:i * 4 + 4] AS w FROM ({X_SQL}), unnest(range(1 + (len(x) - 4) // 4)) t(i))),
a AS (SELECT vec_id, list_sort(list(l)) AS v FROM f GROUP BY vec_id), t AS (SELECT vec_id, v, greatest(v[1 + CAST(floor(0.1::DOUBLE * (len(v) - 1)) AS INT)] + 12, list_max(v) - 38) AS t FROM a),
p AS (SELECT vec_id, list_filter(v, lambda e: e >= t) AS s, list_filter(v, lambda e: e < t) AS q FROM t)
SELECT vec_id, CASE WHEN len(s) > 0 AND len(q) > 0 THEN round(list_sum(s) / len(s) - list_sum(q) / len(q), 2) END AS snr FROM p"""


def _frames(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("i"), (c("value") / 10 - 50).alias("level"))


SPAN_SQL = """
WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value / 10 - 50 AS l FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY l, i) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n, max(l) OVER (PARTITION BY user_id) AS p FROM f),
q AS (SELECT *, max(CASE WHEN r = floor(0.1::DOUBLE * (n - 1)) THEN l END) OVER (PARTITION BY user_id) AS fl FROM r),
v AS (SELECT *, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) - 1 AS g FROM q WHERE p - fl >= 15 AND l >= greatest(fl + 30, p - 38)),
s AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS s FROM v),
m AS (SELECT user_id, s, min(i) AS a, max(i) + 1 AS b, max(n) AS n FROM s GROUP BY user_id, s),
w AS (SELECT user_id, greatest(0.0, a * 0.1::DOUBLE - 0.05::DOUBLE) AS x, least(n * 0.1::DOUBLE, b * 0.1::DOUBLE + 0.05::DOUBLE) AS y FROM m),
o AS (SELECT user_id, round(x, 4) AS start_s, round(y, 4) AS end_s FROM w WHERE y - x >= 0.22::DOUBLE UNION ALL SELECT user_id, 0.0, round(max(n) * 0.1::DOUBLE, 4) FROM q WHERE p - fl < 15 AND p > -50 GROUP BY user_id)"""


def _spans(spark, d):
    frames = _frames(spark, d).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("user_id")))
    return V.spans(frames, "user_id", "i", "level", 0.1, c("n") * 0.1, min_speech_s=0.22, min_silence_s=0.2, pad_s=0.05, margin=30.0)


QUERIES["q_vad_spans"] = lambda spark, d: _spans(spark, d).select("user_id", "span", "start_s", "end_s")
ORACLE["q_vad_spans"] = SPAN_SQL + " SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_s, end_s) AS INTEGER) AS span, start_s, end_s FROM o"
QUERIES["q_pauses"] = lambda spark, d: V.pauses(_spans(spark, d), "user_id")
ORACLE["q_pauses"] = SPAN_SQL + " SELECT user_id, count(*) - 1 AS pauses FROM o GROUP BY user_id"

QUERIES["q_centroid_cosine"] = lambda spark, d: _x(spark, d).join(V.centroid(_x(spark, d), "label", "x"), "label").select("vec_id", F.round(S.cosine(c("x"), c("centroid")), 6).alias("similarity"))
ORACLE["q_centroid_cosine"] = f"""
WITH e AS ({X_SQL}), m AS (SELECT label, i, avg(x[i]) AS v FROM e, unnest(range(1, 65)) t(i) GROUP BY label, i), k AS (SELECT label, list(v ORDER BY i) AS v FROM m GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(x, v), 6) AS similarity FROM e JOIN k ON e.label = k.label"""

QUERIES["q_array_slice"] = lambda spark, d: _x(spark, d).select("vec_id", F.size(S.cut(c("x"), F.lit(16), (c("vec_id") % 3) / 2, F.lit(1.25))).alias("n"), F.round(S.total(S.cut(c("x"), F.lit(16), (c("vec_id") % 3) / 2, F.lit(1.25))), 6).alias("total"))
ORACLE["q_array_slice"] = f"""
WITH s AS (SELECT vec_id, x[CAST(floor((vec_id % 3) / 2.0 * 16) AS INT) + 1:CAST(floor(((vec_id % 3) / 2.0 + 1.25) * 16) AS INT)] AS y FROM ({X_SQL}))
SELECT vec_id, CAST(len(y) AS INTEGER) AS n, round(list_sum(y), 6) AS total FROM s"""

QUERIES["q_char_timing"] = lambda spark, d: table(spark, d, "conversations").withColumn("chars", F.split("text", "")).withColumn(
    "stamps", F.transform(F.sequence(F.lit(1), F.char_length("text") + F.when(c("conv_id") % 4 == 0, 1).otherwise(0)), lambda i: i * 0.25)
).select("conv_id", "turn", F.when(F.size("chars") == F.size("stamps"), F.arrays_zip("chars", "stamps")).alias("z")).select(
    "conv_id", "turn", F.coalesce(F.size("z"), F.lit(0)).alias("n"), F.coalesce(F.array_max(F.transform("z", lambda s: s["stamps"])) > 25, F.lit(False)).alias("beyond")
)
ORACLE["q_char_timing"] = """
SELECT conv_id, turn, CAST(CASE WHEN conv_id % 4 = 0 THEN 0 ELSE length(text) END AS INTEGER) AS n, conv_id % 4 <> 0 AND length(text) * 0.25 > 25 AS beyond FROM conversations"""
