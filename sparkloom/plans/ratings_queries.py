"""Rating queries: ``labels`` are the ratings, ``documents`` the blind key, ``source`` the candidate."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import ratings as R
from sparkloom.session import table

HIGH, LOW = ["quality"], ["toxic"]

QUERIES: dict = {}
ORACLE: dict = {}


def _folded(spark, d):
    return R.fold(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", HIGH, LOW, 1.0)


FOLD_SQL = """
SELECT d.source, count(*) AS n_ratings, count(DISTINCT l.doc_id) AS n_items,
  round(coalesce(avg(l.quality), 0.0), 4) AS quality_mean, round(coalesce(stddev_pop(l.quality), 0.0), 4) AS quality_std, count(l.quality) AS quality_n,
  round(coalesce(avg(l.toxic), 0.0), 4) AS toxic_mean, round(coalesce(stddev_pop(l.toxic), 0.0), 4) AS toxic_std, count(l.toxic) AS toxic_n,
  round((round(coalesce(avg(l.quality), 0.0), 4) + (1.0::DOUBLE - round(coalesce(avg(l.toxic), 0.0), 4))) / 2, 6) AS composite
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.source"""

QUERIES["q_rating_fold"] = lambda spark, d: R.ranked(_folded(spark, d), "source")
ORACLE["q_rating_fold"] = f"SELECT *, CAST(row_number() OVER (ORDER BY composite DESC NULLS LAST, source) AS INTEGER) AS rank FROM ({FOLD_SQL})"

QUERIES["q_anchor_gap"] = lambda spark, d: R.anchor_gap(_folded(spark, d), "source", "src1", HIGH, LOW)
ORACLE["q_anchor_gap"] = f"""
WITH f AS ({FOLD_SQL}), a AS (SELECT quality_mean AS aq, toxic_mean AS atox FROM f WHERE source = 'src1')
SELECT source, round(quality_mean - aq, 4) AS quality_gap, round(atox - toxic_mean, 4) AS toxic_gap FROM f, a WHERE source <> 'src1'"""

QUERIES["q_orphan_ratings"] = lambda spark, d: R.orphans(
    table(spark, d, "labels").withColumn("rater", F.col("doc_id") % 7), table(spark, d, "documents").filter("lang = 'en'").select("doc_id"), "doc_id", "rater"
)
ORACLE["q_orphan_ratings"] = """
SELECT count(*) AS n_ratings, count(*) FILTER (WHERE k.doc_id IS NULL) AS n_orphans, count(DISTINCT l.doc_id % 7) AS n_raters
FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') k ON l.doc_id = k.doc_id"""

QUERIES["q_rater_agreement"] = lambda spark, d: R.mean_agreement(table(spark, d, "events"), "user_id", "event_type", "value", ["ts", "event_id"]).select(
    "n_pairs", F.round("agreement", 6).alias("agreement")
)
ORACLE["q_rater_agreement"] = """
WITH last AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL),
p AS (SELECT a.user_id AS l, b.user_id AS r, count(*) AS n, sum(a.v) AS sx, sum(b.v) AS sy, sum(a.v * a.v) AS sxx, sum(b.v * b.v) AS syy, sum(a.v * b.v) AS sxy
  FROM last a JOIN last b ON a.event_type = b.event_type AND a.user_id < b.user_id GROUP BY ALL),
c AS (SELECT (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM p WHERE n >= 3 AND n * sxx - sx * sx > 1e-9 AND n * syy - sy * sy > 1e-9)
SELECT count(*) AS n_pairs, round(avg(r), 6) AS agreement FROM c"""


def _aggregated(spark, d):
    believed = F.when(F.col("doc_id") % 3 != 0, F.col("quality") > F.col("toxic"))
    rated = table(spark, d, "labels").withColumn("believed", believed)
    key = table(spark, d, "documents").select("doc_id", "source", (F.col("lang") == "en").alias("truth"))
    names = key.select("source").distinct().filter("source <> 'src2'").withColumn("label", F.concat(F.lit("Source "), "source"))
    return R.aggregate(rated, key, "doc_id", "source", HIGH, LOW, 1.0, "believed", "src1", "truth", names)


QUERIES["q_rating_aggregate"] = lambda spark, d: _aggregated(spark, d).select("source", "label", "n_ratings", "n_items", "quality_mean", "toxic_mean", "believed_real_rate", "is_ground_truth")
ORACLE["q_rating_aggregate"] = f"""
WITH f AS ({FOLD_SQL}), b AS (SELECT source, round(avg((quality > toxic)::INT) FILTER (WHERE l.doc_id % 3 <> 0), 4) AS believed_real_rate, bool_and(coalesce(lang = 'en', NULL)) OR source = 'src1' AS is_ground_truth
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source)
SELECT f.source, CASE WHEN f.source <> 'src2' THEN 'Source ' || f.source ELSE f.source END AS label, n_ratings, n_items, quality_mean, toxic_mean, believed_real_rate, is_ground_truth
FROM f JOIN b ON f.source = b.source"""
