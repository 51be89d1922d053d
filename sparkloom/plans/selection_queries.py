"""Splits, banks and retrieval over ``part`` (style = brand, duration = size), ``customer`` requests and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import selection as S
from sparkloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}

PARTS_SQL = "SELECT p_partkey, p_brand, p_name, p_size::DOUBLE / 4 AS duration, round(p_retailprice / 2500, 6) AS quality FROM part"


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_name", (F.col("p_size").cast("double") / 4).alias("duration"), F.round(F.col("p_retailprice") / 2500, 6).alias("quality"))


QUERIES["q_split_assign"] = lambda spark, d: S.assign_splits(_parts(spark, d), "p_brand", "quality", "p_partkey", "p_partkey", 4, 0.1).select("p_partkey", "p_brand", "split")
SPLIT_SQL = f"""
WITH s AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY quality DESC, p_partkey) - 1 AS place FROM ({PARTS_SQL})),
h AS (SELECT *, place >= n // 2 AND place < n // 2 + least(4, greatest(0, n - 2)) AS held FROM s),
r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i, count(*) OVER () AS m FROM h WHERE NOT held)
SELECT h.p_partkey, p_brand, CASE WHEN held THEN 'heldout' WHEN i <= floor(m * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM h LEFT JOIN r ON h.p_partkey = r.p_partkey"""
ORACLE["q_split_assign"] = SPLIT_SQL

QUERIES["q_export_split_counts"] = lambda spark, d: QUERIES["q_split_assign"](spark, d).filter("split <> 'heldout'").groupBy(F.when(F.col("p_brand") == "Brand#1", "train").otherwise(F.col("split")).alias("split")).agg(F.count(F.lit(1)).alias("n"))
ORACLE["q_export_split_counts"] = f"SELECT CASE WHEN p_brand = 'Brand#1' THEN 'train' ELSE split END AS split, count(*) AS n FROM ({SPLIT_SQL}) WHERE split <> 'heldout' GROUP BY 1"

QUERIES["q_bank_build"] = lambda spark, d: S.build_bank(_parts(spark, d), "p_brand", "p_name", "duration", "quality", "p_partkey", 3.5, 9.5).select("reference_id", "p_partkey", "p_brand")
ORACLE["q_bank_build"] = f"""
WITH f AS (SELECT *, CASE WHEN duration BETWEEN 3.5 AND 9.5 THEN 1.0::DOUBLE WHEN duration < 3.5 THEN duration / 3.5::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (duration - 9.5::DOUBLE) / 9.5::DOUBLE) END AS fit FROM ({PARTS_SQL})),
o AS (SELECT *, row_number() OVER (PARTITION BY p_brand, trim(p_name) ORDER BY fit DESC, quality DESC, p_partkey) AS r FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY fit DESC, quality DESC, p_partkey) AS n FROM o WHERE r = 1)
SELECT p_brand || printf('_%02d', n) AS reference_id, p_partkey, p_brand FROM n WHERE n <= 4"""

QUERIES["q_bank_minutes"] = lambda spark, d: _parts(spark, d).groupBy("p_brand").agg(F.round(F.sum("duration") / 60, 3).alias("minutes"), F.round(F.sum("duration"), 3).alias("seconds"))
ORACLE["q_bank_minutes"] = f"SELECT p_brand, round(sum(duration) / 60, 3) AS minutes, round(sum(duration), 3) AS seconds FROM ({PARTS_SQL}) GROUP BY p_brand"

QUERIES["q_bank_window_fallback"] = lambda spark, d: S.bank_with_fallback(
    _parts(spark, d).filter("p_brand <> 'Brand#2' OR duration > 9.5"), "p_brand", "duration", "quality", "p_partkey", (3.5, 9.5), (3.0, 10.0), 6.0, 6
).select("p_brand", "place", "p_partkey")
ORACLE["q_bank_window_fallback"] = f"""
WITH s AS (SELECT *, max(duration BETWEEN 3.5 AND 9.5) OVER (PARTITION BY p_brand) AS a FROM ({PARTS_SQL}) WHERE p_brand <> 'Brand#2' OR duration > 9.5),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY abs(duration - 6), quality DESC, p_partkey) AS INTEGER) AS place FROM s
  WHERE CASE WHEN a THEN duration BETWEEN 3.5 AND 9.5 ELSE duration BETWEEN 3.0 AND 10.0 END)
SELECT p_brand, place, p_partkey FROM p WHERE place <= 6"""


def _requests(spark, d):
    style = F.concat(F.lit("Brand#"), F.col("c_custkey") % 40)
    return table(spark, d, "customer").select("c_custkey", style.alias("style"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("turn-"), F.col("c_custkey"))).alias("variation_key"))


QUERIES["q_ref_select"] = lambda spark, d: S.select_references(
    _requests(spark, d),
    table(spark, d, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey") + 15).alias("name"), F.concat(F.lit("Brand#"), F.col("n_regionkey") * 8).alias("core_style")),
    _parts(spark, d).select(F.col("p_partkey").alias("reference_id"), F.col("p_brand").alias("style"), "duration", "quality"), "c_custkey", (3.5, 9.5),
)
ORACLE["q_ref_select"] = f"""
WITH q AS (SELECT c_custkey, 'Brand#' || (c_custkey % 40) AS style, CASE WHEN c_custkey % 3 <> 0 THEN 'turn-' || c_custkey END AS k FROM customer),
s AS (SELECT 'Brand#' || (n_nationkey + 15) AS name, 'Brand#' || (n_regionkey * 8) AS core FROM nation),
b AS (SELECT p_partkey AS reference_id, p_brand AS style, round(0.65::DOUBLE * quality + 0.35::DOUBLE * CASE WHEN duration BETWEEN 3.5 AND 9.5 THEN 1.0 WHEN duration < 3.5 THEN duration / 3.5::DOUBLE ELSE greatest(0.0, 1 - (duration - 9.5::DOUBLE) / 19.0::DOUBLE) END, 6) AS total FROM ({PARTS_SQL})),
c AS (SELECT c_custkey, 1 AS p, style AS s FROM q UNION ALL SELECT c_custkey, 2, core FROM q JOIN s ON q.style = s.name UNION ALL SELECT c_custkey, 3, 'neutral' FROM q),
m AS (SELECT c_custkey, arg_min(s, p) AS matched FROM c WHERE s IN (SELECT style FROM b) GROUP BY c_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY style ORDER BY total DESC, reference_id) AS r, count(*) OVER (PARTITION BY style) AS n FROM b),
g AS (SELECT *, row_number() OVER (ORDER BY total DESC, reference_id) AS r, count(*) OVER () AS n FROM b),
i AS (SELECT q.*, m.matched FROM q LEFT JOIN m ON q.c_custkey = m.c_custkey)
SELECT i.c_custkey, i.style AS requested, coalesce(r.reference_id, g.reference_id) AS reference_id, coalesce(r.style, g.style) AS matched, coalesce(i.matched, '') <> i.style AS was_fallback
FROM i LEFT JOIN r ON r.style = i.matched AND r.r = 1 + coalesce(('0x' || substr(sha256(k), 1, 16))::UBIGINT % least(3, r.n), 0)
LEFT JOIN g ON i.matched IS NULL AND g.r = 1 + coalesce(('0x' || substr(sha256(k), 1, 16))::UBIGINT % least(3, g.n), 0)"""

QUERIES["q_control_set"] = lambda spark, d: S.control_set(table(spark, d, "supplier"), "s_suppkey", 7)
ORACLE["q_control_set"] = """
WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier)
SELECT s_suppkey FROM p WHERE n > 7 AND i % greatest(1, n // 7) = 0 AND i / greatest(1, n // 7) < 7"""

QUERIES["q_best_reference"] = lambda spark, d: S.best_reference(_parts(spark, d).withColumn("kind", F.col("p_partkey") % 9), "kind", "p_brand", "Brand#12", "duration", "quality", "p_partkey")
ORACLE["q_best_reference"] = f"""
WITH s AS (SELECT *, p_partkey % 9 AS kind FROM ({PARTS_SQL})),
l AS (SELECT * FROM (SELECT *, max(p_brand = 'Brand#12') OVER (PARTITION BY kind) AS a FROM s) WHERE p_brand = 'Brand#12' OR NOT a),
f AS (SELECT * FROM (SELECT *, max(duration BETWEEN 3 AND 10) OVER (PARTITION BY kind) AS a2 FROM l) WHERE duration BETWEEN 3 AND 10 OR NOT a2)
SELECT kind, p_partkey, quality FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY quality DESC, p_partkey DESC) AS r FROM f) WHERE r = 1"""

QUERIES["q_reference_for"] = lambda spark, d: S.reference_for(
    spark.range(1, 40).select(F.concat(F.lit("Brand#"), F.col("id")).alias("p_brand")), _parts(spark, d).withColumn("p_brand", F.when(F.col("p_brand") == "Brand#5", "neutral").otherwise(F.col("p_brand"))), "p_brand", "quality", "p_partkey"
)
ORACLE["q_reference_for"] = f"""
WITH b AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#5' THEN 'neutral' ELSE p_brand END AS p_brand, quality FROM ({PARTS_SQL})),
o AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY quality DESC, p_partkey) AS r FROM b),
n AS (SELECT p_partkey FROM o WHERE p_brand = 'neutral' AND r = 1), a AS (SELECT p_partkey FROM b ORDER BY quality DESC, p_partkey LIMIT 1)
SELECT 'Brand#' || i AS p_brand, coalesce(o.p_partkey, (SELECT p_partkey FROM n), (SELECT p_partkey FROM a)) AS p_partkey FROM range(1, 40) t(i) LEFT JOIN o ON o.p_brand = 'Brand#' || i AND o.r = 1"""

QUERIES["q_first_per_style"] = lambda spark, d: S.first_per_style(
    spark.range(0, 60).select(F.concat(F.lit("Brand#"), F.col("id")).alias("p_brand")), table(spark, d, "part"), "p_brand", "p_name", "p_partkey"
)
ORACLE["q_first_per_style"] = """
WITH o AS (SELECT p_brand, arg_min(p_name, p_partkey) AS n FROM part GROUP BY p_brand)
SELECT 'Brand#' || i AS p_brand, coalesce(o.n, (SELECT arg_min(p_name, p_partkey) FROM part)) AS p_name FROM range(0, 60) t(i) LEFT JOIN o ON o.p_brand = 'Brand#' || i"""

QUERIES["q_tail_limit"] = lambda spark, d: S.tail(table(spark, d, "events"), "user_id", ["ts", "event_id"], 12).select("user_id", "event_id")
ORACLE["q_tail_limit"] = "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 12"

QUERIES["q_anchor_pick"] = lambda spark, d: table(spark, d, "orders").filter("o_orderstatus = 'F'").orderBy("o_orderkey").limit(25).select("o_orderkey").unionByName(table(spark, d, "orders").filter(F.col("o_orderkey").isin(3, 7, 11)).select("o_orderkey"))
ORACLE["q_anchor_pick"] = "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25) UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey IN (3, 7, 11)"

QUERIES["q_list_filter_limit"] = lambda spark, d: table(spark, d, "orders").filter("o_orderpriority <> '5-LOW'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")
ORACLE["q_list_filter_limit"] = "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50"

QUERIES["q_split_list"] = lambda spark, d: (
    _parts(spark, d).filter(F.col("duration").between(0.8, 15)).withColumn("o", F.sha2(F.concat(F.lit("0:"), F.col("p_partkey")), 256)).orderBy("o").limit(64).select("p_partkey", F.lit("heldout").alias("split"))
)
ORACLE["q_split_list"] = f"SELECT p_partkey, 'heldout' AS split FROM ({PARTS_SQL}) WHERE duration BETWEEN 0.8 AND 15 ORDER BY sha256('0:' || p_partkey) LIMIT 64"

REF_STYLES = lambda spark, d: table(spark, d, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey") + 15).alias("name"), F.concat(F.lit("Brand#"), F.col("n_regionkey") * 8).alias("core_style"))
REF_BANK = lambda spark, d: _parts(spark, d).select(F.col("p_partkey").alias("reference_id"), F.col("p_brand").alias("style"), "duration", "quality")
EXCLUDED = list(range(1, 60))
QUERIES["q_ref_exclude"] = lambda spark, d: S.select_references(_requests(spark, d), REF_STYLES(spark, d), REF_BANK(spark, d), "c_custkey", (3.5, 9.5), exclude=EXCLUDED)
ORACLE["q_ref_exclude"] = ORACLE["q_ref_select"].replace("FROM (" + PARTS_SQL + "))", "FROM (" + PARTS_SQL + " WHERE p_partkey >= 60))")
QUERIES["q_bank_order"] = lambda spark, d: S.by_style(_parts(spark, d), "p_brand", "quality", "p_partkey").select("p_brand", "place", "p_partkey")
ORACLE["q_bank_order"] = f"SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY quality DESC, p_partkey) AS INTEGER) AS place, p_partkey FROM ({PARTS_SQL})"
QUERIES["q_bank_resolve"] = lambda spark, d: S.resolve(
    spark.range(0, 60).select(F.concat(F.lit("Brand#"), F.col("id")).alias("p_brand")), REF_STYLES(spark, d), _parts(spark, d).filter("p_brand <> 'Brand#16'"), "p_brand", "quality", "p_partkey"
)
ORACLE["q_bank_resolve"] = f"""
WITH b AS (SELECT * FROM ({PARTS_SQL}) WHERE p_brand <> 'Brand#16'), q AS (SELECT 'Brand#' || i AS p_brand FROM range(0, 60) t(i)),
s AS (SELECT 'Brand#' || (n_nationkey + 15) AS name, 'Brand#' || (n_regionkey * 8) AS core FROM nation),
c AS (SELECT p_brand, 1 AS p, p_brand AS s FROM q UNION ALL SELECT p_brand, 2, core FROM q JOIN s ON q.p_brand = s.name),
m AS (SELECT p_brand, arg_min(s, p) AS s FROM c WHERE s IN (SELECT p_brand FROM b) GROUP BY p_brand),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY quality DESC, p_partkey) AS r, row_number() OVER (ORDER BY quality DESC, p_partkey) AS g FROM b)
SELECT m.p_brand, CAST(r AS INTEGER) AS place, p_partkey FROM m JOIN r ON m.s = r.p_brand WHERE r <= 3
UNION ALL SELECT q.p_brand, CAST(g AS INTEGER), p_partkey FROM q, r WHERE g <= 3 AND q.p_brand NOT IN (SELECT p_brand FROM m)"""
QUERIES["q_active_sources"] = lambda spark, d: S.active_sources(
    table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "bad").alias("error"), F.when(F.col("s_suppkey") % 2 == 0, "a.wav").alias("path")), "s_suppkey", "error", "path", 60
).select("s_suppkey")
ORACLE["q_active_sources"] = "SELECT s_suppkey FROM (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 60) WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0"
