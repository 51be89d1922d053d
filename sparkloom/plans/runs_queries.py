"""Run statistics over orders and line items, grids over nations and regions, blind items over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import runs as R
from sparkloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}

QUERIES["q_run_report"] = lambda spark, d: R.run_report(
    table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")),
    "o_orderpriority", F.col("l_linestatus") == "F", F.col("l_discount") * 100, F.col("l_quantity"),
)
ORACLE["q_run_report"] = """
SELECT o_orderpriority, count(*) FILTER (WHERE l_linestatus = 'F') AS n_ok, count(*) FILTER (WHERE l_linestatus <> 'F') AS n_failed,
  round(median(nullif(l_discount * 100, 0.0)) FILTER (WHERE l_linestatus = 'F'), 4) AS median_duration,
  round(median(nullif(l_quantity, 0.0)) FILTER (WHERE l_linestatus = 'F'), 4) AS median_latency,
  round(avg(nullif(l_quantity, 0.0) / 1000 / nullif(l_discount * 100, 0.0)) FILTER (WHERE l_linestatus = 'F'), 6) AS mean_rtf
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"""

QUERIES["q_fallback_rate"] = lambda spark, d: R.fallback_rate(table(spark, d, "orders"), F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT")
ORACLE["q_fallback_rate"] = "SELECT round(coalesce(avg((o_orderpriority = '1-URGENT')::INT), 0.0), 6) AS fallback_rate FROM orders WHERE o_orderstatus = 'F'"



def k():
    return F.get_json_object("props", "$.k").cast("int")


QUERIES["q_dropped_controls"] = lambda spark, d: R.dropped_controls(
    table(spark, d, "events").withColumn("k", k()), "event_type",
    F.array_compact(F.array(F.when(F.col("k") % 2 == 1, "speed"), F.when(F.col("k") % 3 == 0, "emotion"), F.when(F.col("k") > 95, "seed"))),
)
ORACLE["q_dropped_controls"] = """
WITH e AS (SELECT event_type, CAST(props->>'$.k' AS INT) AS k FROM events),
c AS (SELECT event_type, unnest(list_filter([CASE WHEN k % 2 = 1 THEN 'speed' END, CASE WHEN k % 3 = 0 THEN 'emotion' END, CASE WHEN k > 95 THEN 'seed' END], lambda x: x IS NOT NULL)) AS c FROM e)
SELECT event_type, array_to_string(list_sort(list(DISTINCT c)), ',') AS controls FROM c GROUP BY event_type"""

QUERIES["q_failure_topk"] = lambda spark, d: R.failure_top(
    table(spark, d, "events").withColumn("k", k()).withColumn("error", F.when(F.col("k") % 4 == 0, F.concat(F.lit("code "), F.col("k") % 11))), "event_type", "error", "event_id", 20
)
ORACLE["q_failure_topk"] = """
WITH e AS (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events)
SELECT event_type || ': code ' || (k % 11) AS reason, count(*) AS n, min(event_id) AS first_pos FROM e WHERE k % 4 = 0 GROUP BY 1 ORDER BY n DESC, first_pos LIMIT 20"""

QUERIES["q_style_hist"] = lambda spark, d: R.histogram(table(spark, d, "events").withColumn("style", F.when(F.col("event_id") % 10 != 0, F.col("event_type"))), "style")
ORACLE["q_style_hist"] = "SELECT CASE WHEN event_id % 10 <> 0 THEN event_type ELSE '—' END AS value, count(*) AS n FROM events GROUP BY 1"

QUERIES["q_grid"] = lambda spark, d: R.grid(table(spark, d, "region").select("r_regionkey"), table(spark, d, "nation").select("n_nationkey"), 3, 4242, "n_nationkey").select(
    "r_regionkey", "n_nationkey", "repeat", "seed"
)
ORACLE["q_grid"] = """
SELECT r_regionkey, n_nationkey, CAST(r AS INTEGER) AS repeat, CAST(4242 + n_nationkey * 100 + r AS BIGINT) AS seed FROM region, nation, range(3) t(r)"""

QUERIES["q_blind_items"] = lambda spark, d: R.blind(
    table(spark, d, "documents").select(F.lit("generated").alias("kind"), F.col("doc_id").alias("key"), F.col("source").alias("candidate")),
    table(spark, d, "benchmark").select(F.lit("anchor").alias("kind"), F.col("item_id").alias("key"), F.lit("ground_truth").alias("candidate")),
    7, 500, ["candidate"],
)
ORACLE["q_blind_items"] = """
WITH r AS (SELECT 'generated' AS kind, doc_id AS key, source AS candidate FROM documents UNION ALL SELECT 'anchor', item_id, 'ground_truth' FROM benchmark),
n AS (SELECT *, row_number() OVER (ORDER BY sha256('7:' || kind || ':' || key), kind, key) AS n FROM r)
SELECT printf('item-%03d', n) AS item_id, kind, key, candidate FROM n WHERE n <= 500"""

QUERIES["q_item_text"] = lambda spark, d: (
    table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.length("text").alias("own")), "doc_id", "left")
    .withColumn("item_id", F.col("doc_id") % 40).join(table(spark, d, "benchmark").select("item_id", F.length("text").alias("anchor")), "item_id", "left")
    .select("doc_id", F.coalesce("own", "anchor").cast("long").alias("n_text"))
)
ORACLE["q_item_text"] = """
SELECT l.doc_id, CAST(coalesce(length(d.text), length(b.text)) AS BIGINT) AS n_text FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.lang = 'en'
LEFT JOIN benchmark b ON l.doc_id % 40 = b.item_id"""

QUERIES["q_derived_seed"] = lambda spark, d: table(spark, d, "part").select("p_partkey", R.derived_seed(42, F.col("p_name"), F.col("p_brand")).alias("seed"))
ORACLE["q_derived_seed"] = "SELECT p_partkey, CAST('0x' || substr(sha256('42|' || p_name || '|' || p_brand), 1, 8) AS BIGINT) AS seed FROM part"
