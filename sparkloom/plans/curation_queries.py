"""Curation queries over documents, labels, line items, parts, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import curation as C
from sparkloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}

SEG_SQL = """SELECT l_orderkey, l_linenumber, l_quantity / 3 AS duration, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount / 5 END AS clipping, CASE WHEN l_linenumber = 2 THEN '  ' WHEN l_linenumber = 4 THEN NULL ELSE l_returnflag END AS t,
  1 - l_tax * 8 AS sim, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity / 2 END AS snr, -l_quantity AS peak, l_linestatus = 'F' AS edited, l_returnflag AS old FROM lineitem"""


def _segments(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 3).alias("duration"), F.when(n != 3, F.col("l_discount") / 5).alias("clipping"), F.when(n == 2, "  ").when(n != 4, F.col("l_returnflag")).alias("t"),
        (1 - F.col("l_tax") * 8).alias("sim"), F.when(n != 5, F.col("l_quantity") / 2).alias("snr"), (-F.col("l_quantity")).alias("peak"), (F.col("l_linestatus") == "F").alias("edited"), F.col("l_returnflag").alias("old"),
    )


c = F.col


def reason():
    return C.auto_rejection(c("duration"), c("clipping"), c("t"), c("sim"))



REASON_SQL = "CASE WHEN duration < 0.8 THEN 'too_short' WHEN duration > 15 THEN 'too_long' WHEN clipping > 0.01::DOUBLE THEN 'clipped_audio' WHEN trim(t) = '' THEN 'non_speech' WHEN sim < 0.5 THEN 'other_speaker' END"

QUERIES["q_auto_reject"] = lambda spark, d: _segments(spark, d).groupBy(F.coalesce(reason(), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 4).alias("mean_duration"))
ORACLE["q_auto_reject"] = f"SELECT coalesce({REASON_SQL}, 'kept') AS reason, count(*) AS n, round(avg(duration), 4) AS mean_duration FROM ({SEG_SQL}) GROUP BY 1"

QUERIES["q_status_partition"] = lambda spark, d: _segments(spark, d).withColumn("status", C.review_status(reason(), c("edited") & (c("l_linenumber") == 1), c("old"), True)).groupBy("status", c("status").isin("approved", "corrected").alias("usable")).agg(F.count(F.lit(1)).alias("n"))
ORACLE["q_status_partition"] = f"""
WITH s AS (SELECT CASE WHEN edited AND l_linenumber = 1 THEN old WHEN {REASON_SQL} IS NOT NULL THEN 'rejected' ELSE 'approved' END AS status FROM ({SEG_SQL}))
SELECT status, status IN ('approved', 'corrected') AS usable, count(*) AS n FROM s GROUP BY 1"""

QUERIES["q_issue_tags"] = lambda spark, d: _segments(spark, d).select(F.array_join(C.issues(c("peak"), c("clipping"), c("snr"), c("duration"), c("t"), c("sim")), ",").alias("issues")).groupBy("issues").agg(F.count(F.lit(1)).alias("n"))
ORACLE["q_issue_tags"] = f"""
SELECT array_to_string(list_filter([CASE WHEN peak < -38 THEN 'quiet' END, CASE WHEN clipping > 0.001::DOUBLE THEN 'clipping' END, CASE WHEN snr < 15 THEN 'noise' END, CASE WHEN duration < 1 THEN 'short' END, CASE WHEN duration > 15 THEN 'long' END,
  CASE WHEN coalesce(trim(t) = '', true) THEN 'no_text' END, CASE WHEN sim < 0.5 THEN 'other_speaker' END], lambda x: x IS NOT NULL), ',') AS issues, count(*) AS n FROM ({SEG_SQL}) GROUP BY 1"""

QUERIES["q_issue_histogram"] = lambda spark, d: _segments(spark, d).select(F.explode(C.issues(c("peak"), c("clipping"), c("snr"), c("duration"), c("t"), c("sim"))).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
ORACLE["q_issue_histogram"] = f"SELECT unnest(string_split(issues, ',')) AS issue, CAST(sum(n) AS BIGINT) AS n FROM ({ORACLE['q_issue_tags']}) WHERE issues <> '' GROUP BY 1"

QUERIES["q_quality_score"] = lambda spark, d: _segments(spark, d).select("l_orderkey", "l_linenumber", C.quality_score(c("clipping"), c("snr"), c("peak"), c("t"), c("duration")).alias("quality"))
ORACLE["q_quality_score"] = f"""
SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, 1.0::DOUBLE - CASE WHEN clipping IS NOT NULL THEN least(0.5, clipping * 50) ELSE 0.0 END - coalesce(CASE WHEN snr < 8 THEN least(0.35, (8 - snr) / 30) END, 0.0)
  - CASE WHEN peak < -35 THEN 0.15 ELSE 0.0 END - CASE WHEN trim(t) = '' THEN 0.3 ELSE 0.0 END - CASE WHEN duration < 0.8 THEN 0.2 ELSE 0.0 END)), 4)::DOUBLE AS quality FROM ({SEG_SQL})"""

QUERIES["q_text_tags"] = lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", F.array_join(C.text_tags(c("text")), ",").alias("tags"), C.guess_style(c("text")).alias("style"))
ORACLE["q_text_tags"] = r"""
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[？?]$') THEN 'question' END, CASE WHEN regexp_matches(text, '[！!]$') THEN 'exclamation' END, CASE WHEN contains(text, '…') THEN 'ellipsis' END,
  CASE WHEN length(text) <= 6 THEN 'short' END, CASE WHEN length(text) >= 25 THEN 'long' END], lambda x: x IS NOT NULL), ',') AS tags,
  CASE WHEN regexp_matches(text, '[！!]\s*$') THEN 'excited' WHEN contains(text, '……') OR contains(text, '...') THEN 'soft' ELSE 'neutral' END AS style FROM conversations"""

QUERIES["q_style_guess"] = lambda spark, d: table(spark, d, "documents").groupBy(C.guess_style(c("text")).alias("style")).agg(F.count(F.lit(1)).alias("n"))
ORACLE["q_style_guess"] = r"SELECT CASE WHEN regexp_matches(text, '[！!]\s*$') THEN 'excited' WHEN contains(text, '……') OR contains(text, '...') THEN 'soft' ELSE 'neutral' END AS style, count(*) AS n FROM documents GROUP BY 1"

LABELS = {"view": "neutral", "click": "happy", "purchase": "excited", "signup": ""}
QUERIES["q_label_map"] = lambda spark, d: table(spark, d, "events").select(
    "event_id", C.map_label(F.concat(F.lit(" X/"), F.upper("event_type"), F.lit("|click")), LABELS).alias("style"), F.round(C.confidence(c("value") / 100 - 3), 6).alias("confidence"), C.speed(F.when(c("event_id") % 5 == 0, 1.5), F.element_at(F.array(*[F.lit(x) for x in C.RATE]), (c("event_id") % 7 + 1).cast("int"))).alias("speed")
)
ORACLE["q_label_map"] = """
SELECT event_id, CASE event_type WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'happy' WHEN 'purchase' THEN 'excited' WHEN 'signup' THEN 'unknown' ELSE 'happy' END AS style,
  round(greatest(0.0, least(1.0, CASE WHEN value / 100 - 3 < 0 THEN 1 + (value / 100 - 3) / 5 ELSE value / 100 - 3 END)), 6) AS confidence,
  CASE WHEN event_id % 5 = 0 THEN 1.5 ELSE [0.75, 0.85, 0.93, 1.0, 1.07, 1.15, 1.3][event_id % 7 + 1] END::DOUBLE AS speed FROM events"""

STYLES = [*C.EMOTION, "other"]
QUERIES["q_emotion_vector"] = lambda spark, d: table(spark, d, "events").select(
    "event_id", F.posexplode(C.emotion_vector(F.element_at(F.array(*[F.lit(s) for s in STYLES]), (c("event_id") % 11 + 1).cast("int")), c("value") / 397 - 0.1)).alias("dim", "weight")
).filter("weight > 0")
ORACLE["q_emotion_vector"] = f"""
WITH w(style, dim, w) AS (VALUES {", ".join(f"({i}, {C.DIMS.index(d)}, {w}::DOUBLE)" for i, s in enumerate(STYLES) for d, w in C.EMOTION.get(s, C.EMOTION["neutral"]).items())})
SELECT event_id, CAST(dim AS INTEGER) AS dim, weight FROM (SELECT event_id, dim, round(w * greatest(0.0, least(1.0, value / 397 - 0.1::DOUBLE)), 4) AS weight FROM events JOIN w ON event_id % 11 = style) WHERE weight > 0"""

QUERIES["q_review_queue"] = lambda spark, d: C.review_queue(
    table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.when(c("quality").isNotNull(), (c("quality") * 2 + 1 - c("toxic")) / 3).alias("q"), "lang"), "q", "doc_id", c("lang") == "en", 100
).select("doc_id", F.round("q", 6).alias("q"))
ORACLE["q_review_queue"] = """
SELECT doc_id, round(q, 6) AS q FROM (SELECT d.doc_id, (quality * 2 + 1 - toxic) / 3 AS q, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE lang = 'en' ORDER BY coalesce(q, 1.0), doc_id LIMIT 100"""


def _review(spark, d):
    rows = table(spark, d, "documents").select(
        "doc_id", c("text").alias("transcript"), c("lang").alias("style"), F.when(c("doc_id") % 4 == 0, "approved").when(c("doc_id") % 4 == 1, "rejected").otherwise("pending").alias("status"), F.when(c("doc_id") % 4 == 1, "too_short").alias("reason"), (c("doc_id") % 9 == 0).alias("human_edited")
    )
    i = c("doc_id")
    patch = table(spark, d, "labels").select(
        "doc_id", F.when(i % 3 == 0, F.concat(F.lit("fixed "), i)).alias("p_transcript"), F.when(i % 5 == 0, "en").alias("p_style"), F.when(c("toxic") == 1, "rejected").when(c("quality") == 1, "approved").alias("p_status"), F.when(i % 2 == 0, "music").alias("p_reason"), F.when(i % 7 == 0, True).alias("p_anchor")
    )
    return C.apply_patch(rows, patch, "doc_id")


QUERIES["q_review_patch"] = _review
ORACLE["q_review_patch"] = """
WITH r AS (SELECT doc_id, text AS transcript, lang AS style, CASE doc_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN doc_id % 4 = 1 THEN 'too_short' END AS reason, doc_id % 9 = 0 AS he FROM documents),
p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fixed ' || doc_id END AS pt, CASE WHEN doc_id % 5 = 0 THEN 'en' END AS ps, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'corrected' ELSE 'approved' END END AS pst,
  CASE WHEN doc_id % 2 = 0 THEN 'music' END AS pr, doc_id % 7 = 0 AS pa FROM labels),
x AS (SELECT r.*, pt, ps, pst, pr, coalesce(pt IS NOT NULL AND pt IS DISTINCT FROM transcript, false) OR coalesce(ps IS NOT NULL AND ps IS DISTINCT FROM style, false) OR coalesce(pst IS NOT NULL AND pst IS DISTINCT FROM status, false) OR coalesce(pa, false) AS touched
  FROM r LEFT JOIN p ON r.doc_id = p.doc_id)
SELECT doc_id, coalesce(pt, transcript) AS transcript, coalesce(ps, style) AS style, coalesce(pst, status) AS status, CASE WHEN pst = 'rejected' THEN coalesce(pr, 'other') WHEN pst IS NULL THEN reason END AS reason, he OR touched AS human_edited, touched FROM x"""

QUERIES["q_upsert_merge"] = lambda spark, d: C.upsert(
    table(spark, d, "documents").filter("lang <> 'fr'").select("doc_id", F.lit("edited").alias("text"), F.lit("soft").alias("style"), (c("n_chars") > 500).alias("approved"), (c("source") == "src1").alias("human_edited")),
    table(spark, d, "documents").filter("lang <> 'de'").select("doc_id", "text", c("n_chars").alias("duration")), "doc_id",
)
ORACLE["q_upsert_merge"] = r"""
SELECT doc_id, n_chars AS duration, CASE WHEN keep THEN 'edited' ELSE t END AS text, CASE WHEN keep THEN 'soft' WHEN regexp_matches(t, '[！!]\s*$') THEN 'excited' WHEN contains(t, '……') OR contains(t, '...') THEN 'soft' ELSE 'neutral' END AS style,
  CASE WHEN keep THEN n_chars > 500 ELSE t <> '' END AS approved, lang <> 'fr' AS existed
FROM (SELECT doc_id, n_chars, lang, trim(text) AS t, lang <> 'fr' AND source = 'src1' AS keep FROM documents WHERE lang <> 'de')"""

QUERIES["q_pack_summary"] = lambda spark, d: C.pack_summary(_segments(spark, d).withColumn("pack", c("l_orderkey") % 50), "pack", "duration", reason().isNull(), 250, 1500.0)
ORACLE["q_pack_summary"] = f"""
WITH s AS (SELECT l_orderkey % 50 AS pack, duration, {REASON_SQL} IS NULL AS a FROM ({SEG_SQL}))
SELECT pack, count(*) AS clips, count(*) FILTER (WHERE a) AS approved_clips, round(coalesce(sum(duration) FILTER (WHERE a), 0.0), 1) AS usable_s, round(coalesce(sum(duration) FILTER (WHERE NOT a), 0.0), 1) AS rejected_s,
  count(*) FILTER (WHERE a) >= 250 AND coalesce(sum(duration) FILTER (WHERE a), 0.0) >= 1500 AS ready FROM s GROUP BY pack"""

QUERIES["q_long_span_split"] = lambda spark, d: C.segment_spans(
    table(spark, d, "events").groupBy("user_id").agg(F.min(F.unix_timestamp(c("ts").cast("timestamp"))).cast("double").alias("a"), F.max(F.unix_timestamp(c("ts").cast("timestamp"))).cast("double").alias("b")), "a", "b", 90000.0
).select("user_id", "piece", F.round("piece_start", 3).alias("piece_start"), F.round("piece_length", 3).alias("piece_length"))
ORACLE["q_long_span_split"] = """
WITH s AS (SELECT user_id, min(floor(epoch(ts)))::DOUBLE AS a, max(floor(epoch(ts)))::DOUBLE AS b FROM events GROUP BY user_id),
n AS (SELECT *, CAST(CASE WHEN b - a > 90000 THEN greatest(2, floor((b - a) / 90000) + 1) ELSE 1 END AS INT) AS n FROM s)
SELECT user_id, CAST(i AS INTEGER) AS piece, round(a + (b - a) / n * i, 3) AS piece_start, round((b - a) / n, 3) AS piece_length FROM n, unnest(range(n)) t(i) WHERE (b - a) / n > 0.05"""

QUERIES["q_readiness"] = lambda spark, d: C.readiness(
    table(spark, d, "customer").select(c("c_custkey").alias("id"), F.when(c("c_custkey") % 3 != 0, c("c_nationkey")).alias("connection_id"), F.when(c("c_custkey") % 5 != 0, c("c_custkey") % 120).alias("voice_id")),
    table(spark, d, "nation").filter("n_nationkey <> 4").select(c("n_nationkey").alias("id"), F.when(c("n_regionkey") == 2, "disabled").otherwise("ok").alias("status")),
    table(spark, d, "supplier").select(c("s_suppkey").alias("id"), F.when(c("s_acctbal") > 0, "ready").otherwise("failed").alias("status")), 7,
)
ORACLE["q_readiness"] = """
SELECT c_custkey AS id, array_to_string(p, ',') AS problems, len(p) = 0 AS ready FROM (SELECT c_custkey, list_filter([CASE WHEN n.n_nationkey IS NULL THEN 'no_connection' END, CASE WHEN n.n_regionkey = 2 THEN 'connection_disabled' END,
  CASE WHEN s.s_suppkey IS NULL THEN 'no_voice' END, CASE WHEN NOT s.s_acctbal > 0 THEN 'voice_not_ready' END], lambda x: x IS NOT NULL) AS p
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 4) n ON n.n_nationkey = CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey ELSE 7 END LEFT JOIN supplier s ON s.s_suppkey = CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 120 END)"""

QUERIES["q_active_conflict"] = lambda spark, d: C.conflicts(table(spark, d, "orders"), "o_custkey", c("o_orderstatus") == "O")
ORACLE["q_active_conflict"] = "SELECT o_custkey, count(*) AS n_active FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) > 1"

QUERIES["q_orphan_jobs"] = lambda spark, d: table(spark, d, "orders").join(table(spark, d, "lineitem").filter("l_quantity > 30").select(c("l_orderkey").alias("o_orderkey")).distinct().withColumn("queued", F.lit(True)), "o_orderkey", "left").select(
    "o_orderkey", F.when((c("o_orderstatus") == "O") & c("queued").isNull(), "failed").otherwise(c("o_orderstatus")).alias("status")
)
ORACLE["q_orphan_jobs"] = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30) THEN 'failed' ELSE o_orderstatus END AS status FROM orders"

QUERIES["q_fk_checks"] = lambda spark, d: table(spark, d, "supplier").join(table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(c("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").select("s_suppkey")
ORACLE["q_fk_checks"] = "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')"

QUERIES["q_default_style"] = lambda spark, d: table(spark, d, "events").select("event_id", F.when(c("event_id") % 6 != 0, c("event_type")).otherwise("unknown").alias("label")).join(
    table(spark, d, "events").select("event_type").distinct().filter("event_type <> 'view'").select(c("event_type").alias("label"), F.lit(True).alias("d")), "label", "left"
).select("event_id", C.default_style(c("label"), F.coalesce("d", F.lit(False)), F.lit(False)).alias("style"))
ORACLE["q_default_style"] = "SELECT event_id, CASE WHEN event_id % 6 <> 0 AND event_type <> 'view' THEN event_type END AS style FROM events"

QUERIES["q_segment_source"] = lambda spark, d: table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), c("l_orderkey") == c("o_orderkey"), "left").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("seconds"))
ORACLE["q_segment_source"] = "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS seconds FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"
