"""Text, dialogue and conversation queries over documents, pages, conversations, benchmark and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import alignment as A
from sparkloom.functions import text as T
from sparkloom.operators import conversation as V
from sparkloom.operators import dialogue as D
from sparkloom.operators.curation import running_new_max
from sparkloom.session import table

QUERIES: dict = {}
ORACLE: dict = {}
c = F.col

QUERIES["q_safe_name"] = lambda spark, d: table(spark, d, "pages").select("page_id", T.safe_name(c("url")).alias("name"))
ORACLE["q_safe_name"] = r"""
SELECT page_id, coalesce(nullif(substr(regexp_replace(list_last(string_split(regexp_replace(replace(url, '\', '/'), '/+$', ''), '/')), '[^\w.\-一-鿿]+', '_', 'g'), 1, 150), ''), 'file') AS name FROM pages"""

QUERIES["q_clip_id"] = lambda spark, d: table(spark, d, "pages").select("page_id", T.clip_id(F.concat(F.repeat("url", 3), F.lit(".wav"))).alias("clip_id"))
ORACLE["q_clip_id"] = r"""
WITH s AS (SELECT page_id, repeat(url, 3) || '.wav' AS p, regexp_replace(regexp_replace(repeat(url, 3) || CASE WHEN url LIKE '%/' THEN '.wav' ELSE '' END, '[^\p{L}\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)
SELECT page_id, CASE WHEN length(s) <= 120 THEN s ELSE substr(s, 1, 110) || '_' || substr(sha1(p), 1, 8) END AS clip_id FROM s"""

QUERIES["q_redact"] = lambda spark, d: table(spark, d, "documents").select("doc_id", T.redact(F.concat("text", F.lit(" sk-abcdef123456 Authorization: Bearer "), c("doc_id"), F.lit(" api_key="), c("doc_id"))).alias("text"), T.mask_secret(F.concat(F.lit("sk-"), c("doc_id"))).alias("masked"))
ORACLE["q_redact"] = """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(sk-[A-Za-z0-9_\\-]{6})[A-Za-z0-9_\\-]+', '\\1[redacted]', 'g'), '(?i)(authorization:\\s*bearer\\s+)\\S+', '\\1[redacted]', 'g'), '(?i)(api[_-]?key["''=:\\s]+)[^\\s,"''}]+', '\\1[redacted]', 'g')
  || ' sk-abcdef[redacted] Authorization: Bearer [redacted] api_key=[redacted]' AS text, 'sk-••••••••' || CASE WHEN doc_id > 99999 THEN right(doc_id::VARCHAR, 4) ELSE '' END AS masked FROM documents"""

QUERIES["q_path_rules"] = lambda spark, d: table(spark, d, "pages").withColumn("p", F.when(c("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("/a", "a\\b", "a/../b", "a//b", "a/b")]), (c("page_id") % 5 + 1).cast("int"))))).select(
    "page_id", T.path_problem(c("p")).alias("problem"), T.version(F.concat(F.lit("v1."), c("page_id") % 7, F.lit("."), c("page_id") % 5))["minor"].alias("minor")
)
ORACLE["q_path_rules"] = r"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?://', '') ELSE ['/a', 'a\b', 'a/../b', 'a//b', 'a/b'][page_id % 5 + 1] END AS p FROM pages)
SELECT page_id, CASE WHEN p LIKE '/%' OR starts_with(p, '\') THEN 'absolute' WHEN contains(p, '\') THEN 'backslash' WHEN list_contains(string_split(p, '/'), '..') THEN 'parent' WHEN list_contains(string_split(p, '/'), '') THEN 'empty part' END AS problem,
  CAST(page_id % 7 AS INTEGER) AS minor FROM p"""

QUERIES["q_speech_duration"] = lambda spark, d: table(spark, d, "documents").select("doc_id", T.speech_seconds(c("text")).alias("seconds"), T.ends_completely(c("text")).alias("complete"), F.char_length(T.one_line(c("text"))).cast("long").alias("n_line"))
ORACLE["q_speech_duration"] = r"""
SELECT doc_id, round(greatest(0.25, (2.2::DOUBLE * len(regexp_extract_all(text, '[A-Za-z0-9_.-]+'))) / 4.8::DOUBLE + len(regexp_extract_all(text, '[，。！？；：、…,.!?;:]')) * 0.18::DOUBLE), 4) AS seconds,
  regexp_matches(regexp_replace(text, '[”’）》」』"'')\s]+$', ''), '[。！？!?…吧呢吗啊呀嘛哦喔耶咯啦嘞]$') AS complete, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n_line FROM documents"""

QUERIES["q_text_rate"] = lambda spark, d: table(spark, d, "documents").select("doc_id", T.chars_per_second(c("text"), c("n_chars") / 16 + c("doc_id") % 3).alias("rate"))
ORACLE["q_text_rate"] = r"SELECT doc_id, round(length(regexp_replace(text, '\s', '', 'g')) / (n_chars / 16 + doc_id % 3), 3) AS rate FROM documents"

QUERIES["q_error_map"] = lambda spark, d: table(spark, d, "events").select("event_id", T.first_match(F.concat(F.lit("Job "), c("event_type"), F.lit(" failed: "), c("props")), [("purchase", "memory"), ("view", "missing"), ('"k": 7', "crash")], "unknown").alias("cause"))
ORACLE["q_error_map"] = """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'memory' WHEN contains(lower('job ' || event_type), 'view') THEN 'missing' WHEN contains(props, '"k": 7') THEN 'crash' ELSE 'unknown' END AS cause FROM events"""



def _log(spark, d):
    line = F.concat(F.lit("\x1b[32m====> Epoch: "), c("event_id") % 40, F.lit("\x1b[0m\rloss_gen_all="), F.round(c("value"), 1), F.lit(" loss_mel: 3.5 total_loss=2\n"))
    return table(spark, d, "events").select("user_id", "ts", "event_id", line.alias("log"))


QUERIES["q_log_parse"] = lambda spark, d: _log(spark, d).select("event_id", F.posexplode(T.log_lines(c("log"))).alias("n", "line")).select(
    "event_id", "n", F.nullif(F.regexp_extract("line", r"====> Epoch: (\d+)", 1), F.lit("")).cast("long").alias("epoch"), F.array_join(F.transform(T.losses(c("line")), lambda x: x.cast("string")), ",").alias("losses")
)
ORACLE["q_log_parse"] = """
SELECT event_id, 0 AS n, event_id % 40 AS epoch, '' AS losses FROM events UNION ALL SELECT event_id, 1, NULL, round(value, 1)::VARCHAR || ',3.5,2.0' FROM events"""

QUERIES["q_running_max"] = lambda spark, d: running_new_max(table(spark, d, "events").select("user_id", "ts", "event_id", (c("event_id") % 40).alias("epoch")), "user_id", ["ts", "event_id"], "epoch").select("user_id", "event_id", "epoch")
ORACLE["q_running_max"] = """
SELECT user_id, event_id, epoch FROM (SELECT user_id, event_id, event_id % 40 AS epoch, max(event_id % 40) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR epoch > b"""

QUERIES["q_latest_stage"] = lambda spark, d: V.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")
ORACLE["q_latest_stage"] = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"

EDGES = [("view", "click"), ("click", "purchase"), ("view", "signup"), ("signup", "view"), ("purchase", "view"), ("click", "view")]
QUERIES["q_state_transitions"] = lambda spark, d: V.illegal_transitions(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", spark.createDataFrame(EDGES, "from_state string, to_state string")).select("user_id", "event_id", "from_state", "to_state")
ORACLE["q_state_transitions"] = f"""
WITH m AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
SELECT * FROM m WHERE from_state IS NOT NULL AND from_state <> to_state AND (from_state, to_state) NOT IN ({", ".join(f"('{a}', '{b}')" for a, b in EDGES)})"""

QUERIES["q_forced_transitions"] = lambda spark, d: V.transitions(
    table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", spark.createDataFrame(EDGES, "from_state string, to_state string"), c("event_id") % 5 == 0
).select("user_id", "event_id", "from_state", "to_state", "verdict")
ORACLE["q_forced_transitions"] = f"""
WITH m AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
SELECT *, CASE WHEN (from_state, to_state) IN ({", ".join(f"('{a}', '{b}')" for a, b in EDGES)}) THEN 'legal' WHEN event_id % 5 = 0 THEN 'forced' ELSE 'illegal' END AS verdict
FROM m WHERE from_state IS NOT NULL AND from_state <> to_state"""

QUERIES["q_emit_on_change"] = lambda spark, d: V.emit_on_change(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 40000.0, "ts").select("user_id", "event_id", "event_type")
ORACLE["q_emit_on_change"] = """
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, lag(ts) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p IS NULL OR p <> event_type OR ts - t >= INTERVAL 40000 SECOND"""

QUERIES["q_first_delta_latency"] = lambda spark, d: V.first_latency(table(spark, d, "events"), "user_id", "ts", c("event_type") == "purchase", c("event_type") == "view")
ORACLE["q_first_delta_latency"] = """
SELECT user_id, round((epoch_us(f) - epoch_us(s)) / 1e6::DOUBLE, 3) AS latency_s FROM (SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS s, min(ts) FILTER (WHERE event_type = 'purchase') AS f FROM events GROUP BY user_id) WHERE f >= s"""

MESSAGES = {"view": ["state"], "click": ["audio_begin", "audio_end"], "purchase": ["turn_end"], "signup": []}
QUERIES["q_protocol_rows"] = lambda spark, d: V.project_messages(table(spark, d, "events").select("event_id", "event_type"), "event_type", MESSAGES).select("event_id", "message_pos", "message")
ORACLE["q_protocol_rows"] = f"SELECT event_id, CAST(p AS INTEGER) AS message_pos, m AS message FROM events JOIN (VALUES {', '.join(f"('{k}', {i}, '{m}')" for k, v in MESSAGES.items() for i, m in enumerate(v))}) t(k, p, m) ON event_type = k"

QUERIES["q_supersede"] = lambda spark, d: V.supersede(table(spark, d, "events").withColumn("turn", c("event_id") % 3), "user_id", ["ts", "event_id"], "turn", c("event_type") == "click").select("event_id", "applied")
ORACLE["q_supersede"] = """
SELECT event_id, CASE WHEN event_type = 'click' THEN coalesce(event_id % 3 = cur, false) ELSE true END AS applied
FROM (SELECT *, last_value(CASE WHEN event_type <> 'click' THEN event_id % 3 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM events)"""

QUERIES["q_memory_window"] = lambda spark, d: V.memory_window(table(spark, d, "conversations"), "conv_id", "turn", 2, 1).select("conv_id", "turn", "recent", "due")
ORACLE["q_memory_window"] = """
SELECT conv_id, turn, b <= 4 AS recent, b > 4 AND n - 4 >= 2 AS due FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""

QUERIES["q_extract_facts"] = lambda spark, d: V.facts(table(spark, d, "conversations"), "conv_id", "turn", "text", c("role") == "user")
ORACLE["q_extract_facts"] = r"""
WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, string_agg('- ' || CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END, chr(10) ORDER BY turn) AS facts FROM t WHERE t <> '' GROUP BY conv_id"""

QUERIES["q_transcript"] = lambda spark, d: V.transcript(table(spark, d, "conversations").filter("role <> 'system'"), "conv_id", "turn", "text", F.when(c("role") == "user", "对方").otherwise("她"))
ORACLE["q_transcript"] = "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '对方' ELSE '她' END || '：' || trim(text), chr(10) ORDER BY turn) AS transcript FROM conversations WHERE role <> 'system' GROUP BY conv_id"

QUERIES["q_summary_bound"] = lambda spark, d: V.bounded_lines(table(spark, d, "conversations").withColumn("line", c("text")), "conv_id", "turn", "line", 600).select("conv_id", "turn", V.usable_summary(c("line")).alias("usable"))
ORACLE["q_summary_bound"] = """
WITH l AS (SELECT conv_id, turn, text AS line FROM conversations),
n AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS n FROM l), o AS (SELECT *, max(n > 600) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS o FROM n)
SELECT conv_id, turn, trim(line) NOT IN ('', '无', '无。', 'none', 'None') AND NOT regexp_matches(trim(line), '^(好的|当然|以下是|作为)') AS usable FROM o WHERE NOT o"""


def _reply():
    return F.concat(F.lit("(sighs) "), F.regexp_replace("text", r"\.", "。"), F.lit(" [nods]"))


QUERIES["q_guards"] = lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", T.truncate_reply(T.strip_narration(_reply()), 60).alias("text"), T.breaks_character(c("text"), ["the", "As an AI"]).alias("breaks"), T.nearest_style(F.concat(F.lit("soft_"), c("role")), ["user", "neutral"]).alias("style"))
ORACLE["q_guards"] = r"""
WITH r AS (SELECT conv_id, turn, role, text, trim(regexp_replace('(sighs) ' || replace(text, '.', '。') || ' [nods]', '[（(\[【][^）)\]】]{0,40}[）)\]】]', '', 'g')) AS t FROM conversations),
w AS (SELECT *, regexp_extract(substr(t, 1, 60), '(?s)^.+[。！？…]') AS whole FROM r)
SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN '……' WHEN length(t) > 60 THEN CASE WHEN whole <> '' THEN whole ELSE rtrim(substr(t, 1, 60)) || '……' END ELSE t END AS text,
  CASE WHEN contains(lower(text), 'the') THEN 'the' WHEN contains(lower(text), 'as an ai') THEN 'As an AI' END AS breaks, CASE WHEN role = 'user' THEN 'user' ELSE 'neutral' END AS style FROM w"""


def _raw():
    json_ = F.to_json(F.struct(F.concat(F.lit("line "), c("event_id")).alias("text"), F.when(c("event_id") % 3 == 0, c("event_type")).alias("emotion"), F.lit(0.9).alias("confidence")))
    return F.when(c("event_id") % 4 == 0, F.concat(F.lit("plain "), c("event_id"))).otherwise(F.concat(F.lit("Sure:\n```json\n"), json_, F.lit("\n```")))


QUERIES["q_plan_parse"] = lambda spark, d: table(spark, d, "events").select("event_id", T.parse_plan(_raw(), "neutral").alias("p")).select("event_id", "p.text", "p.emotion", "p.source")
ORACLE["q_plan_parse"] = """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'plain ' ELSE 'line ' END || event_id AS text, CASE WHEN event_id % 4 <> 0 AND event_id % 3 = 0 THEN event_type ELSE 'neutral' END AS emotion,
  CASE WHEN event_id % 4 = 0 THEN 'fallback' ELSE 'parsed' END AS source FROM events"""

# -- retrieval -------------------------------------------------------------------------


def _pool(spark, d):
    t = table(spark, d, "conversations").filter("role <> 'system'")
    prior = F.lag(F.struct("role", "text")).over(W.partitionBy("conv_id").orderBy("turn"))
    x = t.withColumn("p", prior).filter("role = 'assistant' AND p.role = 'user'")
    return x.select((c("conv_id") * 100 + c("turn")).alias("pos"), c("p.text").alias("user"), c("text").alias("character"), F.when(c("turn") % 2 == 0, "soft").otherwise("plain").alias("style"))


def _queries(spark, d):
    return table(spark, d, "benchmark").select(c("item_id").alias("query_id"), c("text").alias("query"), F.when(c("item_id") % 2 == 0, "soft").alias("style"))


QUERIES["q_idf"] = lambda spark, d: D.idf(_pool(spark, d)).select("gram", F.round("idf", 6).alias("idf"))
G = r"regexp_replace({0}, '[\s，。！？、；：,.!?;:\"''“”‘’（）()\[\]【】—…·~～\-]+', '', 'g')"
POOL_SQL = """WITH t AS (SELECT *, lag(role) OVER w AS pr, lag(text) OVER w AS pt FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pool AS (SELECT conv_id * 100 + turn AS pos, pt AS u, text AS ch, CASE WHEN turn % 2 = 0 THEN 'soft' ELSE 'plain' END AS style FROM t WHERE role = 'assistant' AND pr = 'user'),
g AS (SELECT pos, style, 1.0 AS side, {0} AS s FROM pool UNION ALL SELECT pos, style, 0.35, {1} FROM pool),
grams AS (SELECT DISTINCT pos, style, side, substr(s, i, 2) AS gram FROM g, unnest(range(1, greatest(length(s), 2))) x(i) WHERE length(s) > 0),
idf AS (SELECT gram, ln(1 + (SELECT count(*) FROM pool) / (1 + count(DISTINCT pos))::DOUBLE) AS idf FROM grams GROUP BY gram)""".format(G.format("u"), G.format("ch"))
ORACLE["q_idf"] = POOL_SQL + " SELECT gram, round(idf, 6) AS idf FROM idf"

QUERIES["q_example_scores"] = lambda spark, d: D.scores(_queries(spark, d), _pool(spark, d)).select("query_id", "pos", F.round("score", 6).alias("score"))
ORACLE["q_example_scores"] = POOL_SQL + f""",
b AS (SELECT item_id, {G.format("text")} AS s FROM benchmark),
q AS (SELECT DISTINCT item_id, substr(s, i, 2) AS gram FROM b, unnest(range(1, greatest(length(s), 2))) x(i) WHERE length(s) > 0),
qw AS (SELECT item_id, q.gram, coalesce(idf, 1.0) AS w FROM q LEFT JOIN idf ON q.gram = idf.gram), ceil_ AS (SELECT item_id, sum(w) AS c FROM qw GROUP BY item_id),
h AS (SELECT item_id, pos, style, sum(w * side) AS s FROM qw JOIN grams ON qw.gram = grams.gram GROUP BY ALL)
SELECT h.item_id AS query_id, h.pos, round(s / c * CASE WHEN {G.format("p.u")} = '' THEN 0.8 ELSE 1.0 END * CASE WHEN h.item_id % 2 = 0 AND h.style = 'soft' THEN 1.6 ELSE 1.0 END, 6) AS score
FROM h JOIN ceil_ ON h.item_id = ceil_.item_id JOIN pool p ON h.pos = p.pos"""

QUERIES["q_example_topk"] = lambda spark, d: D.top_k(_queries(spark, d), _pool(spark, d), 5).select("query_id", "rank", "pos", F.round("score", 6).alias("score"))
ORACLE["q_example_topk"] = f"""
WITH s AS ({ORACLE["q_example_scores"].replace(", 6) AS score", ", 9) AS score")}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, pos, round(score, 6) AS score FROM r WHERE rank <= 5"""

QUERIES["q_example_select"] = lambda spark, d: D.select(_queries(spark, d), _pool(spark, d), 6)
DISTINCT_SQL = f"""WITH RECURSIVE turns AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, {G.format("text")} AS s FROM conversations WHERE role <> 'system'),
lines AS (SELECT conv_id, turn, i, list_distinct(list_transform(range(1, greatest(length(s), 2)), lambda k: substr(s, k, 2))) AS grams FROM turns),
walk AS (SELECT conv_id, i, turn, true AS kept, [{{'g': grams}}] AS seen FROM lines WHERE i = 1
  UNION ALL SELECT l.conv_id, l.i, l.turn, x.new, CASE WHEN x.new THEN list_append(w.seen, {{'g': l.grams}}) ELSE w.seen END
  FROM walk w JOIN lines l ON w.conv_id = l.conv_id AND l.i = w.i + 1,
    LATERAL (SELECT count(*) = 0 AS new FROM unnest(w.seen) u(k) WHERE len(list_intersect(k.g, l.grams)) >= 0.85 * len(list_distinct(list_concat(k.g, l.grams)))) x),
kept_lines AS (SELECT conv_id, turn FROM walk WHERE kept)"""
ORACLE["q_near_dup_distinct"] = DISTINCT_SQL + " SELECT * FROM kept_lines"
QUERIES["q_near_dup_distinct"] = lambda spark, d: D.distinct_lines(table(spark, d, "conversations").filter("role <> 'system'"), "conv_id", "turn", "text")
SCORED_SQL = ORACLE["q_example_scores"].replace(", 6) AS score", ", 9) AS score")
#: Turn by turn the row that is worth most: its score less a charge for likeness to the chosen ones. (Where no row of a query scores, other rules hold; no supplied query is such.)
CHOSEN_SQL = """WITH RECURSIVE sc AS ({0}), side AS (SELECT pos, list(DISTINCT substr(s, i, 2)) AS g FROM (SELECT pos, {1} AS s FROM ({2})), unnest(range(1, greatest(length(s), 2))) x(i) WHERE length(s) > 0 GROUP BY pos),
sim AS (SELECT a.pos AS a, b.pos AS b, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::DOUBLE AS sim FROM side a, side b WHERE a.pos <> b.pos),
q AS (SELECT DISTINCT query_id FROM sc), every AS (SELECT q.query_id, p.pos, coalesce(sc.score, 0.0::DOUBLE) AS score FROM q CROSS JOIN ({2}) p LEFT JOIN sc ON sc.query_id = q.query_id AND sc.pos = p.pos),
walk(query_id, turn, chosen) AS (SELECT query_id, 0, []::BIGINT[] FROM q UNION ALL
  SELECT query_id, turn + 1, list_append(chosen, pos) FROM (
    SELECT query_id, turn, chosen, pos, row_number() OVER (PARTITION BY query_id ORDER BY score - 0.55::DOUBLE * r * greatest(score, 0.2::DOUBLE) DESC, pos) AS n FROM (
      SELECT w.query_id, w.turn, w.chosen, e.pos, e.score, coalesce(max(sim.sim), 0.0::DOUBLE) AS r
      FROM walk w JOIN every e ON e.query_id = w.query_id LEFT JOIN sim ON sim.a = e.pos AND list_contains(w.chosen, sim.b) WHERE w.turn < {3} AND NOT list_contains(w.chosen, e.pos) GROUP BY w.query_id, w.turn, w.chosen, e.pos, e.score)
    WHERE r < 0.85) WHERE n = 1),
chosen AS (SELECT query_id, unnest(arg_max(chosen, turn)) AS pos FROM walk GROUP BY query_id)"""
SAID_SQL = "SELECT conv_id * 100 + turn AS pos, text AS ch FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS pr FROM conversations WHERE role <> 'system') WHERE role = 'assistant' AND pr = 'user'"
ORACLE["q_example_select"] = CHOSEN_SQL.format(SCORED_SQL, G.format("ch"), SAID_SQL, 6) + " SELECT query_id, pos FROM chosen"
QUERIES["q_distinct_documents"] = lambda spark, d: D.distinct_lines(table(spark, d, "documents").withColumn("all", F.lit("all")), "all", "doc_id", "text")
#: All documents are one group; the walk keeps the sets that stay.
ORACLE["q_distinct_documents"] = f"""
WITH RECURSIVE t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, string_split({G.format("text")}, '') AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, i, list_distinct(list_transform(range(1, greatest(len(l), 2)), lambda k: l[k] || coalesce(l[k + 1], ''))) AS grams FROM t),
walk AS (SELECT i, doc_id, true AS kept, [{{'g': grams}}] AS seen FROM lines WHERE i = 1
  UNION ALL SELECT l.i, l.doc_id, x.new, CASE WHEN x.new THEN list_append(w.seen, {{'g': l.grams}}) ELSE w.seen END FROM walk w JOIN lines l ON l.i = w.i + 1,
    LATERAL (SELECT count(*) = 0 AS new FROM unnest(w.seen) u(k) WHERE least(len(k.g), len(l.grams)) >= 0.85 * greatest(len(k.g), len(l.grams)) AND len(list_intersect(k.g, l.grams)) >= 0.85 * len(list_distinct(list_concat(k.g, l.grams)))) x)
SELECT 'all' AS "all", doc_id FROM walk WHERE kept"""
QUERIES["q_turn_context"] = lambda spark, d: (
    D.select(_queries(spark, d), _pool(spark, d), 3).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ",").alias("examples"))
    .join(V.memory_window(table(spark, d, "conversations"), "conv_id", "turn", 2, 1).filter("recent").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_recent")), c("query_id") == c("conv_id"), "left")
    .join(V.facts(table(spark, d, "conversations"), "conv_id", "turn", "text", c("role") == "user"), "conv_id", "left").select("query_id", "examples", "n_recent", "facts")
)

ORACLE["q_turn_context"] = (
    CHOSEN_SQL.format(SCORED_SQL, G.format("ch"), SAID_SQL, 3)
    + r""",
x AS (SELECT query_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS examples FROM chosen GROUP BY 1),
n AS (SELECT conv_id, count(*) AS n_recent FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 4 GROUP BY 1),
f AS ("""
    + ORACLE["q_extract_facts"]
    + """)
SELECT query_id, examples, n_recent, facts FROM x LEFT JOIN n ON x.query_id = n.conv_id LEFT JOIN f ON n.conv_id = f.conv_id"""
)

QUERIES["q_jaccard"] = lambda spark, d: _queries(spark, d).alias("a").join(_queries(spark, d).alias("b"), c("a.query_id") + 1 == c("b.query_id")).select(c("a.query_id").alias("query_id"), F.round(T.jaccard(T.bigrams(c("a.query")), T.bigrams(c("b.query"))), 6).alias("jaccard"))
ORACLE["q_jaccard"] = f"""
WITH b AS (SELECT item_id, {G.format("text")} AS s FROM benchmark), q AS (SELECT item_id, list(DISTINCT substr(s, i, 2)) AS g FROM b, unnest(range(1, length(s))) x(i) GROUP BY item_id)
SELECT a.item_id AS query_id, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS jaccard FROM q a JOIN q b ON a.item_id + 1 = b.item_id"""

QUERIES["q_anchor_set"] = lambda spark, d: table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(c("event_id") % 3 == 0, c("event_type"))).alias("a"), F.collect_set(F.when(c("event_id") % 11 == 0, c("event_type"))).alias("r")).select("user_id", F.array_join(F.array_sort(F.array_except(F.array_union("a", F.array(F.lit("anchor"))), "r")), ",").alias("anchors"))
ORACLE["q_anchor_set"] = """
WITH e AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE event_id % 3 = 0) AS a, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 11 = 0), []) AS r FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_filter(list_concat(coalesce(a, []), ['anchor']), lambda x: NOT list_contains(r, x))), ',') AS anchors FROM e"""

QUERIES["q_cer_micro"] = lambda spark, d: table(spark, d, "benchmark").alias("x").join(table(spark, d, "benchmark").alias("y"), c("x.item_id") + 1 == c("y.item_id")).select(
    F.regexp_replace("x.text", "[^A-Za-z0-9]", "").alias("r"), F.regexp_replace("y.text", "[^A-Za-z0-9]", "").alias("h")
).agg(F.round(F.sum(F.levenshtein("r", "h")) / F.sum(F.char_length("r")), 6).alias("cer"), F.count_if(F.levenshtein("r", "h") <= 0.05 * F.char_length("r")).alias("n_close"), F.count(F.lit(1)).alias("n"))
ORACLE["q_cer_micro"] = """
WITH p AS (SELECT regexp_replace(x.text, '[^A-Za-z0-9]', '', 'g') AS r, regexp_replace(y.text, '[^A-Za-z0-9]', '', 'g') AS h FROM benchmark x JOIN benchmark y ON x.item_id + 1 = y.item_id)
SELECT round(sum(levenshtein(r, h)) / sum(length(r)), 6) AS cer, count(*) FILTER (WHERE levenshtein(r, h) <= 0.05 * length(r)) AS n_close, count(*) AS n FROM p"""

QUERIES["q_token_alignment"] = lambda spark, d: table(spark, d, "benchmark").alias("x").join(table(spark, d, "benchmark").alias("y"), c("x.item_id") + 1 == c("y.item_id")).select(
    c("x.item_id"), A.aligned(T.words(c("x.text")), T.words(c("y.text"))).alias("a")
).select("item_id", "a.distance", F.array_join("a.lost", " ").alias("lost"))
#: Rows of the distance table one by one, then the path back.
ORACLE["q_token_alignment"] = """
WITH RECURSIVE b AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS t FROM benchmark), p AS (SELECT x.item_id, x.t AS r, y.t AS h FROM b x JOIN b y ON x.item_id + 1 = y.item_id),
d(item_id, i, line) AS (SELECT item_id, 0::BIGINT, range(0, len(h) + 1) FROM p UNION ALL
  SELECT item_id, i, list_reduce(list_prepend([i], list_transform(range(1, len(h) + 1), lambda j: [j])), lambda z, j: list_append(z, least(prev[j[1] + 1] + 1, z[-1] + 1, prev[j[1]] + (r[i] <> h[j[1]])::BIGINT)))
  FROM (SELECT d.item_id, d.i + 1 AS i, d.line AS prev, p.r, p.h FROM d JOIN p ON d.item_id = p.item_id WHERE d.i < len(p.r))),
w(item_id, step, i, j, lost) AS (SELECT item_id, 0, len(r), len(h), NULL::VARCHAR FROM p UNION ALL
  SELECT item_id, step + 1, i - (diagonal OR gone)::INTEGER, j - (diagonal OR NOT gone)::INTEGER, CASE WHEN gone AND NOT diagonal THEN token END FROM (
    SELECT w.item_id, w.step, w.i, w.j, p.r[w.i] AS token, coalesce(w.i > 0 AND w.j > 0 AND a.line[w.j + 1] = u.line[w.j] + (p.r[w.i] <> p.h[w.j])::BIGINT, false) AS diagonal,
      coalesce(w.i > 0 AND a.line[w.j + 1] = u.line[w.j + 1] + 1, false) AS gone
    FROM w JOIN p ON p.item_id = w.item_id JOIN d a ON a.item_id = w.item_id AND a.i = w.i LEFT JOIN d u ON u.item_id = w.item_id AND u.i = w.i - 1 WHERE w.i > 0 OR w.j > 0))
SELECT p.item_id, (SELECT line[-1] FROM d WHERE d.item_id = p.item_id AND d.i = len(p.r)) AS distance, coalesce((SELECT string_agg(lost, ' ' ORDER BY step DESC) FROM w WHERE w.item_id = p.item_id AND lost IS NOT NULL), '') AS lost FROM p"""
