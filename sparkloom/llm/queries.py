"""Queries of the training-data operators over the supplied tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, embedding_dedup, html_text, language, lm, mixing, more_sql, near_dup, periodic, sharding, substring_dedup, topk, turn_repair, url_filter

CONTRACT = {"op3": ["doc_id", "size", "source_size", "target", "taken"]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the byte-level vocabulary; the package with the files is optional until it is used."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5, scale=256)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(CONTRACT["op3"])


def op4_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(_table(spark, sf_dir, "embeddings"), least=0.93)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents")).drop("row_number")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the kept text, and the removed spans as "start-until" pairs of offsets in the original text."""
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["until"].cast("string"))), " ")
    cut = substring_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "text", F.size("removed").alias("n_removed"), "n_removed_chars", spans.alias("removed"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_language(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary())


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = periodic.periodic_runs(docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.call_function("div", 1000 * F.col("longest.length"), -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired_after_damage(_table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, q.v, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(m.vec_id, coalesce(l.b, m.vec_id)) AS component_id, least(m.vec_id, coalesce(l.b, m.vec_id)) = m.vec_id AS kept
FROM embeddings m LEFT JOIN low l ON m.vec_id = l.a LEFT JOIN deg d ON m.vec_id = d.a"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS h, md5(coalesce(text, '')) AS t FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
    / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY (source_size * 3)::DOUBLE / weight, source NULLS LAST)),
c AS (SELECT *, source_size * 3 < weight * level AS clamped FROM l),
t AS (SELECT source, source_size, CASE WHEN clamped THEN (source_size * 3)::DOUBLE ELSE weight * max(level) FILTER (WHERE NOT clamped) OVER () END AS target FROM c),
e AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 1 END AS whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY substr(h, 12, 2), h, t ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (whole + (middle < target - whole * source_size AND whole < 3)::BIGINT))::BIGINT AS taken FROM e"""


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM w, unnest(range(1, greatest(len(w), 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), s AS (SELECT g.doc_id, s, n FROM g JOIN n ON g.doc_id = n.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, least(d.doc_id, coalesce(l.b, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN low l ON d.doc_id = l.a"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_minhash_near_dup, op2_exact_top_k, op3_mix_sources, op4_embedding_near_dup, op5_html_text,
        op6_shard, op7_substring_dedup, op8_language_id, op9_bpe, op10_lm_score,
        op11_url_filter, op12_periodic_runs, op13_turn_repair,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dup": OP1_SQL, "op2_exact_top_k": OP2_SQL, "op3_mix_sources": OP3_SQL, "op4_embedding_near_dup": OP4_SQL,
            "op11_url_filter": more_sql.OP11_SQL, "op13_turn_repair": more_sql.OP13_SQL}
