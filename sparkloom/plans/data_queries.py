"""Sources, exports, quality findings, the text front end and stateful operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import chinese as Z
from sparkloom.operators import chunks as K
from sparkloom.operators import quality as Q
from sparkloom.operators import selection as S
from sparkloom.plans.chunk_sql import CHUNKS_SQL, STREAM_CHUNKS_SQL
from sparkloom.plans.text_queries import DISTINCT_SQL
from sparkloom.session import table
from sparkloom.sources import exports as X
from sparkloom.sources import files as R
from sparkloom.sources import formats
from sparkloom.streaming import blocks as B
from sparkloom.streaming import endpointing as E
from sparkloom.streaming import replies as L
from sparkloom.streaming.drain import delivered, delivered_to, shared_folder
from sparkloom.streaming.ingest import Ledger, taken_in

QUERIES: dict = {}
ORACLE: dict = {}
c = F.col


def _samples(spark, d):
    i = c("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("s"), i).alias("sample_id"), F.concat(F.lit("clips/"), i, F.lit(".wav")).alias("path"), F.concat(c("p_name"), F.lit("  "), c("p_type")).alias("text"), c("p_brand").alias("style"),
        F.when(i % 5 == 0, "pending").when(i % 7 == 0, "corrected").otherwise("approved").alias("status"), (c("p_size") / 4).alias("duration_s"), (i % 401 != 0).alias("has_audio"), (i % 3 == 0).alias("altered"), (c("p_retailprice") / 2500).alias("quality"),
    )


def _splits(spark, d):
    return table(spark, d, "part").filter("p_size > 10").select(F.concat(F.lit("s"), c("p_partkey")).alias("sample_id"), F.when(c("p_size") > 45, "heldout").when(c("p_size") > 40, "val").otherwise("train").alias("split"))


ROUTED_SQL = """SELECT * FROM (SELECT 's' || p_partkey AS sample_id, 'clips/' || p_partkey || '.wav' AS path, trim(regexp_replace(p_name || '  ' || p_type, '\\s+', ' ', 'g')) AS t, p_brand AS style,
  CASE WHEN p_size > 45 THEN 'heldout' WHEN p_size > 40 THEN 'val' ELSE 'train' END AS split FROM part WHERE p_partkey % 5 <> 0) WHERE split <> 'heldout'"""


def _routed(spark, d):
    return X.routed(_samples(spark, d), _splits(spark, d))


QUERIES["q_export_list"] = lambda spark, d: X.pipe_list(_routed(spark, d), "spk")
ORACLE["q_export_list"] = f"SELECT sample_id, split, path || '|spk|ZH|' || t AS line FROM ({ROUTED_SQL})"
QUERIES["q_export_jsonl"] = lambda spark, d: X.json_lines(_routed(spark, d))
ORACLE["q_export_jsonl"] = f"""SELECT sample_id, split, '{{"audio":"' || path || '","text":"' || t || '","style":"' || style || '"}}' AS line FROM ({ROUTED_SQL})"""
QUERIES["q_export_prompt"] = lambda spark, d: X.with_prompt(_routed(spark, d), _samples(spark, d).filter("sample_id = 's1'"))
ORACLE["q_export_prompt"] = f"""SELECT sample_id, split, '{{"audio":"' || path || '","text":"' || t || '","prompt_audio":"clips/1.wav","prompt_text":"' || (SELECT trim(regexp_replace(p_name || '  ' || p_type, '\\s+', ' ', 'g')) FROM part WHERE p_partkey = 1) || '"}}' AS line FROM ({ROUTED_SQL})"""


def _kaldi(spark, d):
    files = X.kaldi(_routed(spark, d), "spk")
    return Q.findings(*[f.select(F.lit(n).alias("file"), "split", "line") for n, f in files.items()])


QUERIES["q_export_kaldi"] = _kaldi
ORACLE["q_export_kaldi"] = f"""
WITH r AS ({ROUTED_SQL}) SELECT 'wav.scp' AS file, split, sample_id || ' ' || path AS line FROM r UNION ALL SELECT 'text', split, sample_id || ' ' || t FROM r
UNION ALL SELECT 'utt2spk', split, sample_id || ' spk' FROM r UNION ALL SELECT 'spk2utt', split, sample_id FROM r"""


def _kaldi_files(spark, d):
    """The lines of the export, written by the data source and read back from its files."""
    formats.register(spark)
    folder = f"{shared_folder(spark)}/kaldi"
    _kaldi(spark, d).select("split", "file", "line").write.format("kaldi").mode("overwrite").save(folder)
    read = spark.read.option("recursiveFileLookup", True).text(folder).select(F.split(F.input_file_name(), "/").alias("p"), c("value").alias("line"))
    return read.select(F.element_at("p", -2).alias("file"), F.element_at("p", -3).alias("split"), "line")


QUERIES["q_kaldi_files"] = _kaldi_files
ORACLE["q_kaldi_files"] = ORACLE["q_export_kaldi"]
#: All formats by their names: how many lines each has, and the digest of the first.
QUERIES["q_export_formats"] = lambda spark, d: Q.findings(
    *[X.export(n, _routed(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.md5(F.min("line")).alias("first")).select(F.lit(n).alias("format"), "split", "n", "first") for n in sorted(X.FORMATS)]
)
ORACLE["q_export_formats"] = f"""
WITH r AS ({ROUTED_SQL}), p AS (SELECT r.*, p_size::DOUBLE / 4 AS d, p_retailprice / 2500 AS q FROM r JOIN part ON sample_id = 's' || p_partkey),
b AS (SELECT split, sample_id, path, t FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY style = '' DESC, d BETWEEN 3 AND 10 DESC, q DESC, sample_id DESC) AS k FROM p) WHERE k = 1),
f AS (SELECT 'jsonl' AS format, split, '{{"audio":"' || path || '","text":"' || t || '","style":"' || style || '"}}' AS line FROM r UNION ALL SELECT 'kaldi_spk2utt', split, sample_id FROM r UNION ALL SELECT 'kaldi_text', split, sample_id || ' ' || t FROM r
  UNION ALL SELECT 'kaldi_utt2spk', split, sample_id || ' speaker' FROM r UNION ALL SELECT 'kaldi_wav', split, sample_id || ' ' || path FROM r UNION ALL SELECT 'labels', split, t FROM r UNION ALL SELECT 'list', split, path || '|speaker|ZH|' || t FROM r
  UNION ALL SELECT 'prompt', r.split, '{{"audio":"' || r.path || '","text":"' || r.t || '","prompt_audio":"' || b.path || '","prompt_text":"' || b.t || '"}}' FROM r JOIN b ON r.split = b.split UNION ALL SELECT 'reference', split, t FROM b)
SELECT format, split, count(*) AS n, md5(min(line)) AS first FROM f GROUP BY ALL"""
QUERIES["q_export_reference"] = lambda spark, d: X.best_reference(_routed(spark, d), "split", "Brand#7").select("split", "sample_id", "line")
ORACLE["q_export_reference"] = f"""
WITH r AS (SELECT r.*, p_size::DOUBLE / 4 AS d, p_retailprice / 2500 AS q FROM ({ROUTED_SQL}) r JOIN part ON sample_id = 's' || p_partkey),
l AS (SELECT * FROM (SELECT *, max(style = 'Brand#7') OVER (PARTITION BY split) AS a FROM r) WHERE style = 'Brand#7' OR NOT a),
f AS (SELECT * FROM (SELECT *, max(d BETWEEN 3 AND 10) OVER (PARTITION BY split) AS a2 FROM l) WHERE d BETWEEN 3 AND 10 OR NOT a2)
SELECT split, sample_id, t AS line FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY q DESC, sample_id DESC) AS r FROM f) WHERE r = 1"""


def _build(spark, d):
    usable = _samples(spark, d).filter(c("status").isin("approved", "corrected")).withColumn("pos", F.substring("sample_id", 2, 20).cast("long"))
    split = S.assign_splits(usable, "style", "quality", "sample_id", "pos", 3, 0.05)
    bank = S.build_bank(split.filter("split <> 'heldout'"), "style", "text", "duration_s", "quality", "sample_id", 3.5, 9.5)
    return split.join(bank.select("sample_id", "reference_id"), "sample_id", "left").groupBy("style", "split").agg(F.count(F.lit(1)).alias("n"), F.count("reference_id").alias("n_bank"), F.round(F.sum("duration_s") / 60, 3).alias("minutes"))


QUERIES["q_build_dataset"] = _build
ORACLE["q_build_dataset"] = """
WITH s AS (SELECT 's' || p_partkey AS sample_id, p_partkey AS pos, p_brand AS style, trim(p_name || '  ' || p_type) AS t, p_size::DOUBLE / 4 AS d, p_retailprice / 2500 AS q FROM part WHERE p_partkey % 5 <> 0),
h AS (SELECT *, count(*) OVER (PARTITION BY style) AS n, row_number() OVER (PARTITION BY style ORDER BY q DESC, sample_id) - 1 AS place FROM s), m AS (SELECT *, place >= n // 2 AND place < n // 2 + least(3, greatest(0, n - 2)) AS held FROM h),
r AS (SELECT sample_id, row_number() OVER (ORDER BY pos) AS i, count(*) OVER () AS k FROM m WHERE NOT held),
x AS (SELECT m.*, CASE WHEN held THEN 'heldout' WHEN i <= floor(k * 0.05::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM m LEFT JOIN r ON m.sample_id = r.sample_id),
f AS (SELECT *, CASE WHEN d BETWEEN 3.5 AND 9.5 THEN 1.0::DOUBLE WHEN d < 3.5 THEN d / 3.5::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (d - 9.5::DOUBLE) / 9.5::DOUBLE) END AS fit FROM x WHERE split <> 'heldout'),
o AS (SELECT *, row_number() OVER (PARTITION BY style, t ORDER BY fit DESC, q DESC, sample_id) AS r1 FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY style ORDER BY fit DESC, q DESC, sample_id) AS r2 FROM o WHERE r1 = 1)
SELECT x.style, x.split, count(*) AS n, count(b.sample_id) AS n_bank, round(sum(x.d) / 60, 3) AS minutes FROM x LEFT JOIN (SELECT sample_id FROM b WHERE r2 <= 4) b ON x.sample_id = b.sample_id GROUP BY 1, 2"""


def _styles(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("Brand#"), c("n_nationkey")).alias("style"))


def _validate(spark, d):
    bank = _samples(spark, d).filter("duration_s BETWEEN 3.5 AND 9.5").select(c("sample_id").alias("reference_id"), "style", F.when(c("altered"), c("text")).otherwise("").alias("transcript"), "has_audio")
    extra = _splits(spark, d).unionByName(spark.createDataFrame([("s-1", "train")], "sample_id string, split string"))
    profile = spark.createDataFrame([("hero", "other_pack", "Brand#99")], "id string, pack string, default_style string")
    wanted = spark.createDataFrame([("Brand#1",), ("Brand#77",)], "style string")
    pack, built = (spark.createDataFrame([row], "id string, version string") for row in (("pack", "1.1.0"), ("other_pack", "1.0.0")))
    return Q.findings(Q.bank_issues(pack, built), Q.bank_issues(pack, built.limit(0), required=False), Q.reference_issues(_styles(spark, d), bank), Q.dataset_issues(_styles(spark, d), _samples(spark, d), extra, 2e5), Q.profile_issues(profile, wanted, _styles(spark, d), "pack"))


QUERIES["q_validate"] = _validate
VALIDATE_SQL = """
WITH st AS (SELECT 'Brand#' || n_nationkey AS style FROM nation), s AS (SELECT 's' || p_partkey AS id, p_partkey AS i, p_brand AS style, p_size::DOUBLE / 4 AS d FROM part),
b AS (SELECT * FROM s WHERE d BETWEEN 3.5 AND 9.5), n AS (SELECT st.style, count(b.id) AS n FROM st LEFT JOIN b ON st.style = b.style GROUP BY 1), u AS (SELECT * FROM s WHERE i % 5 <> 0)
SELECT 'error' AS severity, 'references.unknown_style' AS code, id AS subject FROM b WHERE style NOT IN (SELECT style FROM st)
UNION ALL SELECT 'error', 'references.missing_audio', id FROM b WHERE i % 401 = 0 UNION ALL SELECT 'error', 'references.no_transcript', id FROM b WHERE i % 3 <> 0
UNION ALL SELECT 'error', 'references.style_empty', style FROM n WHERE n = 0 UNION ALL SELECT 'warning', 'references.style_thin', style FROM n WHERE n = 1
UNION ALL SELECT 'warning', 'dataset.too_small', round(sum(d) / 60, 2)::VARCHAR FROM u HAVING sum(d) < 2e5 * 60 UNION ALL SELECT DISTINCT 'error', 'dataset.unknown_styles', style FROM u WHERE style NOT IN (SELECT style FROM st)
UNION ALL SELECT 'error', 'dataset.missing_audio', count(*)::VARCHAR FROM u WHERE i % 401 = 0 HAVING count(*) > 0 UNION ALL SELECT 'warning', 'dataset.unreviewed', count(*)::VARCHAR FROM s WHERE i % 5 = 0 HAVING count(*) > 0
UNION ALL SELECT 'info', 'dataset.destructive_processing', count(*)::VARCHAR FROM u WHERE i % 3 = 0 HAVING count(*) > 0 UNION ALL SELECT 'error', 'dataset.unknown_sample', 's-1'
UNION ALL SELECT 'error', 'references.id_mismatch', 'other_pack' UNION ALL SELECT 'warning', 'references.version_drift', '1.0.0' UNION ALL SELECT 'info', 'references.missing', 'pack'
UNION ALL SELECT 'error', 'profile.pack_mismatch', 'hero' UNION ALL SELECT 'error', 'profile.unsupported_styles', 'Brand#77' UNION ALL SELECT 'error', 'profile.bad_default_style', 'hero'"""
ORACLE["q_validate"] = VALIDATE_SQL
QUERIES["q_validation_summary"] = lambda spark, d: Q.passed(_validate(spark, d))
ORACLE["q_validation_summary"] = f"SELECT count(*) FILTER (WHERE severity = 'error') AS n_error, count(*) FILTER (WHERE severity = 'warning') AS n_warning, count(*) FILTER (WHERE severity = 'info') AS n_info, count(*) FILTER (WHERE severity = 'error') = 0 AS ok FROM ({VALIDATE_SQL})"


def _lint(spark, d):
    spoken = table(spark, d, "conversations").filter("role <> 'system'")
    examples = spoken.select(c("conv_id").cast("string").alias("profile"), c("turn").alias("pos"), c("role").alias("style"), c("text").alias("character"), F.when(c("turn") % 3 != 0, "file").alias("source"))
    profiles = examples.select("profile").distinct().unionByName(spark.createDataFrame([("nobody",)], "profile string"))
    styles = profiles.select("profile", F.explode(F.array(F.lit("user"), F.lit("zh"))).alias("style"))
    readings = spark.createDataFrame([("1", "重", "chong2"), ("2", "重重", "9x")], "profile string, word string, reading string")
    return Q.lint(examples, styles, readings, least=4)


QUERIES["q_lint"] = _lint
LINT_SQL = DISTINCT_SQL + r""",
e AS (SELECT conv_id::VARCHAR AS profile, role AS style, text AS ch, CASE WHEN turn % 3 <> 0 THEN 'file' END AS source FROM conversations WHERE role <> 'system'),
st AS (SELECT profile, s AS style FROM (SELECT DISTINCT profile FROM e UNION ALL SELECT 'nobody'), (VALUES ('user'), ('zh')) v(s)),
dn AS (SELECT conv_id::VARCHAR AS profile, count(*) AS nd FROM kept_lines GROUP BY 1),
a AS (SELECT p.profile, count(e.ch) AS n, coalesce(any_value(nd), 0) AS nd, count(*) FILTER (WHERE e.ch IS NOT NULL AND trim(coalesce(source, '')) = '') AS us, count(*) FILTER (WHERE regexp_matches(ch, '[A-Za-z]')) AS la
  FROM (SELECT DISTINCT profile FROM st) p LEFT JOIN e ON p.profile = e.profile LEFT JOIN dn ON p.profile = dn.profile GROUP BY 1),
k AS (SELECT profile, style, count(*) AS k FROM e GROUP BY ALL), dc AS (SELECT st.profile, st.style, coalesce(k, 0) AS k FROM st LEFT JOIN k ON st.profile = k.profile AND st.style = k.style JOIN a ON st.profile = a.profile WHERE a.n > 0)
SELECT 'error' AS severity, 'profile.no_examples' AS code, profile AS subject FROM a WHERE n = 0 UNION ALL SELECT 'warning', 'profile.few_examples', profile FROM a WHERE n BETWEEN 1 AND 3
UNION ALL SELECT 'warning', 'profile.duplicate_examples', profile FROM a WHERE nd < n UNION ALL SELECT 'warning', 'profile.unsourced_examples', profile FROM a WHERE us > 0.5 * n UNION ALL SELECT 'info', 'profile.latin_in_examples', profile FROM a WHERE la > 0
UNION ALL SELECT 'error', 'profile.style_without_examples', profile || '/' || style FROM dc WHERE k = 0 UNION ALL SELECT 'warning', 'profile.thin_style', profile || '/' || style FROM dc WHERE k = 1
UNION ALL SELECT 'warning', 'profile.examples_in_undeclared_styles', profile || '/' || style FROM k WHERE style NOT IN ('user', 'zh') UNION ALL SELECT 'error', 'profile.bad_pronunciation', '2/重重' UNION ALL SELECT 'warning', 'profile.multi_char_pronunciation', '2/重重'"""
ORACLE["q_lint"] = LINT_SQL
QUERIES["q_lint_summary"] = lambda spark, d: Q.lint_summary(_lint(spark, d), table(spark, d, "conversations").select(c("conv_id").alias("profile")))
ORACLE["q_lint_summary"] = f"""
SELECT p.profile, count(*) FILTER (WHERE severity = 'error') AS n_error, count(*) FILTER (WHERE severity = 'warning') AS n_warning, count(*) FILTER (WHERE severity = 'info') AS n_info, count(*) FILTER (WHERE severity = 'error') = 0 AS ok
FROM (SELECT DISTINCT conv_id::VARCHAR AS profile FROM conversations) p LEFT JOIN ({LINT_SQL}) l ON string_split(subject, '/')[1] = p.profile GROUP BY 1"""

QUERIES["q_duplicate_ids"] = lambda spark, d: table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
ORACLE["q_duplicate_ids"] = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"

QUERIES["q_category_counts"] = lambda spark, d: table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
ORACLE["q_category_counts"] = "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL"

QUERIES["q_pipeline_summary"] = lambda spark, d: _samples(spark, d).groupBy(F.coalesce(F.when(~c("altered"), c("style")), F.when(c("has_audio"), "auto"), F.lit("unassigned")).alias("key")).agg(
    F.count(F.lit(1)).alias("n"), F.count_if(c("status") == "approved").alias("n_approved"), F.round(F.sum(F.when(c("status") != "pending", c("duration_s"))), 3).alias("usable_s")
)
ORACLE["q_pipeline_summary"] = """
SELECT coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, CASE WHEN p_partkey % 401 <> 0 THEN 'auto' END, 'unassigned') AS key, count(*) AS n, count(*) FILTER (WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0) AS n_approved,
  round(sum(p_size::DOUBLE / 4) FILTER (WHERE p_partkey % 5 <> 0), 3) AS usable_s FROM part GROUP BY 1"""



def _ratings_union(spark, d):
    """Half of the ratings as a record a line, the others nested in documents of at most 100; all are read back as one table."""
    labels = table(spark, d, "labels")
    nested = labels.filter("toxic = 0").groupBy(F.floor(c("doc_id") / 100).alias("file")).agg(F.collect_list(F.struct("doc_id", "quality", "toxic")).alias("ratings"))
    return R.unnested(nested, "ratings").unionByName(labels.filter("toxic <> 0 OR toxic IS NULL"))


QUERIES["q_ratings_union"] = _ratings_union
ORACLE["q_ratings_union"] = "SELECT doc_id, quality, toxic FROM labels"

QUERIES["q_table_counts"] = lambda spark, d: R.table_counts({n: table(spark, d, n) for n in ("orders", "pages", "documents", "events")})
ORACLE["q_table_counts"] = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("orders", "pages", "documents", "events"))
QUERIES["q_next_version"] = lambda spark, d: R.next_version(table(spark, d, "documents"), "source")
ORACLE["q_next_version"] = "SELECT source, count(*) + 1 AS version FROM documents GROUP BY source"
QUERIES["q_enabled"] = lambda spark, d: S.enabled(table(spark, d, "supplier").select("s_suppkey", F.when(c("s_suppkey") % 4 != 0, c("s_suppkey") % 3 != 0).alias("enabled"))).select("s_suppkey")
ORACLE["q_enabled"] = "SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 3 <> 0"
QUERIES["q_capped_list"] = lambda spark, d: Q.capped(table(spark, d, "orders").filter("o_orderstatus = 'F'"), "o_custkey", "o_orderkey", 5)
ORACLE["q_capped_list"] = """
WITH l AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_custkey, array_to_string(k[1:5], ', ') || CASE WHEN len(k) > 5 THEN ' (' || len(k) || ' in all)' ELSE '' END AS shown FROM l"""

QUERIES["q_incremental_ingest"] = lambda spark, d: R.ingest(table(spark, d, "pages").filter("url LIKE 'https%'").select("page_id"), table(spark, d, "pages"), "page_id", F.encode("html", "UTF-8"))
ORACLE["q_incremental_ingest"] = "SELECT page_id, sha256(html) AS sha256, CASE WHEN html IS NULL OR html = '' THEN 'empty' END AS error FROM pages WHERE url NOT LIKE 'https%'"


def _ingested(spark, d):
    """Two deliveries of pages, of which the second has all again: each page comes in once, with the batch that brought it."""
    pages = table(spark, d, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("html"))
    drops = pages.filter("url LIKE 'https%'").withColumn("delivery", F.lit(0)).unionByName(pages.withColumn("delivery", F.lit(1)))
    ledger = Ledger(spark, f"{shared_folder(spark)}/ingest")
    schema = "page_id long, sha256 string, error string, n_delivery int"
    shape = lambda new: R.ingest(new.limit(0), new, "page_id", c("html")).join(new.select("page_id", "n_delivery"), "page_id").select("page_id", "sha256", "error", "n_delivery")
    delivered_to(drops.withColumn("n_delivery", c("delivery")), "delivery", taken_in(ledger, "page_id", shape, schema))
    return ledger.rows(schema)


QUERIES["q_ingest_stream"] = _ingested
ORACLE["q_ingest_stream"] = "SELECT page_id, sha256(html) AS sha256, CASE WHEN html IS NULL OR html = '' THEN 'empty' END AS error, CASE WHEN url LIKE 'https%' THEN 0 ELSE 1 END::INTEGER AS n_delivery FROM pages"


def _uploads(spark, d):
    i = c("page_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("wav", "TXT", "exe", "mp3")]), (i % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("f"), i, F.lit("."), ext).alias("name"), F.octet_length("html").cast("long").alias("size"), F.when(i % 9 != 0, (i % 7) / 10).alias("duration"))


QUERIES["q_upload_gate"] = lambda spark, d: R.upload_gate(_uploads(spark, d), "name", "size", "duration", 4000).select("page_id", "reason", "kind")
ORACLE["q_upload_gate"] = """
WITH u AS (SELECT page_id, ['wav', 'txt', 'exe', 'mp3'][page_id % 4 + 1] AS e, strlen(html) AS size, CASE WHEN page_id % 9 <> 0 THEN (page_id % 7) / 10 END AS d FROM pages),
r AS (SELECT *, CASE WHEN size > 4000 THEN 'too large' WHEN e = 'exe' THEN 'unsupported' WHEN e <> 'txt' AND d IS NULL THEN 'not audio' WHEN e <> 'txt' AND d < 0.3 THEN 'too short' WHEN e <> 'txt' AND d > 10800 THEN 'too long' END AS reason FROM u)
SELECT page_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN e = 'txt' THEN 'transcript' ELSE 'audio' END END AS kind FROM r"""
QUERIES["q_transcript_coverage"] = lambda spark, d: R.transcript_coverage(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id", 0.35)
ORACLE["q_transcript_coverage"] = "SELECT count(*) AS n, count(l.doc_id) AS n_text, count(l.doc_id) / count(*) >= 0.35 AS provided FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
QUERIES["q_build_gate"] = lambda spark, d: Q.build_gate(_samples(spark, d).withColumn("transcript_source", F.when(c("altered"), "stub").otherwise("asr")), 20)
ORACLE["q_build_gate"] = "SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 3 = 0) AS n_stub, CASE WHEN count(*) < 20 THEN 'no approved samples' WHEN count(*) FILTER (WHERE p_partkey % 3 = 0) > 0 THEN 'stub transcripts' END AS reason FROM part WHERE p_partkey % 5 <> 0"

QUERIES["q_normalize_text"] = lambda spark, d: Z.normalized(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "spoken", "rules", "warnings")
QUERIES["q_numbers_zh"] = lambda spark, d: table(spark, d, "orders").select("o_orderkey", Z.read_numbers(c("o_totalprice").cast("long")).alias("spoken"))
D, U = "['零', '一', '二', '三', '四', '五', '六', '七', '八', '九']", "['', '十', '百', '千']"
ORACLE["q_numbers_zh"] = f"""
WITH n AS (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS n FROM orders),
g AS (SELECT o_orderkey, n, i, (n // CAST(10 ** (4 * i) AS BIGINT)) % 10000 AS v FROM n, range(0, 4) t(i)),
d AS (SELECT o_orderkey, i, v, string_agg(CASE WHEN (v // CAST(10 ** j AS BIGINT)) % 10 = 0 THEN '零' ELSE {D}[(v // CAST(10 ** j AS BIGINT)) % 10 + 1] || {U}[j + 1] END, '' ORDER BY j DESC) AS raw FROM g, range(0, 4) t(j) GROUP BY ALL),
f AS (SELECT o_orderkey, i, v, regexp_replace(regexp_replace(raw, '零+', '零', 'g'), '^零|零$', '', 'g') AS said, max(i) FILTER (WHERE v > 0) OVER (PARTITION BY o_orderkey) AS top,
  lead(v) OVER (PARTITION BY o_orderkey ORDER BY i) AS higher FROM d),
s AS (SELECT o_orderkey, string_agg(CASE WHEN v = 0 THEN '' ELSE CASE WHEN i < top AND (higher = 0 OR v < 1000) THEN '零' ELSE '' END || said || ['', '万', '亿', '万亿'][i + 1] END, '' ORDER BY i DESC) AS t FROM f GROUP BY 1)
SELECT o_orderkey, CASE WHEN t = '' THEN '零' WHEN t LIKE '一十%' THEN substr(t, 2) ELSE t END AS spoken FROM s"""
QUERIES["q_chunks"] = lambda spark, d: K.chunked(table(spark, d, "documents"), "doc_id", "text")
ORACLE["q_chunks"] = CHUNKS_SQL


def _frames(spark, d, *more):
    e = table(spark, d, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    level = F.when(F.pmod(F.floor(seq / 25), F.lit(2)) == 0, -20 - c("value") / 60).otherwise(-60 + c("value") / 200)
    return e.select(c("user_id").cast("string").alias("session"), seq.cast("long").alias("seq"), level.alias("level"), (c("event_type") == "purchase").alias("speaking"), *more)


QUERIES["q_endpointing_batch"] = lambda spark, d: E.endpoints(_frames(spark, d), E.Rules(silence_ms=200, least_ms=100))
#: One turn of the recursion is ``step`` of the endpointing module, then the flush at a session's end.
ENDPOINT_SQL = """
WITH RECURSIVE f AS (SELECT user_id::VARCHAR AS session, seq, CASE WHEN (seq // 25) % 2 = 0 THEN -20 - value / 60 ELSE -60 + value / 200 END AS level, event_type = 'purchase' AS busy
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)),
w AS (SELECT session, 0::BIGINT AS seq, NULL::DOUBLE AS fl, 0 AS voiced, 0 AS silent, 0 AS over_, false AS speaking, 0 AS ring, 0 AS kept, NULL::VARCHAR AS event, 0 AS frames FROM f WHERE seq = 1
  UNION ALL
  SELECT f.session, f.seq, b.fl, CASE WHEN c.began THEN 3 WHEN f.busy THEN w.voiced ELSE b.voiced END, CASE WHEN c.began THEN 0 WHEN f.busy THEN w.silent ELSE b.silent END,
    CASE WHEN f.busy AND NOT c.began THEN b.over_ ELSE 0 END, CASE WHEN c.began THEN true WHEN c.ended THEN false ELSE w.speaking END, CASE WHEN c.began THEN 0 ELSE b.ring END,
    CASE WHEN c.began THEN b.kept + b.ring WHEN c.ended THEN 0 ELSE b.kept END,
    CASE WHEN c.began AND f.busy THEN 'barge_in' WHEN c.began THEN 'speech_start' WHEN c.ended AND (c.long_ OR greatest(0, b.kept * 20 - 200) >= 100) THEN 'speech_end' END,
    CASE WHEN c.began THEN b.kept + b.ring ELSE b.kept END
  FROM w JOIN f ON f.session = w.session AND f.seq = w.seq + 1,
    LATERAL (SELECT w.fl IS NOT NULL AND f.level > -45 AND f.level >= w.fl + 10 AS v) a,
    LATERAL (SELECT coalesce(w.fl, f.level) + CASE WHEN w.fl IS NOT NULL AND NOT a.v THEN (f.level - w.fl) * CASE WHEN f.level < w.fl THEN 0.35::DOUBLE ELSE 0.02::DOUBLE END ELSE 0 END AS fl,
      CASE WHEN a.v THEN w.voiced + 1 ELSE 0 END AS voiced, CASE WHEN a.v THEN 0 ELSE w.silent + 1 END AS silent, CASE WHEN a.v THEN w.over_ + 1 ELSE 0 END AS over_,
      CASE WHEN w.speaking THEN w.ring ELSE least(6, w.ring + 1) END AS ring, CASE WHEN w.speaking THEN w.kept + 1 ELSE w.kept END AS kept) b,
    LATERAL (SELECT CASE WHEN f.busy THEN b.over_ >= 5 ELSE NOT w.speaking AND b.voiced >= 3 END AS began, NOT f.busy AND w.speaking AND b.kept * 20 >= 20000 AS long_,
      NOT f.busy AND w.speaking AND (b.kept * 20 >= 20000 OR b.silent * 20 >= 200) AS ended) c),
z AS (SELECT *, max(seq) OVER (PARTITION BY session) AS last FROM w)
SELECT session, seq, event, CAST(frames AS INTEGER) AS frames FROM w WHERE event IS NOT NULL"""
FLUSHED = "UNION ALL SELECT session, seq, 'speech_end', CAST(kept AS INTEGER) FROM z WHERE seq = last AND speaking AND kept * 20 >= 100"
ORACLE["q_endpointing_batch"] = f"{ENDPOINT_SQL} {FLUSHED}"


def _endpointing_stream(spark, d):
    """The frames in twenty deliveries, up to 5 hours late, and a last one long after, whose time ends all sessions."""
    hours = F.unix_timestamp("ts") / 3600
    frames = _frames(spark, d, "ts")
    late = F.pmod(F.xxhash64("session", "seq"), F.lit(5))
    first, last = (table(spark, d, "events").agg(f(hours).alias("h")) for f in (F.min, F.max))
    span = first.select(c("h").alias("h0")).crossJoin(last.select(c("h").alias("h1")))  # one row: aggregates without keys
    dealt = frames.crossJoin(F.broadcast(span)).withColumn("delivery", F.least(F.lit(19), F.floor(20 * (hours + late - c("h0")) / (c("h1") - c("h0") + 5))).cast("int")).drop("h0", "h1")
    after = table(spark, d, "events").agg(F.max("ts").alias("ts")).filter("ts IS NOT NULL").select(
        F.lit("").alias("session"), F.lit(0).cast("long").alias("seq"), F.lit(-90.0).alias("level"), F.lit(False).alias("speaking"), (c("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit(20).alias("delivery")
    )
    rules = E.Rules(silence_ms=200, least_ms=100)
    return delivered(dealt.unionByName(after), "delivery", lambda s: E.stream_endpoints(s, rules, idle_ms=90 * 86_400_000, event_time="ts", delay="6 hours"))


QUERIES["q_endpointing_stream"] = _endpointing_stream
ORACLE["q_endpointing_stream"] = ORACLE["q_endpointing_batch"]


def _samples_stream(spark, d):
    """Vectors as deliveries of samples: fifty ids are a session; deliveries come up to two batches late, a few twice."""
    x = table(spark, d, "embeddings").filter("vec_id IS NOT NULL").select(F.floor(c("vec_id") / 50).alias("session"), "vec_id", c("embedding").cast("array<double>").alias("samples"))
    rows = x.withColumn("seq", (F.row_number().over(W.partitionBy("session").orderBy("vec_id")) - 1).cast("long"))
    batch = (F.floor(c("seq") / 6) + F.pmod(F.xxhash64("vec_id"), F.lit(3))).cast("int")
    twice = F.when(c("vec_id") % 17 == 0, F.array(batch, batch + 1)).otherwise(F.array(batch))
    return rows.select(c("session").cast("string").alias("session"), "seq", "samples", F.explode(twice).alias("delivery"))


def _reblocked(spark, d):
    got = delivered(_samples_stream(spark, d), "delivery", lambda s: B.stream_blocks(s, 100, idle_ms=None))
    marks = F.transform("samples", lambda v: F.floor(256 * v).cast("long").cast("string"))
    return got.select("session", "block", F.size("samples").cast("long").alias("n"), F.md5(F.array_join(marks, ",")).alias("digest"))


QUERIES["q_reblock_stream"] = _reblocked
ORACLE["q_reblock_stream"] = """
WITH v AS (SELECT vec_id // 50 AS session, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL),
s AS (SELECT session, vec_id, unnest(embedding) AS sample, generate_subscripts(embedding, 1) AS i FROM v),
n AS (SELECT session, sample, row_number() OVER (PARTITION BY session ORDER BY vec_id, i) - 1 AS n FROM s)
SELECT session::VARCHAR AS session, n // 100 AS block, count(*) AS n, md5(string_agg(floor(256 * sample::DOUBLE)::BIGINT::VARCHAR, ',' ORDER BY n)) AS digest FROM n GROUP BY session, n // 100 HAVING count(*) = 100"""


#: Deltas of a reply are of this length; each comes a batch after the one before, from a batch of the reply's own on.
DELTA = 150


def _deltas(spark, d):
    """Replies as deltas in some micro-batches: the text goes on where the last delivery ended."""
    said = table(spark, d, "conversations").filter("trim(text) <> ''").select(F.concat_ws("/", "conv_id", "turn").alias("reply"), "text")
    n = F.ceil(F.char_length("text") / DELTA).cast("int")
    cut = said.select("reply", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    batch = F.least(F.lit(11), c("seq")) + F.pmod(F.xxhash64("reply"), F.lit(2))
    return cut.select("reply", c("seq").cast("long").alias("seq"), F.substring("text", c("seq") * DELTA + 1, F.lit(DELTA)).alias("delta"), (c("seq") == c("n") - 1).alias("last"), batch.cast("int").alias("delivery"))


QUERIES["q_stream_chunks"] = lambda spark, d: delivered(_deltas(spark, d), "delivery", lambda s: L.stream_chunks(s, idle_ms=None))
ORACLE["q_stream_chunks"] = STREAM_CHUNKS_SQL


def _turns(spark, d):
    """Turns as they come: each in a micro-batch after those before it."""
    t = table(spark, d, "conversations").select(c("conv_id").cast("string").alias("conv"), "turn", "role", "text")
    return t.withColumn("delivery", F.least(F.lit(9), F.floor(c("turn") / 2) + F.pmod(F.xxhash64("conv"), F.lit(2))).cast("int"))


QUERIES["q_stream_equals_batch"] = lambda spark, d: delivered(_turns(spark, d), "delivery", lambda s: L.stream_memory(s, max_turns=1, after_turns=1, most=90, idle_ms=None)).groupBy("conv").agg(F.max_by(F.struct("folded", "summary"), "turn").alias("x")).select("conv", "x.folded", "x.summary")
ORACLE["q_stream_equals_batch"] = r"""
WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE trim(text) <> ''),
n AS (SELECT *, 2 * greatest(0, (count(*) OVER (PARTITION BY conv_id) - 2) // 2) AS folded FROM t),
l AS (SELECT conv_id, i, '- ' || CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS line FROM n WHERE i <= folded AND role = 'user'),
k AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY i DESC) - 1 AS size FROM l),
s AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS summary FROM k WHERE size <= 90 GROUP BY 1)
SELECT n.conv_id::VARCHAR AS conv, CAST(max(folded) AS INTEGER) AS folded, coalesce(max(summary), '') AS summary FROM n LEFT JOIN s ON n.conv_id = s.conv_id GROUP BY n.conv_id"""
