"""The registered queries: results against DuckDB where SQL exists, columns of the others, and the pipeline."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from sparkloom.llm import queries

COLUMNS = {
    "op1_minhash_near_dup": {"doc_id", "n_shingles", "component_id", "kept"}, "op5_html_text": {"page_id", "url", "text", "n_chars"}, "op7_substring_dedup": {"doc_id", "text"},
    "op6_shard": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op8_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op9_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op10_lm_score": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op12_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
}


@pytest.mark.parametrize("name", sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])))
def test_query(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    rows = df.collect()
    if name not in queries.oracle_sql():
        table = "pages" if name.startswith("op5") else "documents"
        assert COLUMNS[name] <= set(df.columns) and len(rows) == spark.read.parquet(f"{sf}/{table}.parquet").count()
        return
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    at = [list(want.columns).index(c) for c in columns]
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(tuple(flat(r[c]) for c in columns) for r in rows) == sorted(tuple(flat(r[i]) for i in at) for r in want.fetchall())


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.keep_known_language(spark, docs, sf)
    assert first.columns == docs.columns and first.count() == docs.count()  # every document there has a language
    second = corpus_pipeline.keep_one_of_near_duplicates(spark, first, sf)
    assert second.columns == docs.columns and 0 < second.count() < docs.count()
    third = corpus_pipeline.cut_repeated_passages(spark, second, sf)
    assert third.columns == docs.columns and third.filter("n_chars <> char_length(text)").count() == 0
    fourth = corpus_pipeline.mix_sources(spark, third, sf)
    assert fourth.columns == docs.columns and fourth.count() > 0
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == fourth.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dup", "substring_dedup", "mix", "bpe"] and corpus_pipeline.ORACLE_SQL is None
