"""Queries against their SQL on rows that the small tables lack."""

import duckdb

from sparkloom.plans import catalogue


def both(spark, tmp_path, query, name, rows, shape):
    """The rows of ``query`` and of its SQL over a table ``name`` of ``rows``."""
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = catalogue.queries()[query](spark, str(tmp_path))
    want = con.sql(catalogue.oracle_sql()[query])
    return sorted(tuple(r) for r in df.select(*want.columns).collect()), sorted(want.fetchall())


def test_amounts_of_seven_digits_and_more(spark, tmp_path):
    keys = [0, 1, 26, 27, 2702, 27026, 27027, 270270, 1_199_999, 2_702_702]
    got, want = both(spark, tmp_path, "q_spoken_stock", "part", [(k, k % 50 + 1) for k in keys], "p_partkey long, p_size int")
    assert len(want) == len(keys) and got == want


def test_rates_between_two_thousandths(spark, tmp_path):
    sizes = [(651, 1280), (323, 1280), (641, 1280), (201, 6400), (1021, 1280), (434, 512), (3, 7)]
    rows = [(3 * i, "x" * n + " " * (m - n), m) for i, (n, m) in enumerate(sizes)]
    got, want = both(spark, tmp_path, "q_text_rate", "documents", rows, "doc_id long, text string, n_chars long")
    assert len(want) == len(sizes) and got == want
