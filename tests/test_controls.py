"""Controls, speakers and saved state."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import controls as C
from sparkloom.operators import speakers as S
from sparkloom.sources import state as T


def test_controls(spark):
    r = spark.range(1).select(
        C.unsupported(F.lit("x"), F.lit(None), F.lit(1.1), F.lit(False), F.lit(False), F.lit(True)).alias("u"), C.label(F.lit(""), F.lit("e"), F.lit("m")).alias("l"), C.duration_payload(F.lit(4.0), F.lit(0.1), F.array(F.lit(0.0)), 0.5).alias("p"),
        C.instruction(F.lit("soft_teasing"), F.lit(0.9), F.lit("fast"), F.lit("normal")).alias("i"), C.tokens_per_second(F.lit(10), F.lit(0)).alias("t"), C.clamped(F.lit(9.0), 0.0, 5.0, 1.0).alias("c"), C.staged_progress(F.lit(0.2), F.lit(0.6), F.lit(0.5)).alias("g"),
    ).first()
    assert r.u == ["instruct"] and r.l == "e:m" and json.loads(r.p) == {"duration_factor": 0.5, "emo_alpha": 0.1} and r.i == "明显soft teasing的语气，语速快"
    assert r.t is None and r.c == 5.0 and math.isclose(r.g, 0.4)


@pytest.mark.parametrize(
    ("body", "problem"),
    [("[]", "not an object"), ("nonsense", "not an object"), ('{"call": ""}', "call"), ('{"call": "a", "kwargs": []}', "kwargs"), ('{"call": "a", "seed": "x"}', "seed"), ('{"call": "a", "sample_rate": 100}', "sample_rate"), ('{"call": "a", "kwargs": {"b": 1}, "seed": null, "sample_rate": 16000}', None)],
)
def test_payloads(spark, body, problem):
    assert spark.createDataFrame([(body,)], "b string").select(C.payload_problem(F.col("b")).alias("p")).first().p == problem


def test_speakers(spark):
    rows = [("p", "a", [1.0, 0.0], True), ("p", "b", [0.0, 1.0], False), ("p", "c", None, False), ("q", "d", [1.0, 1.0], False)]
    got = {r.k: (r.similarity, r.n_anchors) for r in S.similarity(spark.createDataFrame(rows, "pack string, k string, v array<double>, anchor boolean"), "pack", "k", "v", "anchor").collect()}
    assert got == {"a": (1.0, 1), "b": (0.0, 1), "d": (1.0, 0)}
    tone = [math.sin(2 * math.pi * 300 * i / 8000) for i in range(4000)]
    v = S.band_embedding(spark.createDataFrame([("t", tone, 8000, 300.0, None), ("e", [], 8000, None, None)], "k string, x array<double>, r int, m double, d double"), "k", "x", "r", "m", "d").collect()
    assert len(v[0].vector) == 13 and math.isclose(sum(z * z for z in v[0].vector), 1.0)


def test_simulated_ratings_rank_the_anchor_first(spark):
    key = spark.range(60).select(F.col("id").alias("item_id"), (F.col("id") % 3 == 0).alias("is_ground_truth"))
    got = S.simulated_ratings(key, 3)
    means = {r.is_ground_truth: r.m for r in got.join(key, "item_id").groupBy("is_ground_truth").agg(F.avg("naturalness").alias("m")).collect()}
    assert got.count() == 180 and means[True] > means[False] + 0.8 and got.exceptAll(S.simulated_ratings(key, 3)).count() == 0


def test_state(spark, tmp_path):
    folder = str(tmp_path)
    assert T.load_state(spark, folder, "p") is None
    T.save_state(spark.range(3), folder, "p")
    T.save_state(spark.range(2), folder, "p")
    assert T.load_state(spark, folder, "p").count() == 2 and T.pending(spark.range(5), T.load_state(spark, folder, "p"), "id").count() == 3
    with pytest.raises(ValueError, match="not of"):
        T.load_state(spark, folder, "other")
