"""Hand-derived cases that the supplied tables don't hold: nulls, CJK, order, files and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sparkloom.functions import signal as G
from sparkloom.operators import curation as C
from sparkloom.operators import dialogue as D
from sparkloom.operators import quality as Q
from sparkloom.operators import ratings as A
from sparkloom.operators import selection as S
from sparkloom.operators import vad as V
from sparkloom.sources import exports as X
from sparkloom.sources import files as R
from sparkloom.streaming import endpointing as E
from sparkloom.streaming import replies as P
from sparkloom.streaming.drain import rocks_state


def test_fold_handles_orphans_and_single_values(spark):
    ratings = spark.createDataFrame([(1, 5, 1), (2, 3, 2), (9, 1, 1)], "item int, good int, bad int")
    key = spark.createDataFrame([(1, "a"), (2, "b")], "item int, cand string")
    got = {r.cand: r for r in A.ranked(A.fold(ratings, key, "item", "cand", ["good"], ["bad"], 6.0), "cand").collect()}
    assert got["a"].composite == 5.0 and got["b"].composite == 3.5 and got["a"].good_std == 0.0 and got["a"].rank == 1
    assert A.orphans(ratings.withColumn("rater", F.lit(1)), key, "item", "rater").first().n_orphans == 1


def test_agreement_skips_constant_raters(spark):
    rows = [("x", i, float(i), i) for i in range(4)] + [("y", i, float(2 * i), i) for i in range(4)] + [("z", i, 1.0, i) for i in range(4)]
    pairs = A.agreement_pairs(spark.createDataFrame(rows, "rater string, item int, v double, pos int"), "rater", "item", "v", ["pos"]).collect()
    assert [(p.left_rater, p.right_rater, round(p.r, 6)) for p in pairs] == [("x", "y", 1.0)]


def test_fallback_chain_and_rotation(spark):
    styles = spark.createDataFrame([("soft_teasing", "teasing")], "name string, core_style string")
    bank = spark.createDataFrame([("t1", "teasing", 5.0, 0.9), ("n1", "neutral", 5.0, 0.8)], "reference_id string, style string, duration double, quality double")
    ask = spark.createDataFrame([(1, "soft_teasing", None), (2, "angry", None), (3, "teasing", "k")], "id int, style string, variation_key string")
    got = {r.id: r for r in S.select_references(ask, styles, bank, "id", (3.5, 9.5)).collect()}
    assert got[1].reference_id == "t1" and got[1].was_fallback and got[2].reference_id == "n1" and not got[3].was_fallback
    none = S.select_references(ask, styles, bank.limit(0), "id", (3.5, 9.5)).collect()
    assert all(r.reference_id is None for r in none)


def test_control_set_empty_when_small(spark):
    assert S.control_set(spark.range(5), "id", 5).count() == 0 and S.control_set(spark.range(5), "id", 0).count() == 0
    assert [r.id for r in S.control_set(spark.range(10), "id", 3).orderBy("id").collect()] == [0, 3, 6]


def test_first_rows(spark):
    rows = spark.createDataFrame([(i * i, f"k{i:03d}") for i in range(100)] + [(None, "z"), (81, "a")], "pos long, key string")
    n = lambda k: spark.createDataFrame([(k,)], "_n long")
    want = [r.key for r in rows.orderBy(F.col("pos").asc_nulls_last(), "key").collect()]
    for k in (0, 1, 10, 11, 100, 102, 500):
        assert sorted(r.key for r in S.first_rows(rows, n(k), "pos", "key").collect()) == sorted(want[:k])
    assert S.first_rows(rows.limit(0), n(3), "pos", "key").count() == 0


def test_places_of_a_hot_group(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([1.0, 2.0, None]), i) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        table = spark.createDataFrame(rows, "style string, quality double, id int")
        got = S.placed(table, ["style"], [F.col("quality").desc_nulls_last(), F.col("id").asc()]).collect()
        best = S.best_of_style(table, "style", "quality", "id", 3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for style, quality, i in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
        want.setdefault(style, []).append(i)
    assert {r.id: (r._i, r._n) for r in got} == {i: (k, len(ids)) for ids in want.values() for k, i in enumerate(ids)}
    assert {(r.style, r.place, r.id) for r in best} == {(s, k + 1, i) for s, ids in want.items() for k, i in enumerate(ids[:3])}


def test_curation_nulls(spark):
    df = spark.createDataFrame([(2.0, None, None, None)], "d double, clip double, t string, sim double")
    r = df.select(C.auto_rejection(F.col("d"), F.col("clip"), F.col("t"), F.col("sim")).alias("r"), C.issues(F.lit(None), F.col("clip"), F.lit(None), F.col("d"), F.col("t"), F.col("sim")).alias("i"), C.quality_score(F.col("clip"), F.lit(None), F.lit(None), F.col("t"), F.col("d")).alias("q"), C.guess_style(F.lit("走开！ ")).alias("s")).first()
    assert r.r is None and r.i == ["no_text"] and r.q == 1.0 and r.s == "excited"


def test_emotion_labels(spark):
    r = spark.range(1).select(*[C.map_label(F.lit(x)).alias(str(i)) for i, x in enumerate(("生气/angry", "new|SAD", "other", ""))]).first()
    assert tuple(r) == ("angry", "sad", "unknown", "unknown")


def test_examples_prefer_relevant_and_distinct(spark):
    pool = spark.createDataFrame([(0, "你吃饭了吗", "我吃过饭了", "a"), (1, "今天天气", "天气真好", "a"), (2, "吃饭吗", "我吃过饭了", "a"), (3, "", "晚安", "b")], "pos int, user string, character string, style string")
    q = spark.createDataFrame([(1, "吃饭了吗", None), (2, "zzz", None)], "query_id int, query string, style string")
    got = {}
    for r in D.select(q, pool, 2).collect():
        got.setdefault(r.query_id, []).append(r.pos)
    assert got[1][0] in (0, 2) and not {0, 2} <= set(got[1]) and sorted(got[2]) == [0, 1]


def test_signal_edges(spark):
    r = spark.range(1).select(G.rms(F.array().cast("array<double>")).alias("a"), G.dbfs(F.lit(0.0)).alias("b"), G.frame_levels(F.array().cast("array<double>"), 4, 2).alias("c"), G.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("d"), G.percentile_floor(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 0.1).alias("e"), G.pcm_to_float(F.unhex(F.lit("00800040FF")), 32768.0).alias("f"), G.resample(F.array(F.lit(0.0), F.lit(1.0)), F.lit(3)).alias("g"), G.trimmed_stats(F.array(F.lit(100.0), F.lit(700.0))).alias("h")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (0.0, -120.0, [], 0.0, 1.0, [-1.0, 0.5], [0.0, 0.5, 1.0], None)


def test_spans_merge_gaps_and_flat_clips(spark):
    rows = [("a", i, -20.0 if 5 <= i < 10 or 12 <= i < 20 else -70.0) for i in range(40)] + [("b", i, -20.0) for i in range(10)] + [("c", i, -60.0) for i in range(10)]
    frames = spark.createDataFrame(rows, "clip string, i int, level double")
    got = V.spans(frames, "clip", "i", "level", 0.1, F.when(F.col("clip") == "a", 4.0).otherwise(1.0), pad_s=0.0).orderBy("clip", "span").collect()
    assert [(r.clip, r.start_s, r.end_s) for r in got] == [("a", 0.5, 2.0), ("b", 0.0, 1.0)]


def test_pitch_of_a_tone(spark):
    import math

    tone = [math.sin(2 * math.pi * 200 * i / 16000) for i in range(16000)]
    track = V.pitch_tracks(spark.createDataFrame([("t", tone, 16000)], "clip string, x array<double>, rate int"), "clip", "x", "rate").first().track
    assert track and all(abs(f - 200) < 6 for f in track)


def test_quality_summary(spark):
    issues = spark.createDataFrame([("error", "x", "1"), ("info", "y", "2")], Q.ISSUES)
    r = Q.passed(issues).first()
    assert (r.n_error, r.n_warning, r.n_info, r.ok) == (1, 0, 1, False) and Q.passed(issues.limit(0)).first().ok


RATING = StructType([StructField("rater", StringType()), StructField("score", IntegerType())])


def test_rating_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"rater": "a", "score": 1}]))
    (tmp_path / "b.json").write_text(json.dumps({"ratings": [{"rater": "b", "score": 2}, {"rater": "c", "score": 3}]}))
    assert sorted(r.score for r in R.ratings(spark, str(tmp_path), RATING).collect()) == [1, 2, 3]
    assert R.if_present(spark, str(tmp_path / "none.json"), lambda p: 1) is None


def test_documents_are_strict(spark, tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text('{"rater": "a", "score": 1}')
    bad.write_text('{"rater": "a", "extra": 1}')
    assert R.json_document(spark, str(good), RATING).first().score == 1
    with pytest.raises(Exception, match="unknown keys"):
        R.json_document(spark, str(bad), RATING).collect()


def test_wav_round_trip_and_scan(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(R.wav_bytes([0.0, 0.5, -2.0], 8000))
    (tmp_path / ".hidden.wav").write_bytes(b"")
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    assert {r.path.rpartition("/")[2] for r in R.scan(spark, str(tmp_path)).collect()} == {"x.wav", "bad.wav"}
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.wav"))
    got = {r.path.rpartition("/")[2]: r.samples for r in R.wav_samples(files).collect()}
    assert got["bad.wav"] is None and [round(x, 2) for x in got["x.wav"]] == [0.0, 0.5, -1.0]


def test_event_log(spark, tmp_path):
    R.append_events(spark.createDataFrame([("2024-01-01T00:00:00Z", "start", 3)], "at string, kind string, n int"), str(tmp_path / "log"))
    r = R.event_log(spark, str(tmp_path / "log")).first()
    assert r.kind == "start" and json.loads(r.fields)["n"] == 3


def test_exports(spark, tmp_path):
    samples = spark.createDataFrame([("s1", "approved", "a.wav", "x  y", "n"), ("s2", "approved", "b.wav", "z", "n"), ("s3", "rejected", "c.wav", "q", "n")], "sample_id string, status string, path string, text string, style string")
    splits = spark.createDataFrame([("s2", "heldout")], "sample_id string, split string")
    rows = X.routed(samples, splits)
    assert [r.line for r in X.pipe_list(rows, "spk").collect()] == ["a.wav|spk|ZH|x y"]
    X.write_lines(X.json_lines(X.require_training(rows)), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "split=train")).count() == 1
    with pytest.raises(ValueError, match="no sample"):
        X.require_training(rows.limit(0))
    with pytest.raises(KeyError):
        X.export("none", rows)


def frames():
    levels = [-60.0] * 10 + [-20.0] * 30 + [-60.0] * 40 + [-20.0] * 5 + [-60.0] * 40
    return [("s", i, x, False) for i, x in enumerate(levels)]


def test_endpointing(spark):
    df = spark.createDataFrame(frames(), "session string, seq long, level double, speaking boolean")
    events = [(r.seq, r.event) for r in E.endpoints(df).orderBy("seq").collect()]
    assert events == [(12, "speech_start"), (74, "speech_end"), (82, "speech_start")]  # the second is a cough
    talk = spark.createDataFrame([("s", i, -60.0 if i < 3 else -10.0, True) for i in range(12)], df.schema)
    assert [r.event for r in E.endpoints(talk, end=False).collect()] == ["barge_in"]


def stream(spark, tmp_path, name, schema, parts, build):
    folder = tmp_path / name
    folder.mkdir()
    sink = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state"))
    with rocks_state(spark):
        query = sink.start()
    try:
        for i, rows in enumerate(parts):
            (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
            query.processAllAvailable()
            time.sleep(0.1)
        return spark.table(name).collect()
    finally:
        query.stop()


def test_streamed_endpoints_equal_batch(spark, tmp_path):
    names = ("session", "seq", "level", "speaking")
    rows = [dict(zip(names, f, strict=True)) for f in frames()]
    got = stream(spark, tmp_path, "endpoints", "session string, seq long, level double, speaking boolean", [rows[:37], rows[37:20:-1] + rows[38:90], rows[90:]], lambda d: E.stream_endpoints(d, idle_ms=None))
    df = spark.createDataFrame(frames(), "session string, seq long, level double, speaking boolean")
    assert sorted((r.seq, r.event) for r in got) == sorted((r.seq, r.event) for r in E.endpoints(df, end=False).collect())


def test_streamed_chunks_and_memory(spark, tmp_path):
    text = "好的。我们现在就出发吧。路上小心一点。"
    deltas = [[{"reply": "r", "seq": i, "delta": ch, "last": i == len(text) - 1}] for i, ch in enumerate(text)]
    parts = [sum(deltas[:7], []), sum(deltas[7:], [])]
    got = sorted(stream(spark, tmp_path, "chunks", "reply string, seq long, delta string, last boolean", parts, lambda d: P.stream_chunks(d, idle_ms=None)))
    assert "".join(r.chunk for r in got) == text and [r.is_final for r in got] == [False] * (len(got) - 1) + [True]
    turns = [{"conv": "c", "turn": i, "role": "user" if i % 2 == 0 else "assistant", "text": f"句子{i}"} for i in range(8)]
    rows = stream(spark, tmp_path, "memory_fold", "conv string, turn long, role string, text string", [turns[:5], turns[5:]], lambda d: P.stream_memory(d, 1, 1, idle_ms=None))
    assert max(rows, key=lambda r: r.turn).summary.split("\n") == ["- 句子0", "- 句子2", "- 句子4"]


def test_label_pairs_and_files(spark, tmp_path):
    audio = spark.createDataFrame([("a", 6.5), ("b", 2.0), ("c", 5.9), ("d", 9.0)], "stem string, duration double")
    labels = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "w")], "stem string, text string")
    assert [r.stem for r in R.pairs(audio, labels, "stem", "duration", 2).collect()] == ["c", "a"]
    X.label_files(spark.createDataFrame([("s1", "one  line")], "sample_id string, text string"), str(tmp_path / "labels"))
    assert spark.read.text(str(tmp_path / "labels" / "sample_id=s1")).first().value == "one line"


def test_uploads_and_coverage(spark):
    files = spark.createDataFrame([("a.wav", 10, 0.1), ("b.lab", 10, None), ("c.exe", 10, None), ("d.mp3", 10, None), ("e.wav", 999, 5.0), ("f.WAV", 10, 5.0)], "name string, size long, duration double")
    got = {r.name: (r.reason, r.kind) for r in R.upload_gate(files, "name", "size", "duration", 100).collect()}
    assert got == {"a.wav": ("too short", None), "b.lab": (None, "transcript"), "c.exe": ("unsupported", None), "d.mp3": ("not audio", None), "e.wav": ("too large", None), "f.WAV": (None, "audio")}
    none = R.transcript_coverage(files.limit(0).withColumn("stem", F.col("name")), files.withColumn("stem", F.col("name")), "stem").first()
    assert none.n == 0 and none.provided is False


def test_pronunciation_hints(spark):
    from sparkloom.functions import chinese as Z

    assert spark.range(1).select(Z.hints(F.lit("重要"), {"重": "chong2", "行": "hang2"}).alias("h")).first().h == {"重": "chong2"}
