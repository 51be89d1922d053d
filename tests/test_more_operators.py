"""References left out and resolved, ratings by candidate, signals, files, labels, late frames and greedy selection by brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkloom.functions import controls as C
from sparkloom.functions import signal as G
from sparkloom.functions import text as T
from sparkloom.operators import conversation as V
from sparkloom.operators import dialogue as D
from sparkloom.operators import quality as Q
from sparkloom.operators import ratings as A
from sparkloom.operators import selection as S
from sparkloom.operators import vad
from sparkloom.sources import exports as X
from sparkloom.sources import files as R
from sparkloom.sources import state
from sparkloom.streaming import endpointing as E


def test_excluded_references(spark):
    styles = spark.createDataFrame([("soft_teasing", "teasing")], "name string, core_style string")
    bank = spark.createDataFrame([("t1", "teasing", 5.0, 0.9), ("t2", "teasing", 5.0, 0.8), ("n1", "neutral", 5.0, 0.7)], "reference_id string, style string, duration double, quality double")
    ask = spark.createDataFrame([(1, "teasing", None)], "id int, style string, variation_key string")
    pick = lambda gone: S.select_references(ask, styles, bank, "id", (3.5, 9.5), exclude=gone).first()
    assert pick(["t1"]).reference_id == "t2" and pick(["t1", "t2"]).reference_id == "n1" and pick(["t1", "t2"]).was_fallback
    with pytest.raises(ValueError, match="no reference"):
        pick(["t1", "t2", "n1"])
    got = S.resolve(spark.createDataFrame([("soft_teasing",), ("angry",)], "style string"), styles, bank.filter("style <> 'neutral'"), "style", "quality", "reference_id", 5).orderBy("style", "place").collect()
    assert [(r.style, r.place, r.reference_id) for r in got] == [("angry", 1, "t1"), ("angry", 2, "t2"), ("soft_teasing", 1, "t1"), ("soft_teasing", 2, "t2")]


def test_numbered_keys(spark):
    keys = random.Random(1).sample(range(10_000), 500)
    got = S.numbered(spark.createDataFrame([(k,) for k in [*keys, 3, 3]], "k long").repartition(7), "k").collect()
    assert [r.k for r in sorted(got, key=lambda r: r._i)] == sorted([*keys, 3, 3]) and [r._i for r in sorted(got, key=lambda r: r._i)] == list(range(502)) and {r._n for r in got} == {502}


def test_ratings_by_candidate(spark):
    ratings = spark.createDataFrame([(1, 5, 1, True), (1, 4, 1, None), (2, 3, 2, False), (3, 5, 1, True), (9, 1, 1, True)], "item int, good int, bad int, real boolean")
    key = spark.createDataFrame([(1, "a", False), (2, "a", False), (3, "b", True)], "item int, cand string, truth boolean")
    labels = spark.createDataFrame([("a", "Model A")], "cand string, label string")
    got = {r.cand: r for r in A.aggregate(ratings, key, "item", "cand", ["good"], ["bad"], 6.0, "real", "anchor", "truth", labels).collect()}
    assert got["a"].believed_real_rate == 0.5 and not got["a"].is_ground_truth and got["a"].label == "Model A" and got["a"].n_items == 2
    assert got["b"].believed_real_rate == 1.0 and got["b"].is_ground_truth and got["b"].label == "b"
    bare = A.aggregate(ratings.filter("item = 1").withColumn("real", F.lit(None).cast("boolean")), key.withColumn("cand", F.lit("anchor")), "item", "cand", ["good"], ["bad"], 6.0, "real", "anchor", "truth").first()
    assert bare.believed_real_rate is None and bare.is_ground_truth


def test_forced_transitions(spark):
    rows = spark.createDataFrame([("x", i, s, f) for i, (s, f) in enumerate([("a", False), ("b", False), ("a", True), ("c", False), ("c", False)])], "k string, i int, s string, f boolean")
    legal = spark.createDataFrame([("a", "b")], "from_state string, to_state string")
    got = [(r.from_state, r.to_state, r.verdict) for r in V.transitions(rows, "k", ["i"], "s", legal, F.col("f")).orderBy("i").collect()]
    assert got == [("a", "b", "legal"), ("b", "a", "forced"), ("a", "c", "illegal")]


def test_bank_issues(spark):
    pack = spark.createDataFrame([("p", "1.1")], "id string, version string")
    codes = lambda rows, **k: sorted((r.severity, r.code) for r in Q.bank_issues(pack, spark.createDataFrame(rows, "id string, version string"), **k).collect())
    assert codes([("p", "1.1")]) == [] and codes([("p", "1.0")]) == [("warning", "references.version_drift")]
    assert codes([("q", "1.1")]) == [("error", "references.id_mismatch")] and codes([]) == [("error", "references.missing")] and codes([], required=False) == [("info", "references.missing")]
    rows = spark.createDataFrame([("k", x) for x in "cab"] + [("one", "z"), ("none", None)], "key string, v string")
    assert {r.key: r.shown for r in Q.capped(rows, "key", "v", 2).collect()} == {"k": "a, b (3 in all)", "one": "z", "none": ""}


def test_blocks_and_bytes(spark):
    x = F.array(*[F.lit(v) for v in (0.0, 1.0, -1.0, 2.0, 0.5)])
    r = spark.range(1).select(
        G.block_mean(x, 2).alias("mean"), G.block_mean(x, 1).alias("same"), G.block_mean(F.array(F.lit(1.0)), 4).alias("short"), G.blocks(x, 2).alias("two"), G.blocks(x, 9).alias("none"),
        F.hex(G.float_to_pcm(x)).alias("pcm"), G.pcm_to_float(G.float_to_pcm(x), 32767.0).alias("back"),
    ).first()
    assert r.mean == [0.5, 0.5] and r.same == [0.0, 1.0, -1.0, 2.0, 0.5] and r.short == [] and r.two == [[0.0, 1.0], [-1.0, 2.0]] and r.none == []
    assert r.pcm == "0000FF7F0180FF7F0040" and r.back[:4] == [0.0, 1.0, -1.0, 1.0] and math.isclose(r.back[4], 0.5, abs_tol=1e-4)


def voice(seconds, hz=210.0, rate=8000):
    return [0.3 * math.sin(2 * math.pi * hz * i / rate) for i in range(int(seconds * rate))]


def test_measured_and_trimmed_clips(spark):
    quiet = lambda s: [1e-6 * math.sin(i) for i in range(int(s * 8000))]
    x = quiet(0.6) + voice(0.8) + quiet(0.5) + voice(0.6) + quiet(0.5)
    clips = spark.createDataFrame([("a", x, "今天天气真好"), ("e", [], "")], "clip string, x array<double>, t string")
    rows = vad.measured(clips, "clip", "x", 8000, "t").collect()
    assert [r.clip for r in rows] == ["a"]
    r = rows[0]
    assert r.duration_s == 3.0 and abs(r.f0_mean_hz - 210) < 6 and r.pause_count == 1 and r.pauses_per_second == 0.3333 and r.chars_per_second == 2.0 and r.seconds_per_char == 0.5
    assert r.clipping_ratio == 0.0 and r.snr_db > 40 and abs(r.silence_ratio - 1.6 / 3) < 0.03 and abs(r.peak_dbfs - 20 * math.log10(0.3)) < 0.1
    found = vad.spans(vad.level_frames(clips, "clip", "x", 8000), "clip", "i", "level", 0.01, F.col("duration_s"), pad_s=0.12)
    cut = {c.clip: c for c in vad.trimmed(clips.withColumn("rate", F.lit(8000)), found, "clip", "x", "rate").collect()}
    assert abs(cut["a"].start_s - 0.48) < 0.04 and abs(cut["a"].end_s - 2.62) < 0.04 and abs(len(cut["a"].x) / 8000 - (cut["a"].end_s - cut["a"].start_s)) < 0.001
    assert cut["e"].x == [] and cut["e"].start_s == 0.0


def test_short_clips_have_no_pitch(spark):
    rows = [("short", voice(0.04), 8000), ("one", voice(0.06), 8000), ("still", [0.0] * 4000, 8000)]
    got = {r.clip: r.track for r in vad.pitch_tracks(spark.createDataFrame(rows, "clip string, x array<double>, rate int"), "clip", "x", "rate").collect()}
    assert got["short"] == [] and len(got["one"]) == 1 and abs(got["one"][0] - 210) < 6 and got["still"] == []


def test_labels(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    r = spark.range(1).select(
        F.array(*[T.duration_label(F.lit(s)) for s in (None, 0.0, 41.6, 210.0, 2520.0, 4320.0)]).alias("d"), F.array(*[T.bytes_label(F.lit(n)) for n in (900, 12288, 3565158, 1342177280)]).alias("b"),
        T.elapsed_label(at("2026-01-01 00:00:00"), at("2026-01-01 00:03:20")).alias("e"), T.elapsed_label(F.lit(None).cast("timestamp"), at("2026-01-01 00:00:00")).alias("n"), C.run_id("bench", at("2026-03-04 05:06:07")).alias("run"),
    ).first()
    assert r.d == ["0 秒", "0 秒", "42 秒", "3.5 分钟", "42 分钟", "1.2 小时"] and r.b == ["900 B", "12 KB", "3.4 MB", "1.25 GB"]
    assert r.e == "3 分 20 秒" and r.n == "—" and r.run == "bench-20260304-050607"


def test_documents_are_saved_and_read(spark, tmp_path):
    shape = StructType([StructField("name", StringType()), StructField("lang", StringType())])
    for suffix, read in (("json", R.json_document), ("yaml", R.yaml_document)):
        if suffix == "yaml":
            pytest.importorskip("yaml")
        path = str(tmp_path / f"a.{suffix}")
        R.save_document({"name": "旧"}, path, spark)
        R.save_document({"name": "名字", "lang": "zh"}, path, spark)
        assert tuple(read(spark, path, shape).first()) == ("名字", "zh")
        R.save_document({"other": 1}, path, spark)
        with pytest.raises(Exception, match="unknown keys"):
            read(spark, path, shape).collect()


def test_state_survives_an_unfinished_write(spark, tmp_path):
    folder = str(tmp_path / "s")
    state.save_state(spark.range(3), folder, "p")
    state.save_state(spark.range(4), folder, "p")
    (tmp_path / "s" / "state-000000000009-broken").mkdir()  # a version whose job didn't commit
    assert state.load_state(spark, folder, "p").count() == 4
    for n in (5, 6, 7):
        state.save_state(spark.range(n), folder, "p")
    assert state.load_state(spark, folder, "p").count() == 7 and len(state._versions(spark, folder)) == 2


def test_two_writers_never_take_one_number(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert [state._claimed(spark, folder, 1) for _ in range(3)] == [1, 2, 3]
    rows = spark.createDataFrame([(1,)], "x int")
    state.save_state(rows, folder, "p")
    assert state._versions(spark, folder)[0].startswith("state-000000000004") and state.load_state(spark, folder, "p").count() == 1


def test_formats_by_name(spark):
    X.registered("own")(lambda rows: rows.select("split", F.lit("x").alias("line")))
    try:
        assert X.export("own", spark.createDataFrame([("train",)], "split string")).first().line == "x"
        with pytest.raises(ValueError, match="own"):
            X.registered("own")(lambda rows: rows)
    finally:
        del X.FORMATS["own"]


def test_speaker_lines(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i:02d}", "approved", "train" if i % 4 else "val", "a.wav", "x", "n") for i in range(20)], "sample_id string, status string, split string, path string, text string, style string")
    X.write_speaker_lines(X.kaldi(rows, "spk")["spk2utt"], "spk", str(tmp_path / "out"), width=8)
    words = [line.value.split(" ") for line in spark.read.text(str(tmp_path / "out" / "split=train")).collect()]
    assert all(w[0] == "spk" and w[1:] == sorted(w[1:]) for w in words) and sorted(sum((w[1:] for w in words), [])) == [f"s{i:02d}" for i in range(20) if i % 4]


def test_frames_wait_for_those_before_them():
    waiting = {5: (0.0, False), 6: (0.0, False)}
    assert E._in_order(dict(waiting), -(2**62), 3).empty  # where the session begins isn't known yet
    assert E._in_order({**waiting, 8: (0.0, False)}, -(2**62), 3)["seq"].tolist() == [5, 6]
    assert E._in_order(waiting, 5, 3)["seq"].tolist() == [5, 6] and waiting == {}
    late = {3: (0.0, False), 7: (0.0, False), 9: (0.0, False)}
    assert E._in_order(late, 4, 2)["seq"].tolist() == [3, 7] and list(late) == [9]  # the walk drops 3


def plain_select(query, style, rows, limit):
    """The greedy choice over a whole pool, by its definition."""
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or ({s} if s else set())
    df, n = {}, len(rows)
    for _, user, said, _ in rows:
        for g in grams(user) | grams(said):
            df[g] = df.get(g, 0) + 1
    idf = {g: math.log(1 + n / (1 + k)) for g, k in df.items()}
    q = grams(query)
    ceiling = sum(idf.get(g, 1.0) for g in q)
    scored = []
    for pos, user, said, own in rows:
        s = sum(idf[g] for g in q & grams(user)) + 0.35 * sum(idf[g] for g in q & grams(said))
        scored.append((pos, round(s / ceiling * (0.8 if not user else 1.0) * (1.6 if own == style else 1.0), 9), grams(said)))
    like = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    chosen = []
    if len(rows) <= limit or all(s <= 0 for _, s, _ in scored):
        for r in scored:
            if len(chosen) < limit and all(like(r[2], c[2]) < 0.85 for c in chosen):
                chosen.append(r)
        return sorted(c[0] for c in chosen)
    left = list(scored)
    while left and len(chosen) < limit:
        worth = [(s - 0.55 * m * max(s, 0.2), -p, (p, s, g)) for p, s, g in left if (m := max([like(g, c[2]) for c in chosen], default=0.0)) < 0.85]
        if not worth:
            break
        best = max(worth, key=lambda w: w[:2])[2]
        chosen.append(best)
        left.remove(best)
    return sorted(c[0] for c in chosen)


@pytest.mark.parametrize("first", [4, 64])
def test_selection_equals_brute_force(spark, first):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))
    rows = [(i, word(), word(), rng.choice(["s", "t"])) for i in range(70)]
    rows += [(100 + i, "abcd", "abcdefgh"[: 7 + i % 2], "s") for i in range(12)]  # near-duplicates that crowd the top
    asks = [(1, "abcdef", "s"), (2, "hgfe", None), (3, "zzz", None), (4, "abcz", "t")]
    got = {}
    for r in D.select(spark.createDataFrame(asks, "query_id int, query string, style string"), spark.createDataFrame(rows, "pos int, user string, character string, style string"), 5, first).collect():
        got.setdefault(r.query_id, []).append(r.pos)
    assert {q: sorted(p) for q, p in got.items()} == {q: plain_select(text, style, rows, 5) for q, text, style in asks}


def test_selection_takes_one_pass_a_turn(spark):
    """Rows whose best are alike: a charge makes later choices fall below many others, for which the whole pool used to come to one task."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(3, 30)))
    rows = [(i, word(), word(), "s") for i in range(300)]
    asks = [(1, "abcdabddcab", "s"), (2, "a", None), (3, "zz", "s"), (4, "dcba", None)]
    pool, queries = spark.createDataFrame(rows, "pos int, user string, character string, style string"), spark.createDataFrame(asks, "query_id int, query string, style string")
    got, alone = {}, {}
    for r in D.select(queries, pool, 6, 7).collect():
        got.setdefault(r.query_id, []).append(r.pos)
    assert {q: sorted(p) for q, p in got.items()} == {q: plain_select(text, style, rows, 6) for q, text, style in asks}
    top = D.top_k(queries, pool, 5).collect()
    every = D.scores(queries, pool).collect()
    for r in every:
        alone.setdefault(r.query_id, []).append((-round(r.score, 9), r.pos))
    assert {(r.query_id, r["rank"], r.pos) for r in top} == {(q, k + 1, pos) for q, x in alone.items() for k, (_, pos) in enumerate(sorted(x)[:5])}
    assert not any("Exchange hash" in x for x in D.scores(queries, pool)._jdf.queryExecution().executedPlan().toString().split("\n") if "pos" in x)  # no row of the pool is shuffled
