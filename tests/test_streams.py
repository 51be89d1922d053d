"""Streams over many micro-batches: state that is carried, late rows, timers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import signal as S
from sparkloom.streaming import blocks as B
from sparkloom.streaming import endpointing as E
from sparkloom.streaming import replies as P
from sparkloom.streaming.drain import delivered, rocks_state

FRAMES = "session string, seq long, level double, speaking boolean, at timestamp_ntz, delivery int"


def frames(session, n, seed):
    """Loud and quiet stretches of a session, a frame a second."""
    rng = random.Random(seed)
    loud = [i // rng.choice([9, 14, 23]) % 2 == 1 for i in range(n)]
    return [(session, i, (-15.0 if x else -62.0) + rng.random(), rng.random() < 0.03) for i, x in enumerate(loud)]


def stamped(rows, delivery_of):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    return [(s, i, x, b, start + datetime.timedelta(seconds=i), delivery_of(i)) for s, i, x, b in rows]


@pytest.fixture(scope="module")
def walks(spark):
    rows = frames("a", 160, 1) + frames("b", 120, 2)
    rules = E.Rules(silence_ms=100, least_ms=60)
    whole = E.endpoints(spark.createDataFrame(stamped(rows, lambda i: 0), FRAMES), rules)
    return rows, rules, sorted(tuple(r) for r in whole.collect())


def test_frames_in_any_deliveries(spark, walks):
    rows, rules, want = walks
    rng = random.Random(4)
    table = spark.createDataFrame(stamped(rows, lambda i: (i + rng.randint(0, 8)) // 24), FRAMES)
    got = delivered(table.drop("at"), "delivery", lambda s: E.stream_endpoints(s, rules, late=10, idle_ms=None))
    found = sorted(tuple(r) for r in got.collect())
    last = {s: max(r[1] for r in rows if r[0] == s) for s in "ab"}
    assert set(found) <= set(want) and all(x in found for x in want if x[1] < last[x[0]] - 12)  # the newest frames still wait


def test_frames_by_event_time_end_when_idle(spark, walks):
    rows, rules, want = walks
    rng = random.Random(5)
    dealt = stamped(rows, lambda i: (i + rng.randint(0, 20)) // 30)
    after = [("", 0, -90.0, False, dealt[0][4].replace(year=2025), 90)]
    too_late = [("a", 500, -90.0, False, dealt[0][4], 80)]  # long behind the watermark: Spark leaves it out
    got = delivered(spark.createDataFrame(dealt + too_late + after, FRAMES), "delivery", lambda s: E.stream_endpoints(s, rules, idle_ms=3_600_000, event_time="at", delay="25 seconds"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_gap_is_passed_by_the_watermark(spark, walks):
    rows, rules, _ = walks
    kept = [r for r in rows if r[0] == "a" and r[1] not in (40, 41, 77)]
    want = sorted(tuple(r) for r in E.endpoints(spark.createDataFrame(stamped(kept, lambda i: 0), FRAMES), rules).collect())
    dealt = stamped(kept, lambda i: i // 20)
    after = [("", 0, -90.0, False, dealt[0][4].replace(year=2025), 90)]
    got = delivered(spark.createDataFrame(dealt + after, FRAMES), "delivery", lambda s: E.stream_endpoints(s, rules, idle_ms=3_600_000, event_time="at", delay="5 seconds"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_sessions_share_calls_to_the_state(spark):
    """Sessions of a bucket, one without a name and some that end long before others, keep their own walks, ends and timers."""
    import datetime

    rng, start, rules = random.Random(6), datetime.datetime(2024, 1, 1), E.Rules(silence_ms=100, least_ms=60)
    rows, sessions = [], [None, *map(str, range(11))]
    for k, name in enumerate(sessions):
        rows += [(s, i, x, b, start + datetime.timedelta(seconds=i + 300 * (k % 3)), (i + 300 * (k % 3) + rng.randint(0, 20)) // 90) for s, i, x, b in frames(name, 60 + k, k)]
    table = spark.createDataFrame([*rows, ("", 0, -90.0, False, start.replace(year=2025), 90)], FRAMES)
    as_rows = lambda x: sorted((str(r.session), r.seq, r.event, r.frames) for r in x.collect())
    want = as_rows(E.endpoints(table.filter("delivery < 90"), rules))
    assert len({r[0] for r in want}) > 6
    for buckets in (1, 5):
        got = delivered(table, "delivery", lambda s: E.stream_endpoints(s, rules, idle_ms=120_000, event_time="at", delay="25 seconds", buckets=buckets))  # noqa: B023
        assert as_rows(got) == want


def test_idle_session_is_flushed_by_a_timer(spark, tmp_path):
    import json

    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"session": "a", "seq": i, "level": -60.0 if i < 5 else -10.0, "speaking": False} for i in range(30)]
    stream = spark.readStream.schema("session string, seq long, level double, speaking boolean").json(str(folder))
    sink = E.stream_endpoints(stream, idle_ms=1500).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "state"))
    with rocks_state(spark):
        query = sink.start()
    try:
        (folder / "0.json").write_text("\n".join(json.dumps(r) for r in rows))
        events = []  # in this mode batches go on without data, so there is no end to wait for
        for _ in range(80):
            time.sleep(0.5)
            events = [r.event for r in spark.table("idle").collect()]
            if len(events) > 1:
                break
        assert events == ["speech_start", "speech_end"]
    finally:
        query.stop()


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_of_any_cuts(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for session in ("a", "b"):
        samples = [float(rng.randint(-99, 99)) for _ in range(rng.randint(150, 260))]
        want[session] = [samples[i : i + 16] for i in range(0, len(samples) - 15, 16)]
        at = seq = 0
        while at < len(samples):
            n = rng.choice([0, 1, 3, 15, 16, 17, 40])
            piece = samples[at : at + n] if n else None
            delivery = seq // 4 + rng.randint(0, 2)  # some come before their turn
            rows += [(session, seq, piece, delivery)] + [(session, seq, piece, delivery + 1)] * (rng.random() < 0.2)
            at, seq = at + n, seq + 1
    table = spark.createDataFrame(rows, "session string, seq long, samples array<double>, delivery int")
    got = delivered(table, "delivery", lambda s: B.stream_blocks(s, 16, idle_ms=None)).orderBy("session", "block").collect()
    assert {s: [r.samples for r in got if r.session == s] for s in want} == want
    assert all(r.block == i for s in want for i, r in enumerate(x for x in got if x.session == s))
    whole = spark.createDataFrame([(s, sum(b, [])) for s, b in want.items()], "session string, x array<double>").select("session", S.blocks(F.col("x"), 16).alias("b"))
    assert {r.session: r.b for r in whole.collect()} == want


def test_chunks_and_memory_over_batches(spark):
    from sparkloom.operators import chunks as K

    rng = random.Random(3)
    rows, want = [], {}
    for reply in range(4):
        text = "".join(rng.choice(["好的", "我们走", "。", "，", "但是", "！”", "word ", "？"]) for _ in range(90))
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(7))})
        buffer, said = "", []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            rows.append((str(reply), i, text[a:b], b == len(text), i + reply % 2))
            new, buffer = K.take(buffer + text[a:b], len(said))
            said += new
        want[str(reply)] = said + K.rest(buffer, len(said))
    table = spark.createDataFrame(rows, "reply string, seq long, delta string, last boolean, delivery int")
    got = delivered(table, "delivery", lambda s: P.stream_chunks(s, idle_ms=None)).orderBy("reply", "chunk_index").collect()
    assert {k: [r.chunk for r in got if r.reply == k] for k in want} == want
    assert [(r.reply, r.is_final) for r in got if r.is_final] == [(k, True) for k in sorted(want)]


def test_no_deliveries(spark):
    none = spark.createDataFrame([], "session string, seq long, samples array<double>, delivery int")
    assert delivered(none, "delivery", lambda s: B.stream_blocks(s, 16, idle_ms=None)).count() == 0


def test_state_is_kept_in_no_more_parts_than_cores(spark):
    name, log = "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    own = spark.conf.get(name)
    spark.conf.set(name, "50")
    try:
        with rocks_state(spark):
            assert int(spark.conf.get(name)) == spark.sparkContext.defaultParallelism < 50
            assert spark.conf.get(log) == "true"
        assert spark.conf.get(name) == "50"
    finally:
        spark.conf.set(name, own)
