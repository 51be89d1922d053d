"""Data sources with planning, filters and commits, and ingest that can fail at any step."""

import glob
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkloom.sources import files as R
from sparkloom.sources import formats
from sparkloom.streaming.ingest import Ledger, taken_in


def test_wav_source(spark, tmp_path):
    formats.register(spark)
    for i in range(6):
        folder = tmp_path / ("a" if i < 4 else "b")
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.wav").write_bytes(R.wav_bytes([i / 10] * 800, 8000))
    (tmp_path / "a" / "bad.wav").write_bytes(b"RIFFnothing")
    (tmp_path / "a" / ".hidden.wav").write_bytes(b"")
    (tmp_path / "a" / "x.txt").write_text("no")
    table = spark.read.format("wav").option("bytes", 3000).load(str(tmp_path))
    got = {os.path.basename(r.path): (r.rate, r.duration_s, len(r.samples or [])) for r in table.collect()}
    assert got == {f"{i}.wav": (8000, 0.1, 800) for i in range(6)} | {"bad.wav": (None, None, 0)}
    assert table.rdd.getNumPartitions() > 3
    assert [os.path.basename(r.path) for r in table.filter(F.col("path").endswith("/4.wav") & (F.col("rate") > 0)).collect()] == ["4.wav"]


def test_wav_filters_choose_files():
    reader = formats.WavReader("/nowhere", 10)
    rest = list(reader.pushFilters([formats.EqualTo(("path",), "/x/1.wav"), formats.EqualTo(("rate",), 8000)]))
    assert rest == [formats.EqualTo(("rate",), 8000)] and reader._fits("/x/1.wav") and not reader._fits("/x/2.wav")


def lines_of(folder):
    out = {}
    for path in sorted(glob.glob(f"{folder}/*/*/part-*")):
        with open(path) as f:
            out.setdefault(tuple(path.split(os.sep)[-3:-1]), []).extend(f.read().splitlines())
    return {k: sorted(v) for k, v in out.items()}


def test_kaldi_writer(spark, tmp_path):
    formats.register(spark)
    rows = spark.createDataFrame([(["train", "val"][i % 2], ["text", "wav.scp"][i % 3 > 0], f"s{i}") for i in range(40)], "split string, file string, line string").repartition(3)
    folder = str(tmp_path / "out")
    want = {}
    for r in rows.collect():
        want.setdefault((r.split, r.file), []).append(r.line)
    rows.write.format("kaldi").mode("overwrite").save(folder)
    assert lines_of(folder) == {k: sorted(v) for k, v in want.items()} and sorted(os.listdir(folder)) == ["_SUCCESS", "train", "val"]
    rows.filter("line = 's1'").write.format("kaldi").mode("append").save(folder)
    assert sum(map(len, lines_of(folder).values())) == 41
    fails = rows.withColumn("line", F.when(F.col("line") == "s7", F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    before = lines_of(folder)
    with pytest.raises(Exception, match="broken"):
        fails.write.format("kaldi").mode("append").save(folder)
    assert lines_of(folder) == before and not [x for x in os.listdir(folder) if x.startswith("_staged")]
    rows.filter("line = 's2'").write.format("kaldi").mode("overwrite").save(folder)
    assert list(lines_of(folder).values()) == [["s2"]]


def test_kaldi_task_that_ends_after_the_abort_leaves_nothing(tmp_path, monkeypatch):
    task = type("Task", (), {"partitionId": lambda self: 0, "attemptNumber": lambda self: 0})()
    monkeypatch.setattr(formats.TaskContext, "get", lambda: task)
    rows = [Row(split="train", file=f, line="s1") for f in ("text", "wav.scp")]
    writer = formats.KaldiWriter(str(tmp_path / "out"), False)
    assert len(writer.write(iter(rows)).moves) == 2
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter(rows))
    assert os.listdir(tmp_path / "out") == []


def test_ingest_that_fails_between_write_and_entry(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "pages"))
    take = taken_in(ledger, "path", lambda new: new.select("path", F.sha2("content", 256).alias("sha256")), "path string, sha256 string")
    one = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2"), (None, "x")], "path string, content string")
    two = spark.createDataFrame([("b", "9"), ("c", "3")], "path string, content string")
    paths = lambda: sorted(r.path for r in ledger.rows("path string, sha256 string").collect())
    enter = Ledger.enter
    monkeypatch.setattr(Ledger, "enter", lambda self, batch: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        take(one, 0)
    assert paths() == []  # written, not entered: nobody sees it
    monkeypatch.setattr(Ledger, "enter", enter)
    take(one, 0)
    take(one, 0)
    assert paths() == ["a", "b"]
    take(two, 1)
    take(two, 1)
    assert paths() == ["a", "b", "c"] and ledger.complete() == [0, 1]
