"""Dataset exports: usable samples routed by split, as lines of several training formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import one_line
from sparkloom.operators import selection

Export = Callable[[DataFrame], DataFrame]


def routed(samples: DataFrame, splits: DataFrame, include_val: bool = True) -> DataFrame:
    """Approved or corrected ``samples`` (sample_id, status, ...) with split: the first entry of ``splits``, train by default; held-out ones go, val
    counts as train unless included.
    """
    first = splits.groupBy("sample_id").agg(F.min("split").alias("split"))
    x = samples.filter(F.col("status").isin("approved", "corrected")).join(first, "sample_id", "left").withColumn("split", F.coalesce("split", F.lit("train"))).filter("split <> 'heldout'")
    return x if include_val else x.withColumn("split", F.lit("train"))


def require_training(rows: DataFrame) -> DataFrame:
    """``rows``, or an error where none is for training."""
    if rows.filter("split = 'train'").isEmpty():
        raise ValueError("no sample for training")
    return rows


def pipe_list(rows: DataFrame, speaker: str, language: str = "ZH") -> DataFrame:
    """path|speaker|language|text lines."""
    return rows.select("sample_id", "split", F.concat_ws("|", "path", F.lit(speaker), F.lit(language), one_line(F.col("text"))).alias("line"))


def label_files(rows: DataFrame, folder: str) -> None:
    """One file of text a sample, in a folder of its own named by the sample."""
    rows.select("sample_id", one_line(F.col("text")).alias("value")).repartition("sample_id").write.partitionBy("sample_id").mode("overwrite").text(folder)


def json_lines(rows: DataFrame) -> DataFrame:
    """A JSON object a sample."""
    return rows.select("sample_id", "split", F.to_json(F.struct(F.col("path").alias("audio"), one_line(F.col("text")).alias("text"), F.col("style"))).alias("line"))


def with_prompt(rows: DataFrame, prompt: DataFrame) -> DataFrame:
    """JSON lines with the columns of the one-row ``prompt`` (path, text) on each."""
    p = prompt.limit(1).select(F.col("path").alias("_pp"), one_line(F.col("text")).alias("_pt"))
    return rows.crossJoin(F.broadcast(p)).select("sample_id", "split", F.to_json(F.struct(F.col("path").alias("audio"), one_line(F.col("text")).alias("text"), F.col("_pp").alias("prompt_audio"), F.col("_pt").alias("prompt_text"))).alias("line"))


def kaldi(rows: DataFrame, speaker: str) -> dict[str, DataFrame]:
    """wav.scp, text and utt2spk lines a sample, each as (split, line), and the samples of spk2utt, which ``write_speaker_lines`` puts on lines."""
    line = lambda *c: rows.select("sample_id", "split", F.concat_ws(" ", *c).alias("line"))
    return {"wav.scp": line("sample_id", "path"), "text": line("sample_id", one_line(F.col("text"))), "utt2spk": line("sample_id", F.lit(speaker)), "spk2utt": line("sample_id")}


def write_speaker_lines(entries: DataFrame, speaker: str, folder: str, width: int = 1000) -> None:
    """spk2utt lines of each split: the speaker and at most ``width`` of its samples a line, in order.

    Readers of the format join lines of one speaker; so no task holds all samples of a split.
    """
    placed = selection.numbered(entries, "sample_id").withColumn("_l", F.floor(F.col("_i") / width))
    lines = placed.groupBy("split", "_l").agg(F.array_join(F.array_sort(F.collect_list("line")), " ").alias("samples"))
    lines.select("split", F.concat_ws(" ", F.lit(speaker), "samples").alias("value")).write.partitionBy("split").mode("overwrite").text(folder)


def best_reference(rows: DataFrame, by: str, preferred: str) -> DataFrame:
    """The reference clip of each split with its text as ``line``: of the preferred style if there is one, of 3 to 10 s if there is one, best quality."""
    best = selection.best_reference(rows, by, "style", preferred, "duration_s", "quality", "sample_id").select(by, "sample_id")
    return rows.join(best, [by, "sample_id"]).withColumn("line", one_line(F.col("text")))


def write_lines(lines: DataFrame, folder: str) -> None:
    """The lines as text, a folder a split; an empty split writes none."""
    lines.select("split", F.col("line").alias("value")).write.partitionBy("split").mode("overwrite").text(folder)


def with_own_prompt(rows: DataFrame) -> DataFrame:
    """JSON lines with the reference clip of the line's own split as prompt; one row a split is joined."""
    p = best_reference(rows, "split", "").select("split", F.col("path").alias("_pp"), one_line(F.col("text")).alias("_pt"))
    line = F.to_json(F.struct(F.col("path").alias("audio"), one_line(F.col("text")).alias("text"), F.col("_pp").alias("prompt_audio"), F.col("_pt").alias("prompt_text")))
    return rows.join(F.broadcast(p), "split").select("sample_id", "split", line.alias("line"))  # splits are train and val


def _kaldi_file(name: str) -> Export:
    return lambda rows: kaldi(rows, "speaker")[name].select("split", "line")


#: Lines (split, line, most with sample_id) of ``routed`` samples by the name of the format; ``registered`` adds one.
FORMATS: dict[str, Export] = {
    "list": lambda rows: pipe_list(rows, "speaker"),
    "labels": lambda rows: rows.select("sample_id", "split", one_line(F.col("text")).alias("line")),
    "jsonl": json_lines,
    "prompt": with_own_prompt,
    "kaldi_wav": _kaldi_file("wav.scp"),
    "kaldi_text": _kaldi_file("text"),
    "kaldi_utt2spk": _kaldi_file("utt2spk"),
    "kaldi_spk2utt": _kaldi_file("spk2utt"),
    "reference": lambda rows: best_reference(rows, "split", "").select("sample_id", "split", "line"),
}


def registered(name: str) -> Callable[[Export], Export]:
    """Adds a format under ``name``, which must be free."""

    def add(make: Export) -> Export:
        if name in FORMATS:
            raise ValueError(f"there is a format {name!r} already")
        FORMATS[name] = make
        return make

    return add


def export(name: str, rows: DataFrame) -> DataFrame:
    """The lines of ``rows`` in the format ``name``; an unknown name lists the known ones."""
    if name not in FORMATS:
        raise KeyError(f"unknown format {name!r}; there are {sorted(FORMATS)}")
    return FORMATS[name](rows)
