"""Readers: rating files, documents, event logs, directory scans, WAV samples, incremental ingest and upload gates."""

from __future__ import annotations

import io
import json
import uuid
import wave
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

AUDIO = ("wav", "mp3", "flac", "ogg", "m4a", "aac", "opus")
TRANSCRIPTS = ("txt", "lab")


def ratings(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Ratings of a JSON file or folder of them; a file holds a list, one object, or an object with a ``ratings`` list. Read as text once, parsed with
    the given schema.
    """
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True) if not path.endswith(".json") else spark.read.text(path, wholetext=True)
    bare = F.ltrim(F.regexp_replace("value", r"^\s+", ""))
    listed = F.from_json("value", ArrayType(schema))
    nested = F.from_json("value", StructType().add("ratings", ArrayType(schema)))["ratings"]
    rows = F.when(bare.startswith("["), listed).otherwise(F.coalesce(nested, F.array(F.from_json("value", schema))))
    return text.select(F.explode(rows).alias("r")).select("r.*")


def unnested(rows: DataFrame, nested: str) -> DataFrame:
    """Rows that hold a list of records, as the records."""
    return rows.select(F.explode(nested).alias("_r")).select("_r.*")


def json_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON document with a fixed schema: a malformed one fails, as do keys that the schema lacks."""
    raw = spark.read.text(path, wholetext=True)
    extra = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(n) for n in schema.names]))
    checked = raw.select(F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(extra, ", ")))).otherwise(F.col("value")).alias("value"))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def yaml_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A YAML document as one row; the parser is optional."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    if unknown := set(data) - set(schema.names):
        raise ValueError(f"{path}: unknown keys {sorted(unknown)}")
    return spark.createDataFrame([tuple(data.get(n) for n in schema.names)], schema)


def save_document(document: dict, path: str, spark: SparkSession) -> None:
    """One document as indented JSON in UTF-8, or as YAML by its suffix, put in place by a rename, so that readers meet the old or the new one."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = yaml.safe_dump(document, allow_unicode=True, sort_keys=False)
    else:
        text = json.dumps(document, ensure_ascii=False, indent=2) + "\n"
    hadoop = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    staged = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(hadoop(staged), True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    options = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    overwrite[0] = jvm.java.lang.Enum.valueOf(options, "OVERWRITE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(hadoop(staged)), fs.makeQualified(hadoop(path)), overwrite)  # one step: there is always a file


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table, in one plan."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def next_version(existing: DataFrame, by: str) -> DataFrame:
    """(by, version): one more than the rows that each key has."""
    return existing.groupBy(by).agg((F.count(F.lit(1)) + 1).alias("version"))


def if_present(spark: SparkSession, path: str, read) -> DataFrame | None:
    """``read(path)``, or None where nothing is there; what is there but invalid still fails."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return read(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def event_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines with at, kind and free fields: those two as columns, the whole line as JSON beside them."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return lines.select(F.get_json_object("value", "$.at").cast("timestamp").alias("at"), F.get_json_object("value", "$.kind").alias("kind"), F.col("value").alias("fields"))


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Audio files under ``root`` (path, length, modified), without hidden ones; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.lower(F.substring_index("path", "/", -1))
    return found.filter(F.substring_index(name, ".", -1).isin(*AUDIO) & ~name.startswith("."))


def wav_samples(files: DataFrame) -> DataFrame:
    """(path, rate, duration_s, samples) of 16-bit PCM ``files`` (path, content): channels averaged, divided by 32767. Unreadable files have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(raw)) as w:
                        if w.getsampwidth() != 2:
                            raise wave.Error("not 16 bit")
                        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32767
                        out.append((path, w.getframerate(), len(x) / w.getframerate(), x.tolist()))
                except (wave.Error, EOFError):
                    out.append((path, None, None, None))
            yield pd.DataFrame(out, columns=["path", "rate", "duration_s", "samples"]).astype({"rate": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, rate int, duration_s double, samples array<double>")


def wav_bytes(samples: list[float], rate: int) -> bytes:
    """16-bit mono PCM of samples clamped to [-1, 1]."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, float), -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def ingest(known: DataFrame, found: DataFrame, path: str, content: Column, limit: int | None = None) -> DataFrame:
    """New rows of ``found`` by ``path``, with the SHA-256 of their content and an error where there is none; ``limit`` takes the first by path."""
    new = found.join(known.select(path), path, "left_anti")
    new = new.orderBy(path).limit(limit) if limit else new
    return new.select(path, F.sha2(content, 256).alias("sha256"), F.when(content.isNull() | (F.octet_length(content) == 0), "empty").alias("error"))


def upload_gate(files: DataFrame, name: str, size: str, duration: str, most_bytes: int) -> DataFrame:
    """``files`` with the first reason for which an upload is refused, or null, and its kind."""
    suffix = F.lower(F.substring_index(name, ".", -1))
    audio = suffix.isin(*AUDIO)
    reason = (
        F.when(F.col(size) > most_bytes, "too large").when(~audio & ~suffix.isin(*TRANSCRIPTS), "unsupported").when(audio & F.col(duration).isNull(), "not audio")
        .when(audio & (F.col(duration) < 0.3), "too short").when(audio & (F.col(duration) > 3 * 3600), "too long")
    )
    return files.withColumns({"reason": reason, "kind": F.when(reason.isNull(), F.when(audio, "audio").otherwise("transcript"))})


def transcript_coverage(audio: DataFrame, texts: DataFrame, stem: str, least: float = 0.8) -> DataFrame:
    """One row: clips, clips with a provided transcript, and whether these cover enough for recognition to be skipped."""
    joined = audio.select(stem).join(texts.select(stem, F.lit(1).alias("_t")).distinct(), stem, "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count("_t").alias("n_text")).withColumn("provided", F.coalesce(F.try_divide("n_text", "n") >= least, F.lit(False)))


def pairs(audio: DataFrame, labels: DataFrame, stem: str, duration: str, n: int, low: float = 3.5, high: float = 9.5) -> DataFrame:
    """Audio with its label file by stem, within the duration window, the ``n`` nearest to 6 s."""
    return audio.join(labels, stem).filter(F.col(duration).between(low, high)).orderBy(F.abs(F.col(duration) - 6), stem).limit(n)
