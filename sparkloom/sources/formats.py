"""Data sources of their own: WAV samples as a table, and lines put into files of a Kaldi folder all at once or not at all."""

from __future__ import annotations

import io
import time
import uuid
import wave
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Files(InputPartition):
    """Some files for one task, and where their file system is."""

    root: str
    paths: list[str]


class WavReader(DataSourceReader):
    """Files by path in partitions of about ``bytes`` bytes; filters on ``path`` choose files before any is opened."""

    def __init__(self, root: str, size: int):
        self.root, self.size, self.wanted = root, size, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringEndsWith | StringStartsWith) and tuple(f.attribute) == ("path",):
                self.wanted.append(f)
            else:
                yield f

    def _fits(self, path: str) -> bool:
        test = {EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringEndsWith: lambda f: path.endswith(f.value), StringStartsWith: lambda f: path.startswith(f.value)}
        return all(test[type(f)](f) for f in self.wanted)

    def partitions(self) -> list[Files]:
        system, base = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        wavs = sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(".wav") and not f.base_name.startswith(".") and self._fits(f.path))
        parts, held, total = [], [], 0
        for path, size in wavs:
            if held and total + size > self.size:
                parts.append(Files(self.root, held))
                held, total = [], 0
            held.append(path)
            total += size
        return [*parts, Files(self.root, held)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(partition.root)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                raw = f.read()
            try:
                with wave.open(io.BytesIO(raw)) as w:
                    if w.getsampwidth() != 2:
                        raise wave.Error("not 16 bit")
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32767
                    yield path, w.getframerate(), len(x) / w.getframerate(), x.tolist()
            except (wave.Error, EOFError):
                yield path, None, None, None


class Wav(DataSource):
    """``spark.read.format("wav").load(folder)``: path, rate, duration_s, samples of 16-bit files; unreadable ones have nulls. Option ``bytes``: how
    much a task reads. Folders are of any file system that Arrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, rate int, duration_s double, samples array<double>"

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options["path"], int(self.options.get("bytes", 64 << 20)))


@dataclass
class Staged(WriterCommitMessage):
    """What a task wrote: (staged file, its place)."""

    moves: list[tuple[str, str]]


#: So often is a folder deleted that tasks still write to.
TRIES = 20


class KaldiWriter(DataSourceWriter):
    """Each task writes its lines beside the result, a file for each (file, split) it has; only the commit of the whole job moves them into place.

    The driver makes the folder for that, once; a task makes only its own inside it, so one that is still being killed leaves nothing after an abort.
    """

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.staging = root.rstrip("/"), overwrite, f"_staged-{uuid.uuid4().hex}"
        system, base = fs.FileSystem.from_uri(self.root)
        system.create_dir(f"{base}/{self.staging}", recursive=True)

    def write(self, rows: Iterator[Row]) -> Staged:
        system, base = fs.FileSystem.from_uri(self.root)
        task = TaskContext.get()
        open_files: dict[tuple[str, str], pa.NativeFile] = {}
        moves = []
        for row in rows:
            place = (row["split"], row["file"])
            if place not in open_files:
                staged = f"{base}/{self.staging}/{task.partitionId()}-{task.attemptNumber()}/{len(open_files)}"
                if not open_files:
                    system.create_dir(staged.rpartition("/")[0], recursive=False)
                open_files[place] = system.open_output_stream(staged)
                moves.append((staged, f"{base}/{row['split']}/{row['file']}/part-{task.partitionId():05d}"))
            open_files[place].write(row["line"].encode() + b"\n")
        for f in open_files.values():
            f.close()
        return Staged(moves)

    def commit(self, messages: list[Staged | None]) -> None:
        system, base = fs.FileSystem.from_uri(self.root)
        if self.overwrite:
            old = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
            for f in old:
                if f.base_name != self.staging:
                    system.delete_dir(f.path) if f.type == fs.FileType.Directory else system.delete_file(f.path)
        else:
            tag = uuid.uuid4().hex[:8]
        for message in messages:
            for staged, place in message.moves if message else ():
                system.create_dir(place.rpartition("/")[0], recursive=True)
                system.move(staged, place if self.overwrite else f"{place}-{tag}")
        self._clear(system, base)
        system.create_dir(base, recursive=True)
        system.open_output_stream(f"{base}/_SUCCESS").close()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.root))

    def _clear(self, system: fs.FileSystem, base: str) -> None:
        for turn in range(TRIES):
            if system.get_file_info(f"{base}/{self.staging}").type != fs.FileType.Directory:
                return
            try:
                system.delete_dir(f"{base}/{self.staging}")
            except OSError:  # a task made its folder meanwhile
                if turn == TRIES - 1:
                    raise
                time.sleep(0.1)


class Kaldi(DataSource):
    """``rows.write.format("kaldi").mode("overwrite").save(folder)`` of rows (split, file, line): the lines as <folder>/<split>/<file>/part-..., all
    of them or, if a task fails for good, none.
    """

    @classmethod
    def name(cls) -> str:
        return "kaldi"

    def schema(self) -> str:
        return "split string, file string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> KaldiWriter:
        return KaldiWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets it push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Wav, Kaldi):
        spark.dataSource.register(source)
