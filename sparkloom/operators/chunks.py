"""Speech chunks: where a reply, whole or streamed, can be cut for synthesis."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_type

#: Ends and pauses of sentences, closers that stay with them, and openers that no cut may strand.
STRONG, SOFT, CLOSERS = "。！？!?…", "，、；：,;:", "”’）》」』\"')"
OPENERS = ("但是", "但", "不过", "然后", "而且", "所以", "因为", "如果", "虽然", "并且", "或者", "还是", "可是", "只是", "就是")


_OPENS = re.compile(r"\s*(?:" + "|".join(OPENERS) + ")")
_MARK = re.compile(f"[{re.escape(STRONG + SOFT)}]")
_TAIL = re.compile(f"[{re.escape(CLOSERS)}]*[{re.escape(STRONG)}]*")


class Marks:
    """The marks of a text in order: where they are, and where the closers and terminators after them end; found once, however often the text is cut."""

    def __init__(self, text: str):
        self.text = text
        self.at = [m.start() for m in _MARK.finditer(text)]
        self.end = [_TAIL.match(text, i + 1).end() for i in self.at]
        self.strong = [j for j, i in enumerate(self.at) if text[i] in STRONG]

    def free(self, end: int) -> bool:
        """No opener begins after ``end``."""
        return not _OPENS.match(self.text, end)

    def first_strong(self, start: int, least: int) -> int | None:
        for k in range(bisect_left(self.strong, bisect_left(self.at, start)), len(self.strong)):
            end = self.end[self.strong[k]]
            if end >= least and self.free(end):
                return end
        return None

    def last_soft(self, start: int, least: int, most: int) -> int | None:
        for j in range(bisect_left(self.at, most) - 1, bisect_left(self.at, start) - 1, -1):
            if self.text[self.at[j]] in SOFT and least <= self.end[j] <= most and self.free(self.end[j]):
                return self.end[j]
        return None

    def last_any(self, least: int, before: int) -> int | None:
        j = bisect_left(self.at, before) - 1
        return self.end[j] if j >= 0 and self.at[j] >= least else None


@dataclass(frozen=True)
class Limits:
    least: int = 8
    first: int = 3
    most: int = 60
    hard: int = 100
    soft_from: int = 16


def cut_at(marks: Marks, first: bool, limits: Limits = Limits(), force: bool = False, start: int = 0) -> int | None:
    """Where to cut the text of ``marks`` after ``start``: at the first sentence end within the preferred length; beyond it at the last pause that
    fits, or the sentence end; at the hard limit, the last mark or bluntly. None: wait for more.
    """
    least, size = start + (limits.first if first else limits.least), len(marks.text) - start
    strong = marks.first_strong(start, least)
    if strong is not None and strong - start <= limits.most:
        return strong
    if size >= limits.most:
        soft = marks.last_soft(start, max(least, start + limits.soft_from), start + limits.most)
        if soft is not None or strong is not None:
            return strong if soft is None else soft
    if size > 0 and (force or size >= limits.hard):
        cut = marks.last_any(least, min(len(marks.text), start + limits.hard))
        return start + limits.hard if cut is None else cut
    return None


def _spoken(piece: str) -> str:
    return piece.strip().lstrip(SOFT + STRONG).strip()


def take(buffer: str, emitted: int, limits: Limits = Limits()) -> tuple[list[str], str]:
    """The chunks that are complete in ``buffer`` (``emitted`` were before) and what stays."""
    out: list[str] = []
    start, marks = 0, Marks(buffer)
    while (at := cut_at(marks, emitted + len(out) == 0, limits, start=start)) is not None:
        if said := _spoken(buffer[start:at]):
            out.append(said)
        start = at
    return out, buffer[start:]


def rest(buffer: str, emitted: int, limits: Limits = Limits()) -> list[str]:
    """The last chunks, whatever their length."""
    out: list[str] = []
    start, marks = 0, Marks(buffer)
    while len(buffer) - start > limits.hard:
        at = cut_at(marks, emitted + len(out) == 0, limits, force=True, start=start) or start + limits.hard
        if said := _spoken(buffer[start:at]):
            out.append(said)
        start = at
    return out + ([said] if (said := _spoken(buffer[start:])) else [])


def split(text: str, limits: Limits = Limits()) -> list[str]:
    """All chunks of a whole reply."""
    out, left = take(text, 0, limits)
    return out + rest(left, len(out), limits)


@udtf(returnType="chunk_index int, chunk string, is_final boolean")
class SpeechChunks:
    """SELECT ... FROM t, LATERAL speech_chunks(t.text)"""

    def eval(self, text: str) -> Iterator[tuple]:
        parts = split(text or "")
        for i, p in enumerate(parts):
            yield i, p, i == len(parts) - 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("speech_chunks", SpeechChunks)


#: So many texts of an Arrow batch are Python strings at once.
STRETCH = 256


def chunked(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_index, chunk, is_final) of every row."""

    kind = to_arrow_type(rows.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, STRETCH):
                part = batch.slice(first, STRETCH)
                found = [(k, i, p, i == len(parts) - 1) for k, t in zip(part[key].to_pylist(), part[text].to_pylist(), strict=True) for parts in [split(t or "")] for i, p in enumerate(parts)]
                columns = zip(*found, strict=True) if found else ((), (), (), ())
                arrays = [pa.array(list(x), t) for x, t in zip(columns, (kind, pa.int32(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "chunk_index", "chunk", "is_final"])

    return rows.select(key, text).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, chunk_index int, chunk string, is_final boolean")
