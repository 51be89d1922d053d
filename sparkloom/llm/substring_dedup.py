"""Repeated lines and sentences across documents: unit digests grouped globally, the earliest occurrence stays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._store import hold, release, store
from sparkloom.llm._text import freed

LINE = re.compile(r"[^\n\r]+")
#: A sentence end: closing marks after . ! ? and before white space, or the full stops of scripts without spaces.
END = re.compile(r"[.!?]+[\"')\]»”]*(?=\s)|[。！？｡]+[”’」』）]*")
#: Characters of scripts without spaces between words; two of them count as a word.
SOLID = re.compile("[\u0e00-\u0edf\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
UNIT_WORDS, LINE_WORDS = 5, 3
#: So many rows of a batch are taken out of Arrow at once.
STRETCH = 256


def units(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, digest, words) of the units of ``text``, in code points: every line, and inside a line of several sentences each run of sentences that
    ends at the first sentence end with UNIT_WORDS words or more in it, so that a passage moved into another line falls
    into the same units again after its first long sentence.

    Units are normalised by lower case and one space between words. Lines below LINE_WORDS words and runs below UNIT_WORDS aren't units; a word is what
    stands between white space, and of scripts without spaces two characters (SOLID).
    """
    out = []
    solid = not text.isascii() and SOLID.search(text) is not None

    def size(part: str, words: list[str]) -> int:
        return len(words) + len(SOLID.findall(part)) // 2 if solid else len(words)

    def add(a: int, b: int, least: int) -> None:
        part = text[a:b]
        words = part.lower().split()
        n = size(part, words)
        if n >= least:
            out.append((a, b, xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")), n))

    for line in LINE.finditer(text):
        a, b = line.span()
        add(a, b, LINE_WORDS)
        cuts, at = [], a
        for end in END.finditer(text, a, b):
            part = text[at : end.end()]
            if size(part, part.split(None, UNIT_WORDS - 1)) >= UNIT_WORDS:
                cuts.append((at, end.end()))
                at = end.end()
        if cuts:
            if at < b:
                cuts.append((at, b))
            if len(cuts) > 1:
                for x, y in cuts:
                    add(x, y, UNIT_WORDS)
    return out


def unit_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, until, digest, words) of all units of ``docs`` (doc_id, text); text_hash tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, STRETCH):
                part = batch.slice(first, STRETCH)
                found = [(i, h, *u) for i, t, h in zip(*(c.to_pylist() for c in part.columns), strict=True) for u in units(t or "")]
                i, h, a, b, d, n = zip(*found, strict=True) if found else ((),) * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
                columns = [pa.array(c, kind) for c, kind in zip((i, h, a, b, d, n), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "start", "until", "digest", "words"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(freed(run), "doc_id long, text_hash long, start int, until int, digest binary, words int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, removed array<struct<start, until>>) of the documents that lose something.

    A digest's occurrences are ranked by doc_id (null first), then text_hash, then offset; the first stays and the others go. Counting is a map-side aggregate, and
    only digests that occur again are joined back, dealt anew (the rebalance hint) so that both sides of the join come from shuffles of its own:
    a line that a third of all rows hold costs a partial sum a task and a join that Spark can split. A unit whose every rank is earliest stays even where a line around it goes elsewhere.
    The units are computed once and held on the executors' disks until the spans are stored.
    """
    all_units = hold(unit_table(docs).drop("words"))
    first = F.struct("doc_id", "text_hash", "start", "until")
    again = all_units.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n").hint("rebalance")
    later = all_units.join(again, "digest").filter(F.struct("doc_id", "text_hash", "start", "until") != F.col("first"))
    spans = store(later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "until"))).alias("removed")), "spans")
    release(all_units)
    return spans


def _cut(text: str, spans: list[dict]) -> tuple[str, list[dict], int]:
    """``text`` without the union of ``spans``, the union itself, and its length. A line that is left empty goes with its line end."""
    merged: list[list[int]] = []
    for s in spans:
        if merged and s["start"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["until"])
        else:
            merged.append([s["start"], s["until"]])
    kept, at, gone = [], 0, 0
    for a, b in merged:
        kept.append(text[at:a])
        gone += b - a
        at = b
        if (a == 0 or text[a - 1] == "\n") and text[b : b + 1] == "\n":
            at += 1
    kept.append(text[at:])
    return "".join(kept), [{"start": a, "until": b} for a, b in merged], gone


def dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and removed (spans of the original text in code points) and n_removed_chars.

    Null texts stay null and empty ones empty, with no spans. Rows that share doc_id (or its lack) and text are taken as repeats of one document: each loses the
    spans found for it, so repeated rows stay equal to one another. Nothing is capped; an empty table gives none. Columns of ``docs``
    named like a result column are replaced.
    """
    names = [c for c in docs.columns if c not in ("removed", "n_removed_chars")]
    spans = repeated_spans(docs).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    joined = docs.select(*names).join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left").drop("_id", "_hash")
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("until", pa.int32())]))
        for batch in batches:
            for first in range(0, batch.num_rows, STRETCH):
                part = batch.slice(first, STRETCH)
                texts, removed, gone = part.column(place).to_pylist(), [], []
                for i, s in enumerate(part.column(len(names)).to_pylist()):
                    cut, merged, n = _cut(texts[i], s) if s and texts[i] is not None else (texts[i], [], 0)
                    texts[i] = cut
                    removed.append(merged)
                    gone.append(n)
                columns = [pa.array(texts, pa.string()) if j == place else part.column(j) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, kind), pa.array(gone, pa.int64())], names=[*names, "removed", "n_removed_chars"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return joined.mapInArrow(freed(run), f"{shape}, removed array<struct<start: int, until: int>>, n_removed_chars long")
