"""Runs of a repeated stretch of words (tandem repeats) in whole texts, by common extensions at a grid of places for each period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._text import chunks, mix, powers

#: A run has at least so many words, and at least so many times its period.
LEAST, TIMES = 6, 4
#: Bounds on the pairs of period and place that are extended at once, and on the text that is held at once.
PAIRS, BYTES = 500_000, 1_000_000


def numbered(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """The words of all ``docs`` as equal numbers for equal words, the first place of each document, and the words. A number of its own stands after each document."""
    known: dict[bytes, int] = {}
    words = [d.split() for d in docs]  # bytes are split at the six ASCII spaces only
    numbers = [known.setdefault(w, len(known)) for one in words for w in [*one, None]]
    first = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).astype(np.int64)
    ids = np.array(numbers, np.int64)
    ids[first[1:] - 1] = -1 - np.arange(len(docs))
    return ids, first, words


def _exact(ids: np.ndarray, start: int, end: int, p: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of period ``p`` between two places, by comparing all words."""
    same = np.concatenate([[False], ids[start : end - p] == ids[start + p : end], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(start + a, start + b + p) for a, b in edges.reshape(-1, 2).tolist() if b - a + p >= max(LEAST, TIMES * p)]


class Prefixes:
    """Hashes of all prefixes of ``ids`` (polynomial, modulo 2 ** 64, over mixed numbers), which give that of any stretch."""

    def __init__(self, ids: np.ndarray):
        self.powers = powers(0xD1342543DE82EF95, len(ids) + 1)
        terms = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * self.powers[:-1]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether ``n`` words from ``a`` have the hash of those from ``b`` >= ``a``."""
        return (self.sums[a + n] - self.sums[a]) * self.powers[b - a] == self.sums[b + n] - self.sums[b]

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on, at most ``most``; with ``back``, those before them. One binary search for all pairs."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            shift = middle if back else 0
            fits = self.same(a - shift, b - shift, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _extended(ids: np.ndarray, prefixes: Prefixes, begin: np.ndarray, end: np.ndarray, a: np.ndarray, p: np.ndarray) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of the runs around the places ``a``, whose word is that ``p`` places on; ``begin`` and ``end`` bound the document of each place."""
    after = prefixes.extension(a, a + p, end - a - p, False)
    before = prefixes.extension(a, a + p, a - begin, True)
    start, stop = a - before, a + p + after
    long = stop - start >= np.maximum(LEAST, TIMES * p)
    found: dict[tuple[int, int], int] = {}
    for s, e, q, left, right in np.unique(np.stack([start, stop, p, begin, end])[:, long], axis=1).T.tolist():
        if (s, e) in found:
            continue  # places come by period, and a multiple of a run's period has the same run
        true = np.array_equal(ids[s : e - q], ids[s + q : e]) and (s == left or ids[s - 1] != ids[s - 1 + q]) and (e == right or ids[e] != ids[e - q])
        for run in [(s, e)] if true else _exact(ids, left, right, q):  # a hash that lied: all words of the document decide
            found[run] = min(q, found.get(run, q))
    return found


def find_runs(ids: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each document, (start, length, period) of its runs by start, then period.

    A run of period p has at least 4 p words, so 3 p places whose word is that p places on; every third multiple of p is looked at, which meets each run.
    The places of all periods, harmonic in number, are extended both ways together. A run that has several periods has its smallest one.
    """
    n_words = np.diff(first) - 1
    longest = int(n_words.max(initial=0)) // TIMES
    out: list[list[tuple[int, int, int]]] = [[] for _ in n_words]
    if longest < 1:
        return out
    prefixes = Prefixes(ids)
    owner = np.repeat(np.arange(len(n_words)), n_words + 1)
    runs: dict[tuple[int, int], int] = {}

    def extend() -> None:
        at, period = np.concatenate(places), np.repeat(periods, [len(x) for x in places])
        doc = owner[at]
        inside = at + period < first[doc + 1] - 1
        at, period, doc = at[inside], period[inside], doc[inside]
        for run, q in _extended(ids, prefixes, first[doc], first[doc + 1] - 1, at, period).items():
            runs[run] = min(q, runs.get(run, q))

    places, periods, held = [], [], 0
    for p in range(1, longest + 1):
        at = np.flatnonzero(ids[: len(ids) - p : 3 * p] == ids[p :: 3 * p]) * (3 * p)
        if len(at):
            places.append(at)
            periods.append(p)
            held += len(at)
        if held >= PAIRS:
            extend()
            places, periods, held = [], [], 0
    if places:
        extend()
    for (s, e), q in sorted((run, q) for run, q in runs.items()):
        doc = int(owner[s])
        out[doc].append((s - int(first[doc]), e - s, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and collapsed text of every row of ``docs`` (doc_id, text).

    Words are stretches without ASCII white space. ``runs`` holds each stretch of at least 6 words and 4 times its smallest period in which words a period apart are
    equal and that no neighbouring word extends, by start, then period. ``collapsed`` has the words that no run holds after its first period, joined by one space.
    Null, empty and blank texts have no words and no runs. Very long texts are searched whole, in n log n steps; memory holds one text or a megabyte of them. Repeated
    rows get equal results; an empty table gives none; other columns are ignored. One scan, without a shuffle.
    """
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in chunks(batch.column(1).to_pylist(), BYTES):
                ids, first, words = numbered(texts)
                runs = find_runs(ids, first)
                ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind))
                text = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
                columns = [batch.column(0).slice(a, len(texts)), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), structs), text]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {RUNS}")


def planted(doc_id: Column, text: Column) -> Column:
    """``text``, or for a tenth of the ids its words with a stretch repeated to the end, as the query's contract says; null ids are left alone."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    g = F.call_function("div", h, F.lit(10))
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731 - evaluates ``value`` once

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.call_function("div", n - a, 3 + F.pmod(g, F.lit(8)))
        out = let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")))))
        return F.when(n > 0, F.array_join(out, " ")).otherwise(text)

    return F.when(F.pmod(h, F.lit(10)) == 0, let(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1), repeat)).otherwise(text)
