"""Language ID: multinomial naive Bayes over hashed character n-grams, scored sparsely in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._store import store
from sparkloom.llm._text import freed

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
PART = 4096
_letters: np.ndarray | None = None


@dataclass(frozen=True)
class Model:
    """Labels in code-point order, log priors, and log probabilities of BUCKETS n-gram buckets by label; ``more`` has the labels after these."""

    labels: list[str]
    prior: np.ndarray
    matrix: np.ndarray
    more: tuple[Model, ...] = ()


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the letter bigrams and trigrams of all ``texts`` (lower-cased, a run of other characters one space), the text of each
    bucket, and the letters of each text. No n-gram spans two texts."""
    lowered = [" " + (t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _is_letter()[points]
    count = np.bincount(owner[letter], minlength=len(texts))
    points = np.where(letter, points, np.uint32(32))
    stays = np.concatenate([[True], letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])]) if len(points) else letter
    points, owner = points[stays], owner[stays]
    two = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + points[2:] * np.uint32(0x27D4EB2F)
    same2, same3 = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    fold = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)
    two, three = fold(two)[same2], fold(three + np.uint32(1))[same3]
    return np.concatenate([two, three]), np.concatenate([owner[:-1][same2], owner[:-2][same3]]), count


def _parts(texts: list, most: int = 400_000) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or "") > most:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def _counted(labelled: DataFrame) -> DataFrame:
    """(lang, part, counts): how often the n-grams of each bucket, and documents (the bucket after the last), are among the rows of a label, by ranges of buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                at = np.flatnonzero(c)
                edges = np.searchsorted(at, range(0, BUCKETS + PART + 1, PART))
                some = [(i, at[x:y]) for i, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
                keys, sums = ([f(k).tobytes() for _, k in some] for f in (lambda k: (k % PART).astype(np.uint16), lambda k: c[k]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([i for i, _ in some], pa.int32()), pa.array(keys, pa.binary()), pa.array(sums, pa.binary())], names=["lang", "part", "keys", "counts"])
            held.clear()

        for batch in batches:
            langs, texts = np.array(batch.column(1).to_pylist(), object), batch.column(0).to_pylist()
            for a, b in _parts(texts):
                buckets, owner, _ = grams(texts[a:b])
                names, which = np.unique(langs[a:b].astype(str), return_inverse=True)
                for j, name in enumerate(names):
                    c = held.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    c[:BUCKETS] += np.bincount(buckets[which[owner] == j], minlength=BUCKETS)
                    c[BUCKETS] += int((which == j).sum())
                    if len(held) > 64:
                        yield from flush()
        yield from flush()

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(PART, np.int64)
        for k, c in zip(t.column("keys"), t.column("counts"), strict=True):
            total[np.frombuffer(k.as_buffer(), np.uint16)] += np.frombuffer(c.as_buffer(), np.int64)
        return pa.table({"lang": [t.column("lang")[0].as_py()], "part": pa.array([t.column("part")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    known = labelled.filter("lang IS NOT NULL").select("text", F.col("lang").cast("string"))
    return known.mapInArrow(freed(count), "lang string, part int, keys binary, counts binary").groupBy("lang", "part").applyInArrow(add, "lang string, part int, counts binary")


def train(labelled: DataFrame, alpha: float = 0.5, max_labels: int = 500) -> Model:
    """A model of all rows of ``labelled`` (text, lang) whose lang is not null.

    Every task counts its own n-grams by label; the counts, packed by label and range of buckets, are summed in Spark. A model's matrix takes 262 kB a label and is broadcast, so beyond
    ``max_labels`` labels there are several, one for each so many labels in code-point order, which ``tag`` asks in turn: no label is dropped, and results are the same however they are cut.
    Null and letterless texts add only to the label's prior.
    """
    counted = _counted(labelled)
    many = labelled.select("lang").filter("lang IS NOT NULL").distinct().limit(max_labels + 1).count() > max_labels
    counted = store(counted, "label-counts") if many else counted
    labels = sorted(r.lang for r in counted.select("lang").distinct().collect()) if many else None

    def counts_of(some: list[str] | None) -> tuple[list[str], np.ndarray]:
        rows = (counted if some is None else counted.filter(F.col("lang").between(some[0], some[-1]))).collect()
        names = sorted({r.lang for r in rows})
        counts = np.zeros((len(names), BUCKETS + PART))
        for r in rows:
            counts[names.index(r.lang), r.part * PART : (r.part + 1) * PART] = np.frombuffer(bytes(r.counts), np.int64)
        return names, counts

    blocks = [labels[i : i + max_labels] for i in range(0, len(labels), max_labels)] if many else [None]
    models, docs = [], []
    for block in blocks:
        names, counts = counts_of(block)
        c = counts[:, :BUCKETS] + alpha
        docs.append(counts[:, BUCKETS])
        models.append((names, np.log(c / c.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()))
    total = max(sum(d.sum() for d in docs), 1)
    with np.errstate(divide="ignore"):
        first, *more = (Model(names, np.log(d / total), matrix) for (names, matrix), d in zip(models, docs, strict=True))
    return Model(first.labels, first.prior, first.matrix, tuple(more))


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (the posterior), over the whole text of every row.

    A null text, one without letters, or a model without labels gives ``und`` with score 0. Equal posteriors go to the first label in
    code-point order. Repeated rows get equal results; an empty table gives none. Columns of ``docs`` named like a result column are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = names.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    mark = "_tag"
    while any(c.startswith(mark) for c in names):
        mark = f"_{mark}"
    state = [f"{mark}_label", f"{mark}_best", f"{mark}_sum"]  # the best label so far, its log, and the sum of all chances over its
    first = Model(model.labels, model.prior, model.matrix)

    def asked(rows: DataFrame, one: Model, last: bool, begins: bool) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                texts = batch.column(place).to_pylist()
                own = batch.columns[: len(names)]
                for a, b in _parts(texts):
                    buckets, owner, letters = grams(texts[a:b])
                    best, label, over = np.full(b - a, -np.inf), np.full(b - a, None, object), np.zeros(b - a)
                    if not begins:
                        label, best, over = (np.array(batch.column(len(names) + i).slice(a, b - a).to_pylist(), k) for i, k in enumerate((object, float, float)))
                    if m.labels:
                        logs = np.stack([np.bincount(owner, m.matrix[:, j][buckets], minlength=b - a) + m.prior[j] for j in range(len(m.labels))], axis=1)
                        top = logs.max(axis=1)
                        new, better = np.maximum(best, top), top > best
                        label[better] = np.array(m.labels, object)[logs.argmax(axis=1)][better]
                        with np.errstate(invalid="ignore"):
                            over = np.where(over > 0, over * np.exp(best - new), 0) + np.exp(logs - new[:, None]).sum(axis=1)
                        best = new
                    kept = [c.slice(a, b - a) for c in own]
                    if last:
                        known = (letters > 0) & (over > 0)
                        said = pa.array([x if k else "und" for x, k in zip(label, known, strict=True)], pa.string())
                        yield pa.RecordBatch.from_arrays([*kept, said, pa.array(np.divide(1.0, over, out=np.zeros(b - a), where=known))], names=[*names, "lang_pred", "score"])
                    else:
                        yield pa.RecordBatch.from_arrays([*kept, pa.array(label, pa.string()), pa.array(best), pa.array(over)], names=[*names, *state])

        return rows.mapInArrow(freed(run), f"{kinds}, lang_pred string, score double" if last else f"{kinds}, {state[0]} string, {state[1]} double, {state[2]} double")

    rows = docs.select(*names)
    every = [first, *model.more]
    for i, one in enumerate(every):
        rows = asked(rows, one, i == len(every) - 1, i == 0)
    return rows


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text); see ``tag``."""
    return tag(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "lang_pred", "score")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(of))


def held_out_language(docs: DataFrame, of: int = 5) -> DataFrame:
    """Predictions for all ``docs`` by a model of those outside fold 0: doc_id, held_out, lang_pred, score."""
    model = train(docs.filter(fold(F.col("doc_id"), of) != 0).select("text", "lang"))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id"), of) == 0).alias("held_out"), "lang_pred", "score")
