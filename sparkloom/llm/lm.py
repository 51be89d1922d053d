"""Language-model scores by prediction by partial matching over bytes, with a word base score beside it.

Model: a trie of byte contexts of 0 to 5 bytes, learned from the training documents. A byte that a context has seen c times of T, among D
different ones, has (c - 1/2) / T; the escape to the context one byte shorter has D / 2T, and there the bytes of the longer context are
excluded from T and D. After the empty context, what is left is uniform over the bytes not seen. As the trie is static, the probability of a
byte depends on the byte and its 5-byte context only, so it is computed once for each distinct six bytes of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._store import store
from sparkloom.llm._text import chunks, mix, word_hashes
from sparkloom.llm.language import fold

U = np.uint64
ORDER = 5
PAD = b"\n" * ORDER
END = U(0x7A5C3E1F9B8D6421)
Counts = tuple[np.ndarray, np.ndarray]


def normal(doc: bytes) -> bytes:
    """Lower-cased words with one space between and a line end, which no word holds, as the end symbol."""
    return b" ".join(doc.lower().split()) + b"\n"


def contexts(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the normalised ``docs``: the byte and the 5 before it, the nearest in the highest place, as a 48-bit integer; and its document."""
    texts = [normal(d) for d in docs]
    x = np.frombuffer(PAD.join([b"", *texts]), np.uint8).astype(np.uint64)
    lengths = np.array([len(t) for t in texts])
    key = x[ORDER:].copy()
    for j in range(1, ORDER + 1):
        key |= x[ORDER - j : len(x) - j] << U(8 * (ORDER + 1 - j))
    owner = np.repeat(np.arange(len(docs)), lengths)
    return key[np.arange(len(owner)) + ORDER * owner], owner


def runs(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, int)


def added(keys: np.ndarray, counts: np.ndarray) -> Counts:
    """Distinct ``keys`` in order, with the sums of their ``counts``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = runs(keys)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def shortened(keys: np.ndarray, n: int) -> np.ndarray:
    """Six-byte keys with a context of the nearest ``n`` bytes only."""
    return ((keys >> U(8 * (ORDER + 1 - n))) << U(8)) | (keys & U(255))


def _found(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(among):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


def log_probabilities(keys: np.ndarray, counts: np.ndarray, low: Counts) -> np.ndarray:
    """log10 probability of each six-byte key (distinct, in order). ``counts`` are those of training; ``keys`` hold every training key that shares their
    three nearest context bytes, and ``low`` the counts of all training keys of two context bytes."""
    nodes = {2: low}
    for n in (1, 0):
        nodes[n] = added(((low[0] >> U(8 * (3 - n))) << U(8)) | (low[0] & U(255)), low[1])
    seen = counts > 0
    nodes[ORDER] = (keys[seen], counts[seen])
    for n in range(ORDER - 1, 2, -1):
        nodes[n] = added(shortened(keys[seen], n), counts[seen])
    result, done, longer = np.zeros(len(keys)), np.zeros(len(keys), bool), None
    for n in range(ORDER, -1, -1):
        node, c = nodes[n]
        first = runs(node >> U(8))
        context = (node >> U(8))[first]
        total = np.add.reduceat(c, first).astype(np.float64) if len(first) else np.zeros(0)
        kinds = np.diff(np.append(first, len(node))).astype(np.float64)
        mine = shortened(keys, n)
        at, known = _found(context, mine >> U(8))
        place, hit = _found(node, mine)
        t, d = np.zeros(len(keys)), np.zeros(len(keys))
        t[known], d[known] = total[at[known]], kinds[at[known]]
        if longer is not None:  # without the bytes of the longer context, where that was seen
            up_node, up_first, up_kinds, up_at, up_known = longer
            parent = ((up_node >> U(16)) << U(8)) | (up_node & U(255))
            p, same = _found(node, parent)
            out = np.add.reduceat(np.where(same, c[p], 0), up_first).astype(np.float64) if len(up_first) else np.zeros(0)
            t[up_known] -= out[up_at[up_known]]
            d[up_known] -= up_kinds[up_at[up_known]]
        open_ = known & ~done & (t > 0)
        take = open_ & hit
        result[take] += np.log10((c[place[take]] - 0.5) / t[take])
        leave = open_ & ~hit
        result[leave] += np.log10(d[leave] / (2 * t[leave]))
        done |= take
        longer = (node, first, kinds, at, known)
    left = 256 - (len(nodes[0][0]) if len(nodes[0][0]) < 256 else 0)
    result[~done] -= np.log10(left)
    return result


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys) % U(buckets)).astype(np.int64)


def _distinct(docs: list[bytes], train: np.ndarray) -> tuple[Counts, Counts]:
    """Distinct six-byte keys and word hashes of ``docs``, with their counts in training documents."""
    grams, words = [], []
    for first, part in chunks_of(docs):
        key, owner = contexts(part)
        tagged = np.sort((key << U(1)) | train[first : first + len(part)][owner].astype(np.uint64))
        at = runs(tagged)
        n = np.diff(np.append(at, len(tagged)))
        grams.append((tagged[at] >> U(1), np.where(tagged[at] & U(1), n, 0)))
        h, edge = word_hashes(part)
        mark = np.repeat(train[first : first + len(part)], np.diff(edge)).astype(np.int64)
        ends = np.array([END, END], np.uint64)
        words.append(added(np.append(h, ends), np.append(mark, [int(train[first : first + len(part)].sum()), 0])))
    both = lambda x: added(np.concatenate([k for k, _ in x]), np.concatenate([c for _, c in x]).astype(np.int64))
    return both(grams), both(words)


def chunks_of(docs: list[bytes], most: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of about ``most`` bytes and at most 50,000 documents."""
    first = size = 0
    for i, d in enumerate(docs):
        if i > first and (size + len(d) > most or i - first >= 50_000):
            yield first, docs[first:i]
            first, size = i, 0
        size += len(d)
    if first < len(docs):
        yield first, docs[first:]


def _dealt(keys: np.ndarray, of: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket, then key, and the end of each bucket's stretch."""
    b = _bucket(of, buckets)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets), side="right")


def _raw(texts: pa.ChunkedArray) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def _low_counts(docs: DataFrame) -> Counts:
    """Training counts of two context bytes and a byte: summed in Spark by range; at most 2 ** 24 entries by construction, so they fit any driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, part in chunks(batch.column(0).to_pylist()):
                k = np.sort(shortened(contexts(part)[0], 2).astype(np.uint32))
                at = runs(k)
                keys, counts = added(np.append(keys, k[at].astype(np.uint64)), np.append(counts, np.diff(np.append(at, len(k)))))
        part = (keys >> U(19)).astype(np.int64)
        at = np.append(runs(part), len(part))
        yield pa.RecordBatch.from_arrays([pa.array(part[at[:-1]], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["part", "keys", "counts"])

    def add(t: pa.Table) -> pa.Table:
        k, c = added(*(np.concatenate([np.frombuffer(x.as_buffer(), d) for x in t.column(n)]) for n, d in (("keys", np.uint64), ("counts", np.int64))))
        return pa.table({"part": t.column("part")[:1], "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([c.tobytes()], pa.binary())})

    schema = "part long, keys binary, counts binary"
    rows = sorted(docs.select("text").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect())
    join = lambda x, d: np.concatenate([np.frombuffer(bytes(r), d) for r in x]) if x else np.zeros(0, d)
    return join([r.keys for r in rows], np.uint64), join([r.counts for r in rows], np.int64)


def scores(docs: DataFrame, of: int = 10, block_bytes: int = 16_000_000, least_buckets: int = 512) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text); documents outside fold 0 train.

    Documents are dealt by hash, equal rows in turn, to blocks of about ``block_bytes``; ``docs`` is read twice for it and must give its rows in the same
    partitions and order both times, as files do (else lengths differ and the query fails). Each block sends its distinct six-byte keys and word hashes, with its training counts,
    to buckets, ``least_buckets`` or as many as there are blocks, so that a bucket's share doesn't grow (keys by their three nearest context bytes, which keeps a context's keys together); a bucket sums the counts of all
    blocks, computes the probabilities of its keys and the totals of its words, and answers every block; a block then adds up its documents.
    So all counts are whole, a frequent word or context is one entry a block, and nothing but the bounded two-byte counts is broadcast.

    Null and empty texts consist of the end alone. Repeated rows count each and get equal scores. An empty table gives none; other
    columns are ignored. A null doc_id counts as the empty id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), of) == 0).alias("held_out"), "text")
    low = spark.sparkContext.broadcast(_low_counts(rows.filter("not held_out")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    buckets = max(least_buckets, blocks)
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(4096))  # equal rows go to many blocks
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", turn), F.lit(blocks)).cast("int"))

    def ask(t: pa.Table) -> pa.Table:
        (gk, gc), (wk, wc) = _distinct(_raw(t.column("text")), ~np.array(t.column("held_out").to_pylist(), bool))
        go, ge = _dealt(gk, gk >> U(24), buckets)
        wo, we = _dealt(wk, wk, buckets)
        gk, gc, wk, wc = gk[go], gc[go], wk[wo], wc[wo]
        cut = lambda x, e: pa.array([x[a:b].tobytes() for a, b in zip(np.append(0, e), e, strict=False)], pa.binary())
        return pa.table({"block": pa.array([t.column("block")[0].as_py()] * buckets, pa.int32()), "bucket": pa.array(range(buckets), pa.int32()), "grams": cut(gk, ge), "gram_counts": cut(gc.astype(np.uint32), ge), "words": cut(wk, we), "word_counts": cut(wc.astype(np.uint32), we)})

    def answer(t: pa.Table) -> pa.Table:
        def summed(keys: str, counts: str) -> tuple:
            k = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(keys)]
            c = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column(counts)]).astype(np.int64)
            all_ = np.concatenate(k)
            u, s = added(all_, c)
            return u, s, np.searchsorted(u, all_), np.cumsum([len(x) for x in k])

        back = lambda x, e: pa.array([x[a:b].tobytes() for a, b in zip(np.append(0, e), e, strict=False)], pa.binary())
        u, s, at, edge = summed("grams", "gram_counts")
        logs = log_probabilities(u, s, low.value)
        w, ws, wat, wedge = summed("words", "word_counts")
        rest = [0] * (t.num_rows - 1)
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "logs": back(logs[at], edge), "known": back(ws[wat], wedge), "n": pa.array([int(ws.sum()), *rest], pa.int64()), "v": pa.array([int((ws > 0).sum()), *rest], pa.int64())})

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        docs_, out = _raw(left.column("text")), {n: [] for n in names[2:]}
        nothing = np.zeros(len(docs_), bool)
        (gk, _), (wk, _) = _distinct(docs_, nothing)
        right = right.sort_by("bucket")
        logs, known = np.zeros(len(gk)), np.zeros(len(wk), np.int64)
        logs[_dealt(gk, gk >> U(24), buckets)[0]] = np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in right.column("logs")])
        known[_dealt(wk, wk, buckets)[0]] = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in right.column("known")])
        end = known[np.searchsorted(wk, END)]
        base = np.log10(known + 0.1)
        for _, part in chunks_of(docs_):
            key, owner = contexts(part)
            tagged = np.sort((key << U(16)) | owner.astype(np.uint64))
            at = runs(tagged >> U(16))
            each = np.repeat(logs[np.searchsorted(gk, tagged[at] >> U(16))], np.diff(np.append(at, len(tagged))))
            out["score"].append(np.bincount((tagged & U(0xFFFF)).astype(np.int64), each, minlength=len(part)))
            h, edge = word_hashes(part)
            which, n = np.searchsorted(wk, h), np.diff(edge)
            doc = np.repeat(np.arange(len(part)), n)
            out["n_tokens"].append(n + 1)
            out["n_known"].append(np.bincount(doc, known[which] > 0, minlength=len(part)).astype(np.int64) + (end > 0))
            out["base"].append(np.bincount(doc, base[which], minlength=len(part)) + np.log10(end + 0.1))
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64()}
        return pa.table([left.column("doc_id"), left.column("held_out"), *(pa.array(np.concatenate(out[n]), kinds[n]) for n in names[2:])], names=names)

    asked = placed.groupBy("block").applyInArrow(ask, "block int, bucket int, grams binary, gram_counts binary, words binary, word_counts binary")
    answers = store(asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, logs binary, known binary, n long, v long"), "answers")
    n, v = answers.agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0
    each = placed.groupBy("block").cogroup(answers.select("block", "bucket", "logs", "known").groupBy("block")).applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    return each.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(n + 0.1 * (v + 1))))).alias("base_score"), "score")
