"""Byte-level BPE with the merges of a public vocabulary file: encoding and decoding of whole texts."""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._text import freed

#: The pattern that splits text into pieces before the merges, with white space by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = 1 << 29
SHORT = 48
#: The cache holds so many pieces at most, half of them from before, each of at most KEPT characters, so some 50 MB at worst.
CACHED, KEPT = 200_000, 32


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes, in order, are written from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Pieces to ids and ids to bytes. Holds a bounded cache of pieces."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        byte, vocab = byte_chars(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.single = [0] * 256
        for c, b in byte.items():
            self.single[b] = vocab[c]
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        #: by the left id the ranks of merging it with right ones, and by rank the id that a merge makes
        none: dict[int, int] = {}
        self.merge, self.made = [none] * len(self.bytes), []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if self.merge[vocab[a]] is none:
                self.merge[vocab[a]] = {}
            self.merge[vocab[a]].setdefault(vocab[b], rank)
            self.made.append(vocab[a + b])
        codec = self

        class Cache(dict):
            """Ids by piece. When half of CACHED are held they become the old ones, of which those that are met again are taken over."""

            old: dict[str, bytes] = {}

            def __missing__(self, piece: str) -> bytes:
                out = self.old.get(piece)
                if out is None:
                    out = array("I", codec.piece(piece.encode())).tobytes()
                if len(piece) <= KEPT:
                    if len(self) >= CACHED // 2:
                        self.old = dict(self)
                        self.clear()
                    self[piece] = out
                return out

        self.cache = Cache()

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece: ids of its parts and, beside them, the rank of joining each part with the next; the lowest rank goes first, the
        leftmost of equal ones, its boundary is deleted and the two ranks beside it are looked up anew."""
        ids = [self.single[b] for b in raw]
        if len(ids) > SHORT:
            return self._long(ids)
        merge, made = self.merge, self.made
        ranks = [merge[a].get(b, NONE) for a, b in pairwise(ids)]
        while ranks and (low := min(ranks)) != NONE:
            i = ranks.index(low)
            ids[i] = one = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merge[ids[i - 1]].get(one, NONE)
            if i < len(ranks):
                ranks[i] = merge[one].get(ids[i + 1], NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same for long pieces, with a heap of ranks, as scanning would take the square of the length."""
        n, merge, made = len(ids), self.merge, self.made
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := merge[ids[i]].get(ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made[low], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := merge[ids[left]].get(ids[right], NONE)) != NONE:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        get, pieces = self.cache.__getitem__, self.pieces.findall
        if not any(x in text for x in self.special):
            return b"".join(map(get, pieces(text)))
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else b"".join(map(get, pieces(x))) for x in self.split.split(text))

    def decode(self, ids: bytes) -> str:
        """The text of such ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(vocabulary: str) -> Codec:
    """One codec a Python worker and vocabulary; workers live on from task to task."""
    key = hash(vocabulary)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def _texts(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text); with ``decoded``, also the text that the ids give again.

    ``path`` names the vocabulary file, on the driver; its text (a few MB) is broadcast. ``ids`` is binary: little-endian unsigned 32-bit
    integers. Null and empty texts have no ids. Very long pieces take n log n steps. Repeated rows get equal results; an empty
    table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_texts(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                out = [part.column(0), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(map(codec.decode, ids), pa.string())] * decoded, names=["doc_id", "ids"] + ["decoded"] * decoded)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freed(run), "doc_id long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of every row of ``encoded`` (doc_id, ids binary); null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_texts(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(freed(run), "doc_id long, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    return encode(docs, path, decoded=True).select(
        "doc_id", F.call_function("div", F.octet_length("ids"), F.lit(4)).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )
