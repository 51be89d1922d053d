"""Word and shingle hashes of whole texts, in numpy over many documents at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACES = b" \t\n\r\x0b\x0c"
_rng = np.random.default_rng(20240229)
#: A 64-bit value per byte: A-Z as a-z, white space 0, so that hashes need no lower-cased copy.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BYTE[65:91] = BYTE[97:123]
BYTE[list(SPACES)] = 0
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(0xD1342543DE82EF95, 64)


def chunks(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts in UTF-8) of runs of about ``most`` bytes; one text may be longer. Null is empty."""
    held, first, size = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > most:
            yield first, held
            held, first, size = [], i, 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


def stretches(column: pa.Array, rows: int = 256, most: int = 250_000) -> Iterator[tuple[int, list[bytes]]]:
    """``chunks`` of a column, of which only ``rows`` texts are taken out of Arrow at once: a worker then holds no second copy of a whole batch."""
    for a in range(0, len(column), rows):
        for first, part in chunks(column.slice(a, rows).to_pylist(), most):
            yield a + first, part


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow in a worker that gives back, after each batch and at the end, what Arrow's pool keeps: workers live on from task to task,
    and beside their executor what they keep counts in full.
    """

    def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                pa.default_memory_pool().release_unused()

        yield from run(each())
        pa.default_memory_pool().release_unused()

    return freeing


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all ``docs`` and the first word of each document (one more entry at the end)."""
    global _POWERS
    raw = np.frombuffer(b" ".join(docs) + b" ", dtype=np.uint8)
    space = IS_SPACE[raw]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    edges = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
    first = np.searchsorted(begins, edges)
    if not len(begins):
        return np.zeros(0, np.uint64), first
    lengths = np.diff(np.concatenate([begins, [len(raw)]]))
    if lengths.max() > len(_POWERS):
        _POWERS = powers(0xD1342543DE82EF95, int(lengths.max()) + 1)
    raw = raw[begins[0] :]
    place = np.arange(len(raw)) - np.repeat(begins - begins[0], lengths)
    return mix(np.add.reduceat(BYTE[raw] * _POWERS[place], begins - begins[0])), first


def shingles(docs: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct ``k``-word shingles of each document as 64-bit hashes; a document of fewer words has its whole
    sequence as its only shingle, one without words none."""
    words, first = word_hashes(docs)
    mult = powers(0x2545F4914F6CDD1D, k + 1)[1:]
    whole = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        whole += words[j : j + len(whole)] * mult[j]
    whole = mix(whole)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        elif b > a:
            yield mix((words[a:b] * mult[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * _STEP)
        else:
            yield whole[:0]
