"""Edit distance of token lists and the tokens that were lost, by bit vectors over whole columns of the distance table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: So many columns are kept at once on the way back; wider stretches are halved and computed again.
KEPT = 64


class _Table:
    """The distance table of ``reference`` (rows) and ``said`` (columns): bit i - 1 of a vector stands for row i.

    A column is two vectors: rows that are one more, and one less, than the row above. ``equal`` has the rows that equal their upper left neighbour.
    """

    def __init__(self, reference: list, said: list):
        self.rows, self.said = len(reference), said
        self.all = (1 << self.rows) - 1
        self.where: dict = {}
        for i, token in enumerate(reference):
            self.where[token] = self.where.get(token, 0) | 1 << i

    def step(self, up: int, down: int, j: int) -> tuple[int, int, int, int]:
        """Column ``j`` after ``j`` - 1: its two vectors, ``equal``, and how much the last row changes."""
        match = self.where.get(self.said[j - 1], 0)
        equal = ((((match & up) + up) ^ up) | match | down) & self.all
        more = (down | ~(equal | up)) & self.all
        less = equal & up
        top = self.rows - 1
        change = (more >> top & 1) - (less >> top & 1) if self.rows else 1
        more, less = (more << 1 | 1) & self.all, less << 1 & self.all
        return less | ~(equal | more) & self.all, more & equal, equal, change

    def distance(self) -> int:
        up, down, d = self.all, 0, self.rows
        for j in range(1, len(self.said) + 1):
            up, down, _, change = self.step(up, down, j)
            d += change
        return d

    def lost(self) -> list[int]:
        """Rows that the path back deletes: diagonal steps first, then deletions, then insertions."""
        out: list[int] = []
        i = self.rows
        todo = [(0, len(self.said), self.all, 0)]  # columns (low, high] with the column ``low``
        while todo and i:
            low, high, up, down = todo.pop()
            if high - low > KEPT:
                middle = (low + high) // 2
                a, b = up, down
                for j in range(low + 1, middle + 1):
                    a, b, _, _ = self.step(a, b, j)
                todo += [(low, middle, up, down), (middle, high, a, b)]
                continue
            columns = []
            for j in range(low + 1, high + 1):
                up, down, equal, _ = self.step(up, down, j)
                columns.append((up, equal, self.where.get(self.said[j - 1], 0)))
            while columns and i:
                one_more, equal, match = (x >> (i - 1) & 1 for x in columns[-1])
                if match or not equal:
                    i -= 1
                    columns.pop()
                elif one_more:
                    i -= 1
                    out.append(i)
                else:
                    columns.pop()
        return [*range(i), *reversed(out)]


def edit_distance(reference: list[str], said: list[str]) -> tuple[int, list[str]]:
    """Edit distance of token lists and the reference tokens deleted on the shortest path that prefers diagonal steps from the end, then deletions.

    Each token of ``said`` costs a few operations on integers of as many bits as ``reference`` has tokens; memory is that of some columns, whatever the lengths.
    """
    table = _Table(reference, said)
    return table.distance(), [reference[i] for i in table.lost()]


def aligned(reference: Column, said: Column) -> Column:
    """struct(distance, lost) of two array<string> columns: the edit distance over tokens, and the reference tokens that ``said`` lacks. Null arrays
    are empty, null tokens equal each other.
    """

    @F.pandas_udf("distance long, lost array<string>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        lists = ([[] if x is None else list(x) for x in s] for s in (a, b))
        return pd.DataFrame([edit_distance(x, y) for x, y in zip(*lists, strict=True)], columns=["distance", "lost"])

    return run(reference, said)


def bare(text: Column) -> Column:
    """The Chinese characters, letters and digits of ``text``, one token each."""
    return F.regexp_extract_all(text, F.lit("([一-鿿A-Za-z0-9])"), 1)
