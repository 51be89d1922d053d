"""Samples that come in pieces of any length, as whole blocks: what is left of a delivery waits for the next."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

BLOCKS = "session string, block long, samples array<double>"


class Reblocker(StatefulProcessor):
    """State of a session: the samples left over (a list of fewer than ``size``), the deliveries that came before their turn (a map by seq), and the
    numbers of the next delivery and block (a value).
    """

    def __init__(self, size: int, idle_ms: int | None):
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getListState("left", "sample double", self.idle_ms)
        self.early = handle.getMapState("early", "seq long", "samples array<double>", self.idle_ms)
        self.place = handle.getValueState("place", "seq long, block long, timer long", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        seq, block, timer = self.place.get() if self.place.exists() else (0, 0, -1)
        known = {int(k[0]) for k in self.early.keys()}
        new: dict[int, list] = {}
        for frame in rows:
            for s, x in zip(frame["seq"].tolist(), frame["samples"], strict=True):
                if s >= seq and s not in known:
                    new.setdefault(int(s), [float(v) for v in x] if x is not None else [])
        had = held = [v for (v,) in self.left.get()] if self.left.exists() else []
        while seq in new or seq in known:
            if seq in known:
                held = held + list(self.early.getValue((seq,))[0])
                self.early.removeKey((seq,))
                known.discard(seq)
            else:
                held = held + new.pop(seq)
            seq += 1
        for s, x in new.items():
            self.early.updateValue((s,), (x,))
        whole = len(held) // self.size
        out = [(key[0], block + i, held[i * self.size : (i + 1) * self.size]) for i in range(whole)]
        if held is not had:
            rest = held[whole * self.size :]
            self.left.put([(v,) for v in rest]) if rest else self.left.clear()
        if self.idle_ms:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.place.update((seq, block + whole, timer))
        yield pd.DataFrame(out, columns=["session", "block", "samples"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.left, self.early, self.place):
            state.clear()
        yield pd.DataFrame([], columns=["session", "block", "samples"])

    def close(self) -> None:
        pass


def stream_blocks(deliveries: DataFrame, size: int, idle_ms: int | None = 600_000) -> DataFrame:
    """(session, block, samples): blocks of ``size`` samples, however ``deliveries`` (session string, seq from 0 without gaps, samples array<double>)
    and the micro-batches cut them.

    A delivery that comes before its turn waits; one that came already is dropped. Null samples of a delivery are none. What is left of the last
    delivery isn't a block. A session without deliveries for ``idle_ms`` is forgotten (timer and TTL); None keeps all. The stream needs the RocksDB
    state store.
    """
    rows = deliveries.select("session", "seq", "samples").groupBy("session")
    return rows.transformWithStateInPandas(Reblocker(size, idle_ms), BLOCKS, "Append", "ProcessingTime" if idle_ms else "None")
