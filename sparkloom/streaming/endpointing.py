"""Utterance endpointing over frames of a session, batch or streamed: one state-transition function for both."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

EVENTS = "session string, seq long, event string, frames int"


@dataclass(frozen=True)
class Rules:
    frame_ms: int = 20
    start_frames: int = 3
    barge_in_frames: int = 5
    silence_ms: int = 700
    least_ms: int = 300
    most_s: float = 20.0
    margin_db: float = 10.0
    floor_dbfs: float = -45.0
    attack: float = 0.35
    release: float = 0.02


class State(NamedTuple):
    """floor: the room's level, NaN before the first frame. ring: frames held before speech. kept: frames of the utterance."""

    floor: float = float("nan")
    voiced: int = 0
    silent: int = 0
    over: int = 0
    speaking: bool = False
    ring: int = 0
    kept: int = 0
    next_seq: int = -(2**62)


def step(s: State, level: float, character_speaks: bool, rules: Rules) -> tuple[State, list[tuple[str, int]]]:
    """The state after a frame, and its events with the frames of the utterance. In plain variables, as it runs once a frame."""
    floor, run, silent, over, speaking, ring, kept, next_seq = s
    known = floor == floor
    voiced = known and level > rules.floor_dbfs and level >= floor + rules.margin_db
    if not known:
        floor = level
    elif not voiced:
        floor += (level - floor) * (rules.attack if level < floor else rules.release)
    if speaking:
        kept += 1
    else:
        ring = min(max(rules.start_frames, rules.barge_in_frames) + 1, ring + 1)
    if character_speaks:
        over = over + 1 if voiced else 0
        if over < rules.barge_in_frames:
            return State(floor, run, silent, over, speaking, ring, kept, next_seq), []
        return State(floor, rules.start_frames, 0, 0, True, 0, kept + ring, next_seq), [("barge_in", kept + ring)]
    run, silent = (run + 1, 0) if voiced else (0, silent + 1)
    if speaking:
        if kept * rules.frame_ms >= rules.most_s * 1000:
            return State(floor, run, silent, 0, False, ring, 0, next_seq), [("too_long", kept), ("speech_end", kept)]
        if silent * rules.frame_ms >= rules.silence_ms:
            enough = max(0, kept * rules.frame_ms - rules.silence_ms) >= rules.least_ms
            return State(floor, run, silent, 0, False, ring, 0, next_seq), [("speech_end", kept)] if enough else []
    elif run >= rules.start_frames:
        return State(floor, rules.start_frames, 0, 0, True, 0, kept + ring, next_seq), [("speech_start", kept + ring)]
    return State(floor, run, silent, 0, speaking, ring, kept, next_seq), []


def flush(s: State, rules: Rules) -> tuple[State, list[tuple[str, int]]]:
    """An explicit end: the utterance ends now if it is long enough, trailing silence included."""
    if not s.speaking:
        return s, []
    ended = s._replace(speaking=False, silent=0, voiced=0, ring=0, kept=0)
    return ended, [("speech_end", s.kept)] if s.kept * rules.frame_ms >= rules.least_ms else []


def _walk(state: State, frames: Iterable[tuple], rules: Rules) -> tuple[State, list[tuple[int, str, int]]]:
    """Over (seq, level, speaking) in order of seq."""
    out: list[tuple[int, str, int]] = []
    next_seq = state.next_seq
    for seq, level, speaks in frames:
        if seq < next_seq:
            continue  # a frame that came too late or twice
        state, events = step(state, float(level), bool(speaks), rules)
        next_seq = int(seq) + 1
        if events:
            out += [(int(seq), e, n) for e, n in events]
    return state._replace(next_seq=next_seq), out


def endpoints(frames: DataFrame, rules: Rules = Rules(), end: bool = True) -> DataFrame:
    """(session, seq, event, frames) of ``frames`` (session string, seq, level in dBFS, speaking); ``end`` flushes at the end of each session. A
    session is one task's, as its state is sequential.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        state, out = _walk(State(), g.sort_values("seq")[["seq", "level", "speaking"]].itertuples(index=False, name=None), rules)
        if end:
            out += [(state.next_seq - 1, e, n) for e, n in flush(state, rules)[1]]
        return pd.DataFrame([(g["session"].iloc[0], *x) for x in out], columns=["session", "seq", "event", "frames"])

    return frames.select("session", "seq", "level", "speaking").groupBy("session").applyInPandas(run, EVENTS)


def _ready(waiting: dict[int, tuple], next_seq: int, late: int) -> list[tuple]:
    """Takes from ``waiting`` the frames that can be walked: the next one by seq, or one whose gap before it is ``late`` frames old."""
    ready = []
    newest = max(waiting, default=0)
    for seq in sorted(waiting):
        if seq > next_seq and newest - seq < late:
            break
        ready.append((seq, *waiting.pop(seq)[:2]))
        next_seq = max(next_seq, seq + 1)
    return ready


def _in_order(waiting: dict[int, tuple], next_seq: int, late: int) -> pd.DataFrame:
    """The same as a table."""
    return pd.DataFrame(_ready(waiting, next_seq, late), columns=["seq", "level", "speaking"])


#: Sessions are kept in so many buckets, as a call to the executor's state for each session and micro-batch costs far more than its frames do.
BUCKETS = 512
#: A session of a bucket: its name, where the walk stands, the time of its newest frame, and the frames that wait for others.
SESSION = pa.schema(
    [("session", pa.string()), ("floor", pa.float64()), *((x, pa.int64()) for x in ("voiced", "silent", "over")), ("speaking", pa.bool_()), *((x, pa.int64()) for x in ("ring", "kept", "next_seq", "last"))]
    + [("seq", pa.list_(pa.int64())), ("level", pa.list_(pa.float64())), ("busy", pa.list_(pa.bool_())), ("at", pa.list_(pa.int64()))]
)


class _Session:
    __slots__ = ("state", "last", "waiting")

    def __init__(self, state: State = State(), last: int = -1, waiting: dict[int, tuple] | None = None):
        self.state, self.last, self.waiting = state, last, waiting if waiting is not None else {}


def _packed(sessions: dict[str | None, _Session]) -> bytes:
    rows = []
    for name, x in sessions.items():
        level, busy, at = zip(*x.waiting.values(), strict=True) if x.waiting else ((), (), ())
        rows.append((name, *x.state, x.last, tuple(x.waiting), level, busy, at))
    batch = pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), SESSION, strict=True)], schema=SESSION)
    return batch.serialize().to_pybytes()


def _unpacked(blob: bytes) -> dict[str | None, _Session]:
    columns = [x.to_pylist() for x in pa.ipc.read_record_batch(pa.py_buffer(bytes(blob)), SESSION).columns]
    out = {}
    for name, *plain, last, seq, level, busy, at in zip(*columns, strict=True):
        out[name] = _Session(State(*plain), last, dict(zip(seq, zip(level, busy, at, strict=True), strict=True)))
    return out


class Endpointer(StatefulProcessor):
    """The walk over the sessions of a bucket, delivery by delivery.

    State: a bucket's sessions, written as one value (see ``SESSION``), and its timer, the first that one of them needs. Frames are let go in order of
    seq. A gap is waited for until a frame ``late`` places after it has come, or, in event time, until the watermark has passed the frame behind it. A
    session that has been idle for ``idle_ms`` walks what waits, is flushed, and its state goes.
    """

    def __init__(self, rules: Rules, late: int, idle_ms: int | None, event_time: bool):
        self.rules, self.late, self.idle_ms, self.event_time = rules, late, idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "sessions binary, timer long")

    def _known(self) -> tuple[dict[str | None, _Session], int]:
        blob, timer = self.bucket.get() or (None, -1)
        return _unpacked(blob) if blob else {}, timer

    def _let_go(self, waiting: dict[int, tuple], next_seq: int, watermark: int) -> list[tuple]:
        """Takes from ``waiting`` what can be walked."""
        if not self.event_time:
            return _ready(waiting, next_seq, self.late)
        ready, passed = [], max((seq for seq, x in waiting.items() if x[2] <= watermark), default=next_seq - 1)
        for seq in sorted(waiting):
            if seq > passed and seq != next_seq:
                break
            ready.append((seq, *waiting.pop(seq)[:2]))
            next_seq = max(next_seq, seq + 1)
        return ready

    def _due(self, x: _Session) -> int:
        """When a session is idle, or in event time when its first waiting frame is passed; -1 for never."""
        due = [x.last + self.idle_ms] if self.idle_ms else []
        if self.event_time:
            due += [at for _, _, at in x.waiting.values()]
        return min(due, default=-1)

    def _keep(self, sessions: dict[str | None, _Session], old: int, now: int) -> None:
        """Writes ``sessions``, with the timer that they need in place of ``old``."""
        due = min(map(self._due, sessions.values()), default=-1) if self.idle_ms or self.event_time else -1
        new = max(due, now + 1) if due != -1 else -1
        if new != old:
            if old > now:
                self.handle.deleteTimer(old)
            if new >= 0:
                self.handle.registerTimer(new)
        if sessions:
            self.bucket.update((_packed(sessions), new))
        else:
            self.bucket.clear()

    def _events(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["session", "seq", "event", "frames"])

    def _clock(self, times: TimerValues) -> int:
        return times.getCurrentWatermarkInMs() if self.event_time else times.getCurrentProcessingTimeInMs()

    def _walked(self, name: str | None, x: _Session, ready: list[tuple]) -> list[tuple]:
        x.state, out = _walk(x.state, ready, self.rules)
        return [(name, *event) for event in out]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        sessions, timer = self._known()
        now = self._clock(timerValues) if self.idle_ms or self.event_time else 0
        came: dict[str | None, _Session] = {}
        for frames in rows:
            at = frames["at"].to_numpy().astype("datetime64[ms]").astype("int64").tolist() if self.event_time else [now] * len(frames)
            names = frames["session"].where(frames["session"].notna(), None).tolist()
            for name, seq, level, speaks, t in zip(names, frames["seq"].tolist(), frames["level"].tolist(), frames["speaking"].tolist(), at, strict=True):
                x = came.get(name)
                if x is None:
                    x = came[name] = sessions.setdefault(name, _Session())
                if t > x.last:
                    x.last = t
                if seq >= x.state.next_seq:
                    x.waiting.setdefault(int(seq), (level, bool(speaks), t))
        out = [e for name, x in came.items() for e in self._walked(name, x, self._let_go(x.waiting, x.state.next_seq, now))]
        self._keep(sessions, timer, now)
        yield from self._events(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions, timer = self._known()
        out, now = [], self._clock(timerValues)
        for name, x in list(sessions.items()):
            if self.idle_ms is not None and x.last + self.idle_ms <= now:
                out += self._walked(name, x, _ready(x.waiting, x.state.next_seq, 0))
                out += [(name, x.state.next_seq - 1, e, n) for e, n in flush(x.state, self.rules)[1]]
                del sessions[name]
            elif self.event_time:
                out += self._walked(name, x, self._let_go(x.waiting, x.state.next_seq, now))
        self._keep(sessions, timer, now)
        yield from self._events(out)

    def close(self) -> None:
        pass


def stream_endpoints(frames: DataFrame, rules: Rules = Rules(), late: int = 10, idle_ms: int | None = 60_000, event_time: str | None = None, delay: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """The same over a stream, whatever the micro-batches: frames wait for those before them.

    A gap is waited for until a frame ``late`` places after it has come; a frame that comes even later is dropped, as is a second one of the same seq.
    The first frames of a session wait likewise, as its first seq isn't known. A session without frames for ``idle_ms`` walks what waits, is flushed,
    and its state goes; so the state is bounded by the sessions of that time, each with at most about ``late`` frames. None, for runs that end by
    themselves, keeps all.

    ``event_time`` names a timestamp column (an extension: the listener itself knows no clock but its frames): gaps are then waited for until the
    watermark, ``delay`` behind the newest frame, has passed the frame behind them, and ``idle_ms`` counts in that time, so a run over old frames
    gives what a run in real time gave. The stream needs the RocksDB state store.

    A task holds one of the ``buckets`` of sessions at a time, with its frames of a micro-batch, so streams of many millions of sessions want more.
    """
    columns = [F.pmod(F.xxhash64("session"), F.lit(buckets)).alias("bucket"), "session", "seq", "level", "speaking"]
    mode = "EventTime" if event_time else "ProcessingTime" if idle_ms else "None"
    rows = frames.select(*columns, F.col(event_time).cast("timestamp").alias("at")).withWatermark("at", delay) if event_time else frames.select(*columns)
    return rows.groupBy("bucket").transformWithStateInPandas(Endpointer(rules, late, idle_ms, bool(event_time)), EVENTS, "Append", mode)
