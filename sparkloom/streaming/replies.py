"""Streams of reply deltas cut into speech chunks, and of turns folded into a bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.chunks import rest, take

CHUNKS = "reply string, chunk_index int, chunk string, is_final boolean"
MEMORY = "conv string, turn long, folded int, summary string"


def _timeout(idle_ms: int | None) -> str:
    """A processing-time timeout bounds the state; None, for runs that end by themselves, keeps all."""
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def stream_chunks(deltas: DataFrame, idle_ms: int | None = 600_000) -> DataFrame:
    """Chunks of ``deltas`` (reply string, seq, delta, last boolean) as they complete. The newest chunk is held until another follows or the reply
    ends, so that the final one can say so. A reply without deltas for ``idle_ms`` ends with what there is, and its state goes.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        buffer, emitted, waiting = held.get if held.exists else ("", 0, "")
        out, ended = [], False
        if held.hasTimedOut:
            rows = [(0, "", True)]
        else:
            rows = sorted((x for p in parts for x in zip(p["seq"].tolist(), p["delta"].tolist(), p["last"].tolist(), strict=True)), key=lambda x: x[0])
        for _, delta, last in rows:
            new, buffer = take(buffer + (delta or ""), emitted)
            if last:
                new, buffer, ended = new + rest(buffer, emitted + len(new)), "", True
            for chunk in new:
                if waiting:
                    out.append((key[0], emitted - 1, waiting, False))
                waiting, emitted = chunk, emitted + 1
        if ended:
            if waiting:
                out.append((key[0], emitted - 1, waiting, True))
            held.remove() if held.exists else None
        else:
            held.update((buffer, emitted, waiting))
            if idle_ms:
                held.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["reply", "chunk_index", "chunk", "is_final"])

    return deltas.groupBy("reply").applyInPandasWithState(run, CHUNKS, "buffer string, emitted int, waiting string", "append", _timeout(idle_ms))


def _merged(summary: str, more: str, most: int) -> str:
    lines = [x for x in (summary.strip(), more.strip()) if x]
    lines = "\n".join(lines).split("\n") if lines else []
    while lines and len("\n".join(lines)) > most:
        lines.pop(0)
    return "\n".join(lines)


def fold_turns(turns: list[tuple[str, str]], n_seen: int, n_folded: int, summary: str, window: list[tuple[str, str]], keep: int, after: int, most: int) -> tuple[int, str, list[tuple[str, str]]]:
    """Folds what has aged out of the last ``keep`` messages, once at least ``after`` of it wait; each message once."""
    window = window + turns
    due = max(0, len(window) - keep)
    if after <= 0 or due < after:
        return n_folded, summary, window
    said = []
    for role, text in window[:due]:
        t = " ".join(text.split())
        if role == "user" and t:
            said.append("- " + (t[:59] + "…" if len(t) > 60 else t))
    return n_folded + due, _merged(summary, "\n".join(said), most), window[due:]


def stream_memory(turns: DataFrame, max_turns: int = 12, after_turns: int = 20, most: int = 600, idle_ms: int | None = 86_400_000) -> DataFrame:
    """After each micro-batch the summary of every conversation in it; ``turns`` has conv string, turn, role, text. A conversation without turns for
    ``idle_ms`` is forgotten: a later turn starts it anew.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        roles, texts, folded, summary = held.get if held.exists else ([], [], 0, "")
        window, last = list(zip(roles, texts, strict=True)), 0
        for turn, role, text in pd.concat(list(parts)).sort_values("turn")[["turn", "role", "text"]].itertuples(index=False):
            last = int(turn)
            if (text or "").strip():
                folded, summary, window = fold_turns([(role, text)], 0, folded, summary, window, 2 * max_turns, 2 * after_turns, most)
        held.update(([r for r, _ in window], [t for _, t in window], folded, summary))
        if idle_ms:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], last, folded, summary)], columns=["conv", "turn", "folded", "summary"])

    return turns.groupBy("conv").applyInPandasWithState(run, MEMORY, "roles array<string>, texts array<string>, folded int, summary string", "append", _timeout(idle_ms))
