"""Conversation windows, summaries, state transitions and event projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def memory_window(turns: DataFrame, conv: str, turn: str, max_turns: int, after: int) -> DataFrame:
    """``turns`` with recent (among the last 2 * max_turns) and due (aged out, where the aged ones number at least 2 * after)."""
    w = W.partitionBy(conv)
    back, n = F.row_number().over(w.orderBy(F.desc(turn))), F.count(F.lit(1)).over(w)
    keep = 2 * max_turns
    aged = F.greatest(F.lit(0), n - keep)
    return turns.withColumns({"recent": back <= keep, "due": (back > keep) & F.lit(after > 0) & (aged >= 2 * after)})


def facts(turns: DataFrame, conv: str, turn: str, text: str, is_user: Column, most: int = 60, prefix: str = "- ") -> DataFrame:
    """(conv, facts): what the user said, a line each, white space collapsed and cut to ``most`` characters."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    line = F.concat(F.lit(prefix), F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t))
    said = turns.filter(is_user & (t != "")).select(conv, turn, line.alias("_l"))
    return said.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, "_l"))), lambda s: s["_l"]), "\n").alias("facts"))


def usable_summary(text: Column) -> Column:
    """Neither empty nor a refusal or a preamble."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return ~t.isin("", "无", "无。", "none", "None") & ~t.rlike("^(好的|当然|以下是|作为)")


def bounded_lines(rows: DataFrame, conv: str, pos: str, line: str, most: int = 600) -> DataFrame:
    """The newest lines of each conversation whose joined length (a line end between) stays within ``most``."""
    length = F.sum(F.char_length(line) + 1).over(W.partitionBy(conv).orderBy(F.desc(pos)).rowsBetween(W.unboundedPreceding, 0)) - 1
    over = F.max(F.col("_n") > most).over(W.partitionBy(conv).orderBy(F.desc(pos)).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_n", length).withColumn("_o", over).filter("not _o").drop("_n", "_o")


def transcript(turns: DataFrame, conv: str, turn: str, text: str, who: Column) -> DataFrame:
    """(conv, transcript): lines of speaker and text, in order."""
    line = F.concat(who, F.lit("："), F.trim(text))
    return turns.select(conv, turn, line.alias("_l")).groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, "_l"))), lambda s: s["_l"]), "\n").alias("transcript"))


def _moves(rows: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    moved = rows.withColumn("from_state", F.lag(state).over(W.partitionBy(by).orderBy(*order)))
    return moved.filter(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state))).withColumn("to_state", F.col(state))


def illegal_transitions(rows: DataFrame, by: str, order: list[str], state: str, legal: DataFrame) -> DataFrame:
    """Rows whose state may not follow the one before; ``legal`` has from_state, to_state."""
    return _moves(rows, by, order, state).join(legal, ["from_state", "to_state"], "left_anti")


def transitions(rows: DataFrame, by: str, order: list[str], state: str, legal: DataFrame, forced: Column) -> DataFrame:
    """Every change of state with its verdict: legal, forced (not legal, but ``forced``), or illegal."""
    known = legal.select("from_state", "to_state").distinct().withColumn("_ok", F.lit(True))
    checked = _moves(rows.withColumn("_forced", forced), by, order, state).join(known, ["from_state", "to_state"], "left")
    verdict = F.when(F.col("_ok"), "legal").when(F.coalesce("_forced", F.lit(False)), "forced").otherwise("illegal")
    return checked.withColumn("verdict", verdict).drop("_ok", "_forced")


def emit_on_change(rows: DataFrame, by: str, order: list[str], value: str, keep_alive_s: float | None = None, at: str | None = None) -> DataFrame:
    """Rows whose value differs from the one before, and with ``keep_alive_s`` those at least so long after it."""
    w = W.partitionBy(by).orderBy(*order)
    out = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    if keep_alive_s is not None:
        out = out | (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) >= int(keep_alive_s * 1e6))
    return rows.withColumn("_e", out).filter("_e").drop("_e")


def first_latency(rows: DataFrame, by: str, at: str, is_first: Column, is_start: Column) -> DataFrame:
    """Seconds from the first start to the first token at or after it, by key."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    return rows.groupBy(by).agg(F.min(F.when(is_start, t)).alias("_s"), F.min(F.when(is_first, t)).alias("_f")).filter("_f >= _s").select(by, F.round((F.col("_f") - F.col("_s")) / 1e6, 3).alias("latency_s"))


def project_messages(rows: DataFrame, kind: str, messages: dict[str, list[str]]) -> DataFrame:
    """Zero or more messages for each event, by its kind."""
    table = F.create_map(*[x for k, v in messages.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return rows.withColumn("_m", F.try_element_at(table, F.col(kind))).select("*", F.posexplode("_m").alias("message_pos", "message")).drop("_m")


def supersede(rows: DataFrame, by: str, order: list[str], turn: str, is_interrupt: Column) -> DataFrame:
    """``rows`` with applied: an interrupt counts only for the turn that is current, the last started before it; a start always does."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    current = F.last(F.when(~is_interrupt, F.col(turn)), ignorenulls=True).over(w)
    return rows.withColumn("applied", F.when(is_interrupt, F.coalesce(F.col(turn) == current, F.lit(False))).otherwise(True))


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as an aggregate."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")
