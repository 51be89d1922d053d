"""Conversations that break the order of roles, repaired by the cheapest edits: layers of cost hold bit sets of grammar states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._store import store

SPACES = " \t\n\x0b\x0c\r"
#: What an edit costs, and what a truncated row costs that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A row's code is its role's initial (s, u, a, another) plus four times its fault (none, truncated, blank, duplicate).
INITIALS = "sua"
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 accept. What is left to insert at the end costs this.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 30
#: States after a user or assistant turn, whichever must follow.
NEXT = (2, 2, 3, 2)
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
#: Layers are built for so many rows at once; longer conversations are blocks.
BLOCK = 64


def _turned(x: int) -> int:
    """The states from which a user or assistant turn leads into ``x``, in each four bits."""
    return ((x >> 2) & 0x1111) * 0b1011 | ((x >> 3) & 0x1111) << 2


def _kept(x: int, initial: int) -> int:
    """The states from which a kept row of ``initial`` leads into ``x``, in each four bits."""
    if initial == 0:
        return (x >> 1) & 0x1111
    if initial == 1:
        return ((x >> 2) & 0x1111) * 0b1011
    return ((x >> 3) & 0x1111) << 2 if initial == 2 else 0


def _layer(codes: bytes, last: int, layers: list[list[int]]) -> list[int]:
    """The next layer: for each row, and the end, the states from which the end is reached at most at this cost; ``last`` are those of the end."""
    c, n = len(layers), len(codes)
    at = lambda cost: layers[c - cost] if c >= cost else None
    rerole, delete, worse = at(REROLE), at(DELETE), at(REROLE + TRUNCATED)
    now = [0] * n + [last]
    for i in range(n - 1, -1, -1):
        code = codes[i]
        x = layers[c - 1][i] if c else 0
        if delete:
            x |= delete[i + 1]
        if rerole:
            x |= _turned(rerole[i])  # an insertion before the row
        if code < 4:
            x |= _kept(now[i + 1], code)
            if rerole:
                x |= _turned(rerole[i + 1])
        elif code < 8:
            if rerole:
                x |= _kept(rerole[i + 1], code - 4)
            if worse:
                x |= _turned(worse[i + 1])
        now[i] = x
    return now


def _reachable(codes: bytes) -> int:
    """Entry and exit states of ``codes`` that any edits join: bit 4 * exit + entry."""
    x = 0x8421
    for code in reversed(codes):
        x |= _turned(x) | (_kept(x, code % 4) if code < 8 else 0)
        x |= _turned(_turned(x)) | _turned(x)
    return x


def matrix(codes: bytes) -> list[int]:
    """Least cost from each state before ``codes`` to each state after them, 4 * entry + exit; ``NEVER`` where none leads there."""
    out = [0 if a == b else NEVER for a in range(4) for b in range(4)]
    for start in range(0, len(codes), BLOCK):
        block = codes[start : start + BLOCK]
        layers: list[list[int]] = []
        goal, seen, cost = _reachable(block), 0, [NEVER] * 16
        while seen != goal:
            layers.append(_layer(block, 0x8421, layers))
            new = layers[-1][0] & ~seen
            seen |= new
            for bit in range(16):
                if new >> bit & 1:
                    cost[4 * (bit % 4) + bit // 4] = len(layers) - 1
        out = joined(out, cost)
    return out


def joined(one: list[int], two: list[int]) -> list[int]:
    """Costs over two stretches in a row."""
    return [min(NEVER, *(one[4 * a + k] + two[4 * k + b] for k in range(4))) for a in range(4) for b in range(4)]


def before(costs: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost to the end from each state before a stretch, given that from each state after it."""
    return tuple(min(NEVER, *(costs[4 * a + b] + after[b] for b in range(4))) for a in range(4))


def _trace_block(codes: bytes, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least letters of the cheapest edits of ``codes`` from ``state`` on, and the state after them: the first layer that holds the state, then its bits."""
    base = min(after)
    layers: list[list[int]] = []
    while not layers or not layers[-1][0] >> state & 1:
        layers.append(_layer(codes, sum(1 << s for s in range(4) if after[s] - base <= len(layers)), layers))
    c, i, out = len(layers) - 1, 0, []
    has = lambda cost, row, s: c >= cost and layers[c - cost][row] >> s & 1
    while i < len(codes):
        initial, fault = codes[i] % 4, codes[i] // 4
        extra = TRUNCATED if fault == 1 else 0
        keep = KEPT[initial].get(state) if fault < 2 else None
        if has(DELETE, i + 1, state):
            letter, c, i = "D", c - DELETE, i + 1
        elif has(INSERT, i, NEXT[state]):
            letter, c, state = "I", c - INSERT, NEXT[state]
        elif keep is not None and has(extra, i + 1, keep):
            letter, c, i, state = "K", c - extra, i + 1, keep
        else:
            letter, c, i, state = "R", c - REROLE - extra, i + 1, NEXT[state]
        out.append(letter)
    return "".join(out), state


def trace(codes: bytes, after: tuple[int, ...] = END, state: int = 0) -> tuple[str, int]:
    """The letters of the cheapest edits of ``codes``, the least in ASCII order among equally cheap ones, and the state after them.

    ``after`` is the cost to the end of the conversation from each state after ``codes``. What is inserted at the very end isn't among the letters.
    """
    blocks = [codes[i : i + BLOCK] for i in range(0, len(codes), BLOCK)]
    ends = [after]
    for block in blocks[:0:-1]:
        ends.append(before(matrix(block), ends[-1]))
    letters = []
    for block, end in zip(blocks, reversed(ends), strict=True) if blocks else ():
        some, state = _trace_block(block, end, state)
        letters.append(some)
    return "".join(letters), state


def price(letters: str, codes: bytes) -> int:
    """The cost of ``letters`` over the rows of ``codes``."""
    rows = (c for c in letters if c != "I")
    cost = letters.count("I") * INSERT
    for letter, code in zip(rows, codes, strict=True):
        cost += {"K": 0, "R": REROLE, "D": DELETE}[letter] + (TRUNCATED if letter != "D" and 4 <= code < 8 else 0)
    return cost


def unlike(x: int, y: int) -> bool:
    """Whether rows of codes ``x`` and ``y`` may not follow each other."""
    return (x % 4, y % 4) not in ((0, 1), (1, 2), (2, 1))


def _key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def _digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def _plain(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, digest): nulls of role and text are one space, ``conv`` names the conversation, also that without an id."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), _digest(role, text).alias("digest"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, copies, code, again): rows of ``_plain`` without their texts, equal ones together; all copies but the first are duplicates, and the first is if ``again``."""
    bare = F.rtrim("text", F.lit(SPACES))
    initial = F.coalesce(*[F.when(F.col("role").startswith(x), i) for i, x in enumerate(INITIALS)], F.lit(3))
    ended = F.right(bare, F.lit(1)).isin(".", "!", "?")
    fault = F.when(bare == "", 2).when(~ended, 1).otherwise(0)
    light = rows.groupBy("conv", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("copies"), F.max(initial + 4 * fault).alias("code"))
    since = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")
    first = light.groupBy("conv", "digest").agg(since)
    return light.join(first, ["conv", "digest"]).select("conv", "turn", "role", "digest", "copies", "code", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("again"))


PART = "conv string, part int, edge boolean, codes binary, digests array<string>, low long, high long, n_turns long, costs array<int>"


def parts(light: DataFrame) -> DataFrame:
    """The rows of a conversation in each of the partitions of all rows, sorted by conversation and turn: a long conversation has many parts, whatever its length. ``edge``: others may have more of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), []
        codes, digests, turns, conv, leading = bytearray(), [], [], None, True

        def close(edge: bool) -> tuple:
            known = [t for t in turns if t is not None]
            n_turns = len(known) and 1 + sum(x != y for x, y in zip(known, known[1:]))
            return conv, part, edge, bytes(codes), digests, known[0] if known else None, known[-1] if known else None, n_turns, matrix(bytes(codes)) if edge else None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PART.split(", ")])

        for batch in batches:
            for name, turn, digest, copies, code, again in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if name != conv:
                    if conv is not None:
                        done.append(close(leading))
                        leading = False
                    conv, codes, digests, turns = name, bytearray(), [], []
                twin = code if code // 4 == 2 else code % 4 + 12
                codes += bytes([twin if again else code]) + bytes([twin]) * (copies - 1)
                digests += [digest] * copies
                turns.append(turn)
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        if conv is not None:
            yield batch_of([*done, close(True)])

    ranged = light.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "role", "digest")
    ordered = ranged.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "digest")
    return ordered.select("conv", "turn", "digest", "copies", "code", "again").mapInArrow(run, PART)


def borders(edges: DataFrame) -> DataFrame:
    """(conv, part, after, state, last, unlike, shared) of parts whose conversation may have others.

    Per conversation only sixteen costs and four exits a part meet, so at most as many as there are partitions: first the cost to the end after each part, from the last
    part back; then, with it, where each part leads from each state; then the state before each part, from the first part on.
    """
    small = edges.select("conv", "part", "costs", F.substring("codes", 1, 1).alias("head"), F.substring("codes", -1, 1).alias("tail"), *[F.col(c).cast("string").alias(c) for c in ("low", "high")])

    def back(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part").reset_index(drop=True)
        after = [END]
        for costs in g["costs"].iloc[:0:-1]:
            after.append(before(list(costs), after[-1]))
        heads, tails = ([x[0] for x in g[c]] for c in ("head", "tail"))
        pairs = [0] + [int(unlike(x, y)) for x, y in zip(tails, heads[1:])]
        same = [0] + [int(x is not None and x == y) for x, y in zip(g["high"], g["low"].iloc[1:])]
        out = g[["conv", "part"]].copy()
        return out.assign(after=[list(x) for x in reversed(after)], last=[i == len(g) - 1 for i in range(len(g))], unlike=pairs, shared=same)

    ahead = small.groupBy("conv").applyInPandas(back, "conv string, part int, after array<int>, last boolean, unlike int, shared int")

    def exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ways = []
            for codes, after, costs in zip(f["codes"], f["after"], f["costs"], strict=True):
                able = [x < NEVER for x in before(list(costs), tuple(after))]
                ways.append([trace(codes, tuple(after), s)[1] if able[s] else 0 for s in range(4)])
            yield f[["conv", "part", "after", "last", "unlike", "shared"]].assign(ways=ways)

    led = ahead.join(edges.select("conv", "part", "codes", "costs"), ["conv", "part"]).mapInPandas(exits, "conv string, part int, after array<int>, last boolean, unlike int, shared int, ways array<int>")

    def forth(g: pd.DataFrame) -> pd.DataFrame:
        g, states = g.sort_values("part"), [0]
        for ways in g["ways"]:
            states.append(int(ways[states[-1]]))
        return g.drop(columns="ways").assign(state=states[:-1])

    return led.groupBy("conv").applyInPandas(forth, "conv string, part int, after array<int>, last boolean, unlike int, shared int, state int")


EDITS = (
    "conv string, part int, low long, high long, n_turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "turns array<struct<role: string, digest: string>>"
)


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each part of each conversation of ``_plain`` rows, with counts of faults; ``turns`` are those that stay: a role where it was
    given, else that of the row, and the row's digest, null for an inserted turn. Texts aren't moved for it."""
    light = store(faults(rows), "turns")
    cut = store(parts(light), "turn-parts")
    known = F.broadcast(borders(cut.filter("edge")))  # at most two rows a partition
    ready = cut.join(known, ["conv", "part"], "left").select("conv", "part", "codes", "digests", "low", "high", "n_turns", "after", "last", "unlike", "shared", "state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, codes, digests, low, high, n_turns, after, last, apart, shared, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = state or 0
                letters, end = trace(codes, tuple(after or END), state)
                cost = price(letters, codes)
                if last is not False:  # inserted at the very end
                    letters, cost = letters + "I" * (END[end] // INSERT), cost + END[end]
                place, turns = 0, []
                for letter in letters:
                    if letter == "K":
                        state = KEPT[codes[place] % 4][state]
                        turns.append((None, digests[place]))
                    elif letter != "D":
                        state = NEXT[state]
                        turns.append(("user" if state == 2 else "assistant", digests[place] if letter == "R" else None))
                    place += letter != "I"
                found = [sum(c // 4 == f for c in codes) for f in (2, 3, 1)]
                illegal = (apart or 0) + sum(unlike(x, y) for x, y in zip(codes, codes[1:]))
                out.append((conv, part, low, high, n_turns - (shared or 0), *found, illegal, cost, letters, turns))
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 8, pa.string()]
            columns = [pa.array(list(x), k) for x, k in zip(zip(*(r[:-1] for r in out), strict=True), kinds, strict=True)]
            turned = pa.array([[{"role": r, "digest": d} for r, d in x[-1]] for x in out], pa.list_(pa.struct([("role", pa.string()), ("digest", pa.string())])))
            yield pa.RecordBatch.from_arrays([*columns, turned], names=[x.split()[0] for x in EDITS.split(", ")[:11]] + ["turns"])

    return ready.mapInArrow(run, EDITS)


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired turns of every conversation of ``rows`` (conv_id, turn, role, text).

    Rows come by turn, nulls first; rows of one turn by role and digest, so equal rows stand together. A row's first fault counts: blank; role and text as in a row before;
    truncated (without an end mark). Edits are Keep, Rerole, Delete and Insert; the roles' initials that stay are ``(s?(ua)+)?``. ``audit`` has the initials of the cheapest edits,
    the least in ASCII order if several are; they determine the roles. Null roles and texts are one space. Rows without a conversation's id are one conversation.
    An empty table gives none; other columns are ignored.

    Faults and edits are found over rows without texts, sorted in ranges, so a conversation with a third of all rows is cut into parts, of which only sixteen costs meet.
    The result has one row a conversation, with all its repaired texts: that row, and the texts gathered for it, grow with a conversation, as does its audit.
    """
    plain = _plain(rows)
    found = edits(plain)
    report = found.groupBy("conv").agg(
        F.coalesce(F.try_add(F.try_subtract(F.max("high"), F.min("low")), 1 - F.sum("n_turns")), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in REPORT[1:]],
        F.array_sort(F.collect_list(F.struct("part", "audit", "turns"))).alias("steps"),
    )
    report = report.select("conv", *REPORT, F.array_join(F.col("steps.audit"), "").alias("audit"), F.flatten("steps.turns").alias("turns"))
    texts = plain.groupBy("conv").agg(F.collect_set(F.struct("digest", "role", "text")).alias("texts"))
    shape = "conv string, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired array<struct<role: string, text: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some, out = batch.slice(a, 256), []
                for turns, texts in zip(some.column(8).to_pylist(), some.column(9).to_pylist(), strict=True):
                    known = {x["digest"]: (x["role"], x["text"]) for x in texts} | {None: (None, "")}
                    out.append([{"role": x["role"] or known[x["digest"]][0], "text": known[x["digest"]][1]} for x in turns])
                last = pa.array(out, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
                yield pa.RecordBatch.from_arrays([*some.columns[:8], last], names=["conv", *REPORT, "audit", "repaired"])

    whole = report.join(texts, "conv").select("conv", *REPORT, "audit", "turns", "texts").mapInArrow(run, shape)
    return whole.select(F.when(F.col("conv") != " ", F.col("conv").cast("long")).alias("conv_id"), *REPORT, "audit", "repaired")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): ``rows`` damaged as the query's contract says, by a checksum of conversation and turn."""
    mark = F.pmod(F.crc32(F.encode(F.concat(_key(F.col("conv_id")), F.lit(":"), _key(F.col("turn"))), "UTF-8")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), mark.alias("mark"))
        .filter("mark <> 0")
        .withColumn("text", F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("mark") == 4, "user").otherwise(F.col("role")))
        .withColumn("copy", F.explode(F.when(F.col("mark") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select("conv_id", "turn", "role", "text")
    )


def repaired_after_damage(conversations: DataFrame) -> DataFrame:
    """The report of ``repair`` and a digest of the repaired turns for every conversation of ``conversations``, after ``damaged``; one without rows after it has zeros, an empty audit and the digest of the empty text."""
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    found = repair(damaged(conversations)).select(_key(F.col("conv_id")).alias("conv"), *REPORT, "audit", F.sha2(F.encode(lines, "UTF-8"), 256).alias("repaired_sha256"))
    every = conversations.select("conv_id", _key(F.col("conv_id")).alias("conv")).distinct()
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(found, "conv", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in REPORT], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )
