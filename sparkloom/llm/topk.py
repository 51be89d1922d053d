"""Exact top-k by inner product: KD-trees per shard, walked best first with box bounds and a propagated kth score."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._store import store

LEAF = 256
NO_FLOOR = -(2**62)


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components; an empty vector has no use either."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def _floored(x: Column) -> Column:
    """The largest whole number up to ``x``, as a double; doubles of 2 ** 53 and more are whole."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


class Tree:
    """A KD-tree over integer vectors: median splits along the widest side, with the tight box of every node."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.low, self.high, self.kids, self.members = [], [], [], []
        self._build(np.arange(len(ids)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, at: np.ndarray) -> int:
        node = len(self.kids)
        low, high = self.rows[at].min(axis=0), self.rows[at].max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.members.append(None)
        axis = int((high - low).argmax())
        if len(at) <= LEAF or high[axis] == low[axis]:
            self.members[node] = at
        else:
            middle = len(at) // 2
            order = np.argpartition(self.rows[at, axis], middle)
            self.kids[node] = (self._build(at[order[:middle]]), self._build(at[order[middle:]]))
        return node

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For each query the best (score, -id) here, at most ``k``, that reach its ``floor`` score. No box's product with a query exceeds the sum of the larger
        of its ends' products by component; the box with the largest bound is opened next, and a bound below the kth score so far ends the walk (equal
        bounds are opened, as a smaller id wins a tie)."""
        for q, (query, me) in enumerate(zip(queries.astype(np.int64), own, strict=True)):
            bound = np.maximum(self.low * query, self.high * query).sum(axis=1)
            best: list[tuple[int, int]] = []
            least = int(floor[q])
            queue = [(-int(bound[0]), 0)]
            while queue and -queue[0][0] >= least:
                _, node = heapq.heappop(queue)
                if self.kids[node]:
                    for kid in self.kids[node]:
                        if bound[kid] >= least:
                            heapq.heappush(queue, (-int(bound[kid]), kid))
                    continue
                at = self.members[node]
                scores = self.rows[at] @ query
                for j in np.flatnonzero(scores >= least):
                    if self.ids[at[j]] == me:
                        continue
                    item = (int(scores[j]), -int(self.ids[at[j]]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    if len(best) == k:
                        least = max(least, best[0][0])
            yield q, best


def _top(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Axis and value of the median splits of the first ``depth`` levels of a KD-tree over ``sample``, in heap order."""
    splits = [(0, 0)] * (2**depth - 1)
    held = {0: sample}
    for node in range(2**depth - 1):
        x = held.pop(node)
        axis = int((x.max(axis=0) - x.min(axis=0)).argmax()) if len(x) else 0
        value = int(np.median(x[:, axis])) if len(x) else 0
        splits[node] = (axis, value)
        left = x[:, axis] <= value if len(x) else np.zeros(0, bool)
        held |= {2 * node + 1: x[left], 2 * node + 2: x[~left]}
    return splits


def _leaves(x: np.ndarray, splits: list[tuple[int, int]], depth: int) -> np.ndarray:
    """The leaf, numbered from the left, that each row of ``x`` falls into."""
    axes, values = (np.array(z, np.int64) for z in zip(*splits, strict=True)) if splits else (np.zeros(1, np.int64),) * 2
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        node = 2 * node + 1 + (x[rows, axes[node]] > values[node])
    return node - (2**depth - 1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy().reshape(len(values), -1).astype(np.int32)


def _placed(rows: DataFrame, splits: dict[int, list[tuple[int, int]]], depth: int) -> DataFrame:
    """(vec_id, dim, leaf, v): the leaf of each row in the tree of its length; lengths that the sample lacks have one leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, leaf = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims):
                if dim in splits:
                    at = np.flatnonzero(dims == dim)
                    leaf[at] = _leaves(_matrix(pa.chunked_array([batch.column(2).take(pa.array(at))])), splits[dim], depth)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int32()), batch.column(2)], names=["vec_id", "dim", "leaf", "v"])

    return rows.select("vec_id", "dim", "v").mapInArrow(run, "vec_id long, dim int, leaf int, v array<int>")


def _gathered(placed: DataFrame, shift: int, most: int, name: str) -> DataFrame:
    """Rows in packs of about ``most``, one row a pack: dim, ``name`` (a number), the leaf it begins with, ids, vectors and the tight box as bytes.

    A pack holds the rows of 2 ** ``shift`` neighbouring leaves; those of more than ``most`` rows, such as a leaf of very many equal vectors, are dealt to several.
    """
    place = placed.withColumn("leaf", F.shiftright("leaf", shift)).withColumn("_row", F.monotonically_increasing_id())  # tells repeated rows apart
    sizes = place.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).hint("rebalance")
    dealt = place.join(sizes, ["dim", "leaf"]).withColumn("sub", F.pmod(F.xxhash64("_row"), "parts").cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("v"))
        first = lambda c: t.column(c)[:1]
        raw = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table({"dim": first("dim"), "leaf": first("leaf"), "sub": first("sub"), "ids": raw(t.column("vec_id").to_numpy()), "rows": raw(x), "low": raw(x.min(axis=0)), "high": raw(x.max(axis=0))})

    shape = "dim int, leaf int, sub int, ids binary, rows binary, low binary, high binary"
    packs = dealt.select("dim", "leaf", "sub", "vec_id", "v").groupBy("dim", "leaf", "sub").applyInArrow(pack, shape)
    return store(packs.withColumn(name, F.concat_ws("/", "dim", "leaf", "sub")), name)


def _ints(x: pa.Scalar, dim: int) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int32).reshape(-1, dim)


def _searched(pairs: DataFrame, shards: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, q, vec_id, score): the best ``k`` of each query in each shard of ``pairs`` (block, shard). ``q`` is the query's place in its block."""

    def run(t: pa.Table) -> pa.Table:
        dim, block = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
        ids = lambda name: np.frombuffer(t.column(name)[0].as_buffer(), np.int64)
        tree, own = Tree(ids("shard_ids"), _ints(t.column("shard_rows")[0], dim)), ids("ids")
        floor = t.column("floors").combine_chunks().flatten().to_numpy()
        found = tree.search(_ints(t.column("rows")[0], dim), own, k, floor)
        out = [(block, q, int(own[q]), -i, s) for q, best in found for s, i in best]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["block", "q", "query_id", "vec_id", "score"])

    packs = pairs.join(shards.select("shard", F.col("ids").alias("shard_ids"), F.col("rows").alias("shard_rows")), "shard")
    met = packs.join(blocks.select("block", "dim", "ids", "rows", "floors"), "block")
    return met.groupBy("block", "shard").applyInArrow(run, "block string, q int, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` by score, ties to the smaller id. What meets is at most ``k`` a shard, in practice the few that reach the floor."""
    kept = F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("vec_id")).alias("minus"))), asc=False), 1, k)
    return found.groupBy("block", "q", "query_id").agg(kept.alias("best"))


def _reached(shards: DataFrame, blocks: DataFrame, chunk_rows: int = 1024) -> DataFrame:
    """The pairs (block, shard) in which the bound of the shard's box reaches the floor of a query of the block. Boxes, no rows, meet the blocks, in chunks."""
    chunks = max(1, -(-shards.count() // chunk_rows))
    numbered = F.pmod(F.xxhash64("block"), F.lit(max(1, blocks.count()))).cast("int").alias("nth")

    def run(asked: pa.Table, boxes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and boxes.num_rows:
            dim = asked.column("dim")[0].as_py()
            low, high = (np.concatenate([_ints(b, dim) for b in boxes.column(c)]).astype(np.float64) for c in ("low", "high"))
            for row in range(asked.num_rows):
                x = _ints(asked.column("rows")[row], dim).astype(np.float64)  # exact: products below 2 ** 44, sums below 2 ** 53 up to 512 components
                floor = asked.column("floors")[row].values.to_numpy()
                slack = 0 if dim <= 512 else dim  # beyond that sums can be rounded
                hit = (np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T + slack >= floor[:, None]).any(axis=0)
                block = asked.column("block")[row].as_py()
                out += [(block, s) for s, h in zip(boxes.column("shard").to_pylist(), hit, strict=True) if h]
        b, s = zip(*out, strict=True) if out else ((), ())
        return pa.table({"block": pa.array(b, pa.string()), "shard": pa.array(s, pa.string())})

    asked = blocks.select("dim", "block", "rows", "floors", numbered).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    boxes = shards.select("dim", "shard", "low", "high", F.pmod(F.xxhash64("shard"), F.lit(chunks)).cast("int").alias("chunk"))
    boxes = boxes.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks.count()) - 1))))
    met = asked.groupBy("dim", "nth", "chunk").cogroup(boxes.groupBy("dim", "nth", "chunk"))
    return met.applyInArrow(run, "block string, shard string")


#: Beyond this size components are compared by exact integers of any length.
WIDE = 2**22
LONG = 2**63 - 1


def exact_best(ids: np.ndarray, rows: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query the best (score, id) among ``rows``, at most ``k``, ties to the smaller id, other than its ``own`` id; scores are exact integers.

    Components are doubles that are whole numbers. Products in double tell all scores up to a bound of their rounding, taken in units in which no component exceeds 1; only rows
    that could be among the first ``k`` are multiplied out.
    """
    scale_r, scale_q = (max(float(np.abs(x).max(initial=0)), 1.0) for x in (rows, queries))
    r, q = rows / scale_r, queries / scale_q
    about = q @ r.T
    off = (np.abs(q) @ np.abs(r).T) * (r.shape[1] + 4) * 2.0**-52 + 1e-290
    out = []
    for i in range(len(queries)):
        mine = np.flatnonzero(ids != own[i])
        low, high = about[i, mine] - off[i, mine], about[i, mine] + off[i, mine]
        floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
        exact = [int(x) for x in queries[i]]
        met = [(sum(a * int(b) for a, b in zip(exact, rows[j])), int(ids[j])) for j in mine[high >= floor]]
        out.append(sorted(met, key=lambda x: (-x[0], x[1]))[:k])
    return out


def _packs(rows: DataFrame, most: int, name: str) -> DataFrame:
    """(dim, ``name``, ids, rows): vectors of doubles as bytes, about ``most`` a pack, dealt by hash."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(sizes), "dim").withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "parts").cast("int"))  # one row a length

    def pack(t: pa.Table) -> pa.Table:
        raw = lambda a: pa.array([a.tobytes()], pa.binary())
        x = t.column("x").combine_chunks().flatten().to_numpy()
        return pa.table({"dim": t.column("dim")[:1], "part": t.column("part")[:1], "ids": raw(t.column("vec_id").to_numpy()), "rows": raw(x)})

    made = dealt.select("dim", "part", "vec_id", "x").groupBy("dim", "part").applyInArrow(pack, "dim int, part int, ids binary, rows binary")
    return store(made.withColumn(name, F.concat_ws("/", "dim", "part")), name)


def _wide_top_k(rows: DataFrame, asked: DataFrame, k: int, most: int = 4096) -> DataFrame:
    """``top_k`` where components are wide: ``rows`` and ``asked`` (vec_id, dim, x array<double>) hold those of all sizes; every block of queries meets every block of rows of its length."""
    shards, blocks = _packs(rows, most, "wide-shard"), _packs(asked, 256, "wide-block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for dim, block, qi, qr, ri, rr in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                own, ids = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
                found = exact_best(ids, np.frombuffer(rr).reshape(-1, dim), own, np.frombuffer(qr).reshape(-1, dim), k)
                out += [(block, q, int(own[q]), i, str(s)) for q, best in enumerate(found) for s, i in best]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["block", "q", "query_id", "vec_id", "score"])

    pairs = blocks.select("dim", F.col("wide-block").alias("block"), F.col("ids").alias("qi"), F.col("rows").alias("qr")).join(shards.select("dim", F.col("ids").alias("ri"), F.col("rows").alias("rr")), "dim")
    # a pair is some megabytes, so few are in a batch
    met = pairs.repartition("block", F.md5("ri")).mapInArrow(run, "block string, q int, query_id long, vec_id long, score string")

    def best(t: pa.Table) -> pa.Table:
        order = sorted(zip(t.column("score").to_pylist(), t.column("vec_id").to_pylist(), strict=True), key=lambda x: (-int(x[0]), x[1]))[:k]
        n = len(order)
        columns = {
            "query_id": pa.array([t.column("query_id")[0].as_py()] * n, pa.int64()), "rank": pa.array(range(1, n + 1), pa.int32()),
            "vec_id": pa.array([i for _, i in order], pa.int64()), "score": pa.array([max(-LONG - 1, min(LONG, int(x))) for x, _ in order], pa.int64()),
        }
        return pa.table(columns)

    return met.groupBy("block", "q").applyInArrow(best, "query_id long, rank int, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, shard_rows: int = 4096, block_rows: int = 4096, sample: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: for each distinct row of ``queries`` its ``k`` rows of ``vectors`` (both vec_id, embedding) of highest inner product, other than itself.

    Components become floor(``scale`` * x). Rows are dealt by space: the first levels of a KD-tree, split at the medians of at most ``sample`` rows (about 4 MB on the driver),
    give leaves of about ``shard_rows`` rows, and every row goes to the shard of its leaf; queries go to blocks of neighbouring leaves in the same way. First each block meets the
    shard at its own place, whose kth score is a floor for the query everywhere (a score below it cannot be among the first k). Then the boxes of all shards meet the blocks, and a
    block meets the shards whose box bound reaches a floor of its queries: inside, a KD-tree is walked best first. The sample decides places only; every row is in a shard and
    the result is exact. A task holds one shard and one block, packed as bytes; what is shuffled is a shard a pair that the bounds leave, at worst rows times blocks.

    Vectors that are null, empty or hold null or non-finite components, and rows without a vec_id, take no part, as row or query; vectors of another length
    than a query are no candidates of it. Where a component is 2 ** 22 or more in size, sums could leave 64 bits: then every block of queries meets every block of rows, and what rounding can't decide
    is multiplied out in integers of any length; a score beyond the range of a long is given as the nearest long, but ranks go by its true value. Fewer than ``k`` candidates give fewer rows.
    Repeated query rows are one query; two vectors of one vec_id are two. Repeated rows are candidates each, except for a query of the same vec_id. Other columns are ignored; an empty table gives none.
    """
    whole = F.transform("embedding", lambda x: _floored(x.cast("double") * scale))
    kept = lambda t: t.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.size("embedding").alias("dim"), whole.alias("x"))
    rows, asked = kept(vectors), kept(queries).distinct()
    wide = ~F.forall("x", lambda x: F.abs(x) < WIDE)
    if not rows.filter(wide).isEmpty() or not asked.filter(wide).isEmpty():
        return _wide_top_k(rows, asked, k)
    narrow = lambda t: t.select("vec_id", "dim", F.transform("x", lambda x: x.cast("int")).alias("v"))
    rows, asked = narrow(rows), narrow(asked)
    n = rows.count()
    depth = min(max(0, (n - 1) // shard_rows).bit_length(), 12)
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, n // sample))) == 0).limit(sample).select("dim", "v").collect() if depth else []
    by_dim: dict[int, list] = {}
    for r in drawn:
        by_dim.setdefault(r.dim, []).append(r.v)
    splits = {dim: _top(np.array(x), depth) for dim, x in by_dim.items()}
    wide = min(depth, max(0, (asked.count() - 1) // block_rows).bit_length())
    shards = _gathered(_placed(rows, splits, depth), 0, shard_rows, "shard")
    blocks = _gathered(_placed(asked, splits, depth), depth - wide, block_rows, "block")
    size = (F.octet_length("ids") / 8).cast("int")
    open_ = blocks.withColumn("floors", F.array_repeat(F.lit(NO_FLOOR), size))
    home = shards.groupBy("dim", F.shiftright("leaf", depth - wide).alias("leaf")).agg(F.min("shard").alias("shard"))
    first = _best(_searched(blocks.join(home, ["dim", "leaf"]).select("block", "shard"), shards, open_, k), k)
    floor = F.when(F.size("best") == k, F.element_at("best", k)["score"]).otherwise(F.lit(NO_FLOOR))
    floors = first.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("q", floor))).alias("found"))
    every = F.transform(F.sequence(F.lit(0), size - 1), lambda q: F.coalesce(F.element_at("found", q), F.lit(NO_FLOOR)))
    known = store(blocks.join(floors, "block", "left").withColumn("floors", every).drop("found"), "blocks")
    ranked = _best(_searched(_reached(shards, known), shards, known, k), k).select("query_id", F.posexplode("best").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), (-F.col("hit.minus")).alias("vec_id"), F.col("hit.score").alias("score"))
