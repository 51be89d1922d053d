"""Near-duplicate documents by b-bit MinHash: band candidates, a packed-signature estimate, then exact sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._store import drop, hold, release, store
from sparkloom.llm._text import freed, mix, powers, shingles, stretches
from sparkloom.llm.components import connected

U = np.uint64
#: Minima per document. Bands of ROWS minima: a pair of similarity 0.8 shares none of 42 bands with a chance of 3e-6.
MINIMA, ROWS, BANDS = 256, 6, 42
_A = (powers(0x5851F42D4C957F2D, MINIMA + 1)[1:] >> U(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(_A.astype(np.uint64)) >> U(32)).astype(np.uint32)
_BAND = powers(0x2545F4914F6CDD1D, ROWS + 1)[1:]


def minima(x: np.ndarray) -> np.ndarray:
    """The smallest of MINIMA seeded 32-bit hashes over the shingle hashes ``x``."""
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    y = (x >> U(32)).astype(np.uint32)
    for i in range(0, len(y), 2048):
        np.minimum(low, (_A[:, None] * y[None, i : i + 2048] + _B[:, None]).min(axis=1), out=low)
    return low


def packed(low: np.ndarray, bits: int) -> np.ndarray:
    """The ``bits`` low bits of each (scrambled) minimum, as bit planes of MINIMA bits in 64-bit words."""
    z = low ^ (low >> np.uint32(15))
    z = z * np.uint32(0x2C1B3C6D)
    z ^= z >> np.uint32(12)
    return np.concatenate([np.packbits(((z >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), bitorder="little").view(np.int64) for b in range(bits)])


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    return mix((rows * _BAND).sum(axis=1) + np.arange(1, BANDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)


def digests(x: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two digests of a set of shingle hashes; with its size they tell sets apart."""
    return mix(x ^ U(0xA5A5A5A5A5A5A5A5)).sum(), mix(x + U(0x1234567812345677)).sum()


def _longs(values: list) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of one length as a list column."""
    ends = np.arange(0, sum(map(len, arrays)) + 1, len(arrays[0]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def sketch(docs: DataFrame, k: int, bits: int = 2) -> DataFrame:
    """(doc_id, n shingles, two digests of the set, band keys, signature) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, part in stretches(batch.column(1)):
                n, both, bands, sig = [], [], [], []
                for x in shingles(part, k):
                    low = minima(x)
                    n.append(len(x))
                    both.append(digests(x))
                    bands.append(band_keys(low))
                    sig.append(packed(low, bits))
                columns = [ids.slice(first, len(part)), pa.array(n, pa.int64()), _longs([d for d, _ in both]), _longs([d for _, d in both]), _lists(bands), _lists(sig)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d1", "d2", "bands", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freed(run), "doc_id long, n long, d1 long, d2 long, bands array<long>, sig array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(n, d1, d2, members): the size and digests of each set, and the whole sorted set as 8-byte integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in stretches(batch.column(0)):
                sets = list(shingles(part, k))
                both = [digests(x) for x in sets]
                columns = [pa.array([len(x) for x in sets], pa.int64()), _longs([d for d, _ in both]), _longs([d for _, d in both]), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "d1", "d2", "members"])

    return docs.select("text").mapInArrow(freed(run), "n long, d1 long, d2 long, members binary")


def estimate(a: Column, b: Column, bits: int = 2) -> Column:
    """Similarity from the packed signatures: equal minima by bit counts, corrected for chance agreement 2 ** -bits."""
    words = MINIMA // 64
    differs = [reduce(lambda x, y: x.bitwiseOR(y), [a[p * words + w].bitwiseXOR(b[p * words + w]) for p in range(bits)]) for w in range(words)]
    equal = 1 - reduce(lambda x, y: x + y, [F.bit_count(d) for d in differs]) / F.lit(float(MINIMA))
    return (equal - 2.0**-bits) / (1 - 2.0**-bits)


#: A side of at most so many rows of two ids (16 MB) is broadcast; a larger one is shuffled.
SMALL = 500_000


def _checked(side: DataFrame) -> DataFrame:
    """``side`` (stored, ids only) marked for broadcast if a count shows that it is small."""
    return F.broadcast(side) if side.count() <= SMALL else side


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |intersection| >= percent * |union| of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets. Only sets that a pair needs are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_ = ((np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) for x, y in zip(batch.column(2), batch.column(3), strict=True))
            keep = [_linked(x, y, percent) for x, y in sets_]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    small = pairs.count() <= SMALL
    mark = F.broadcast if small else lambda t: t
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("y")).join(mark(pairs), "b")
    left = sets.select(F.col("cls").alias("a"), F.col("members").alias("x")).join(mark(pairs.select("a").distinct()), "a", "left_semi")
    return right.join(left.hint("merge"), "a").select("a", "b", "x", "y").mapInArrow(freed(run), "a long, b long, linked boolean").filter("linked").select("a", "b").distinct()


def _agree(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of one signature with others, as in ``estimate``."""
    half = MINIMA // 64
    x = others ^ sig
    equal = 1 - np.bitwise_count((x[:, :half] | x[:, half:]).view(np.uint64)).sum(axis=1) / MINIMA
    return (equal - 0.25) / 0.75


def _matrix(t: pa.Table, name: str, width: int) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy().reshape(-1, width)


def _blocks(open_: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The members of open buckets in blocks, and the pairs of blocks to compare.

    A component with a quarter of ``block`` members or more has blocks of its own, smaller ones share packs. Blocks of one component aren't compared with each other, so the
    members of a bucket's main component meet only those of the others.
    """
    sizes = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.col("n") >= block // 4)
    packs = sizes.groupBy("key").agg(F.ceil(F.sum(F.when(~F.col("large"), F.col("n"))) / block).cast("int").alias("packs"))
    sizes = sizes.join(packs, "key").hint("rebalance")
    own = F.when(F.col("large"), F.col("component"))  # null: a pack
    part = F.when(F.col("large"), F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / block))).otherwise(F.pmod(F.xxhash64("component"), "packs")).cast("int").alias("part")
    block_ = F.struct(F.col("large").alias("whole"), F.coalesce(own, F.lit(0)).alias("own"), part)
    dealt = store(open_.join(sizes, ["key", "component"]).select("key", "cls", "component", block_.alias("b")), "blocks")
    blocks = dealt.select("key", "b").distinct()
    met = blocks.withColumnRenamed("b", "lo").join(blocks.withColumnRenamed("b", "hi"), "key")
    same = F.col("lo.whole") & F.col("hi.whole") & (F.col("lo.own") == F.col("hi.own"))
    return dealt, met.filter((F.col("lo") <= F.col("hi")) & ~same)


def _across(open_: DataFrame, near: DataFrame, least: float, percent: int, block: int = 1024) -> DataFrame:
    """(u, v): components of ``open_`` (key, cls, component) that a linked pair in one bucket joins, all such pairs tested. ``near`` has cls, bands, sig, members.

    A task compares two blocks of members (see ``_blocks``): signatures as bit matrices, then the full sets of the likely pairs
    of different components whose first common band is the bucket's. Only joins of components are returned, no pairs.
    """
    dealt, pairs = _blocks(open_, block)
    side = lambda t, b, n: t.select("key", "lo", "hi", F.col(b).alias("b"), F.lit(n).alias("mine"))
    asked = side(pairs, "lo", 0).unionByName(side(pairs.filter("lo <> hi"), "hi", 1))
    met = dealt.join(asked, ["key", "b"]).drop("b").join(near, "cls").withColumn("self", F.col("lo") == F.col("hi"))

    def compare(t: pa.Table) -> pa.Table:
        sig, bands = _matrix(t, "sig", 2 * MINIMA // 64), _matrix(t, "bands", BANDS)
        cls, component, mine = (t.column(c).to_numpy() for c in ("cls", "component", "mine"))
        sets_ = [np.frombuffer(x.as_buffer(), U) for x in t.column("members")]
        band = int((bands[0] == t.column("key")[0].as_py()).argmax())
        alone = t.column("self")[0].as_py()
        left, right = np.flatnonzero(mine == 0), np.flatnonzero(mine == (0 if alone else 1))
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        out = []
        for i in left:
            others = right[right > i] if alone else right
            others = others[component[others] != component[i]]
            others = others[_agree(sig[i], sig[others]) >= least]
            for j in others[(bands[others] == bands[i]).argmax(axis=1) == band]:
                a, b = root(int(component[i])), root(int(component[j]))
                if a != b and cls[i] != cls[j] and _linked(sets_[i], sets_[j], percent):
                    joined[max(a, b)] = min(a, b)
                    out.append((max(a, b), min(a, b)))
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return met.groupBy("key", "lo", "hi").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * |intersection| >= ``percent`` * |union| of their distinct ``k``-word shingles (A-Z
    lower-cased, ASCII white space). Equal sets are one class first, so copies cost one row. Classes that share a band are
    candidates: first each with the smallest of its bucket; then, in buckets that still hold several components, each with all members of other
    components. The signature estimate drops pairs five standard deviations below the threshold, and full sets decide the rest; nothing is
    capped, and pairs inside a component need no test. ``component_id`` is the smallest doc_id reachable, and kept tells whether that is the
    document itself.

    Null, empty and blank texts have no shingles and link with nothing. Repeated rows (same doc_id and text) share one class and
    all get its component. Texts that share a doc_id are classes of their own: each row gets the component of its text, and no link of any of them is lost; a class of rows without
    a doc_id has the null id where it reaches no other. An empty table gives no rows; other columns are ignored.
    """
    p = percent / 100
    agree = p + (1 - p) / 4
    least = p - 5 * (agree * (1 - agree) / MINIMA) ** 0.5 / 0.75
    drawn = store(sketch(docs, k), "sketch")
    same = ["d1", "d2", "n"]
    classes = store(drawn.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    odd = not classes.groupBy("rep").count().filter("rep IS NULL OR count > 1").isEmpty()  # ids don't name classes
    classes = store(classes.withColumn("cls", F.monotonically_increasing_id()), "numbers") if odd else classes.withColumn("cls", F.col("rep"))
    of_rep = drawn.join(classes, same).filter(F.col("doc_id").eqNullSafe(F.col("rep")))
    held = hold(of_rep.select("cls", "rep", *same, "bands", "sig"))
    repeats = odd or held.count() > held.select("cls").distinct().count()  # of rows
    reps = held.dropDuplicates(["cls"]) if repeats else held
    banded = reps.select("cls", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("cls").alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1").hint("rebalance")  # else the join below could not split a hot key
    shared = store(banded.join(buckets, "key"), "shared")  # stored, as are other tables of ids: plans over held ones would hold their plans again and again
    wanted = hold(shared.select("cls").distinct())
    few = _checked(wanted)
    asked = reps.join(few, "cls", "left_semi")
    ids = _checked(hold(asked.select(F.col("rep").alias("doc_id")).distinct())) if odd else few.withColumnRenamed("cls", "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(ids, F.col("_id").eqNullSafe(F.col("doc_id")), "left_semi")
    near = asked.drop("rep").join(shingle_sets(texts, k), same).select("cls", "bands", "sig", "members")
    near = hold(near.dropDuplicates(["cls"]) if repeats else near)
    near.count()
    release(held, wanted)
    a, b = near.select(F.col("cls").alias("a"), F.col("sig").alias("s")), near.select(F.col("cls").alias("b"), F.col("sig").alias("t"))
    star = shared.filter("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    likely = store(star.join(a, "a").join(b, "b").filter(estimate(F.col("s"), F.col("t")) >= least).select("a", "b"), "likely")
    first = connected(_exact(likely, near.select("cls", "members"), percent).select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = shared.filter("members > 2").join(first, F.col("cls") == F.col("id"), "left").select("key", "cls", F.coalesce("component", "cls").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other")).filter("one <> other").select("key").hint("rebalance")
    open_ = store(placed.join(mixed, "key").distinct(), "open")
    found = first.select("id", F.col("component").alias("c")).unionByName(near.select(F.col("cls").alias("id"), F.col("cls").alias("c")).join(first, "id", "left_anti"))
    if open_.isEmpty():
        found = found.withColumnRenamed("c", "component")
    else:
        second = connected(_across(open_, near, least, percent))
        found = found.join(second.select(F.col("id").alias("c"), "component"), "c", "left").select("id", F.coalesce("component", "c").alias("component"))
    if odd:  # components go by class numbers: back to the smallest doc_id of each
        members = classes.select("cls", "rep").join(found, F.col("cls") == F.col("id"))
        found = members.join(members.groupBy("component").agg(F.min("rep").alias("low")).hint("rebalance"), "component").select("id", F.col("low").alias("component"))
    found = store(found, "components")
    release(near)
    drop(shared, likely, open_)
    known = drawn.select("doc_id", *same).join(classes, same, "left")
    component = F.coalesce("component", "rep", "doc_id").alias("component_id")
    return known.join(found, F.col("cls") == F.col("id"), "left").select("doc_id", F.col("n").alias("n_shingles"), component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its distinct (doc_id, text) apart: doc_id, where it does so, else a new one.

    The smallest text digest of an id keeps the id; further texts of it, and all texts without an id, get numbers above every id, stored once so that they don't change.
    """
    digest = F.coalesce(F.md5("text"), F.lit("")).alias("_digest")
    keys = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest).distinct(), "keys")
    own = keys.groupBy("doc_id").agg(F.min("_digest").alias("own"), F.count(F.lit(1)).alias("n")).filter("doc_id IS NULL OR n > 1")
    odd = store(own.withColumn("own", F.when(F.col("doc_id").isNotNull(), F.col("own"))), "odd")
    if odd.isEmpty():
        return docs, "doc_id"
    top = keys.agg(F.max("doc_id")).first()[0] or 0
    # Ids are null-safe keys in both joins: null is one more key, dealt by digest in the second.
    more = keys.join(odd.select(F.col("doc_id").alias("_of"), "own"), F.col("doc_id").eqNullSafe(F.col("_of"))).filter("own IS NULL OR _digest <> own")
    more = store(more.select("_of", F.col("_digest").alias("_with"), (F.monotonically_increasing_id() + (max(top, 0) + 1)).alias("_new")), "numbers")
    placed = docs.select("*", digest).join(_checked(more), F.col("_digest").eqNullSafe(F.col("_with")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_of")), "left")
    return store(placed.select(*docs.columns, F.coalesce("_new", F.col("doc_id").cast("long")).alias("_number")), "numbered"), "_number"


def without_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, and one row of each (doc_id, text) where rows repeat.

    A document is a distinct pair of doc_id and text: texts that share an id are compared like any others and don't go with it, and
    texts without an id, or beyond the first of an id, give way to those with an id that are near to them. Blank texts link with nothing.
    """
    rows, key = _numbered(docs)
    found = store(near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), k, percent).select("doc_id", "kept"), "kept")
    gone = store(found.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    rest = rows.join(_checked(gone), F.col(key) == F.col("_gone"), "left_anti")
    stay = found.filter("kept")
    return (rest.dropDuplicates([key]) if stay.count() > stay.distinct().count() else rest).select(docs.columns)
