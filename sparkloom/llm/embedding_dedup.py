"""Near-duplicate embeddings: random-hyperplane sign codes in several tables, exact cosines in the buckets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._store import drop, hold, release, store
from sparkloom.llm.components import connected
from sparkloom.llm.topk import usable

#: Buckets of at most SMALL members are compared by packs of about PACK rows, as single ones would cost a call each.
SMALL, PACK = 32, 2000
_planes: dict[tuple, np.ndarray] = {}


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """The seeded normals of ``tables`` * ``bits`` hyperplanes, one column each."""
    key = (dim, bits, tables)
    if key not in _planes:
        _planes[key] = np.random.default_rng([7, *key]).standard_normal((dim, tables * bits))
    return _planes[key]


def sign_codes(rows: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The code of each row in each table: one bit a plane, set on its positive side."""
    side = (rows @ planes(rows.shape[1], bits, tables) > 0).reshape(len(rows), tables, bits)
    return np.packbits(side, axis=2, bitorder="little").view(f"<u{2 if bits > 8 else 1}")[..., 0] if bits <= 16 else (side << np.arange(bits)).sum(axis=2)


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches over the links (a, b)."""
    low = np.arange(n)
    while True:
        was = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == was).all():
            return low


def linked(vectors: DataFrame, least: float = 0.93, bits: int = 16, tables: int = 64, block: int = 512) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows are compared only with rows of an equal label that isn't null. Equal vectors of a label (by two 64-bit digests) are one class with a
    weight, so copies are counted, not paired. Classes that share a code of any table meet in that bucket, where their cosine is computed in double precision;
    a pair at ``least`` or above is a link, counted only in the first table that both codes agree in. A bucket gives link counts and a spanning forest,
    not its pairs; buckets above ``block`` members are dealt to tasks as pairs of blocks, nothing is capped. A pair at a cosine of
    0.93 meets in none of 64 tables of 16 bits with a chance of 1.4e-4, a closer pair less often. More ``bits`` suit larger tables.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link with nothing: 0 links, a component of
    their own. Vectors of different lengths don't meet. Repeated rows are vectors of their own, linked with one another. An empty
    table gives none; other columns are ignored.
    """
    ok = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull()
    two = [F.when(ok, F.xxhash64(*salt, F.col("label").cast("string"), "embedding")).alias(name) for name, salt in (("h1", ()), ("h2", (F.lit(29),)))]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *two, "label", "embedding")
    whole = rows.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = store(whole.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def codes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, same in part.groupby(part["embedding"].map(len)):
                c = sign_codes(np.stack(same["embedding"].to_numpy()).astype(np.float64), bits, tables)
                yield pd.DataFrame({"cid": np.repeat(same["cid"].to_numpy(), tables), "label": np.repeat(same["label"].to_numpy(), tables), "dim": dim, "tab": np.tile(np.arange(tables), len(same)), "code": c.ravel()})

    placed = classes.select("cid", F.col("label").cast("string").alias("label"), "embedding").mapInPandas(codes, "cid long, label string, dim int, tab int, code long")
    keyed = hold(placed.select("cid", "tab", F.xxhash64("label", "dim", "tab", "code").alias("key")))
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").hint("rebalance")  # else the join below could not split a hot key
    shared = hold(keyed.join(full, "key"))
    packs = max(1, shared.filter(F.col("members") <= SMALL).count() // PACK)
    large = F.col("members") > SMALL
    n = F.when(large, F.ceil(F.col("members") / block)).otherwise(1).cast("int")
    mine = F.pmod(F.xxhash64("cid", "key"), n).cast("int")
    met = (
        shared.withColumn("n", n).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("key", "tab", "cid", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), large.alias("large"), F.when(large, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(packs))).alias("pack"))
        .join(classes.select("cid", "weight", F.size("embedding").alias("dim"), "embedding"), "cid")
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable")
        x = np.stack(group["embedding"].to_numpy()).astype(np.float64)
        ids, weight, tab, key = (group[c].to_numpy() for c in ("cid", "weight", "tab", "key"))
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        lo, hi, side = int(group["lo"].iloc[0]), int(group["hi"].iloc[0]), group["mine"].to_numpy()
        if not group["large"].iloc[0]:  # many small buckets: neighbours at each distance in the order of keys
            found = [(at := np.flatnonzero(key[d:] == key[:-d]), at + d) for d in range(1, min(SMALL, len(key)))]
            a, b = (np.concatenate(z) if found else np.zeros(0, int) for z in (tuple(f[0] for f in found), tuple(f[1] for f in found)))
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
            a, b = a[near], b[near]
        elif lo == hi:
            a, b = np.nonzero(np.triu(unit @ unit.T >= least, 1))
        else:
            left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
            a, b = np.nonzero(unit[left] @ unit[right].T >= least)
            a, b = left[a], right[b]
        if not len(a):
            return pd.DataFrame({"cid": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        used = np.unique(np.concatenate([a, b]))
        code, place, count = sign_codes(x[used], bits, tables), np.searchsorted(used, np.arange(len(ids))), np.zeros(len(ids), np.int64)
        for i in range(0, len(a), 1 << 14):
            p, q = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
            own = (code[place[p]] == code[place[q]]).argmax(axis=1) == tab[p]
            np.add.at(count, p[own], weight[q[own]])
            np.add.at(count, q[own], weight[p[own]])
        out = pd.DataFrame({"cid": ids, "other": ids[_joined(len(ids), a, b)], "links": count})
        out = out[(out["links"] > 0) | (out["cid"] != out["other"])]
        return out.groupby(["cid", "other"], as_index=False)["links"].sum()

    found = hold(met.groupBy("large", "pack", "dim", "lo", "hi").applyInPandas(compare, "cid long, other long, links long"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected(found.filter("cid <> other").select(F.col("cid").alias("u"), F.col("other").alias("v")))
    member = classes.select("cid", "h1", "h2", "weight", "rep").join(parts.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = member.groupBy("component").agg(F.min("rep").alias("lowest"))
    by_class = store(member.join(lowest, "component").join(counts, "cid", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "lowest"), "classes")
    release(keyed, shared, found)
    drop(classes)
    return rows.select("vec_id", "h1", "h2").join(by_class, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("lowest", "vec_id").alias("component_id"), F.col("vec_id").eqNullSafe(F.coalesce("lowest", "vec_id")).alias("kept")
    )
