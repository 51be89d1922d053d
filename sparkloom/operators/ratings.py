"""Blind ratings: fold to candidates, anchor gaps, orphan counts and rater agreement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.sources.tables import written


def axis_stats(value: Column, name: str, digits: int = 4) -> list[Column]:
    """Mean and population deviation of a rating axis; an axis without values is 0, as one value has deviation 0."""
    return [
        F.round(F.coalesce(F.avg(value), F.lit(0.0)), digits).alias(f"{name}_mean"),
        F.round(F.coalesce(F.stddev_pop(value), F.lit(0.0)), digits).alias(f"{name}_std"),
        F.count(value).alias(f"{name}_n"),
    ]


def fold(ratings: DataFrame, key: DataFrame, item: str, candidate: str, high: list[str], low: list[str], top: float) -> DataFrame:
    """Ratings joined with the blind key on ``item`` and folded per ``candidate``.

    ``high`` axes are good when high, ``low`` axes when low; the composite is the mean of the rounded axis
    means, low axes counted as ``top - mean``. Ratings whose item the key lacks don't count here (see ``orphans``).
    """
    axes = [*high, *low]
    per = ratings.join(key.select(item, candidate), item).groupBy(candidate).agg(
        F.count(F.lit(1)).alias("n_ratings"), F.countDistinct(item).alias("n_items"), *[c for a in axes for c in axis_stats(F.col(a), a)]
    )
    parts = [F.col(f"{a}_mean") for a in high] + [F.lit(top) - F.col(f"{a}_mean") for a in low]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return per.withColumn("composite", F.round(total / len(parts), 6))


def aggregate(ratings: DataFrame, key: DataFrame, item: str, candidate: str, high: list[str], low: list[str], top: float, believed: str, anchor: str, truth: str, labels: DataFrame | None = None) -> DataFrame:
    """``fold`` with believed_real_rate, is_ground_truth and label.

    The rate is the share of true ``believed`` values among those given, null where none is. A candidate is the ground truth if its id is ``anchor``
    or all its rated items are marked so in the key (``truth``). ``labels`` has the candidate and a label; a candidate without one is named by its id.
    """
    known = ratings.join(key.select(item, candidate, truth), item)
    said = known.groupBy(candidate).agg(
        F.round(F.avg(F.col(believed).cast("int")), 4).alias("believed_real_rate"), (F.bool_and(truth) | (F.first(candidate) == anchor)).alias("is_ground_truth")
    )
    out = fold(ratings, key, item, candidate, high, low, top).join(said, candidate)
    named = out.withColumn("label", F.lit(None).cast("string")) if labels is None else out.join(labels.select(candidate, "label"), candidate, "left")
    return named.withColumn("label", F.coalesce("label", F.col(candidate).cast("string")))


def ranked(folded: DataFrame, candidate: str) -> DataFrame:
    """Best composite first, missing last, ties by candidate. The rank runs over one row per candidate, not over ratings."""
    return folded.withColumn("rank", F.row_number().over(W.orderBy(F.col("composite").desc_nulls_last(), F.col(candidate))))


def anchor_gap(folded: DataFrame, candidate: str, anchor: str, high: list[str], low: list[str]) -> DataFrame:
    """Each candidate's axis means against the anchor's, positive when better; no anchor row gives no rows."""
    one = folded.filter(F.col(candidate) == anchor).select(*[F.col(f"{a}_mean").alias(f"anchor_{a}") for a in [*high, *low]])
    gaps = [F.round(F.col(f"{a}_mean") - F.col(f"anchor_{a}"), 4).alias(f"{a}_gap") for a in high]
    gaps += [F.round(F.col(f"anchor_{a}") - F.col(f"{a}_mean"), 4).alias(f"{a}_gap") for a in low]
    return folded.filter(F.col(candidate) != anchor).crossJoin(F.broadcast(one.limit(1))).select(candidate, *gaps)


def orphans(ratings: DataFrame, key: DataFrame, item: str, rater: str) -> DataFrame:
    """One row: all ratings, those whose item the key lacks, and distinct raters over all of them."""
    known = key.select(item).distinct().withColumn("known", F.lit(True))
    return ratings.join(known, item, "left").agg(
        F.count(F.lit(1)).alias("n_ratings"), F.count_if(F.col("known").isNull()).alias("n_orphans"), F.countDistinct(rater).alias("n_raters")
    )


#: A group of the agreement has the ratings of two blocks of about so many raters ...
RATERS = 512
#: ... and of a part of the items, so that there are as many parts as a million ratings fit into all of them.
RATINGS = 1 << 20
#: So many items are columns of a matrix at once.
ITEMS = 1024

MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _moments(left: pd.DataFrame, right: pd.DataFrame, raters: tuple[int, int], items: int) -> list[np.ndarray]:
    """Counts and sums over shared items for each rater of ``left`` with each of ``right``, by products of matrices over some items at a time."""
    sums = [np.zeros(raters) for _ in MOMENTS]
    for first in range(0, items, ITEMS):

        def matrix(rows: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
            rows = rows[(rows["item"] >= first) & (rows["item"] < first + ITEMS)]
            values, given = np.zeros((n, ITEMS)), np.zeros((n, ITEMS))
            values[rows["rater"], rows["item"] - first] = rows["v"]
            given[rows["rater"], rows["item"] - first] = 1
            return values, given

        (x, a), (y, b) = matrix(left, raters[0]), matrix(right, raters[1])
        for out, product in zip(sums, (a @ b.T, x @ b.T, a @ y.T, (x * x) @ b.T, a @ (y * y).T, x @ y.T), strict=True):
            out += product
    return sums


def agreement_pairs(ratings: DataFrame, rater: str, item: str, value: str, order: list[str], least: int = 3, raters: int = RATERS, ratings_a_part: int = RATINGS) -> DataFrame:
    """Pearson correlation of each two raters over the items both rated, from moments.

    A rater's last value of an item (by ``order``) counts. Pairs with fewer than ``least`` shared items or no variance are left out. Raters are dealt
    to blocks and items to parts; a group has two blocks and a part, and gives the moments of its pairs by matrix products. So a rating is sent once
    for each block of raters, never once for each other rater of its item; a hot item is one column, a hot rater's items lie in all parts. The result
    has a row a pair, which is its definition. Ratings without a rater, item or value don't count.
    """
    return _pairs(written(_last(ratings, rater, item, value, order)), least, raters, ratings_a_part)


def _last(ratings: DataFrame, rater: str, item: str, value: str, order: list[str]) -> DataFrame:
    """(rater, item, v): a rater's last value of each item."""
    given = ratings.filter(F.col(value).isNotNull() & F.col(item).isNotNull() & F.col(rater).isNotNull())
    return given.groupBy(F.col(rater).alias("rater"), F.col(item).alias("item")).agg(F.max_by(value, F.struct(*order)).cast("double").alias("v"))


def _pairs(last: DataFrame, least: int, raters: int, ratings_a_part: int) -> DataFrame:
    """``agreement_pairs`` of written last values."""
    n_ratings, n_raters = last.agg(F.count(F.lit(1)), F.approx_count_distinct("rater")).first()
    blocks, parts = -(-n_raters // raters) or 1, -(-n_ratings // ratings_a_part) or 1
    dealt = last.withColumn("block", F.pmod(F.xxhash64("rater"), F.lit(blocks)).cast("int")).withColumn("part", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(parts)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    sent = dealt.select("rater", "item", "v", "block", "part", other).select("rater", "item", "v", "block", "part", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    kind = dict(last.dtypes)["rater"]

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g["a"].iloc[0], g["b"].iloc[0]
        g = g.assign(item=pd.factorize(g["item"])[0])
        sides, names = [], []
        for block in (a, b):
            rows = g[g["block"] == block]
            codes, known = pd.factorize(rows["rater"], sort=True)
            sides.append(rows.assign(rater=codes))
            names.append(np.asarray(known))
        sums = _moments(*sides, (len(names[0]), len(names[1])), int(g["item"].max()) + 1)
        shared = sums[0] > 0
        if a == b:
            shared &= np.triu(np.ones_like(shared), 1)  # names are sorted, so the smaller one is the row
        i, j = np.nonzero(shared)
        out = pd.DataFrame({"left_rater": names[0][i], "right_rater": names[1][j], **{m: s[i, j] for m, s in zip(MOMENTS, sums, strict=True)}})
        turned = out["left_rater"] > out["right_rater"]
        for one, two in (("left_rater", "right_rater"), ("sx", "sy"), ("sxx", "syy")):
            out.loc[turned, [one, two]] = out.loc[turned, [two, one]].to_numpy()
        return out

    shape = f"left_rater {kind}, right_rater {kind}, " + ", ".join(f"{m} double" for m in MOMENTS)
    found = sent.groupBy("a", "b", "part").applyInPandas(pairs, shape)
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in MOMENTS)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return (
        found.groupBy("left_rater", "right_rater")
        .agg(*[F.sum(m).alias(m) for m in MOMENTS])
        .filter((n >= least) & (vx > 1e-9) & (vy > 1e-9))
        .select("left_rater", "right_rater", n.cast("long").alias("n_shared"), ((n * sxy - sx * sy) / F.sqrt(vx * vy)).alias("r"))
    )


#: With at most so many items raters are summed by the items they rated, without pairs: a rater has a row for each of at most 42 sets of 3 items or more.
FEW_ITEMS = 6


def mean_agreement(ratings: DataFrame, rater: str, item: str, value: str, order: list[str], least: int = 3, few: int = FEW_ITEMS) -> DataFrame:
    """One row: n_pairs and agreement, the number and mean of the correlations of ``agreement_pairs``.

    A correlation over a set of shared items is the product of two unit vectors, each a rater's values of the set less their mean. So the sum over the
    pairs of two groups of raters is the product of the groups' summed vectors, and raters are grouped by the items they rated: the work grows with
    the ratings, not with the pairs. Beyond ``few`` items the pairs are made, which is quadratic in the raters.
    """
    last = written(_last(ratings, rater, item, value, order))
    found = last.select("item").distinct().limit(few + 1).orderBy("item")
    names = [row["item"] for row in found.collect()]  # at most few + 1 values
    if len(names) > few:
        return _pairs(last, least, RATERS, RATINGS).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("r").alias("agreement"))
    sets = [m for m in range(1 << len(names)) if m.bit_count() >= max(1, least)]
    if not sets:
        return last.limit(0).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("v").alias("agreement"))
    slots = range(len(names))
    values = last.groupBy("rater").agg(*[F.max(F.when(F.col("item") == F.lit(names[i]), F.col("v"))).alias(f"v{i}") for i in slots])
    rated = sum((F.when(F.col(f"v{i}").isNotNull(), 1 << i).otherwise(0) for i in slots), F.lit(0))

    def unit(shared: int) -> Column:
        """The rater's vector over a set of items, null if it lacks one of them or has no variance."""
        inside = [i for i in slots if shared >> i & 1]
        n, v = len(inside), [F.col(f"v{i}") for i in inside]
        spread = n * sum(x * x for x in v) - sum(v) * sum(v)
        z = [(F.col(f"v{i}") - sum(v) / n) / F.sqrt(spread / n) if i in inside else F.lit(0.0) for i in slots]
        return F.when(spread > 1e-9, F.struct(F.lit(shared).alias("shared"), *[x.alias(f"z{i}") for i, x in enumerate(z)]))

    x = values.select(rated.alias("rated"), F.explode(F.array_compact(F.array(*[unit(m) for m in sets]))).alias("u")).select("rated", "u.*")
    square = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in slots), F.lit(0.0))
    groups = x.groupBy("shared", "rated").agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("own"), *[F.sum(f"z{i}").alias(f"z{i}") for i in slots])
    one, two = (groups.select("shared", *[F.col(c).alias(f"{s}_{c}") for c in groups.columns if c != "shared"]) for s in ("a", "b"))
    both = one.join(two, "shared").filter((F.col("a_rated") <= F.col("b_rated")) & (F.col("a_rated").bitwiseAND(F.col("b_rated")) == F.col("shared")))
    product = sum((F.col(f"a_z{i}") * F.col(f"b_z{i}") for i in slots), F.lit(0.0))
    alike = F.col("a_rated") == F.col("b_rated")
    n = F.when(alike, F.call_function("div", F.col("a_n") * (F.col("a_n") - 1), F.lit(2))).otherwise(F.col("a_n") * F.col("b_n"))
    total = F.when(alike, (product - F.col("a_own")) / 2).otherwise(product)
    sums = both.select(n.alias("n"), total.alias("r")).filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_pairs"), F.sum("r").alias("r"))
    return sums.select("n_pairs", (F.col("r") / F.col("n_pairs")).alias("agreement"))
