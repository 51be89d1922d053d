"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm._store import hold, release, store

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Targets of ``sources`` (source, source_size, weight): shares of the total size by weight, none above
    ``max_epochs`` times its source, the excess going to the others by weight until none is above.

    Repeating the clamp and the redistribution ends where every target is min(weight * level, cap) for one level.
    With sources ordered by cap / weight, the clamped ones are a prefix, so running sums give the level directly.
    The windows here run over one row per source, not over documents. Ties in cap / weight are clamped together or
    not at all, so their order is of no account. Sources of size 0 get 0; no sources give no rows.
    """
    cap = F.col("source_size") * max_epochs
    first = W.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    so_far, rest = first.rowsBetween(W.unboundedPreceding, -1), first.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    level = (total - F.coalesce(F.sum(cap).over(so_far), F.lit(0))) / F.sum("weight").over(rest)
    each = sources.withColumn("level", level).withColumn("clamped", cap < F.col("weight") * F.col("level"))
    final = F.max(F.when(~F.col("clamped"), F.col("level"))).over(W.partitionBy())  # that of the first source not clamped: levels fall after it
    return each.withColumn("final", final).select(
        "source", "source_size", "weight", F.when(F.col("clamped"), cap.cast("double")).otherwise(F.col("weight") * F.coalesce("final", F.lit(0.0))).alias("target")
    )


#: So many sources (one short row each) are broadcast; more are joined by source and slice.
SMALL = 100_000


def _boundaries(light: DataFrame, targets: DataFrame, max_epochs: int) -> DataFrame:
    """One row a source: source, source_size, target, _whole, and the last place of its order that is taken once more, _last, of which _more of _equal rows are.

    ``light`` has source, size and _place. Sizes are first added up by the first five hex digits of the place, 2 ** 20 groups a source at most, and by its first two; running sums of both levels tell the
    group in which the missing words end, and only that group's rows are ordered. Equal places are one row with a count there.
    """
    groups = light.groupBy("source", F.substring("_place", 1, 5).alias("_group")).agg(F.sum("size").alias("_size")).withColumn("_slice", F.substring("_group", 1, 2))
    slices = groups.groupBy("source", "_slice").agg(F.sum("_size").alias("_in_slice"))
    until = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_in_slice").over(until("source").orderBy("_slice")), F.lit(0))).drop("_in_slice")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    plan = targets.withColumn("_whole", whole).withColumn("_missing", F.when(F.col("_whole") < max_epochs, F.col("target") - F.col("_whole") * F.col("source_size")).otherwise(F.lit(0.0)))
    inside = F.coalesce(F.sum("_size").over(until("source", "_slice").orderBy("_group")), F.lit(0))
    placed = groups.withColumn("_inside", inside).alias("g").join(slices.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source")) & (F.col("g._slice") == F.col("s._slice")))
    placed = placed.select("g.source", "g._group", (F.col("_before") + F.col("_inside")).alias("_before")).alias("p").join(plan.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    end = placed.filter("_before < _missing").groupBy("p.source").agg(F.max(F.struct("_group", "_before", "_missing")).alias("end")).select("source", "end.*")
    rows = light.alias("l").join(end.alias("e"), F.col("l.source").eqNullSafe(F.col("e.source")) & (F.substring("_place", 1, 5) == F.col("_group")))
    one = rows.groupBy("e.source", "_group", "_before", "_missing", "_place").agg(F.max("size").alias("_size"), F.count(F.lit(1)).alias("_equal"))
    left = F.col("_missing") - F.col("_before") - F.coalesce(F.sum(F.col("_size") * F.col("_equal")).over(until("source").orderBy("_place")), F.lit(0))
    fits = F.when(F.col("_size") == 0, F.when(left > 0, F.col("_equal")).otherwise(0)).otherwise(F.ceil(left / F.col("_size") + 0.5) - 1)
    taken = one.withColumn("_more", F.when((F.col("_equal") == 1) & (F.col("_size") / 2.0 >= left), 0).otherwise(F.least(fits, "_equal")).cast("long"))
    last = taken.groupBy("source", "_group").agg(F.max(F.when(F.col("_more") > 0, F.struct("_place", "_more", "_equal"))).alias("last"))
    last = last.select("source", F.coalesce("last._place", "_group").alias("_last"), F.coalesce("last._more", F.lit(0)).alias("_more"), F.coalesce("last._equal", F.lit(0)).alias("_equal"))
    return plan.alias("t").join(last.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left").select("t.source", "source_size", "target", "_whole", "_last", "_more", "_equal")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (size * copies); all columns of ``docs`` stay.

    A source's documents are taken floor(target / source_size) whole times; then, in the order of a seeded hash of doc_id, with the text's digest against ties,
    once more while the middle of the document's stretch of the running size is below what is missing. That place is found by two levels of group
    sums (see ``_boundaries``), so neither texts nor all rows are sorted, and every row decides by its own place.

    Null sources are one source, last in order; null or empty texts have size 0 and are taken 0 words (copies as
    the rest). Rows that share a doc_id but not the text have places of their own. Rows repeated with doc_id and text share a place; where the last place taken is such a one, the
    right number of them is taken, which ones is of no account. Reruns agree whatever the partitions. An empty table gives an empty result. Columns
    of ``docs`` that are named like a result column are replaced.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in made]
    digest = F.md5(F.coalesce("text", F.lit("")))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), digest)))  # without an id the text gives the place, so such rows are spread as well
    place = F.concat(F.substring(hashed, 12, 2), hashed, digest)
    rows = docs.drop(*made).withColumns({"size": word_count(F.col("text")), "_place": place})
    light = hold(rows.select("source", "size", "_place"))
    by_source = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_nth") % len(weights) + 1).cast("int"))
    targets = water_fill(by_source.withColumn("_nth", nth).withColumn("weight", weight).drop("_nth"), max_epochs)
    plan = store(_boundaries(light, targets, max_epochs), "mix")
    release(light)
    same = F.col("r.source").eqNullSafe(F.col("q.source"))
    if plan.count() <= SMALL:
        met = rows.alias("r").join(F.broadcast(plan).alias("q"), same)
    else:  # 256 slices a source, so that a hot one is spread
        digits = F.array(*[F.lit(f"{i:02x}") for i in range(256)])
        met = rows.alias("r").join(plan.withColumn("_slice", F.explode(digits)).alias("q"), same & (F.substring("r._place", 1, 2) == F.col("q._slice")))
    met = met.select("r.*", "q.source_size", "q.target", "_whole", "_last", "_more", "_equal")
    tied = F.coalesce((F.col("_place") == F.col("_last")) & (F.col("_more") < F.col("_equal")), F.lit(False))
    below = F.coalesce((F.col("_place") < F.col("_last")) | ((F.col("_place") == F.col("_last")) & (F.col("_more") > 0)), F.lit(False))
    decided = met.withColumn("_extra", below)
    if not plan.filter("_more > 0 AND _more < _equal").isEmpty():  # repeated rows at the end: numbered in two levels
        some = met.filter(tied).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(256)))
        some = some.withColumn("_row", F.row_number().over(W.partitionBy("source", "_salt").orderBy("_place")))
        counts = some.groupBy("source", "_salt").agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        some = some.alias("s").join(counts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s._salt") == F.col("c._salt")))
        some = some.select("s.*", (F.col("_start") + F.col("_row") <= F.col("_more")).alias("_extra")).drop("_salt", "_row")
        decided = decided.filter(~tied).unionByName(some)
    copies = decided.withColumn("copies", F.col("_whole") + F.col("_extra").cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    return copies.select(*kept, *made)
