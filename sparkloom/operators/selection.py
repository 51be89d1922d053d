"""Splits, reference banks, ranked retrieval with fallback, and small selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.runs import rotation_index
from sparkloom.sources.tables import written


def bank_fit(d: Column, low: float, high: float) -> Column:
    """Duration fit when a bank is built: 1 inside, d / low below, 1 - (d - high) / high above, at least 0."""
    return F.when((d >= low) & (d <= high), F.lit(1.0)).when(d < low, d / low).otherwise(F.greatest(F.lit(0.0), 1 - (d - high) / high))


def retrieval_fit(d: Column, low: float, high: float) -> Column:
    """Duration fit at retrieval, which falls half as fast above."""
    return F.when((d >= low) & (d <= high), F.lit(1.0)).when(d < low, F.greatest(F.lit(0.0), d / low)).otherwise(F.greatest(F.lit(0.0), 1 - (d - high) / (high * 2)))


def placed(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with _i, their place from 0 within ``by`` in ``order`` (which should be total), and _n, the number of rows of their group.

    Rows are sorted by group and order into ranges, whose bounds come from samples that the partitions merge, so a hot group lies in many ranges. A place is
    the group's rows in the ranges before, from one count a range and group, plus the place inside the range. No task sees more than a range.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    ranged = written(rows.repartitionByRange(*keys, *order).withColumn("_s", F.spark_partition_id()))
    counts = ranged.groupBy("_s", *by).agg(F.count(F.lit(1)).alias("_c"))
    group = W.partitionBy(*by)  # a row a range here
    before = (F.sum("_c").over(group.orderBy("_s")) - F.col("_c")).alias("_b")
    starts = counts.select(F.col("_s").alias("_s2"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], before, F.sum("_c").over(group).alias("_n"))
    same = F.col("_s") == F.col("_s2")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = F.row_number().over(W.partitionBy("_s", *by).orderBy(*order))
    return ranged.withColumn("_r", inside).join(starts, same).withColumn("_i", F.col("_b") + F.col("_r") - 1).select(*rows.columns, "_i", "_n")


def first_rows(rows: DataFrame, n: DataFrame, pos: str, key: str) -> DataFrame:
    """The first rows of ``rows`` in the order of ``pos``, then ``key``; ``n`` is one row with their number, _n. A null ``pos`` is last."""
    at = placed(rows, [], [F.col(pos).asc_nulls_last(), F.col(key).asc_nulls_last()]).withColumnRenamed("_n", "_all")
    return at.crossJoin(F.broadcast(n.limit(1))).filter(F.col("_i") < F.col("_n")).select(*rows.columns)


def assign_splits(samples: DataFrame, style: str, quality: str, key: str, pos: str, heldout: int, val_fraction: float) -> DataFrame:
    """``samples`` with split: per style, ``heldout`` samples from the middle of the quality order (two always stay), then the
    first share of the rest, in input order ``pos`` (numeric), as val."""
    at = placed(samples, [style], [F.col(quality).desc_nulls_last(), F.col(key).asc_nulls_first()])
    take = F.least(F.lit(heldout), F.greatest(F.lit(0), F.col("_n") - 2))
    middle = F.floor(F.col("_n") / 2)
    marked = at.withColumn("_h", (F.col("_i") >= middle) & (F.col("_i") < middle + take)).drop("_i", "_n")
    rest = marked.filter("not _h")
    cut = rest.agg(F.floor(F.count(F.lit(1)) * F.lit(val_fraction)).alias("_n"))
    val = first_rows(rest.select(*dict.fromkeys((key, pos))), cut, pos, key).select(key, F.lit(True).alias("_v"))
    return marked.join(val, key, "left").withColumn("split", F.when(F.col("_h"), "heldout").when(F.col("_v"), "val").otherwise("train")).drop("_h", "_v")


def build_bank(samples: DataFrame, style: str, text: str, duration: str, quality: str, key: str, low: float, high: float, per_style: int = 4) -> DataFrame:
    """Per style the best ``per_style`` samples by fit, quality and key, one per transcript, named style_01.."""
    rank = [F.desc("_fit"), F.desc(quality), F.col(key)]
    once = samples.withColumns({"_fit": bank_fit(F.col(duration), low, high), "_t": F.trim(text)}).withColumn("_r", F.row_number().over(W.partitionBy(style, "_t").orderBy(*rank))).filter("_r = 1")
    chosen = once.withColumn("_n", F.row_number().over(W.partitionBy(style).orderBy(*rank))).filter(F.col("_n") <= per_style)
    return chosen.withColumn("reference_id", F.concat(F.col(style), F.format_string("_%02d", "_n"))).drop("_fit", "_t", "_r", "_n")


def bank_with_fallback(samples: DataFrame, style: str, duration: str, quality: str, key: str, window: tuple[float, float], wide: tuple[float, float], ideal: float, per_style: int) -> DataFrame:
    """Per style the ``per_style`` samples nearest the ideal duration inside ``window``, or inside ``wide`` where the style has none there."""
    inside = F.col(duration).between(*window)
    found = samples.groupBy(F.col(style).alias("_style")).agg(F.max(inside).alias("_any"))  # counted before the join, so a hot style is one row of it
    pool = samples.join(found, F.col(style).eqNullSafe(F.col("_style"))).drop("_style").filter(F.when(F.col("_any"), inside).otherwise(F.col(duration).between(*wide)))
    n = F.row_number().over(W.partitionBy(style).orderBy(F.abs(F.col(duration) - ideal), F.desc(F.coalesce(F.col(quality), F.lit(0.0))), key))
    return pool.withColumn("place", n).filter(F.col("place") <= per_style).drop("_any")


def style_chain(requested: Column, core: Column) -> Column:
    """Exact, core style, neutral: present ones, each once."""
    return F.array_distinct(F.array_compact(F.array(F.nullif(requested, F.lit("")), core, F.lit("neutral"))))


def select_references(requests: DataFrame, styles: DataFrame, bank: DataFrame, request: str, window: tuple[float, float], pool: int = 3, exclude: list | None = None) -> DataFrame:
    """For each request (``request``, style, variation_key) the reference of the first style of its chain that the bank has, else any.

    ``bank`` has reference_id, style, duration, quality; ``styles`` name, core_style. Within the matched style references are ranked by 0.65 quality +
    0.35 fit, and a variation key picks one of the first ``pool``. The ``pool`` best of each style are all that can be chosen, so the bank is cut to
    them before the join; an empty bank gives null references. The ids of ``exclude`` can't be chosen; if the bank has references but all are
    excluded, this fails.
    """
    if exclude:
        left = bank.filter(~F.col("reference_id").isin(exclude))
        if left.isEmpty() and not bank.isEmpty():
            raise ValueError(f"no reference is left: all are among the {len(exclude)} excluded ids")
        bank = left
    total = F.round(0.65 * F.col("quality") + 0.35 * retrieval_fit(F.col("duration"), *window), 6)
    scored = bank.withColumn("total", total)
    best = lambda d, *by: d.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("total"), "reference_id"))).filter(F.col("_r") <= pool)
    folded = lambda d, *by: best(d, *by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_r", "reference_id", "style"))).alias("refs"))
    by_style = folded(scored, "style").withColumnRenamed("style", "_s")
    first = scored.orderBy(F.desc("total"), "reference_id").limit(pool)
    any_ = best(first.withColumn("_one", F.lit(1)), "_one").agg(F.sort_array(F.collect_list(F.struct("_r", "reference_id", "style"))).alias("any"))
    chains = requests.join(styles, requests.style == styles.name, "left").select(requests["*"], F.posexplode(style_chain(requests.style, F.col("core_style"))).alias("_pos", "_s"))
    hit = chains.join(by_style, "_s").groupBy(request).agg(F.min_by("refs", "_pos").alias("refs"), F.min_by("_s", "_pos").alias("matched"))
    all_ = requests.join(hit, request, "left").crossJoin(F.broadcast(any_))  # one row of at most ``pool`` entries
    refs = F.coalesce("refs", "any")
    i = F.when(F.col("variation_key").isNull(), F.lit(0)).otherwise(rotation_index(F.col("variation_key"), F.size("_refs")))
    return all_.withColumn("_refs", refs).withColumn("_c", F.when(F.size("_refs") > 0, F.get("_refs", i))).select(
        request, F.col("style").alias("requested"), F.col("_c.reference_id").alias("reference_id"), F.col("_c.style").alias("matched"), (F.coalesce("matched", F.lit("")) != F.col("style")).alias("was_fallback")
    )


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with _i, their place from 0 in the order of ``key``, and _n, their number; null keys are first. No task sees all rows."""
    return placed(rows, [], [F.col(key).asc_nulls_first()])


def control_set(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Every n // size-th key in order, ``size`` at most; none where size is not positive or not below n."""
    if size <= 0:
        return rows.select(key).limit(0)
    placed = numbered(rows.select(key), key)
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / size))
    return placed.filter((F.col("_n") > size) & (F.col("_i") % stride == 0) & (F.col("_i") / stride < size)).select(key)


def by_style(bank: DataFrame, style: str, quality: str, key: str) -> DataFrame:
    """``bank`` with place: within each style the best quality first, ties by key. A hot style is ranked in ranges."""
    at = placed(bank, [style], [F.col(quality).desc_nulls_last(), F.col(key).asc_nulls_first()])
    return at.withColumn("place", (F.col("_i") + 1).cast("int")).drop("_i", "_n")


def best_of_style(bank: DataFrame, style: str, quality: str, key: str, most: int) -> DataFrame:
    """The rows of ``by_style`` with a place up to ``most``: each task gives at most so many rows a style before any are sent."""
    first = F.row_number().over(W.partitionBy(style).orderBy(F.col(quality).desc_nulls_last(), F.col(key).asc_nulls_first()))
    return bank.withColumn("place", first).filter(F.col("place") <= most)


def resolve(requests: DataFrame, styles: DataFrame, bank: DataFrame, style: str, quality: str, key: str, most: int = 3) -> DataFrame:
    """(style, place, key): for each requested style the references of the first style of its chain that the bank has, best quality first, else of the
    whole bank; ``most`` of them.
    """
    ranked = best_of_style(bank, style, quality, key, most).select(F.col(style).alias("_s"), "place", key)
    chains = requests.join(styles, F.col(style) == styles.name, "left").select(style, F.posexplode(style_chain(F.col(style), F.col("core_style"))).alias("_pos", "_s"))
    known = chains.join(ranked.select("_s").distinct(), "_s").groupBy(style).agg(F.min_by("_s", "_pos").alias("_s"))
    own = known.join(ranked, "_s").select(style, "place", key)
    first = bank.orderBy(F.desc(quality), key).limit(most).select(quality, key).withColumn("place", F.row_number().over(W.orderBy(F.desc(quality), key)))  # ``most`` rows
    rest = requests.select(style).join(known, style, "left_anti").crossJoin(F.broadcast(first.select("place", key)))
    return own.unionByName(rest.select(style, "place", key))


def active_sources(sources: DataFrame, order: str, error: str, path: str, limit: int | None = None) -> DataFrame:
    """The first ``limit`` sources in order; of these, the ones without an error or with a working file."""
    first = sources.orderBy(order).limit(limit) if limit else sources
    return first.filter(F.col(error).isNull() | F.col(path).isNotNull())


def enabled(candidates: DataFrame, flag: str = "enabled") -> DataFrame:
    """Candidates that aren't switched off; a missing flag counts as on."""
    return candidates.filter(F.coalesce(F.col(flag), F.lit(True)))


def best_reference(samples: DataFrame, by: str, style: str, preferred: str, duration: str, quality: str, key: str) -> DataFrame:
    """Per ``by``: of the preferred style if there is one, else any; of these 3 to 10 s if there is one, else any; then best quality, highest key."""
    liked, fits = F.coalesce(F.col(style) == preferred, F.lit(False)), F.coalesce(F.col(duration).between(3, 10), F.lit(False))
    return samples.groupBy(by).agg(F.max(F.struct(liked.alias("liked"), fits.alias("fits"), quality, key)).alias("_b")).select(by, f"_b.{key}", f"_b.{quality}")


def reference_for(requests: DataFrame, bank: DataFrame, style: str, quality: str, key: str) -> DataFrame:
    """The best reference of each requested style, else of neutral, else of all; the first on ties."""
    first = lambda d, *by: d.groupBy(*by).agg(F.min(F.struct((-F.col(quality)).alias("q"), F.col(key).alias("k"))).alias("b")) if by else d.agg(F.min(F.struct((-F.col(quality)).alias("q"), F.col(key).alias("k"))).alias("b"))
    own, neutral, rest = first(bank, style), first(bank.filter(F.col(style) == "neutral")), first(bank)
    return requests.join(own, style, "left").crossJoin(F.broadcast(neutral.select(F.col("b").alias("n")))).crossJoin(F.broadcast(rest.select(F.col("b").alias("r")))).select(style, F.coalesce("b", "n", "r")["k"].alias(key))


def first_per_style(declared: DataFrame, sentences: DataFrame, style: str, text: str, pos: str) -> DataFrame:
    """The first sentence of each declared style; styles without one get the first of all."""
    own = sentences.groupBy(style).agg(F.min_by(text, pos).alias("_own"))
    first = sentences.agg(F.min_by(text, pos).alias("_first"))
    return declared.join(own, style, "left").crossJoin(F.broadcast(first)).select(style, F.coalesce("_own", "_first").alias(text))


def tail(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each ``by``."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*[F.desc(c) for c in order]))).filter(F.col("_r") <= n).drop("_r")
