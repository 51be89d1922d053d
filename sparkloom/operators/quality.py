"""Data-quality rules as tables of findings: packs, datasets, profiles and lint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.dialogue import distinct_lines
from sparkloom.sources.tables import written

ISSUES = "severity string, code string, subject string"


def rule(rows: DataFrame, severity: str, code: str, when: Column | None, subject: Column) -> DataFrame:
    """One finding for every row that ``when`` holds for."""
    hit = rows if when is None else rows.filter(when)
    return hit.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"))


def findings(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def passed(issues: DataFrame) -> DataFrame:
    """One row: findings by severity, and ok without errors."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    return issues.agg(n("error"), n("warning"), n("info")).withColumn("ok", F.col("n_error") == 0)


def bank_issues(pack: DataFrame, bank: DataFrame, required: bool = True) -> DataFrame:
    """``pack`` and ``bank`` (both id, version; one row, or none of the bank) against each other: a missing bank, one of another pack, one of another
    version.
    """
    one = bank.limit(1).agg(F.max(F.struct("id", "version")).alias("b"))  # one row, whatever the bank
    met = pack.limit(1).select(F.col("id").alias("_id"), F.col("version").alias("_version")).crossJoin(F.broadcast(one)).select("_id", "_version", "b.*", F.col("b").isNotNull().alias("_found"))
    return findings(
        rule(met, "error" if required else "info", "references.missing", ~F.col("_found"), F.col("_id")),
        rule(met, "error", "references.id_mismatch", F.col("_found") & ~F.col("id").eqNullSafe(F.col("_id")), F.col("id")),
        rule(met, "warning", "references.version_drift", F.col("_found") & ~F.col("version").eqNullSafe(F.col("_version")), F.col("version")),
    )


def capped(rows: DataFrame, by: str, value: str, most: int) -> DataFrame:
    """(by, shown): the first ``most`` values of each key in order, and how many there are, as one text: a, b (5 in all). Null values aren't among them.

    Each task sends at most ``most`` values of a key and one count, however many the key has.
    """
    some = rows.select(by, value).filter(F.col(value).isNotNull())
    n = some.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    first = some.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(value))).filter(F.col("_r") <= most)
    shown = first.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(value)), ", ").alias("_shown"))
    met = rows.select(by).distinct().join(n, by, "left").join(shown, by, "left")
    text = F.when(F.col("_n") > most, F.concat("_shown", F.lit(" ("), "_n", F.lit(" in all)"))).otherwise(F.coalesce("_shown", F.lit("")))
    return met.select(by, text.alias("shown"))


def reference_issues(styles: DataFrame, bank: DataFrame, least: int = 2) -> DataFrame:
    """``styles`` (style) against ``bank`` (reference_id, style, transcript, has_audio): unknown styles, missing audio and transcripts, empty and thin
    styles.
    """
    unknown = bank.join(styles, "style", "left_anti")
    counts = styles.join(bank.groupBy("style").agg(F.count(F.lit(1)).alias("n")), "style", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return findings(
        rule(unknown, "error", "references.unknown_style", None, F.col("reference_id")),
        rule(bank, "error", "references.missing_audio", ~F.col("has_audio"), F.col("reference_id")),
        rule(bank, "error", "references.no_transcript", F.trim(F.coalesce("transcript", F.lit(""))) == "", F.col("reference_id")),
        rule(counts, "error", "references.style_empty", F.col("n") == 0, F.col("style")),
        rule(counts, "warning", "references.style_thin", (F.col("n") > 0) & (F.col("n") < least), F.col("style")),
    )


def dataset_issues(styles: DataFrame, samples: DataFrame, splits: DataFrame, minutes: float = 20.0) -> DataFrame:
    """``samples`` (sample_id, style, status, duration_s, has_audio, altered) and ``splits`` (sample_id, split): too little audio, no held-out split, unknown
    styles, missing audio, unreviewed and altered samples; plus split entries of unknown samples and doubled ids."""
    usable = samples.filter(F.col("status").isin("approved", "corrected"))
    one = lambda rows, *aggs: rows.agg(*aggs)
    return findings(
        rule(one(usable, F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("s")), "warning", "dataset.too_small", F.col("s") < minutes * 60, F.round(F.col("s") / 60, 2)),
        rule(one(splits, F.count_if(F.col("split") == "heldout").alias("n")), "warning", "dataset.no_heldout", F.col("n") == 0, F.lit("splits")),
        rule(usable.select("style").distinct().join(styles, "style", "left_anti"), "error", "dataset.unknown_styles", None, F.col("style")),
        rule(one(usable, F.count_if(~F.col("has_audio")).alias("n")), "error", "dataset.missing_audio", F.col("n") > 0, F.col("n")),
        rule(one(samples, F.count_if(F.col("status") == "pending").alias("n")), "warning", "dataset.unreviewed", F.col("n") > 0, F.col("n")),
        rule(one(usable, F.count_if("altered").alias("n")), "info", "dataset.destructive_processing", F.col("n") > 0, F.col("n")),
        rule(splits.join(samples, "sample_id", "left_anti"), "error", "dataset.unknown_sample", None, F.col("sample_id")),
        rule(samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")), "error", "dataset.duplicate_id", F.col("n") > 1, F.col("sample_id")),
    )


def profile_issues(profile: DataFrame, wanted: DataFrame, styles: DataFrame, pack: str) -> DataFrame:
    """``profile`` (id, pack, default_style) and its ``wanted`` styles (style) against a pack's declared ``styles``."""
    return findings(
        rule(profile, "error", "profile.pack_mismatch", F.col("pack") != pack, F.col("id")),
        rule(wanted.select("style").distinct().join(styles, "style", "left_anti"), "error", "profile.unsupported_styles", None, F.col("style")),
        rule(profile.join(styles, profile.default_style == styles.style, "left_anti"), "error", "profile.bad_default_style", None, F.col("id")),
    )


def lint(examples: DataFrame, styles: DataFrame, readings: DataFrame, least: int = 12, per_style: int = 2) -> DataFrame:
    """Findings by profile. ``examples`` has profile, pos, style, character, source; ``styles`` profile, style; ``readings`` profile, word, reading.

    Examples are doubled if they are near-duplicates of an earlier one of their profile, by bigrams. Each rule would read its own columns and so walk
    the examples again: what several rules read is written once.
    """
    distinct = distinct_lines(examples, "profile", "pos", "character").groupBy("profile").agg(F.count(F.lit(1)).alias("n_distinct"))
    counts = examples.groupBy("profile", "style").agg(
        F.count(F.lit(1)).alias("k"), F.count_if(F.trim(F.coalesce("source", F.lit(""))) == "").alias("unsourced"), F.count_if(F.col("character").rlike("[A-Za-z]")).alias("latin")
    )
    counts = written(counts)
    per = counts.groupBy("profile").agg(F.sum("k").alias("n"), *[F.sum(x).alias(x) for x in ("unsourced", "latin")])
    all_ = written(styles.select("profile").distinct().join(per, "profile", "left").join(distinct, "profile", "left").fillna(0, ["n", "unsourced", "latin", "n_distinct"]))
    declared = styles.join(counts.select("profile", "style", "k"), ["profile", "style"], "left").join(all_.filter("n > 0"), "profile", "left_semi").withColumn("k", F.coalesce("k", F.lit(0)))
    declared = written(declared.filter(F.col("k") < per_style))
    p, s = F.col("profile"), F.concat_ws("/", "profile", "style")
    return findings(
        rule(all_, "error", "profile.no_examples", F.col("n") == 0, p), rule(all_, "warning", "profile.few_examples", F.col("n").between(1, least - 1), p),
        rule(all_, "warning", "profile.duplicate_examples", F.col("n_distinct") < F.col("n"), p), rule(all_, "warning", "profile.unsourced_examples", F.col("unsourced") > 0.5 * F.col("n"), p),
        rule(all_, "info", "profile.latin_in_examples", F.col("latin") > 0, p), rule(declared, "error", "profile.style_without_examples", F.col("k") == 0, s),
        rule(declared, "warning", "profile.thin_style", F.col("k").between(1, per_style - 1), s), rule(counts.join(styles, ["profile", "style"], "left_anti"), "warning", "profile.examples_in_undeclared_styles", None, s),
        rule(readings, "error", "profile.bad_pronunciation", ~F.trim("reading").rlike("(?i)^[a-zü]+[1-5]?$"), F.concat_ws("/", "profile", "word")), rule(readings, "warning", "profile.multi_char_pronunciation", F.char_length("word") != 1, F.concat_ws("/", "profile", "word")),
    )


def lint_summary(issues: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row a profile with its findings by severity; profiles without any stay."""
    own = issues.withColumn("profile", F.substring_index("subject", "/", 1)).groupBy("profile").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("error", "warning", "info")])
    return profiles.select(F.col("profile").cast("string").alias("profile")).distinct().join(own, "profile", "left").fillna(0).withColumn("ok", F.col("n_error") == 0)


def build_gate(samples: DataFrame, least: int = 1, stub: str = "stub") -> DataFrame:
    """Whether a dataset can be built: the reason why not, or null."""
    x = samples.agg(F.count_if(F.col("status").isin("approved", "corrected")).alias("n"), F.count_if((F.col("transcript_source") == stub) & F.col("status").isin("approved", "corrected")).alias("n_stub"))
    return x.withColumn("reason", F.when(F.col("n") < least, "no approved samples").when(F.col("n_stub") > 0, "stub transcripts"))
