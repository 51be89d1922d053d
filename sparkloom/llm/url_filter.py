"""Urls judged by rules, and beyond them by the ratio of two character language models, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm._store import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its path; the longest wins.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Letters are the symbols 1 to 26 and the digits one symbol; 0 stands before the first and after the last character.
SYMBOLS = 32
#: A gram is the symbol and the three before it, so a model has at most 32 ** 4 rows, whatever the input.
ORDER = 3
#: Scores are cut into bins of this width for the threshold.
BIN = 1 / 64


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(h: Column, p: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null without one."""
    found = F.lit(None).cast("struct<rule string, verdict string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(text: Column) -> Column:
    """The grams of ``text`` and its end, as numbers: the symbol plus 32 times the one before it, and so on."""
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9./-]", "_")
    # the lowest five bits of these characters are the symbols
    marked = F.concat(F.translate(plain, "0123456789./-", "{{{{{{{{{{|}~"), F.lit("`"))
    symbols = F.transform(F.split(marked, ""), lambda c: F.ascii(c).bitwiseAND(SYMBOLS - 1))

    def numbered(held: Column) -> Column:
        before = lambda i: [F.coalesce(F.get(held, i - k), F.lit(0)) * SYMBOLS**k for k in range(1, ORDER + 1)]
        return F.transform(held, lambda symbol, i: sum(before(i), symbol).cast("long"))

    return F.get(F.transform(F.array(symbols), numbered), F.lit(0))  # so that the symbols are worked out once


def train(labelled: DataFrame) -> DataFrame:
    """(gram, ratio): ln of the probability of a gram's last symbol after the others in accepted texts, less that in rejected ones.

    ``labelled`` has text and accepted (boolean). Both models are of variable order: each order is smoothed with the next shorter
    one by the number of different symbols that follow the context (Witten-Bell), the shortest with equal chances, so a context that
    was never seen leaves the shorter one's value. All 32 ** 4 grams have a row; without labelled texts every ratio is 0.
    """
    spark = labelled.sparkSession
    seen = labelled.select("accepted", F.explode(grams(F.col("text"))).alias("gram"))
    longest = seen.groupBy("gram").agg(*[F.count_if(F.col("accepted") == side).alias(f"n{side}") for side in (True, False)])
    lower = spark.range(1).select(F.lit(0).cast("long").alias("gram"), *[F.lit(1 / SYMBOLS).alias(f"p{s}") for s in (True, False)])
    for order in range(ORDER + 1):
        counts = longest.groupBy(F.pmod("gram", F.lit(SYMBOLS ** (order + 1))).alias("gram")).agg(*[F.sum(f"n{s}").alias(f"n{s}") for s in (True, False)])
        context = counts.groupBy(F.call_function("div", F.col("gram"), F.lit(SYMBOLS)).alias("context")).agg(
            *[F.sum(f"n{s}").alias(f"c{s}") for s in (True, False)], *[F.count_if(F.col(f"n{s}") > 0).alias(f"t{s}") for s in (True, False)]
        )
        every = spark.range(SYMBOLS ** (order + 1)).select(
            F.col("id").alias("gram"),
            F.call_function("div", F.col("id"), F.lit(SYMBOLS)).alias("context"),
            (F.pmod("id", F.lit(SYMBOLS**order)) if order else F.lit(0).cast("long")).alias("shorter"),
        )
        level = every.join(counts, "gram", "left").join(context, "context", "left").join(lower.withColumnRenamed("gram", "shorter"), "shorter")

        def chance(s: bool) -> Column:
            n, c, t = (F.coalesce(f"{x}{s}", F.lit(0)) for x in "nct")
            return F.when(c > 0, (n + t * F.col(f"p{s}")) / (c + t)).otherwise(F.col(f"p{s}")).alias(f"p{s}")

        lower = level.select("gram", chance(True), chance(False))
    return lower.select("gram", F.log(F.col("pTrue") / F.col("pFalse")).alias("ratio"))


def scores(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(text, score) of distinct ``texts``: the mean ratio over its grams. The model is broadcast: 32 ** 4 rows of 16 bytes, whatever the input."""
    rows = texts.select("text", F.explode(grams(F.col("text"))).alias("gram")).join(F.broadcast(model), "gram")
    return rows.groupBy("text").agg(F.avg("ratio").alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """(least): one row, the bin from which ``scored`` (score, accepted) is accepted.

    Bins between two occupied ones have equal errors, so the nearest to 0 stands for them; of these the one with the least balanced
    error is taken, on ties that nearest to 0, then the smaller. 0 if one kind is missing.
    """
    counts = [F.count_if(F.col("accepted") == s).alias(f"n{s}") for s in (True, False)]
    bins = scored.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(*counts)
    # one group, but of bins: scores are bounded by the smoothing, so there are some thousands
    whole = W.partitionBy(F.lit(1))
    below = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    share = lambda s: F.coalesce(F.sum(f"n{s}").over(below), F.lit(0)) / F.sum(f"n{s}").over(whole)
    nearest = F.greatest(F.least(F.lit(0), "bin"), F.max("bin").over(below) + 1)
    both = F.least(F.sum("nTrue").over(whole), F.sum("nFalse").over(whole))
    edges = bins.select("nTrue", "nFalse", "bin", nearest.alias("least"), both.alias("both"), F.when(both > 0, F.round(share(True) + 1 - share(False), 12)).alias("error"))
    best = edges.filter("both > 0").agg(F.min(F.struct("error", F.abs("least").alias("far"), "least")).alias("best"))
    return best.select(F.coalesce("best.least", F.lit(0)).cast("long").alias("least"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, folds: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages`` (page_id, url).

    Where a rule fits, the longest decides. The urls that rules judge teach two models of characters, of accepted and of rejected texts; a text is
    host and path. The verdict of the others is whether the mean log ratio of a text's grams reaches a threshold, which is calibrated on a fold of
    the ruled texts (by md5) that the models haven't seen. Each distinct text counts once for the models, so a url on a third of all rows is one text.

    Null urls and those without ``://`` have empty host and path, and are judged like any text: by the models, as no rule fits. Without ruled urls all
    scores are 0 and all is allowed. Repeated rows get equal results; an empty table gives none; other columns are ignored. Very long urls are read whole.
    """
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = rows.select("host", "path", F.concat("host", "path").alias("text")).distinct().withColumn("found", matched(F.col("host"), F.col("path"), rules))
    ruled = store(ruled, "urls")  # a path is empty or begins with the first slash, so a text is one host and path
    taught = ruled.filter("found is not null").select("text", (F.col("found.verdict") == "allow").alias("accepted"), (F.pmod(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long"), F.lit(folds)) == 0).alias("out"))
    model = store(train(taught.filter("not out")), "url-model")
    scored = store(scores(ruled.select("text"), model), "url-scores")
    least = threshold(scored.join(taught.filter("out"), "text"))
    method = F.when(F.floor(F.col("score") / BIN) >= F.col("least"), "allow").otherwise("block")
    judged = ruled.join(scored, "text").crossJoin(F.broadcast(least)).select(  # one row: an aggregate without keys
        "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), F.round("score", 6).alias("score")
    )
    return rows.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "score")
