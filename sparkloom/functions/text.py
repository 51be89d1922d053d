"""Text columns in built-in functions: names, redaction, bigrams, guards, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that bigrams ignore, sentence terminators, and patterns of secrets whose first group stays.
IGNORED = r"""[\s，。！？、；：,.!?;:"'“”‘’（）()\[\]【】—…·~～\-]+"""
TERMINATORS = "。！？…"
SECRETS = (r"(sk-[A-Za-z0-9_\-]{6})[A-Za-z0-9_\-]+", r"(?i)(authorization:\s*bearer\s+)\S+", r"""(?i)(api[_-]?key["'=:\s]+)[^\s,"'}]+""")
CJK = "[一-鿿]"


def one_line(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bigrams(text: Column) -> Column:
    """Distinct overlapping character pairs without punctuation and white space; a single character is its own."""
    chars = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, ""), "")
    n = F.size(chars)
    pairs = F.array_distinct(F.zip_with(F.slice(chars, 1, F.greatest(n - 1, F.lit(0))), F.slice(chars, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b)))
    return F.when(n >= 2, pairs).otherwise(F.filter(chars, lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def redact(text: Column) -> Column:
    for p in SECRETS:
        text = F.regexp_replace(text, p, "$1[redacted]")
    return text


def mask_secret(secret: Column) -> Column:
    """Eight bullets, after the first three characters of sk- and sk_ keys and before the last four of secrets longer than eight; null for none."""
    head = F.when(secret.startswith("sk-") | secret.startswith("sk_"), F.substring(secret, 1, 3)).otherwise("")
    tail = F.when(F.char_length(secret) > 8, F.right(secret, F.lit(4))).otherwise("")
    return F.when(secret != "", F.concat(head, F.lit("•" * 8), tail))


def safe_name(name: Column) -> Column:
    """The last path part with runs of other characters as _, at most 150 characters; file for nothing."""
    stem = F.substring_index(F.regexp_replace(F.regexp_replace(name, r"\\", "/"), "/+$", ""), "/", -1)
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(stem, r"[^\w.\-一-鿿]+", "_"), 1, 150), F.lit("")), F.lit("file"))


def clip_id(path: Column) -> Column:
    """A slug of a path without its suffix; beyond 120 characters its first 110 and eight of the path's SHA-1; clip for nothing."""
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    slug = F.coalesce(F.nullif(slug, F.lit("")), F.lit("clip"))
    return F.when(F.char_length(slug) <= 120, slug).otherwise(F.concat(F.substring(slug, 1, 110), F.lit("_"), F.substring(F.sha1(path), 1, 8)))


def path_problem(path: Column) -> Column:
    """Why a relative path isn't acceptable, the first reason; null where it is."""
    parts = F.split(path, "/")
    return (
        F.when(path.startswith("/") | path.startswith("\\"), "absolute").when(path.contains("\\"), "backslash")
        .when(F.array_contains(parts, ".."), "parent").when(F.array_contains(parts, ""), "empty part")
    )


def version(text: Column) -> Column:
    """struct(major, minor, patch) of v1.2.3; null for other texts."""
    part = lambda i: F.regexp_extract(text, r"^v?(\d+)\.(\d+)\.(\d+)$", i)
    return F.when(text.rlike(r"^v?\d+\.\d+\.\d+$"), F.struct(*[part(i).cast("int").alias(n) for i, n in enumerate(("major", "minor", "patch"), 1)]))


def chars_per_second(text: Column, duration: Column) -> Column:
    """CJK characters a second, or any but white space where there are none; null without characters or time. Rounded
    as in SQL, where thousandths are taken from the product in double, not from the decimal digits: 8.1375 is 8.137.
    """
    cjk, other = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit(r"\S"))
    n = F.when(cjk > 0, cjk).otherwise(other)
    return F.when((duration > 0) & (n > 0), F.round(n / duration * 1000) / 1000)


def speech_seconds(text: Column, rate: float = 4.8, speed: float = 1.0) -> Column:
    """Estimated speaking time: CJK characters and 2.2 for each Latin run (0.6 a character, 1 at least, where there is neither) at ``rate``, 0.18 s a
    pause, at least 0.25 s.
    """
    units = F.regexp_count(text, F.lit(CJK)) + 2.2 * F.regexp_count(text, F.lit("[A-Za-z0-9_.-]+"))
    units = F.when(units > 0, units).otherwise(F.greatest(F.lit(1.0), F.char_length(text) * 0.6))
    pauses = F.regexp_count(text, F.lit("[，。！？；：、…,.!?;:]"))
    return F.round(F.greatest(F.lit(0.25), (units / max(0.5, rate) + pauses * 0.18) / max(0.1, speed)), 4)


def ends_completely(text: Column) -> Column:
    """Whether the text, without closers, ends in a terminator or a sentence-final particle."""
    return F.coalesce(F.regexp_replace(text, r"""[”’）》」』"')\s]+$""", "").rlike("[。！？!?…吧呢吗啊呀嘛哦喔耶咯啦嘞]$"), F.lit(False))


def strip_narration(text: Column) -> Column:
    """Without bracketed stage directions of up to 40 characters."""
    return F.trim(F.regexp_replace(text, r"[（(\[【][^）)\]】]{0,40}[）)\]】]", ""))


def truncate_reply(text: Column, limit: int) -> Column:
    """Cut at the last terminator within ``limit`` characters (not the very first), else hard with an ellipsis; empty becomes an ellipsis."""
    window = F.substring(text, 1, limit)
    whole = F.regexp_extract(window, f"(?s)^.+[{TERMINATORS}]", 0)
    cut = F.when(whole != "", whole).otherwise(F.concat(F.rtrim(window), F.lit("……")))
    return F.when(F.trim(text) == "", "……").when(F.char_length(text) > limit, cut).otherwise(text)


def breaks_character(text: Column, phrases: list[str]) -> Column:
    """The first of ``phrases`` that the text holds, whatever the case."""
    out = F.lit(None).cast("string")
    for p in reversed(phrases):
        out = F.when(F.lower(text).contains(p.lower()), p).otherwise(out)
    return out


def nearest_style(style: Column, available: list[str]) -> Column:
    """The style itself, else the last of its _ parts that is available, else neutral or the first."""
    have = F.array(*[F.lit(a) for a in available])
    part = F.get(F.filter(F.reverse(F.split(style, "_")), lambda p: F.array_contains(have, p)), F.lit(0))
    return F.when(F.array_contains(have, style), style).otherwise(F.coalesce(part, F.lit("neutral" if "neutral" in available else min(available))))


def parse_plan(raw: Column, default_style: str) -> Column:
    """struct(text, emotion, source) of a model's reply: the outermost JSON object with a text, code fences and unknown keys dropped, else the plain text."""
    bare = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"```[a-zA-Z]*", ""))
    got = F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), "text string, emotion string")
    ok = F.coalesce(F.trim(got["text"]) != "", F.lit(False))
    return F.when(ok, F.struct(got["text"].alias("text"), F.coalesce(got["emotion"], F.lit(default_style)).alias("emotion"), F.lit("parsed").alias("source"))).otherwise(
        F.struct(F.coalesce(F.nullif(bare, F.lit("")), F.lit("……")).alias("text"), F.lit(default_style).alias("emotion"), F.lit("fallback").alias("source"))
    )


def first_match(text: Column, table: list[tuple[str, str]], default: str) -> Column:
    """The value beside the first needle that the text holds."""
    out = F.lit(default)
    for needle, value in reversed(table):
        out = F.when(F.lower(text).contains(needle.lower()), value).otherwise(out)
    return out


def log_lines(text: Column) -> Column:
    """Lines of a log without ANSI codes; carriage returns end lines too, empty lines go."""
    return F.filter(F.split(F.regexp_replace(text, "\u001b\\[[0-9;]*[A-Za-z]", ""), r"[\r\n]+"), lambda x: F.trim(x) != "")


def losses(line: Column, most: int = 3) -> Column:
    """The first ``most`` loss values of a log line."""
    return F.transform(F.slice(F.regexp_extract_all(line, F.lit(r"(?:total_loss\w*|loss_gen\w*|loss_mel\w*)[=:]\s*([0-9.]+(?:e[+-]?\d+)?)"), 1), 1, most), lambda x: x.cast("double"))


def digest_mod(key: Column, n: Column) -> Column:
    """The whole SHA-256 of ``key`` as an integer, modulo ``n``, by folding its hex digits."""
    return F.aggregate(F.split(F.sha2(key, 256), ""), F.lit(0).cast("long"), lambda a, d: F.when(d == "", a).otherwise(F.pmod(a * 16 + F.conv(F.when(d == "", "0").otherwise(d), 16, 10).cast("long"), n)))


def duration_label(seconds: Column) -> Column:
    """0 秒, 42 秒, 3.5 分钟, 42 分钟, 1.2 小时; nothing or less than nothing is 0 秒."""
    tenths = lambda x: F.format_string("%.1f", F.round(x, 1))
    minutes = seconds / 60
    return (
        F.when(seconds.isNull() | (seconds <= 0), "0 秒").when(seconds < 60, F.concat(F.floor(seconds + 0.5), F.lit(" 秒")))
        .when(minutes < 10, F.concat(tenths(minutes), F.lit(" 分钟"))).when(minutes < 60, F.concat(F.round(minutes).cast("int"), F.lit(" 分钟")))
        .otherwise(F.concat(tenths(minutes / 60), F.lit(" 小时")))
    )


def bytes_label(size: Column) -> Column:
    """900 B, 12 KB, 3.4 MB, 1.25 GB."""
    at = lambda power, digits: F.format_string(f"%.{digits}f", size / float(1024**power))
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, F.concat(at(1, 0), F.lit(" KB")))
        .when(size < 1024**3, F.concat(at(2, 1), F.lit(" MB"))).otherwise(F.concat(at(3, 2), F.lit(" GB")))
    )


def elapsed_label(start: Column, end: Column) -> Column:
    """3 分 20 秒, 20 秒, or a dash without a start; never below 0."""
    s = F.greatest(F.lit(0), F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6)).cast("long")
    said = F.when(s >= 60, F.concat(F.floor(s / 60), F.lit(" 分 "), s % 60, F.lit(" 秒"))).otherwise(F.concat(s, F.lit(" 秒")))
    return F.when(start.isNull(), "—").otherwise(said)


def words(text: Column) -> Column:
    """The words of ``text``: runs of letters and digits of ASCII, in order."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), 1)
