"""Curation columns and merges: rejection, status, tags, quality, review patches, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Factors of the speaking-rate buckets, emotion weights of core styles, and their dimension order.
RATE = {"very_slow": 0.75, "slow": 0.85, "slightly_slow": 0.93, "normal": 1.0, "slightly_fast": 1.07, "fast": 1.15, "very_fast": 1.3}
DIMS = ("happy", "angry", "sad", "afraid", "disgusted", "melancholic", "surprised", "calm")
EMOTION = {
    "neutral": {"calm": 0.5}, "soft": {"calm": 0.7}, "happy": {"happy": 1.0}, "sad": {"sad": 1.0}, "angry": {"angry": 1.0},
    "teasing": {"happy": 0.6, "calm": 0.3}, "serious": {"calm": 0.8}, "surprised": {"surprised": 1.0}, "whisper": {"calm": 0.6}, "excited": {"happy": 0.8, "surprised": 0.4},
}

#: Emotion labels of a recogniser, in two languages, and the core style of each; an empty one is unknown.
LABELS = {
    "angry": "angry", "生气": "angry", "disgusted": "angry", "厌恶": "angry", "fearful": "surprised", "恐惧": "surprised", "happy": "happy", "开心": "happy", "neutral": "neutral", "中立": "neutral",
    "sad": "sad", "难过": "sad", "surprised": "surprised", "吃惊": "surprised", "other": "", "其他": "", "unknown": "", "未知": "",
}


def tags(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def first_reason(*pairs: tuple[Column, str]) -> Column:
    """The first name whose condition holds, else null."""
    out = F.when(pairs[0][0], pairs[0][1])
    for c, n in pairs[1:]:
        out = out.when(c, n)
    return out


def blank(text: Column) -> Column:
    """Not null, and nothing but white space."""
    return F.trim(F.regexp_replace(text, r"\s+", " ")) == ""


def auto_rejection(duration: Column, clipping: Column, text: Column, similarity: Column, real_speaker_model: bool = True, low: float = 0.8, high: float = 15.0, clip: float = 0.01, speaker: float = 0.5) -> Column:
    """too_short, too_long, clipped_audio, non_speech, other_speaker: the first that applies; the last only with a real speaker model."""
    return first_reason((duration < low, "too_short"), (duration > high, "too_long"), (clipping > clip, "clipped_audio"), (blank(text), "non_speech"), (F.lit(real_speaker_model) & (similarity < speaker), "other_speaker"))


def review_status(reason: Column, human_edited: Column, old: Column, auto_approve: bool) -> Column:
    """Human edits stay; else rejected, or approved or pending."""
    return F.when(F.coalesce(human_edited, F.lit(False)), old).when(reason.isNotNull(), "rejected").otherwise("approved" if auto_approve else "pending")


def issues(lufs: Column, clipping: Column, snr: Column, duration: Column, text: Column, similarity: Column) -> Column:
    """Names of measured issues; a null measurement names none, a null or blank text does."""
    return tags((lufs < -38, "quiet"), (clipping > 0.001, "clipping"), (snr < 15, "noise"), (duration < 1, "short"), (duration > 15, "long"), (F.coalesce(blank(text), F.lit(True)), "no_text"), (similarity < 0.5, "other_speaker"))


def text_tags(text: Column) -> Column:
    """question, exclamation, ellipsis, and short (6 or less) or long (25 or more)."""
    return tags((text.rlike("[？?]$"), "question"), (text.rlike("[！!]$"), "exclamation"), (text.contains("…"), "ellipsis"), (F.char_length(text) <= 6, "short"), (F.char_length(text) >= 25, "long"))


def guess_style(text: Column) -> Column:
    """excited at a closing exclamation mark, soft with an ellipsis, else neutral."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t.rlike("[！!]$"), "excited").when(t.contains("……") | t.contains("..."), "soft").otherwise("neutral")


def map_label(label: Column, mapping: dict[str, str] = LABELS) -> Column:
    """The first part (split at / and |) that ``mapping`` has; unknown else."""
    known = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    parts = F.transform(F.split(F.lower(F.trim(label)), r"[/|]"), F.trim)
    return F.coalesce(F.nullif(F.get(F.filter(F.transform(parts, lambda p: F.try_element_at(known, p)), lambda x: x.isNotNull()), F.lit(0)), F.lit("")), F.lit("unknown"))


def confidence(v: Column) -> Column:
    """Log-likelihoods below 0 become 1 + v / 5; all are clamped to 0..1."""
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v < 0, 1 + v / 5).otherwise(v))))


def speed(factor: Column, rate: Column) -> Column:
    """An explicit factor, else that of the rate bucket."""
    return F.coalesce(factor, F.try_element_at(F.create_map(*[F.lit(x) for kv in RATE.items() for x in kv]), rate))


def emotion_vector(style: Column, intensity: Column) -> Column:
    """The weights of a core style (neutral's for others) times the clamped intensity, as an array in DIMS order."""
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), intensity))
    out = None
    for name, w in EMOTION.items():
        row = F.array(*[F.lit(float(w.get(d, 0.0))) for d in DIMS])
        out = F.when(style == name, row) if out is None else out.when(style == name, row)
    return F.transform(out.otherwise(F.array(*[F.lit(float(EMOTION["neutral"].get(d, 0.0))) for d in DIMS])), lambda x: F.round(x * level, 4))


def quality_score(clipping: Column, snr: Column, peak: Column, text: Column, duration: Column, min_snr: float = 8.0, shortest: float = 0.8) -> Column:
    """1 less penalties for clipping, noise, quiet peaks, blank text and short clips; null measurements cost nothing."""
    zero = F.lit(0.0)
    out = F.lit(1.0) - F.when(clipping.isNotNull(), F.least(F.lit(0.5), clipping * 50)).otherwise(zero)
    out = out - F.coalesce(F.when(snr < min_snr, F.least(F.lit(0.35), (min_snr - snr) / 30)), zero)
    out = out - F.when(peak < -35, 0.15).otherwise(zero) - F.when(blank(text), 0.3).otherwise(zero) - F.when(duration < shortest, 0.2).otherwise(zero)
    return F.round(F.greatest(zero, F.least(F.lit(1.0), out)), 4)


def review_queue(rows: DataFrame, quality: str, pos: str, status: Column | None = None, limit: int | None = None) -> DataFrame:
    """Worst first; missing quality counts as 1, ties keep their order."""
    rows = rows if status is None else rows.filter(status)
    ordered = rows.orderBy(F.coalesce(F.col(quality), F.lit(1.0)), pos)
    return ordered.limit(limit) if limit else ordered


def apply_patch(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """``rows`` (transcript, style, status, reason, human_edited) with a reviewer's ``patch`` (p_transcript, p_style, p_status, p_reason, p_anchor);
    unknown keys are ignored.

    Only differing fields touch a row. Approving along with a transcript means corrected; rejecting without a reason means other; any other status
    clears the reason.
    """
    x = rows.join(patch, key, "left")
    text = F.coalesce(F.col("p_transcript") != F.col("transcript"), F.col("p_transcript").isNotNull())
    style = F.coalesce(F.col("p_style") != F.col("style"), F.col("p_style").isNotNull())
    status = F.when((F.col("p_status") == "approved") & F.col("p_transcript").isNotNull(), "corrected").otherwise(F.col("p_status"))
    moved = F.coalesce(status != F.col("status"), status.isNotNull())
    touched = text | style | moved | F.col("p_anchor").isNotNull()
    return x.select(
        key, F.when(text, F.col("p_transcript")).otherwise(F.col("transcript")).alias("transcript"), F.coalesce("p_style", "style").alias("style"), F.coalesce(status, "status").alias("status"),
        F.when(status == "rejected", F.coalesce("p_reason", F.lit("other"))).when(status.isNull(), F.col("reason")).alias("reason"), (F.coalesce("human_edited", F.lit(False)) | touched).alias("human_edited"), touched.alias("touched"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Samples after a sync: rows of ``new`` (text, duration), keeping the text, style and approval of human-edited ``old`` ones; old rows that
    ``new`` lacks go.
    """
    o = old.select(key, F.col("text").alias("o_text"), F.col("style").alias("o_style"), F.col("approved").alias("o_approved"), F.col("human_edited").alias("o_edited"), F.lit(True).alias("had"))
    x = new.join(o, key, "left").withColumn("keep", F.coalesce("o_edited", F.lit(False))).withColumn("t", F.trim(F.coalesce("text", F.lit(""))))
    return x.select(
        key, "duration", F.when(F.col("keep"), F.col("o_text")).otherwise(F.col("t")).alias("text"), F.when(F.col("keep"), F.col("o_style")).otherwise(guess_style(F.col("t"))).alias("style"),
        F.when(F.col("keep"), F.col("o_approved")).otherwise(F.col("t") != "").alias("approved"), F.coalesce("had", F.lit(False)).alias("existed"),
    )


def pack_summary(samples: DataFrame, by: str, duration: str, approved: Column, min_clips: int = 20, min_seconds: float = 60.0) -> DataFrame:
    """Per pack: clips, approved ones, usable and rejected seconds, readiness."""
    d = F.col(duration)
    usable = F.coalesce(F.sum(F.when(approved, d)), F.lit(0.0))
    return samples.groupBy(by).agg(
        F.count(F.lit(1)).alias("clips"), F.count_if(approved).alias("approved_clips"), F.round(usable, 1).alias("usable_s"), F.round(F.coalesce(F.sum(F.when(~approved, d)), F.lit(0.0)), 1).alias("rejected_s"),
        ((F.count_if(approved) >= min_clips) & (usable >= min_seconds)).alias("ready"),
    )


def segment_spans(rows: DataFrame, start: str, end: str, limit: float, least: float = 0.05) -> DataFrame:
    """Spans longer than ``limit`` cut into max(2, d // limit + 1) equal pieces; pieces of ``least`` or less go."""
    d = F.col(end) - F.col(start)
    n = F.when(d > limit, F.greatest(F.lit(2), F.floor(d / limit) + 1)).otherwise(F.lit(1)).cast("int")
    cut = rows.withColumns({"_n": n, "_d": d}).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    size = F.col("_d") / F.col("_n")
    return cut.withColumns({"piece_start": F.col(start) + size * F.col("piece"), "piece_length": size}).filter(F.col("piece_length") > least).drop("_n", "_d")


def readiness(characters: DataFrame, connections: DataFrame, voices: DataFrame, default_connection: int) -> DataFrame:
    """Characters (id, connection_id, voice_id) with their problems; the default connection serves those without their own."""
    c = connections.select(F.col("id").alias("_c"), F.col("status").alias("_cs"))
    v = voices.select(F.col("id").alias("_v"), F.col("status").alias("_vs"))
    x = characters.join(c, F.coalesce("connection_id", F.lit(default_connection)) == F.col("_c"), "left").join(v, F.col("voice_id") == F.col("_v"), "left")
    p = tags((F.col("_c").isNull(), "no_connection"), (F.col("_cs") == "disabled", "connection_disabled"), (F.col("_v").isNull(), "no_voice"), (F.col("_vs") != "ready", "voice_not_ready"))
    return x.select("id", F.array_join(p, ",").alias("problems"), (F.size(p) == 0).alias("ready"))


def conflicts(jobs: DataFrame, pack: str, active: Column) -> DataFrame:
    """Packs with more than one active job."""
    return jobs.filter(active).groupBy(pack).agg(F.count(F.lit(1)).alias("n_active")).filter("n_active > 1")


def default_style(label: Column, declared: Column, core_declared: Column) -> Column:
    """The label where it is a declared style, or a core style that is declared; null for none and unknown."""
    return F.when((label == "") | (label == "unknown"), F.lit(None)).when(declared | core_declared, label)


def running_new_max(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value exceeds all before them."""
    before = F.max(value).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col(value) > F.col("_b"))).drop("_b")
