"""Request columns: unsupported controls, engine payloads, gates, clamps, progress and statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.operators.curation import tags

#: Spoken names of speaking rates and volumes.
RATE_WORDS = {"very_slow": "语速很慢", "slow": "语速慢", "slightly_slow": "语速略慢", "normal": "语速正常", "slightly_fast": "语速略快", "fast": "语速快", "very_fast": "语速很快"}

VOLUME_WORDS = {"whisper": "用气声轻声说", "soft": "音量轻柔", "normal": "音量正常", "loud": "音量偏大", "shout": "大声喊"}


def unsupported(instruct: Column, vector: Column, factor: Column, can_instruct: Column, can_vector: Column, can_factor: Column) -> Column:
    """The controls that are set but that an engine doesn't support."""
    return tags(((F.coalesce(instruct, F.lit("")) != "") & ~can_instruct, "instruct"), (vector.isNotNull() & ~can_vector, "emotion_vector"), (factor.isNotNull() & ~can_factor, "duration_factor"))


def label(name: Column, engine: Column, mode: Column) -> Column:
    """The display name, or engine:mode where it is null or empty."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat_ws(":", engine, mode))


def staged_progress(low: Column, high: Column, done: Column) -> Column:
    return low + (high - low) * F.coalesce(done, F.lit(0.0))


def duration_payload(speed: Column, intensity: Column, vector: Column, alpha: float) -> Column:
    """JSON for an engine that takes an inverse speed clamped to 0.5 to 2, and an emotion vector unless it is empty."""
    factor = F.round(F.least(F.lit(2.0), F.greatest(F.lit(0.5), 1 / F.greatest(F.lit(0.5), speed))), 4)
    some = F.when(F.exists(vector, lambda x: x != 0), vector)
    return F.to_json(F.struct(factor.alias("duration_factor"), (alpha * F.greatest(F.lit(0.2), intensity)).alias("emo_alpha"), some.alias("emo_vector")))


def instruction(emotion: Column, intensity: Column, rate: Column, volume: Column) -> Column:
    """A short performance instruction in Chinese; normal volume is left out."""
    degree = F.when(intensity < 0.35, "略带").when(intensity > 0.7, "明显").otherwise("")
    words, volumes = (F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) for t in (RATE_WORDS, VOLUME_WORDS))
    return F.concat_ws("，", F.concat(degree, F.replace(emotion, F.lit("_"), F.lit(" ")), F.lit("的语气")), F.try_element_at(words, rate), F.when(volume != "normal", F.try_element_at(volumes, volume)))


def tokens_per_second(tokens: Column, nanoseconds: Column) -> Column:
    return F.round(F.try_divide(tokens, F.nullif(nanoseconds, F.lit(0)) / 1e9), 1)


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    """An override within its bounds, the default where there is none."""
    return F.when(value.isNull(), F.lit(default)).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def payload_problem(body: Column) -> Column:
    """The first reason for which a JSON request is refused, or null."""
    v = F.try_parse_json(body)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    rate = F.try_variant_get(v, "$.sample_rate", "long")
    absent = lambda path: F.coalesce(kind(path) == "VOID", F.lit(True))
    return (
        F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "not an object")
        .when(~F.coalesce((kind("$.call") == "STRING") & (F.try_variant_get(v, "$.call", "string") != ""), F.lit(False)), "call")
        .when(~absent("$.kwargs") & ~F.coalesce(kind("$.kwargs").startswith("OBJECT"), F.lit(False)), "kwargs")
        .when(~absent("$.seed") & ~F.coalesce(kind("$.seed") == "BIGINT", F.lit(False)), "seed")
        .when(~absent("$.sample_rate") & ~F.coalesce((kind("$.sample_rate") == "BIGINT") & rate.between(8000, 48000), F.lit(False)), "sample_rate")
    )


def run_id(prefix: str, at: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyyMMdd-HHmmss"))
