"""Array numerics over sample columns (array<double>), in built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENCE = -120.0


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def rms(x: Column) -> Column:
    """Root mean square; 0 for no samples."""
    return F.when(F.size(x) > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))).otherwise(0.0)


def dbfs(v: Column) -> Column:
    """Decibels of full scale, not below -120."""
    return F.when(v <= 1e-10, F.lit(SILENCE)).otherwise(F.greatest(F.lit(SILENCE), 20 * F.log10(v)))


def peak_dbfs(x: Column) -> Column:
    return F.when(F.size(x) > 0, dbfs(F.array_max(F.transform(x, F.abs)))).otherwise(SILENCE)


def clipping_ratio(x: Column, level: float = 0.997) -> Column:
    return F.when(F.size(x) > 0, F.size(F.filter(x, lambda v: F.abs(v) >= level)) / F.size(x)).otherwise(0.0)


def loudness(x: Column) -> Column:
    """The RMS stand-in for integrated loudness, to three digits."""
    return F.round(dbfs(rms(x)) - 3, 3)


def loudness_gain(x: Column, target: float, ceiling: float = -1.0, most: float = 18.0) -> Column:
    """The gain towards ``target`` that respects its own limit and the peak ceiling; below 0.05 dB none."""
    gain = F.least(F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(target) - loudness(x))), ceiling - peak_dbfs(x))
    return F.when(F.abs(gain) < 0.05, F.lit(0.0)).otherwise(F.round(gain, 3))


def with_gain(x: Column, gain_db: Column) -> Column:
    return F.transform(x, lambda v: v * F.pow(F.lit(10.0), gain_db / 20))


def frame_levels(x: Column, frame: int, hop: int) -> Column:
    """dBFS of each whole frame; one shorter frame where there are too few samples, none for no samples."""
    n = F.greatest(F.lit(1), 1 + F.floor((F.size(x) - frame) / hop)).cast("int")
    levels = F.transform(F.sequence(F.lit(0), n - 1), lambda i: dbfs(rms(F.slice(x, i * hop + 1, F.lit(frame)))))
    return F.when(F.size(x) > 0, levels).otherwise(F.array().cast("array<double>"))


def percentile_floor(values: Column, fraction: float) -> Column:
    """The entry at floor(fraction * (n - 1)) of the sorted array, without interpolation; -120 for none."""
    return F.when(F.size(values) > 0, F.get(F.sort_array(values), F.floor(F.lit(fraction) * (F.size(values) - 1)).cast("int"))).otherwise(SILENCE)


def speech_threshold(levels: Column, margin: float = 12.0, below_peak: float = 38.0) -> Column:
    return F.greatest(percentile_floor(levels, 0.1) + margin, F.array_max(levels) - below_peak)


def snr(levels: Column) -> Column:
    """Mean level of speech frames less that of the rest; null below six frames or without either kind."""
    t = speech_threshold(levels)
    mean = lambda a: total(a) / F.size(a)
    loud, quiet = F.filter(levels, lambda v: v >= t), F.filter(levels, lambda v: v < t)
    return F.when((F.size(levels) >= 6) & (F.size(loud) > 0) & (F.size(quiet) > 0), F.round(mean(loud) - mean(quiet), 2))


def trimmed_stats(track: Column, low: float = 60.0, high: float = 500.0) -> Column:
    """struct(mean, dev) of the values in range without the outer tenths (one at least each side); null below three values."""
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731 - evaluates ``value`` once

    def stats(inner: Column, mean: Column) -> Column:
        dev = F.sqrt(F.aggregate(inner, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(inner))
        return F.struct(F.round(mean, 2).alias("mean"), F.round(dev, 2).alias("dev"))

    def middle(v: Column) -> Column:
        cut = F.greatest(F.lit(1), F.floor(F.size(v) / 10).cast("int"))
        return F.when(F.size(v) > 2 * cut, F.slice(v, cut + 1, F.greatest(F.size(v) - 2 * cut, F.lit(0)))).otherwise(v)

    whole = F.sort_array(F.filter(track, lambda x: x.between(low, high)))
    return let(whole, lambda v: F.when(F.size(v) >= 3, let(middle(v), lambda inner: let(total(inner) / F.size(inner), lambda mean: stats(inner, mean)))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for missing, unequal or zero vectors."""
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(0.0)


def cut(x: Column, rate: Column, offset_s: Column, duration_s: Column) -> Column:
    """The samples of [offset, offset + duration)."""
    first, last = F.floor(offset_s * rate), F.floor((offset_s + duration_s) * rate)
    return F.slice(x, (first + 1).cast("int"), F.greatest(F.lit(0), (last - first)).cast("int"))


def resample(x: Column, n: Column) -> Column:
    """Linear interpolation to ``n`` samples."""
    step = F.when(n > 1, (F.size(x) - 1) / (n - 1)).otherwise(0.0)

    def at(i: Column) -> Column:
        p = i * step
        j = F.least(F.floor(p), F.size(x) - 1).cast("int")
        return F.get(x, j) + (p - j) * (F.get(x, F.least(j + 1, F.size(x) - 1)) - F.get(x, j))

    return F.when((F.size(x) > 0) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def block_mean(x: Column, factor: int) -> Column:
    """Means of whole blocks of ``factor`` samples; unchanged below 2."""
    if factor < 2:
        return x
    blocks = F.floor(F.size(x) / factor).cast("int")
    return F.when(blocks > 0, F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: total(F.slice(x, i * factor + 1, F.lit(factor))) / factor)).otherwise(F.array().cast("array<double>"))


def pcm_to_float(raw: Column, divisor: float) -> Column:
    """16-bit little-endian samples as floats; an odd last byte is ignored. Files divide by 32767, the wire by 32768."""
    n = F.floor(F.octet_length(raw) / 2).cast("int")
    hexed = F.hex(raw)

    def one(i: Column) -> Column:
        v = F.conv(F.concat(F.substr(hexed, i * 4 + 3, F.lit(2)), F.substr(hexed, i * 4 + 1, F.lit(2))), 16, 10).cast("int")
        return F.when(v >= 32768, v - 65536).otherwise(v) / F.lit(divisor)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))


def float_to_pcm(x: Column) -> Column:
    """Samples clamped to [-1, 1] as 16-bit little-endian bytes, full scale 32767."""

    def one(v: Column) -> Column:
        n = F.rint(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)) * 32767).cast("int")
        hexed = F.lpad(F.hex(F.pmod(n, F.lit(65536))), 4, "0")
        return F.concat(F.substring(hexed, 3, 2), F.substring(hexed, 1, 2))

    return F.unhex(F.array_join(F.transform(x, one), ""))


def blocks(x: Column, size: int) -> Column:
    """Whole blocks of ``size`` samples, in order; what is left of the last one isn't in them."""
    n = F.floor(F.size(x) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<double>>"))
