"""Voice activity: spans of loud frames per clip as gaps and islands, and pitch tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import signal as S
from sparkloom.functions import text as T


def spans(frames: DataFrame, clip: str, index: str, level: str, hop_s: float, duration: Column, min_speech_s: float = 0.2, min_silence_s: float = 0.3, pad_s: float = 0.18, margin: float = 12.0, below_peak: float = 38.0, least_range: float = 15.0, floor_dbfs: float = -50.0) -> DataFrame:
    """(clip, span, start_s, end_s) of ``frames`` (one row a frame, with its level in dBFS; ``duration`` is a column of theirs).

    The threshold lies ``margin`` above the tenth percentile (by floor index) and no more than ``below_peak`` below the peak. A clip without dynamic range is
    speech as a whole, or none when its peak is at ``floor_dbfs`` or below. Gaps up to ``min_silence_s`` are closed before padding, so padded spans may
    overlap; spans shorter than ``min_speech_s`` go. One window by clip; a clip's frames are bounded by its length.
    """
    w = W.partitionBy(clip)
    rank = F.row_number().over(w.orderBy(level, index)) - 1
    ranked = frames.withColumns({"_r": rank, "_n": F.count(F.lit(1)).over(w), "_d": duration, "_peak": F.max(level).over(w)})
    floor_ = F.max(F.when(F.col("_r") == F.floor(0.1 * (F.col("_n") - 1)), F.col(level))).over(w)
    x = ranked.withColumn("_floor", floor_)
    flat = F.col("_peak") - F.col("_floor") < least_range
    whole = x.filter(flat & (F.col("_peak") > floor_dbfs)).groupBy(clip).agg(F.lit(0.0).alias("start_s"), F.round(F.max("_d"), 4).alias("end_s"))
    loud = x.filter(~flat & (F.col(level) >= F.greatest(F.col("_floor") + margin, F.col("_peak") - below_peak)))
    gap = max(1, int(min_silence_s / hop_s))
    previous = F.lag(index).over(w.orderBy(index))
    island = F.sum(F.when(previous.isNull() | (F.col(index) - previous - 1 > gap), 1).otherwise(0)).over(w.orderBy(index))
    merged = loud.withColumn("_i", island).groupBy(clip, "_i").agg(F.min(index).alias("_a"), (F.max(index) + 1).alias("_b"), F.max("_d").alias("_d"))
    padded = merged.select(clip, F.greatest(F.lit(0.0), F.col("_a") * hop_s - pad_s).alias("_s"), F.least(F.col("_d"), F.col("_b") * hop_s + pad_s).alias("_e")).filter(F.col("_e") - F.col("_s") >= min_speech_s)
    out = padded.select(clip, F.round("_s", 4).alias("start_s"), F.round("_e", 4).alias("end_s")).unionByName(whole)
    return out.withColumn("span", F.row_number().over(w.orderBy("start_s", "end_s")))


def pauses(found: DataFrame, clip: str) -> DataFrame:
    """Silences inside each clip: its spans less one."""
    return found.groupBy(clip).agg((F.count(F.lit(1)) - 1).alias("pauses"))


def trimmed(clips: DataFrame, found: DataFrame, clip: str, samples: str, rate: str) -> DataFrame:
    """``clips`` with ``samples`` cut to what lies between the start of the first and the end of the last of their ``found`` spans, and start_s and
    end_s; a clip without spans stays whole.
    """
    edges = found.groupBy(clip).agg(F.min("start_s").alias("_s"), F.max("end_s").alias("_e"))
    x, n = F.col(samples), F.size(samples)
    first, last = F.floor(F.col("_s") * F.col(rate)).cast("int"), F.least(n, F.floor(F.col("_e") * F.col(rate)).cast("int"))
    part = F.when(F.col("_s").isNull(), x).otherwise(F.slice(x, first + 1, F.greatest(F.lit(0), last - first)))
    whole = clips.join(edges, clip, "left").withColumns({samples: part, "start_s": F.coalesce("_s", F.lit(0.0)), "end_s": F.coalesce("_e", n / F.col(rate))})
    return whole.drop("_s", "_e")


def level_frames(clips: DataFrame, clip: str, samples: str, rate: int, frame_ms: float = 25.0, hop_ms: float = 10.0) -> DataFrame:
    """(clip, i, level, duration_s): a row for each frame of clips of one sample ``rate``."""
    levels = S.frame_levels(F.col(samples), max(1, int(rate * frame_ms / 1000)), max(1, int(rate * hop_ms / 1000)))
    return clips.select(clip, (F.size(samples) / F.lit(rate)).alias("duration_s"), F.posexplode(levels).alias("i", "level"))


def measured(clips: DataFrame, clip: str, samples: str, rate: int, text: str, hop_ms: float = 10.0) -> DataFrame:
    """One row a clip: duration_s, f0_mean_hz, f0_std_hz, chars_per_second, pause_count, pauses_per_second, seconds_per_char, peak_dbfs,
    clipping_ratio, snr_db, silence_ratio.

    All clips have the same sample ``rate``. Pauses are the gaps of 180 ms and more between spans of 80 ms and more; silence is what the unpadded
    spans leave. Clips without samples have no row.
    """
    some = clips.filter(F.size(samples) > 0)
    x, hop_s = F.col(samples), max(1, int(rate * hop_ms / 1000)) / rate
    frames = level_frames(some, clip, samples, rate, hop_ms=hop_ms)
    gaps = pauses(spans(frames, clip, "i", "level", hop_s, F.col("duration_s"), min_speech_s=0.08, min_silence_s=0.18, pad_s=0.0), clip)
    loud = spans(frames, clip, "i", "level", hop_s, F.col("duration_s"), pad_s=0.0).groupBy(clip).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("_speech"))
    pitch = pitch_tracks(some.withColumn("_rate", F.lit(rate)), clip, samples, "_rate").select(clip, S.trimmed_stats(F.col("track")).alias("_f0"))
    seconds = F.size(samples) / F.lit(rate)
    han = F.nullif(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([\u4e00-\u9fff])"))), F.lit(0))
    levels = S.frame_levels(x, max(1, int(rate * 0.025)), max(1, int(rate * hop_ms / 1000)))
    base = some.select(
        clip, seconds.alias("_d"), han.alias("_han"), T.chars_per_second(F.col(text), seconds).alias("chars_per_second"), F.round(S.peak_dbfs(x), 2).alias("peak_dbfs"),
        F.round(S.clipping_ratio(x), 6).alias("clipping_ratio"), S.snr(levels).alias("snr_db"),
    )
    met = base.join(pitch, clip, "left").join(gaps, clip, "left").join(loud, clip, "left").withColumn("pause_count", F.coalesce("pauses", F.lit(0)))
    return met.select(
        clip, F.round("_d", 4).alias("duration_s"), F.col("_f0.mean").alias("f0_mean_hz"), F.col("_f0.dev").alias("f0_std_hz"), "chars_per_second", "pause_count",
        F.round(F.col("pause_count") / F.col("_d"), 4).alias("pauses_per_second"), F.round(F.col("_d") / F.col("_han"), 4).alias("seconds_per_char"), "peak_dbfs", "clipping_ratio", "snr_db",
        F.round(F.greatest(F.lit(0.0), 1 - F.coalesce("_speech", F.lit(0.0)) / F.col("_d")), 4).alias("silence_ratio"),
    )


def pitch_tracks(clips: DataFrame, clip: str, samples: str, rate: str, least: float = 0.35) -> DataFrame:
    """(clip, track array<double>): autocorrelation pitch (by the power spectrum of all frames at once) of 40 ms frames every 20 ms at about 8 kHz, 60
    to 500 Hz; unvoiced frames are left out, clips below 50 ms have none.
    """

    def track(x: np.ndarray, sr: int) -> list[float]:
        factor = max(1, sr // 8000)
        if factor > 1:
            x = x[: len(x) // factor * factor].reshape(-1, factor).mean(axis=1)
        sr //= factor
        frame, hop = int(sr * 0.04), max(1, int(sr * 0.02))
        lags = np.arange(max(2, int(sr / 500)), min(frame - 1, int(sr / 60)) + 1)
        if len(x) < int(0.05 * sr) or len(lags) < 2:
            return []
        begins = np.arange(0, max(1, len(x) - frame), hop)  # a frame that ends with the clip isn't one of them
        frames = x[begins[:, None] + np.arange(frame)] if len(x) >= frame else np.zeros((0, frame))
        frames = frames - frames.mean(axis=1, keepdims=True)
        energy = (frames * frames).sum(axis=1)
        frames, energy = frames[energy > 1e-8], energy[energy > 1e-8]
        if not len(frames):
            return []
        size = 1 << (2 * frame - 1).bit_length()  # so that no lag wraps around
        power = np.abs(np.fft.rfft(frames, size)) ** 2
        score = np.round(np.fft.irfft(power, size)[:, lags] / energy[:, None], 9)
        best = score.argmax(axis=1)
        voiced = score[np.arange(len(best)), best] >= least
        return (sr / lags[best[voiced]]).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({clip: b[clip], "track": [track(np.asarray(x, float), int(r)) for x, r in zip(b[samples], b[rate], strict=True)]})

    kind = dict(clips.dtypes)[clip]
    return clips.select(clip, samples, rate).mapInPandas(run, f"{clip} {kind}, track array<double>")


def centroid(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, centroid): the element-wise mean, L2-normalised. Sums are partial per task and position."""
    parts = vectors.select(by, F.posexplode(vector).alias("_i", "_v")).groupBy(by, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    mean = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_c"))
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, v: a + v * v))
    return mean.withColumn("_n", norm).select(by, F.when(F.col("_n") > 0, F.transform("_c", lambda v: v / F.col("_n"))).otherwise(F.col("_c")).alias("centroid"))
