"""Speaker scoring against a centroid, a spectral embedding for want of a model, and simulated ratings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.signal import cosine
from sparkloom.operators.vad import centroid

#: Band edges in Hz.
BANDS = (80, 160, 260, 400, 600, 900, 1400, 2200, 3400, 5200, 8000)


def similarity(segments: DataFrame, pack: str, key: str, vector: str, anchor: str) -> DataFrame:
    """(key, similarity, n_anchors): cosine with the centroid of the pack's anchors, or of all its vectors where it has none; rows without a vector
    are left out.
    """
    have = segments.filter(F.col(vector).isNotNull())
    n = have.groupBy(pack).agg(F.count_if(F.coalesce(F.col(anchor), F.lit(False))).alias("n_anchors"))
    x = have.join(n, pack)
    middle = centroid(x.filter((F.col("n_anchors") == 0) | F.col(anchor)), pack, vector)
    return x.join(middle, pack).select(key, F.round(cosine(F.col(vector).cast("array<double>"), F.col("centroid")), 4).alias("similarity"), "n_anchors")


def band_embedding(clips: DataFrame, key: str, samples: str, rate: str, pitch_mean: str, pitch_dev: str) -> DataFrame:
    """(key, vector): levels of one frequency in each band over the first three seconds, relative to the loudest, with pitch statistics, L2-normalised."""

    def embed(x: np.ndarray, sr: int, mean: float, dev: float) -> list[float]:
        x = x[: sr * 3]
        out = []
        for low, high in zip(BANDS, (*BANDS[1:], sr // 2), strict=True):
            f = float(np.sqrt(max(1.0, low) * max(low + 1.0, high)))
            if not len(x) or f >= sr / 2:
                out.append(0.0)
                continue
            level = abs(np.exp(-2j * np.pi * f / sr * np.arange(len(x))) @ x) / len(x)
            out.append(max(-120.0, 20 * float(np.log10(level))) if level > 1e-10 else -120.0)
        v = np.array([e - max(out) for e in out] + [float(np.log1p(z or 0.0)) / 7 for z in (mean, dev)])
        norm = float(np.linalg.norm(v))
        return (v / norm if norm else v).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b[samples], b[rate], b[pitch_mean].fillna(0.0), b[pitch_dev].fillna(0.0), strict=True)
            yield pd.DataFrame({key: b[key], "vector": [embed(np.asarray(x, float), int(r), m, d) for x, r, m, d in rows]})

    return clips.select(key, samples, rate, pitch_mean, pitch_dev).mapInPandas(run, f"{key} {dict(clips.dtypes)[key]}, vector array<double>")


def simulated_ratings(key: DataFrame, raters: int, seed: int = 7, bonus: float = 1.2, noise: float = 0.6) -> DataFrame:
    """Plausible ratings of ``key`` (item_id, is_ground_truth) by ``raters`` synthetic raters. Noise comes from hashes of seed, rater, item and axis, so that
    runs agree; it follows the intended distributions, not any generator's sequence."""
    unit = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    normal = lambda axis: F.sqrt(-2 * F.log(unit("rater", "item_id", F.lit(axis)))) * F.cos(2 * np.pi * unit("item_id", "rater", F.lit(axis + 100))) * noise
    clamp = lambda x: F.greatest(F.lit(1), F.least(F.lit(5), F.round(x).cast("int")))
    rows = key.withColumn("rater", F.explode(F.sequence(F.lit(1), F.lit(raters))))
    base = F.lit(3.0) + (unit("rater", F.lit(0)) * 0.8 - 0.4) + F.when(F.col("is_ground_truth"), bonus).otherwise(0.0)
    out = rows.withColumn("_b", base).select("item_id", F.concat(F.lit("sim-"), "rater").alias("rater_id"), *[clamp(F.col("_b") + normal(i)).alias(a) for i, a in enumerate(("speaker_similarity", "naturalness", "character_similarity"))], clamp(6 - (F.col("_b") + normal(3))).alias("ai_artifact_level"))
    return out.withColumn("believed_real", (F.col("naturalness") + F.col("speaker_similarity")) / 2 >= 4)
