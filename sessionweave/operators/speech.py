"""Statistics of frame-wise speech measures, and the record of seventy features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names of the features in order.
MFCC = tuple(f"mfcc_{i}_{s}" for i in range(1, 14) for s in ("mean", "std", "min", "max"))
PITCH = ("f0_mean", "f0_std", "f0_min", "f0_max", "f0_range", "f0_variability")
VOICE = ("jitter_local", "shimmer_local", "hnr_mean")
PAUSES = ("pause_count", "pause_total_duration", "pause_mean_duration", "pause_rate")
RATE = ("speaking_rate_wps",)
SPECTRUM = ("rms_mean", "rms_std", "spectral_centroid_mean", "spectral_centroid_std")
FEATURES = MFCC + PITCH + VOICE + PAUSES + RATE + SPECTRUM


def mfcc_stats(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population deviation, least and greatest of each coefficient; frames: keys and array `mfcc`."""
    stats = [f(F.get("mfcc", i)).alias(f"mfcc_{i + 1}_{n}") for i in range(13) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return frames.groupBy(*keys).agg(*stats)


def pitch_stats(frames: DataFrame, keys: list[str], f0: str = "f0") -> DataFrame:
    """The six pitch features over voiced frames (f0 > 0), 0.0 without any."""
    x = F.when(F.col(f0) > 0, F.col(f0))
    out = frames.groupBy(*keys).agg(F.avg(x).alias("f0_mean"), F.stddev_pop(x).alias("f0_std"), F.min(x).alias("f0_min"), F.max(x).alias("f0_max"))
    out = out.withColumn("f0_range", F.col("f0_max") - F.col("f0_min")).withColumn("f0_variability", F.try_divide("f0_std", "f0_mean"))
    return out.na.fill(0.0, list(PITCH))


def spectrum_stats(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.groupBy(*keys).agg(*(f(c).alias(f"{n}_{s}") for c, n in (("rms", "rms"), ("centroid", "spectral_centroid")) for s, f in (("mean", F.avg), ("std", F.stddev_pop))))


def feature_map() -> Column:
    """The seventy features as a map; a feature that isn't finite fails the speech contract later."""
    return F.map_from_arrays(F.array(*map(F.lit, FEATURES)), F.array(*(F.col(n).cast("double") for n in FEATURES)))


def speech_records(features: DataFrame, source_dataset: str, version: str = "phase1_v1", language: str = "English") -> DataFrame:
    """participant_id, session_id, ..., features, from a table with FEATURES and the struct `quality`."""
    return features.select(
        "participant_id", "session_id", F.lit("0").alias("timestamp"), F.lit(source_dataset).alias("source_dataset"), F.lit(language).alias("language"),
        F.lit(True).alias("modality_available"), "quality.quality_score", F.lit(version).alias("feature_version"), feature_map().alias("features"),
        "quality.speech_ratio", "quality.snr_estimate", "segment_id", "label_idx", "start", "end",
    )


def widened(records: DataFrame, keys: list[str]) -> DataFrame:
    """The feature map as seventy columns."""
    return records.select(*keys, *(F.element_at("features", n).alias(n) for n in FEATURES))
