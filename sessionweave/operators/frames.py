"""Per-frame state of a session as window expressions, and session summaries.

A session's frames are ordered by frame_index within one window partition, which is bounded by the session's own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import CLOSED_BELOW, gaze_label
from ..functions.missing import finite_or_null

SMOOTHED = ("pitch", "yaw", "roll", "gaze")
KEPT_VALUES = 5


def frame_clock(frames: DataFrame, fps: Column, order: list[str]) -> DataFrame:
    """frame_index from 1 and timestamp_ms, cut to whole milliseconds."""
    index = F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    return frames.withColumn("frame_index", index).withColumn("timestamp_ms", (F.col("frame_index") / fps * 1000).cast("bigint"))


def smooth(value: str, kept: int = KEPT_VALUES) -> Column:
    """Mean of the last `kept` values that aren't missing; missing frames give NULL and take no place."""
    valid = F.col(value).isNotNull()
    window = Window.partitionBy("session_id", valid).orderBy("frame_index").rowsBetween(-(kept - 1), 0)
    return F.when(valid, F.avg(value).over(window))


def temporal_features(frames: DataFrame) -> DataFrame:
    """Adds smoothed values, gaze_label, blink and cumulative_blinks.

    frames: session_id, frame_index, face_detected (0 or 1), ear, pitch, yaw, roll, gaze. A blink is counted on the first open
    detected frame after a closed one; frames without a face don't change the state; a missing ear counts as open.
    """
    detected = F.col("face_detected") == 1
    clean = frames.withColumns({c: F.when(detected, finite_or_null(F.col(c))) for c in ("ear", *SMOOTHED)})
    closed = F.coalesce(F.col("ear") < CLOSED_BELOW, F.lit(False))
    before = F.lag(closed).over(Window.partitionBy("session_id", "face_detected").orderBy("frame_index"))
    blink = (detected & ~closed & F.coalesce(before, F.lit(False))).cast("int")
    so_far = Window.partitionBy("session_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    out = clean.withColumn("blink", blink).withColumns({f"{c}_smooth": smooth(c) for c in SMOOTHED})
    return out.withColumn("cumulative_blinks", F.sum("blink").over(so_far)).withColumn("gaze_label", gaze_label(F.col("gaze_smooth")))


def finite_stats(value: str, name: str) -> list[Column]:
    """Mean, population deviation, least and greatest of the finite values; NULL without any."""
    x = finite_or_null(F.col(value))
    return [F.avg(x).alias(f"{name}_mean"), F.stddev_pop(x).alias(f"{name}_std"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max")]


def session_summary(frames: DataFrame, fps: float) -> DataFrame:
    """One row per session from temporal_features: coverage, duration, blinks, ear statistics, gaze counts and percentages."""
    labels = ("LEFT", "CENTER", "RIGHT")
    counts = [F.count_if(F.col("gaze_label") == g).alias(f"gaze_{g.lower()}") for g in labels]
    stats = [s for c in ("ear", "pitch_smooth", "yaw_smooth", "roll_smooth", "gaze_smooth") for s in finite_stats(c, c.removesuffix("_smooth"))]
    out = frames.groupBy("session_id").agg(F.count("*").alias("frame_count"), F.count_if(F.col("face_detected") == 1).alias("detected_frames"), F.sum("blink").alias("blink_count"), *counts, *stats)
    total = sum(F.col(f"gaze_{g.lower()}") for g in labels)
    seconds = F.col("frame_count") / fps
    out = out.withColumns({"face_coverage_percent": F.col("detected_frames") / F.col("frame_count") * 100, "duration_seconds": seconds, "blink_rate_per_minute": F.coalesce(F.try_divide(F.col("blink_count"), seconds / 60), F.lit(0.0))})
    return out.withColumns({f"gaze_{g.lower()}_percent": F.coalesce(F.try_divide(F.col(f"gaze_{g.lower()}"), total) * 100, F.lit(0.0)) for g in labels})


def action_unit_stats(table: DataFrame) -> DataFrame:
    """A row per action unit of a wide table: name, mean, std, min, max, activity_rate, presence_rate.

    Intensities are columns AU.._r, presences AU.._c; names may have surrounding space; cells that aren't finite numbers are left out. A
    presence joins its unit's intensity row if there is one. One pass aggregates all columns.
    """
    named = table.toDF(*(c.strip() for c in table.columns))
    units = [c for c in named.columns if c.startswith("AU") and c[-2:] in ("_r", "_c")]
    if not units:
        return table.sparkSession.createDataFrame([], "name string, mean double, std double, min double, max double, activity_rate double, presence_rate double")
    aggregates = []
    for c in units:
        x = finite_or_null(F.col(c))
        rate = F.avg((x > 0).cast("double")) * 100 if c.endswith("_r") else F.avg((x >= 1).cast("double")) * 100
        aggregates.append(F.struct(F.lit(c).alias("name"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), rate.alias("rate"), F.count(x).alias("n")).alias(c))
    long = named.agg(*aggregates).select(F.explode(F.array(*units)).alias("u")).select("u.*").where("n > 0")
    stem = F.regexp_replace("name", "_[rc]$", "")
    intensity = long.where(F.col("name").endswith("_r")).select(stem.alias("stem"), "name", "mean", "std", "min", "max", F.col("rate").alias("activity_rate"))
    presence = long.where(F.col("name").endswith("_c")).select(stem.alias("stem"), F.col("name").alias("c_name"), F.col("rate").alias("presence_rate"))
    return intensity.join(presence, "stem", "full").select(F.coalesce("name", "c_name").alias("name"), "mean", "std", "min", "max", "activity_rate", "presence_rate")
