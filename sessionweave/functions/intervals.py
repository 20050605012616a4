"""Speech intervals as arrays of structs start, end in samples: pauses, coverage, checks and audio slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _starts(intervals: Column) -> Column:
    return F.transform(intervals, lambda i: i["start"].cast("long"))


def _ends(intervals: Column) -> Column:
    return F.transform(intervals, lambda i: i["end"].cast("long"))


def pauses(intervals: Column, total_samples: Column, rate: int = 16_000, least_seconds: float = 0.15) -> Column:
    """Seconds of the gaps before, between and after the intervals that last least_seconds or more; none without speech."""
    after, before = F.array_append(_starts(intervals), total_samples.cast("long")), F.array_prepend(_ends(intervals), F.lit(0).cast("long"))
    gaps = F.transform(F.zip_with(after, before, lambda a, b: a - b), lambda g: g / float(rate))
    empty = F.array().cast("array<double>")
    return F.when((F.size(intervals) > 0) & (total_samples > 0), F.filter(gaps, lambda g: g >= least_seconds)).otherwise(empty)


def pause_features(found: Column, total_samples: Column, rate: int = 16_000) -> list[Column]:
    """pause_count, pause_total_duration, pause_mean_duration and pause_rate, 0.0 without pauses."""
    n, total = F.size(found), F.aggregate(found, F.lit(0.0), lambda s, x: s + x)
    some = n > 0
    return [
        F.when(some, n.cast("double")).otherwise(0.0).alias("pause_count"),
        F.when(some, total).otherwise(0.0).alias("pause_total_duration"),
        F.when(some, total / n).otherwise(0.0).alias("pause_mean_duration"),
        F.when(some, n / (total_samples / float(rate))).otherwise(0.0).alias("pause_rate"),
    ]


def speech_samples(intervals: Column) -> Column:
    return F.aggregate(intervals, F.lit(0).cast("long"), lambda s, i: s + (i["end"] - i["start"]).cast("long"))


def inside(position: Column, intervals: Column) -> Column:
    """Whether a sample lies in any interval."""
    return F.exists(intervals, lambda i: (position >= i["start"]) & (position < i["end"]))


def interval_errors(intervals: Column, total_samples: Column) -> Column:
    """Names of the rules the intervals break: start, order, length, overlap."""
    previous = F.array_prepend(_ends(intervals), F.lit(0).cast("long"))
    overlaps = F.exists(F.zip_with(_starts(intervals), F.slice(previous, 1, F.size(intervals)), lambda a, b: a < b), lambda x: x)
    rules = [
        ("start", F.exists(intervals, lambda i: i["start"] < 0)),
        ("order", F.exists(intervals, lambda i: i["end"] <= i["start"])),
        ("length", F.exists(intervals, lambda i: i["end"] > total_samples)),
        ("overlap", overlaps),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules)))


def speech_audio(audio: Column, intervals: Column, least_samples: int = 512) -> Column:
    """The samples inside the intervals, one after another; all of the audio if those are fewer than least_samples."""
    joined = F.flatten(F.transform(intervals, lambda i: F.slice(audio, (i["start"] + 1).cast("int"), (i["end"] - i["start"]).cast("int"))))
    return F.when(F.size(joined) >= least_samples, joined).otherwise(audio)


def audio_summary(audio: Column, rate: int = 16_000) -> Column:
    """Struct duration_seconds, peak and rms; zeros for empty audio."""
    n = F.size(audio)
    squares = F.aggregate(audio, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    some = n > 0
    return F.struct(
        F.when(some, n / float(rate)).otherwise(0.0).alias("duration_seconds"),
        F.when(some, F.array_max(F.transform(audio, lambda x: F.abs(x).cast("double")))).otherwise(0.0).alias("peak"),
        F.when(some, F.sqrt(squares / n)).otherwise(0.0).alias("rms"),
    )
