"""Contracts: each check is one aggregate or a column of error names; nothing is collected but counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import interval_errors
from ..functions.missing import is_finite, is_positive
from ..functions.text import stripped


class ContractError(ValueError):
    """Data that break a contract."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def require_empty(df: DataFrame, what: str) -> None:
    rows = df.limit(5).collect()
    if rows:
        raise ContractError(f"{what}: {[tuple(r) for r in rows]}")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    require_empty(df.groupBy(*keys).count().where("count > 1"), f"rows that share {keys}")


def require_count(df: DataFrame, expected: int) -> None:
    found = df.count()
    if found != expected:
        raise ContractError(f"expected {expected} rows, found {found}")


def key_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, missing_keys and doubled_keys (rows beyond each key's first), one row."""
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return df.agg(F.count("*").alias("n_rows"), F.count_if(missing).alias("missing_keys"), (F.count("*") - F.count_distinct(F.struct(*keys))).alias("doubled_keys"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule; a rule that is NULL is broken. One pass, one row."""
    return df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))


def require_rules(df: DataFrame, rules: dict[str, Column]) -> None:
    broken = {k: v for k, v in violations(df, rules).first().asDict().items() if v}
    if broken:
        raise ContractError(f"rows that break rules: {broken}")


def error_array(errors: dict[str, Column]) -> Column:
    """The messages whose condition is true, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(text)) for text, broken in errors.items()))) if errors else F.array().cast("array<string>")


def embedding_ok(vector: Column, dimensions: int, unit: bool = True, tolerance: float = 1e-4) -> Column:
    """Right size, all finite, and norm one within tolerance."""
    finite = F.forall(vector, lambda x: is_finite(x))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sound = (F.size(vector) == dimensions) & finite
    return sound & (F.abs(norm - 1) <= tolerance) if unit else sound


def feature_table_rules(dimensions: int = 768, strict: bool = False) -> dict[str, Column]:
    """Rules of the final text feature table; strict adds non-empty texts and unit vectors."""
    rules = {"embedding": embedding_ok(F.col("labse_embedding"), dimensions, unit=strict), "sentiment": is_finite(F.col("sentiment_normalized")) & F.col("sentiment_normalized").between(-1, 1)}
    for c in ("word_count", "avg_word_length", "dependency_tree_depth", "avg_dependency_distance"):
        rules[c] = is_finite(F.col(c)) & (F.col(c) >= 0)
    rules["msttr_10"] = F.col("msttr_10").isNull() | (is_finite(F.col("msttr_10")) & F.col("msttr_10").between(0, 1))
    if strict:
        rules["text"] = F.length(stripped(F.col("text"))) > 0
    return rules


def audio_errors(audio: Column, rate: Column, wanted_rate: int = 16_000) -> Column:
    return error_array({"empty": F.size(audio) <= 0, "rate": rate != wanted_rate, "not finite": F.exists(audio, lambda x: ~is_finite(x))})


def speech_errors(features: Column, quality: Column, intervals: Column | None = None, total_samples: Column | None = None, expected: int = 70) -> Column:
    """features: map of names to doubles; quality: struct of speech_ratio, snr_estimate, quality_score."""
    errors = {
        f"features must be {expected}": F.size(features) != expected,
        "features aren't finite": F.exists(F.map_values(features), lambda x: ~is_finite(x)),
        "quality_score outside [0, 1]": ~F.coalesce(quality["quality_score"].between(0, 1), F.lit(False)),
        "speech_ratio outside [0, 1]": ~F.coalesce(quality["speech_ratio"].between(0, 1), F.lit(False)),
        "snr_estimate isn't finite": ~is_finite(quality["snr_estimate"]),
    }
    out = error_array(errors)
    return out if intervals is None else F.concat(out, F.transform(interval_errors(intervals, total_samples), lambda e: F.concat(F.lit("interval "), e)))


def video_errors(summary: DataFrame, frames: DataFrame) -> DataFrame:
    """(session_id, passed, errors) from session summaries and their frames.

    Checked besides, where the summary has them: fps, quality_indicator (struct metric, value), every column named ear_*, gaze_* or
    pitch_*, yaw_*, roll_* of type double, segment_id and label_idx (may be absent but not empty), openface_status.
    """
    detected = F.col("face_detected") == 1
    gaps = [F.count_if(detected & ~is_finite(F.col(c))).alias(f"bad_{c}") for c in ("ear", "pitch", "yaw", "roll", "gaze")]
    counted = frames.groupBy("session_id").agg(F.count("*").alias("n"), F.count_distinct("frame_index").alias("distinct"), F.count_if(~F.col("face_detected").isin(0, 1)).alias("flags"), *gaps)
    errors = {
        "no frames": F.coalesce(F.col("n"), F.lit(0)) == 0,
        "frame indices repeat": F.col("n") != F.col("distinct"),
        "frame count differs": F.col("n") != F.col("frame_count"),
        "face_detected isn't 0 or 1": F.col("flags") > 0,
        **{f"{c} isn't finite on a detected frame": F.col(f"bad_{c}") > 0 for c in ("ear", "pitch", "yaw", "roll", "gaze")},
        "coverage outside [0, 100]": ~F.coalesce(F.col("face_coverage_percent").between(0, 100), F.lit(False)),
    }
    has = set(summary.columns)
    if "fps" in has:
        errors["fps isn't positive"] = ~is_positive(F.col("fps"))
    if "quality_indicator" in has:
        q = F.col("quality_indicator")
        errors["quality indicator is wrong"] = ~F.coalesce((q["metric"] == "face_detection_coverage_percent") & is_finite(q["value"]), F.lit(False))
    measured = [f.name for f in summary.schema if f.dataType.typeName() == "double" and f.name.split("_")[0] in ("ear", "gaze", "pitch", "yaw", "roll")]
    errors |= {f"{c} is infinite": F.col(c).isNotNull() & ~F.isnan(c) & ~is_finite(F.col(c)) for c in measured}
    errors |= {f"{c} is empty": F.col(c).cast("string") == "" for c in ("segment_id", "label_idx") if c in has}
    if "openface_status" in has:
        errors["openface status isn't explicit"] = ~F.coalesce(F.col("openface_status").isin("success", "failed", "unavailable", "not_run"), F.lit(False))
    found = summary.join(counted, "session_id", "left").withColumn("errors", error_array(errors))
    return found.select("session_id", (F.size("errors") == 0).alias("passed"), "errors")


def common_record_errors() -> Column:
    """Errors of the modality record that all modalities share."""
    given = lambda c: F.length(F.coalesce(stripped(F.col(c)), F.lit(""))) > 0
    named = {f"{c} is empty": ~given(c) for c in ("participant_id", "session_id", "modality", "source_dataset", "feature_version")}
    return error_array({
        **named,
        "quality_score outside [0, 1]": F.col("quality_score").isNotNull() & ~F.col("quality_score").between(0, 1),
        "times are wrong": F.col("start").isNotNull() & F.col("end").isNotNull() & ~(is_finite(F.col("start")) & is_finite(F.col("end")) & (F.col("end") > F.col("start"))),
        "features are missing": F.col("modality_available") & (F.coalesce(F.size("features"), F.lit(0)) <= 0),
        "features aren't finite": F.exists(F.map_values("features"), lambda x: ~is_finite(x)),
    })


def compare_keys(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """artifact, n_rows, missing and extra keys against the first artifact; one pass over all of them."""
    first = next(iter(tables))
    marked = reduce(DataFrame.unionByName, (df.select(*keys, F.lit(name).alias("artifact")) for name, df in tables.items()))
    held = marked.groupBy(*keys).agg(F.collect_set("artifact").alias("held"), *(F.count_if(F.col("artifact") == n).alias(f"n_{k}") for k, n in enumerate(tables)))
    has = lambda n: F.array_contains("held", n)
    columns = [F.struct(F.lit(n).alias("artifact"), F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias("n_rows"), F.count_if(has(first) & ~has(n)).alias("missing"), F.count_if(has(n) & ~has(first)).alias("extra")).alias(f"t{k}") for k, n in enumerate(tables)]
    return held.agg(*columns).select(F.explode(F.array(*(f"t{k}" for k in range(len(tables))))).alias("t")).select("t.*")
