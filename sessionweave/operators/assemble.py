"""One checked record per segment from the modalities' tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_finite
from ..functions.text import dependency_depth, lexical_tokens, mean_dependency_distance, mean_length, msttr, preview, stripped, tokens
from .validate import error_array

KEYS = ["segment_id", "label_idx"]
STATUSES = ("available", "unavailable", "error")
OPENFACE = ("success", "unavailable", "failed", "not_run")
TEXT_DIMENSIONS, SPEECH_DIMENSIONS = 774, 70
ABSENT = "not_present"


def lookup(identities: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """For each identity: status, error and a struct `value` of the table's row. No row: unavailable; several: error."""
    held = table.groupBy(*KEYS).agg(F.count("*").alias("n"), F.first(F.struct(*columns)).alias("value"))
    found = identities.join(held, KEYS, "left")
    one = F.col("n") == 1
    status = F.when(one, "available").when(F.col("n").isNull(), "unavailable").otherwise("error")
    error = F.when(F.col("n").isNull(), "no row for this segment").when(F.col("n") > 1, F.concat(F.col("n"), F.lit(" rows for this segment")))
    return found.select(*identities.columns, status.alias("status"), error.alias("error"), F.when(one, F.col("value")).alias("value"))


def assemble(identities: DataFrame, text: DataFrame | None = None, speech: DataFrame | None = None, facial: DataFrame | None = None) -> DataFrame:
    """identity, text, speech, facial structs; each modality table holds KEYS and a struct `record` with a status, one row a key."""
    own = F.struct("source_dataset", "segment_id", "label_idx", "start", "end")
    out = identities.select(*KEYS, own.alias("identity"))
    for name, table in (("text", text), ("speech", speech), ("facial", facial)):
        if table is None:
            out = out.withColumn(name, F.lit(None).cast("struct<status:string>"))
        else:
            out = out.join(table.select(*KEYS, F.col("record").alias(name)), KEYS, "left")
    return out


def identity_errors(i: Column) -> Column:
    return error_array({
        "identity is missing": i.isNull(),
        "segment_id is empty": F.coalesce(i["segment_id"], F.lit("")) == "",
        "label_idx is missing": i["label_idx"].isNull(),
        "start is not finite": ~is_finite(i["start"]),
        "end is not finite": ~is_finite(i["end"]),
        "end must be after start": is_finite(i["start"]) & is_finite(i["end"]) & (i["end"] <= i["start"]),
        "source_dataset is empty": F.coalesce(i["source_dataset"], F.lit("")) == "",
    })


def text_errors(t: Column) -> Column:
    up = t["status"] == "available"
    f = t["features"]
    scalars = ("sentiment_normalized", "word_count", "avg_word_length", "dependency_tree_depth", "avg_dependency_distance")
    return error_array({
        "text is missing": t.isNull(),
        "text.status is invalid": t.isNotNull() & ~t["status"].isin(*STATUSES),
        f"text.feature_dim must be {TEXT_DIMENSIONS}": up & (t["feature_dim"] != TEXT_DIMENSIONS),
        **{f"text.{c} is not finite": up & f[c].isNotNull() & ~is_finite(f[c]) for c in scalars},
        "text.labse_embedding is missing": up & f["labse_embedding"].isNull(),
        "text.labse_embedding has a wrong size": up & (F.size(f["labse_embedding"]) != 768) & f["labse_embedding"].isNotNull(),
        "text.labse_embedding is not finite": up & F.exists(f["labse_embedding"], lambda x: ~is_finite(x)),
    })


def speech_record_errors(s: Column) -> Column:
    up = s["status"] == "available"
    q = s["quality"]
    return error_array({
        "speech is missing": s.isNull(),
        "speech.status is invalid": s.isNotNull() & ~s["status"].isin(*STATUSES),
        f"speech.feature_dim must be {SPEECH_DIMENSIONS}": up & (s["feature_dim"] != SPEECH_DIMENSIONS),
        f"speech.features must be {SPEECH_DIMENSIONS}": up & (F.coalesce(F.size(s["features"]), F.lit(-1)) != SPEECH_DIMENSIONS),
        "speech.features are not finite": up & F.exists(F.map_values(s["features"]), lambda x: ~is_finite(x)),
        "speech.quality is missing": up & q.isNull(),
        "speech.quality_score outside [0, 1]": up & q.isNotNull() & ~F.coalesce(q["quality_score"].between(0, 1), F.lit(False)),
        "speech.speech_ratio outside [0, 1]": up & q.isNotNull() & ~F.coalesce(q["speech_ratio"].between(0, 1), F.lit(False)),
        "speech.snr_estimate is not finite": up & q.isNotNull() & ~is_finite(q["snr_estimate"]),
    })


def facial_errors(f: Column) -> Column:
    up = f["status"] == "available"
    o = f["openface"]["status"]
    return error_array({
        "facial is missing": f.isNull(),
        "facial.status is invalid": f.isNotNull() & ~f["status"].isin(*STATUSES),
        "facial.face_coverage_percent outside [0, 100]": up & ~F.coalesce(f["face_coverage_percent"].between(0, 100), F.lit(False)),
        "facial.openface must be explicit": up & o.isNull(),
        "facial.openface.status is invalid": up & o.isNotNull() & ~o.isin(*OPENFACE),
        "facial.au_statistics must be empty without openface": up & o.isin(*OPENFACE[1:]) & (F.coalesce(F.size(f["au_statistics"]), F.lit(0)) > 0),
        "facial.ear_statistics are missing": up & f["ear_statistics"].isNull(),
    })


def alignment_errors(i: Column, facial: Column) -> Column:
    """A facial record that names another segment than the identity's."""
    up = facial["status"] == "available"
    return error_array({
        "facial segment_id differs": up & (facial["segment_id"] != i["segment_id"]),
        "facial label_idx differs": up & (facial["label_idx"] != i["label_idx"]),
    })


def with_integration(records: DataFrame, facial_names_segment: bool = False, checks: dict | None = None) -> DataFrame:
    """Adds the struct `integration`: statuses (PASS without errors), the errors and each modality's availability."""
    checks = checks if checks is not None else {"text": text_errors, "speech": speech_record_errors, "facial": facial_errors}
    i = F.col("identity")
    found = F.concat(identity_errors(i), *(check(F.col(name)) for name, check in checks.items()))
    aligned = alignment_errors(i, F.col("facial")) if facial_names_segment else F.array().cast("array<string>")
    available = F.struct(*(F.coalesce(F.col(name)["status"], F.lit(ABSENT)).alias(name) for name in ("text", "speech", "facial")))
    passed = lambda errors: F.when(F.size(errors) == 0, "PASS").otherwise("FAIL")
    return records.withColumn("integration", F.struct(passed(aligned).alias("alignment_status"), passed(found).alias("validation_status"), aligned.alias("alignment_errors"), found.alias("validation_errors"), available.alias("modality_availability")))


def demo_status(text: Column, speech: Column, facial: Column) -> Column:
    """PASS if every status is available or not_applicable, else PARTIAL; a missing facial status doesn't apply, others are unavailable."""
    states = [F.coalesce(text, F.lit("unavailable")), F.coalesce(speech, F.lit("unavailable")), F.coalesce(facial, F.lit("not_applicable"))]
    met = states[0].isin("available", "not_applicable")
    for s in states[1:]:
        met = met & s.isin("available", "not_applicable")
    return F.when(met, "PASS").otherwise("PARTIAL")


def display_text(t: Column) -> Column:
    """What a screen shows of a text record: rounded scalars and a preview, never the vector."""
    f = t["features"]
    shown = {"text_preview": preview(t["text"]), "word_count": f["word_count"].cast("int"), "avg_word_length": F.round(f["avg_word_length"], 6), "sentiment_normalized": F.round(f["sentiment_normalized"], 6), "msttr_10": F.round(f["msttr_10"], 6), "labse_dim": F.size(f["labse_embedding"])}
    up = t["status"] == "available"
    return F.struct(F.coalesce(t["status"], F.lit(ABSENT)).alias("status"), *(F.when(up, c).alias(n) for n, c in shown.items()))


def display_speech(s: Column) -> Column:
    up = s["status"] == "available"
    names = F.array_sort(F.map_keys(s["features"]))
    shown = {"feature_dim": s["feature_dim"], **{c: F.round(s["quality"][c], 6) for c in ("quality_score", "speech_ratio", "snr_estimate")}, "feature_names": names}
    return F.struct(F.coalesce(s["status"], F.lit(ABSENT)).alias("status"), *(F.when(up, c).alias(n) for n, c in shown.items()))


def display_facial(f: Column) -> Column:
    up = f["status"] == "available"
    shown = {
        "face_coverage_percent": F.round(f["face_coverage_percent"], 6), "blink_count": f["blink_count"], "blink_rate_per_minute": F.round(f["blink_rate_per_minute"], 6),
        "openface_status": F.coalesce(f["openface"]["status"], F.lit("not_run")), "au_count": F.coalesce(F.size(f["au_statistics"]), F.lit(0)),
    }
    return F.struct(F.coalesce(f["status"], F.lit(ABSENT)).alias("status"), *(F.when(up, c).alias(n) for n, c in shown.items()))


#: The speech features that a screen shows.
SUMMARY = ("f0_mean", "f0_std", "speaking_rate_wps", "jitter_local", "shimmer_local", "hnr_mean", "pause_count", "pause_total_duration", "rms_mean", "spectral_centroid_mean", "mfcc_1_mean", "mfcc_2_mean")


def speech_summary(features: Column) -> Column:
    """Twelve of the features, rounded; what is missing or NaN is NULL."""
    value = lambda n: F.when(~F.isnan(F.element_at(features, n)), F.round(F.element_at(features, n), 5))
    return F.struct(*(value(n).alias(n) for n in SUMMARY))


def demo_text(transcript: Column, parse: Column | None = None) -> Column:
    """What a live transcript shows: surface measures, and markers for what isn't computed live. Nothing but the status when empty."""
    clean = stripped(transcript)
    words = tokens(clean)
    up = F.length(F.coalesce(clean, F.lit(""))) > 0
    undone = F.struct(F.lit("not_computed").alias("status"))
    shown = {
        "transcript_length": F.length(clean), "word_count": F.size(words), "avg_word_length": mean_length(words), "msttr_10": msttr(lexical_tokens(clean)),
        "dependency_tree_depth": F.lit(None).cast("int") if parse is None else dependency_depth(parse),
        "avg_dependency_distance": F.lit(None).cast("double") if parse is None else mean_dependency_distance(parse),
        "labse_embedding": undone, "sentiment_normalized": undone,
    }
    return F.struct(F.when(up, "available").otherwise("unavailable").alias("status"), F.lit("live_inference").alias("source"), *(F.when(up, c).alias(n) for n, c in shown.items()))


def as_json(record: Column) -> Column:
    """JSON with nulls written out. NaN and infinities must have been made NULL before."""
    return F.to_json(record, {"ignoreNullFields": "false"})
