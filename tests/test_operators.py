"""Operators on small inputs whose results follow from the rules, and against plain loops."""

from __future__ import annotations

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sessionweave.functions import geometry, intervals, missing, plugins, scores
from sessionweave.functions import text as X
from sessionweave.operators import align, assemble, evaluation, frames, media, speech, stats, validate, vectors
from sessionweave.plans import media_mapping, text_pipeline
from sessionweave.sources import readers, sinks


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_missing_values(spark):
    rows = spark.createDataFrame([(1.0,), (0.0,), (None,), (float("nan"),), (float("inf"),), (-2.0,)], "x double")
    x = F.col("x")
    found = rows.select(missing.is_finite(x), missing.is_positive(x), missing.finite_or_null(x), missing.ratio_or_zero(F.lit(3), x)).collect()
    assert [r[0] for r in found] == [True, True, False, False, False, True]
    assert [r[1] for r in found] == [True, False, False, False, False, False]
    assert [r[2] for r in found] == [1.0, 0.0, None, None, None, -2.0]
    assert found[0][3] == 3.0 and found[1][3] == 0.0 and found[2][3] == 0.0


def test_text_measures_match_python(spark):
    rnd = random.Random(1)
    texts = ["", " ", "one", "don't stop 'now'", None] + ["".join(rnd.choice("ab'é \t\n_1.,²") for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    out = {r["k"]: r for r in text_pipeline.lexical_features(text_pipeline.surface_features(df)).collect()}
    pattern = re.compile(r"[^\W](?:[\w']*[^\W])?")
    for k, t in enumerate(texts):
        words, tokens = (t or "").split(), pattern.findall((t or "").lower())
        assert out[k]["word_count"] == len(words)
        assert math.isclose(out[k]["avg_word_length"], sum(map(len, words)) / len(words) if words else 0.0)
        if "²" not in (t or ""):
            assert out[k]["lexical_token_count"] == len(tokens) and out[k]["unique_word_count"] == len(set(tokens))
            blocks = [tokens[i : i + 10] for i in range(0, len(tokens) - 9, 10)]
            wanted = sum(len(set(b)) / 10 for b in blocks) / len(blocks) if blocks else None
            assert (out[k]["msttr_10"] is None) == (wanted is None) and (wanted is None or math.isclose(out[k]["msttr_10"], wanted))


def test_alignment_is_strict_and_keeps_empty_labels(spark):
    words = spark.createDataFrame([("s", 0, 0.0, 1.0, "a"), ("s", 1, 1.0, 2.0, "b"), ("s", 2, 1.0, 2.0, "c"), ("s", 3, 1.5, 2.5, " SP "), ("s", 4, 0.5, 0.5, "z")], "source_id string, pos int, start double, end double, word string")
    labels = spark.createDataFrame([("s", 0, 0.0, 1.0), ("s", 1, 1.0, 3.0), ("s", 2, 5.0, 6.0), ("t", 0, 0.0, 9.0)], "source_id string, label_idx int, start double, end double")
    for bucket in (None, 0.7):
        found = {(r[0], r[1]): r["text"] for r in align.align_words(labels, words, bucket).collect()}
        assert found == {("s", 0): "a z", ("s", 1): "b c", ("s", 2): ""}
    assert align.transcripts(words).first()["text"] == "a b c z"


def test_frame_state_matches_a_loop(spark):
    rnd = random.Random(2)
    rows = [(s, i, rnd.randint(0, 1), rnd.choice([None, float("nan"), rnd.random() / 2]), *(rnd.choice([None, rnd.random()]) for _ in range(4))) for s in "ab" for i in range(1, 150)]
    schema = "session_id string, frame_index int, face_detected int, ear double, pitch double, yaw double, roll double, gaze double"
    found = {(r["session_id"], r["frame_index"]): r for r in frames.temporal_features(spark.createDataFrame(rows, schema)).collect()}
    for s in "ab":
        closed, blinks, kept = False, 0, []
        for _, i, face, ear, _, _, _, gaze in (r for r in rows if r[0] == s):
            mean = None
            if face:
                now = ear is not None and not math.isnan(ear) and ear < 0.21
                blinks += closed and not now
                closed = now
                if gaze is not None:
                    kept = [*kept, gaze][-5:]
                    mean = sum(kept) / len(kept)
            r = found[s, i]
            assert r["cumulative_blinks"] == blinks
            assert (r["gaze_smooth"] is None) == (mean is None) and (mean is None or math.isclose(mean, r["gaze_smooth"]))


def test_session_summary_follows_published_formulas(spark):
    rows = [("x", i, int(i <= 1022), 0.3, 0.0, 0.0, 0.0, 0.5) for i in range(1, 1036)]
    df = frames.temporal_features(spark.createDataFrame(rows, "session_id string, frame_index int, face_detected int, ear double, pitch double, yaw double, roll double, gaze double"))
    r = frames.session_summary(df, 1035 / 40.43).first()
    assert round(r["face_coverage_percent"], 3) == 98.744 and round(r["duration_seconds"], 2) == 40.43 and r["gaze_center_percent"] == 100.0


def test_action_units_pair_presence_with_intensity(spark):
    df = spark.createDataFrame([("0.0", "1", "0"), ("2.0", "0", "1"), ("x", "1", "1")], "` AU01_r` string, `AU01_c ` string, AU28_c string")
    found = {r["name"]: r for r in frames.action_unit_stats(df).collect()}
    assert set(found) == {"AU01_r", "AU28_c"}
    assert found["AU01_r"]["activity_rate"] == 50.0 and found["AU01_r"]["std"] == 1.0 and round(found["AU01_r"]["presence_rate"], 3) == 66.667
    assert found["AU28_c"]["mean"] is None and round(found["AU28_c"]["presence_rate"], 3) == 66.667


def _media(spark):
    manifest = spark.createDataFrame([("a", 1, 0.0, 2.0), ("a", 0, 3.0, 4.0), ("b", 0, 0.0, 5.0), ("b", 1, 5.0, 9.0), ("c", 0, 0.0, 1.0)], "segment_id string, label_idx int, start double, end double")
    raw = spark.createDataFrame([("a", "10", 1.0), ("a", "9", 2.0), ("b", "1", 4.1), ("b", "2", 9.0), ("b", "3", 1.0), ("d", "0", 1.0)], "segment_id string, local_video_id string, duration_sec double")
    raw = raw.selectExpr("*", "concat(segment_id, '/', local_video_id) as video_path", "true as has_video", "true as has_audio")
    return manifest, raw, spark.createDataFrame([("b", 1, "1")], "segment_id string, label_idx int, local_video_id string")


def test_media_mapping_gives_all_reasons(spark):
    manifest, raw, exceptions = _media(spark)
    mapped, said = media_mapping.map_media(manifest, raw, exceptions)
    rows = {(r["segment_id"], r["label_idx"]): r for r in mapped.collect()}
    assert rows["a", 1]["local_video_id"] == "9" and rows["a", 0]["local_video_id"] == "10"  # by time and by number
    assert rows["b", 1]["chronological_rank"] == 1 and rows["b", 1]["duration_validation"] == "CLOSE"
    assert rows["b", 0]["mapping_status"] == "MEDIA_UNAVAILABLE" and rows["c", 0]["duration_validation"] == "NOT_AVAILABLE"
    reasons = sorted((r["segment_id"], r["reason"]) for r in said.collect())
    assert reasons == [("b", "EXTRA_RAW_MEDIA"), ("b", "EXTRA_RAW_MEDIA"), ("b", "MEDIA_UNAVAILABLE"), ("c", "MISSING_RAW_SOURCE"), ("d", "RAW_ONLY_SOURCE")]


@pytest.mark.parametrize("row", [("b", 7, "1"), ("b", 1, "77"), ("a", 0, "9")])
def test_bad_exceptions_are_refused(spark, row):
    manifest, raw, _ = _media(spark)
    with pytest.raises(validate.ContractError):
        media.pair_media(manifest, raw, spark.createDataFrame([row], "segment_id string, label_idx int, local_video_id string"))


def test_attach_media_keeps_clashing_columns_apart(spark):
    left = spark.createDataFrame([("a", 0, None), ("b", 0, None)], "segment_id string, label_idx int, video_path string")
    right = spark.createDataFrame([("a", 0, "x")], "segment_id string, label_idx int, video_path string")
    out = media.attach_media(left, right).orderBy("segment_id").collect()
    assert out[0]["video_path_mapped"] == "x" and out[1]["video_path_mapped"] is None
    with pytest.raises(validate.ContractError):
        media.attach_media(left, right.union(right))


def test_pauses_and_interval_checks(spark):
    iv = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((4000, 8000), (9000, 12000))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    r = one(spark, p=intervals.pauses(iv, F.lit(16000)), q=intervals.pauses(none, F.lit(16000)), n=intervals.speech_samples(iv), e=intervals.interval_errors(iv, F.lit(10000)), ok=intervals.interval_errors(none, F.lit(1)), i=intervals.inside(F.lit(8000), iv))
    assert r["p"] == [0.25, 0.25] and r["q"] == [] and r["n"] == 7000 and r["e"] == ["length"] and r["ok"] == [] and r["i"] is False


def test_quality_score_and_geometry(spark):
    nothing = F.lit(None).cast("double")
    r = one(spark, empty=scores.audio_quality(F.lit(0), F.lit(0), nothing, nothing), full=scores.audio_quality(F.lit(50), F.lit(100), F.lit(1.0), F.lit(0.1)))
    assert tuple(r["empty"]) == (0.0, 0.0, 0.0)
    assert math.isclose(r["full"]["snr_estimate"], 10 * math.log10(1 / (0.1 + 1e-9))) and 0 < r["full"]["quality_score"] < 1
    flat = F.transform(F.sequence(F.lit(0), F.lit(477)), lambda k: F.struct(F.lit(1.0).alias("x"), (k * 1.0).alias("y")))
    eye = one(spark, e=geometry.eye_aspect_ratio(flat, (0, 0, 0, 0, 0, 0)), g=geometry.gaze_label(geometry.gaze_ratio(flat)))
    assert eye["e"] == 0.0 and eye["g"] == "UNKNOWN"


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (6.0,), (10.0,), (-1.0,), (11.0,)], "x double")
    closed = stats.right_closed_bin(F.col("x"), [0, 5, 10], ["low", "high"], include_lowest=True)
    assert [r[0] for r in df.select(closed).collect()] == ["low", "low", "high", "high", None, None]
    assert df.select(stats.right_closed_bin(F.col("x"), [0, 5, 10], ["low", "high"])).first()[0] is None
    table = stats.bin_table(df.select("x", closed.alias("b")), "b", ["low", "high", "none"], "x").orderBy("ordinal").collect()
    assert [r["n"] for r in table] == [2, 2, 0] and [r["share_percent"] for r in table] == [50.0, 50.0, 0.0]


def test_correlation_p_value():
    assert math.isclose(stats.correlation_p_value(0.5, 20), 0.0247, abs_tol=2e-4)
    assert stats.correlation_p_value(1.0, 20) == 0.0 and math.isclose(stats.correlation_p_value(0.0, 20), 1.0)


def test_evaluation_counts_absent_labels(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, 3)], "t int, p int")
    assert sum(r["n"] for r in evaluation.confusion(df, "t", "p", [0, 1, 2]).collect()) == 3
    r = evaluation.classification_report(df, "t", "p").first()
    assert r["accuracy"] == 0.75 and math.isclose(r["macro_f1"], (2 / 3 + 2 / 3 + 1) / 3)


def test_nearest_skips_itself_and_breaks_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "id long, v array<double>")
    found = vectors.nearest(v.where("id = 1"), v, "id", "v", 2).orderBy("rank").collect()
    assert [r["neighbour"] for r in found] == [2, 4]
    assert vectors.nearest(v.where("id > 9"), v, "id", "v").count() == 0


def test_speech_record_has_seventy_features(spark):
    assert len(speech.FEATURES) == 70
    row = spark.range(1).select(*(F.lit(1.0).alias(n) for n in speech.FEATURES))
    q = F.struct(F.lit(0.5).alias("speech_ratio"), F.lit(1.0).alias("snr_estimate"), F.lit(0.5).alias("quality_score"))
    checked = row.select(validate.speech_errors(speech.feature_map(), q).alias("e")).first()
    assert checked["e"] == []
    bad = row.withColumn("f0_mean", F.lit(float("nan"))).select(validate.speech_errors(speech.feature_map(), q).alias("e")).first()
    assert bad["e"] == ["features aren't finite"]


def test_assembly_marks_absence_and_checks(spark):
    ids = spark.createDataFrame([("a", 0, "d", 0.0, 1.0), ("b", 0, "d", 2.0, 1.0)], "segment_id string, label_idx int, source_dataset string, start double, end double")
    table = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("b", 0, 2)], "segment_id string, label_idx int, x int")
    assert [r["status"] for r in assemble.lookup(ids, table, ["x"]).orderBy("segment_id").collect()] == ["available", "error"]
    r = {x["segment_id"]: x["integration"] for x in assemble.with_integration(assemble.assemble(ids), checks={}).collect()}
    assert r["a"]["validation_status"] == "PASS" and r["a"]["modality_availability"]["text"] == "not_present"
    assert r["b"]["validation_errors"] == ["end must be after start"]
    assert json.loads(ids.select(assemble.as_json(F.struct(F.lit(None).cast("int").alias("n")))).first()[0]) == {"n": None}


def test_feature_rules(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0.5, 1, 1.0, 0, 0.0, None), ([float("nan"), 0.0], 2.0, -1, 1.0, 0, 0.0, 1.5)], "labse_embedding array<double>, sentiment_normalized double, word_count int, avg_word_length double, dependency_tree_depth int, avg_dependency_distance double, msttr_10 double")
    assert validate.violations(df, validate.feature_table_rules(2)).first().asDict() == {"embedding": 1, "sentiment": 1, "word_count": 1, "avg_word_length": 0, "dependency_tree_depth": 0, "avg_dependency_distance": 0, "msttr_10": 1}
    with pytest.raises(validate.ContractError):
        validate.require_rules(df, validate.feature_table_rules(2))


def test_plugins_keep_failures_in_their_rows(spark):
    def factory():
        def model(values):
            if any(v == "bad" for v in values):
                raise ValueError("no")
            return [len(v) for v in values]

        return model

    df = spark.createDataFrame([("abc",), ("bad",)], "text string")
    out = {r["text"]: r for r in plugins.apply_model(df, "text", "token_count", "token_count", factory).collect()}
    assert out["abc"]["token_count"] == 3 and out["bad"]["token_count_status"] == "error" and out["bad"]["token_count_error"] == "no"


def test_sources_and_sinks(spark, tmp_path):
    from sessionweave.schemas import EXCEPTIONS

    (tmp_path / "e.csv").write_text("﻿local_video_id, segment_id ,label_idx\n007,125344,x\n")
    r = readers.read_csv(spark, str(tmp_path / "e.csv"), EXCEPTIONS, ["segment_id", "label_idx", "local_video_id"]).first()
    assert r["local_video_id"] == "007" and r["segment_id"] == "125344" and r["label_idx"] is None
    with pytest.raises(validate.ContractError):
        readers.read_csv(spark, str(tmp_path / "e.csv"), EXCEPTIONS)
    for name in ("s1/1.mp4", "s1/sub/2.mp4", "3.mp4"):
        (tmp_path / "m" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / name).write_bytes(b"x")
    files = readers.list_media(spark, str(tmp_path / "m"))
    assert [(r[0], r[1]) for r in files.collect()] == [("s1", "1"), ("s1", "2")]
    said = json.dumps({"streams": [{"codec_type": "audio", "sample_rate": "16000", "channels": 1}, {"codec_type": "video", "codec_name": "h264", "width": 4, "r_frame_rate": "30/0", "duration": "2.5"}], "format": {}})
    index = readers.index_media(files, lambda path: said if path.endswith("1.mp4") else 1 / 0).orderBy("local_video_id").collect()
    assert index[0]["duration_sec"] == 2.5 and index[0]["fps"] is None and index[0]["has_audio"] and index[1]["index_status"].startswith("ERROR")
    sinks.save_csv(spark.createDataFrame([(1, [1.0])], "a int, v array<double>"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["a"]


class FakeState:
    hasTimedOut = False

    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutDuration(self, ms):
        self.ms = ms


def test_streaming_state_equals_batch(spark):
    """The state function that Structured Streaming calls, fed in three micro-batches."""
    import pandas as pd

    from sessionweave.streaming.frames import advance

    rnd = random.Random(4)
    schema = "session_id string, frame_index int, face_detected int, ear double, pitch double, yaw double, roll double, gaze double"
    rows = [("a", i, rnd.randint(0, 1), rnd.random() / 2, *(rnd.random() for _ in range(4))) for i in range(1, 60)]
    names, state, out = [c.split()[0] for c in schema.split(", ")], FakeState(), []
    for k in range(3):
        out += [f for f in advance(("a",), iter([pd.DataFrame([r for r in rows if (r[1] - 1) // 20 == k], columns=names)]), state)]
    streamed = pd.concat(out).set_index("frame_index")
    for r in frames.temporal_features(spark.createDataFrame(rows, schema)).collect():
        s = streamed.loc[r["frame_index"]]
        assert (s["blink"], s["cumulative_blinks"], s["gaze_label"]) == (r["blink"], r["cumulative_blinks"], r["gaze_label"])
        assert pd.isna(s["gaze_smooth"]) if r["gaze_smooth"] is None else math.isclose(s["gaze_smooth"], r["gaze_smooth"])


def test_depth_follows_heads_without_a_limit(spark):
    """Chains, circles and forests against the plain rule: steps to a root, or distinct tokens before one repeats."""
    rnd = random.Random(3)
    parses = [[max(i - 1, 0) for i in range(n)] for n in (1, 2, 100, 300)] + [[1, 2, 0, 2, 3], [1, 0], [0, 0, 3, 2]]
    parses += [[rnd.randrange(n) for _ in range(n)] for n in (rnd.randrange(2, 12) for _ in range(150))]
    rows = [(k, [{"i": i, "head": h, "is_space": False, "is_punct": i % 5 == 4} for i, h in enumerate(p)]) for k, p in enumerate(parses)]
    df = spark.createDataFrame(rows, "k int, parse array<struct<i:int,head:int,is_space:boolean,is_punct:boolean>>")
    found = {r[0]: r[1] for r in df.select("k", X.dependency_depth(F.col("parse"))).collect()}

    def depth(p, i):
        seen = []
        while p[i] != i and i not in seen:
            seen.append(i)
            i = p[i]
        return len(seen)

    for k, p in enumerate(parses):
        real = [i for i in range(len(p)) if i % 5 != 4]
        assert found[k] == (max(depth(p, i) for i in real) if len(real) > 1 else 0), p


def test_exact_quantiles_by_group(spark):
    import numpy as np

    rnd = random.Random(4)
    rows = [(rnd.choice("abc"), rnd.choice([None, 1.0, 2.0, 2.0, rnd.random()])) for _ in range(500)] + [("d", None), ("e", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    found = {(r["g"], r["p"]): r["value"] for r in stats.grouped_quantiles(df, ["g"], "x", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    wanted = {(g, p): np.quantile([x for h, x in rows if h == g and x is not None], p) for g in "abce" for p in (0.0, 0.1, 0.5, 0.99, 1.0)}
    assert set(found) == set(wanted) and all(math.isclose(found[k], wanted[k]) for k in wanted)


def test_pauses_with_any_white_space_are_no_words(spark):
    words = spark.createDataFrame([("s", 0, 0.0, 1.0, "a"), ("s", 1, 0.0, 1.0, "sp\n"), ("s", 2, 0.0, 1.0, " SP")], "source_id string, pos int, start double, end double, word string")
    assert [r["word"] for r in align.spoken(words).collect()] == ["a"]
    assert spark.createDataFrame([("a sp  b",)], "t string").select(X.clean_transcript(F.col("t"))).first()[0] == "a b"


def test_doubled_files_and_manifest_keys_are_refused(spark):
    manifest = spark.createDataFrame([("s", 0, 0.0, 1.0), ("s", 1, 1.0, 2.0)], "segment_id string, label_idx int, start double, end double")
    raw = spark.createDataFrame([("s", "1"), ("s", "01")], "segment_id string, local_video_id string")
    with pytest.raises(validate.ContractError):
        media.pair_media(manifest, raw)
    with pytest.raises(validate.ContractError):
        media.pair_media(manifest.unionByName(manifest), raw.where("local_video_id = '1'"))


def test_neighbours_in_many_blocks_are_the_same(spark):
    rnd = random.Random(5)
    rows = spark.createDataFrame([(k, [rnd.gauss(0, 1) for _ in range(4)] if k % 9 else [1.0, 0.0, 0.0, 0.0]) for k in range(120)], "id long, v array<double>")
    asked = rows.where("id % 20 = 0")
    key = lambda df: sorted((r["query"], r["rank"], r["neighbour"]) for r in df.collect())
    assert key(vectors.nearest(asked, rows, "id", "v")) == key(vectors.nearest(asked, rows, "id", "v", query_parts=3, corpus_parts=7))
    assert vectors.cosine_pairs(asked, rows, "id", "v", query_parts=2, corpus_parts=3).count() == 6 * 119


def test_media_below_a_folder_of_the_same_name(spark, tmp_path):
    (tmp_path / "m" / "s1" / "m").mkdir(parents=True)
    (tmp_path / "m" / "s1" / "m" / "1.mp4").write_bytes(b"x")
    assert [(r[0], r[1]) for r in readers.list_media(spark, str(tmp_path / "m")).collect()] == [("s1", "1")]


def test_metadata_and_sample(spark, tmp_path):
    sinks.save_metadata(spark, f"file://{tmp_path}/meta", 0.0, {"rows": 3}, ["a"], {})
    assert json.loads(spark.read.text(f"file://{tmp_path}/meta").first()[0])["counts"] == {"rows": 3}
    df = spark.range(1000)
    ten = {r[0] for r in stats.sample(df.repartition(7), 10, ["id"]).collect()}
    assert ten == {r[0] for r in stats.sample(df, 10, ["id"]).collect()} and ten < {r[0] for r in stats.sample(df, 20, ["id"]).collect()}
