"""Further queries over the driver's tables: speech records, contracts, record checks and small table operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry, intervals, missing, pose, scores, subwords
from .functions import text as X
from .operators import align, assemble, frames, media, speech, stats, validate
from .plans import text_pipeline
from .queries import FRAMES_SQL, INTERVALS_SQL, MEASURES_SQL, SEGMENTS_SQL, TOKENS_OF, WORDS_OF, _frames, _intervals, _measures, _query, _rounded, _segments, _table, _words

_STATS = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}
_COEFFICIENTS = "[" + ", ".join(f"value * {i} - {i * i}" for i in range(1, 14)) + "]"


@_query("with f as (select user_id::varchar as session_id, " + _COEFFICIENTS + " as m from events) select session_id, " + ", ".join(f"round({f}(m[{i}]), 6) as mfcc_{i}_{n}" for i in range(1, 14) for n, f in _STATS.items()) + " from f group by session_id")
def mfcc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    coefficients = F.array(*(F.col("value") * i - i * i for i in range(1, 14)))
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), coefficients.alias("mfcc"))
    return _rounded(speech.mfcc_stats(rows, ["session_id"]))


@_query("select user_id::varchar as session_id, round(avg(value), 6) as rms_mean, round(stddev_pop(value), 6) as rms_std, round(avg(value * 31), 4) as spectral_centroid_mean, round(stddev_pop(value * 31), 4) as spectral_centroid_std from events group by user_id")
def spectrum_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("value").alias("rms"), (F.col("value") * 31).alias("centroid"))
    found = speech.spectrum_stats(rows, ["session_id"])
    return found.select("session_id", *(F.round(c, 6 if c.startswith("rms") else 4).alias(c) for c in found.columns[1:]))


@_query(f"""with {INTERVALS_SQL}, a as (select session_id, day, list(s order by s) as ss, list(e order by s) as es from iv group by session_id, day)
select session_id, day, list_sum(list_transform(range(0, 86400, 7200), lambda t: (len(list_filter(range(1, len(ss) + 1), lambda i: t >= ss[i] and t < es[i])) > 0)::int))::bigint as marked,
(max_gap > 0)::boolean as ordered from (select *, list_min(list_transform(range(1, len(ss) + 1), lambda i: es[i] - ss[i])) as max_gap from a)""")
def speech_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.transform(F.sequence(F.lit(0), F.lit(86399), F.lit(7200)), lambda t: intervals.inside(t, F.col("intervals")).cast("long"))
    broken = intervals.interval_errors(F.col("intervals"), F.lit(86400))
    return _intervals(spark, sf_dir).select("session_id", "day", F.aggregate(points, F.lit(0).cast("long"), lambda s, x: s + x).alias("marked"), (~F.array_contains(broken, "order")).alias("ordered"))


#: Two intervals of an event: the first from a negative start in some, overlapping or too long in others.
@_query("""with i as (select event_id, floor(value)::int - 5 as s1, floor(value)::int + 10 as e1, floor(value * 0.9)::int + 12 as s2, floor(value)::int + event_id % 30 as e2 from events),
e as (select event_id, s1 < 0 or s2 < 0 as a, e1 <= s1 or e2 <= s2 as b, e1 > 100 or e2 > 100 as c, s1 < 0 or s2 < e1 as d from i)
select event_id, array_to_string(list_filter([case when a then 'start' end, case when b then 'order' end, case when c then 'length' end, case when d then 'overlap' end], lambda x: x is not null), ',') as errors from e""")
def interval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, w = F.floor("value").cast("int"), F.floor(F.col("value") * 0.9).cast("int")
    pair = F.array(F.struct((v - 5).alias("start"), (v + 10).alias("end")), F.struct((w + 12).alias("start"), (v + F.col("event_id") % 30).cast("int").alias("end")))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(intervals.interval_errors(pair, F.lit(100)), ",").alias("errors"))


_AUDIO_SQL = "audio as (select vec_id, list_concat(embedding::double[], embedding::double[]) as a, vec_id % 60 as s, vec_id % 60 + 40 as e from embeddings)"


def _audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("vec_id") % 60
    twice = F.concat(F.col("embedding").cast("array<double>"), F.col("embedding").cast("array<double>"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", twice.alias("audio"), F.array(F.struct(s.alias("start"), (s + 40).alias("end"))).alias("intervals"))


@_query(f"with {_AUDIO_SQL}, c as (select vec_id, case when e - s >= 32 then a[s + 1:e] else a end as c, a from audio) select vec_id, len(c)::int as n_samples, round(list_sum(c), 5) as total, round(len(a) / 16.0::double, 6) as duration_seconds, round(list_max(list_transform(a, lambda x: abs(x))), 6) as peak, round(sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)), 6) as rms from c")
def speech_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _audio(spark, sf_dir).select("vec_id", intervals.speech_audio(F.col("audio"), F.col("intervals"), 32).alias("c"), intervals.audio_summary(F.col("audio"), 16).alias("s"))
    total = F.aggregate("c", F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.size("c").alias("n_samples"), F.round(total, 5).alias("total"), *(F.round(F.col(f"s.{c}"), 6).alias(c) for c in ("duration_seconds", "peak", "rms")))


@_query("select event_id, round(case when event_id % 5 = 0 or event_type = 'view' or value = 0 then 0.0 else (event_id % 7) / value end, 6) as zero_filled, value > 10 as positive from events")
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = F.when(F.col("event_id") % 5 == 0, 0.0).when(F.col("event_type") == "view", None).otherwise(F.col("value"))
    return _rounded(_table(spark, sf_dir, "events").select("event_id", missing.ratio_or_zero(F.col("event_id") % 7, below).alias("zero_filled"), missing.is_positive(F.col("value") - 10).alias("positive")))


@_query("select event_type, count(*) as n, count(*) filter (where try_cast(replace(value::varchar, '.', event_type[1:1]) as double) is not null) as finite from events group by event_type")
def finite_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.replace(F.col("value").cast("string"), F.lit("."), F.substring("event_type", 1, 1))
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(missing.is_finite(cell)).alias("finite"))


@_query("select vec_id, round(embedding[1]::double, 5) as sentiment, round(embedding[7]::double, 5) as fear, len(list_filter(embedding[2:7], lambda x: x > 0))::int as positive from embeddings")
def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.slice(F.col("embedding").cast("array<double>"), 1, 7)
    named = _table(spark, sf_dir, "embeddings").select("vec_id", *scores.label_columns(label), scores.positive_labels(label).alias("positive"))
    return _rounded(named.select("vec_id", "sentiment", "fear", "positive"), 5)


#: A chain of heads: every token hangs on the one before, so depth grows with the text.
@_query(f"with w as (select doc_id, {WORDS_OF} as w from documents), r as (select doc_id, list_filter(range(0, len(w)), lambda i: i % 7 <> 6) as r from w) select doc_id, (case when len(r) > 1 then list_max(r) else 0 end)::int as dependency_tree_depth, (case when len(r) > 1 then 1.0 else 0.0 end)::double as avg_dependency_distance from r")
def dependency_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    parse = F.transform(X.tokens(F.col("text")), lambda _, i: F.struct(i.alias("i"), F.greatest(i - 1, F.lit(0)).alias("head"), F.lit(False).alias("is_space"), (i % 7 == 6).alias("is_punct")))
    parsed = _table(spark, sf_dir, "documents").select("doc_id", parse.alias("parse"))
    return text_pipeline.complexity_features(parsed).select("doc_id", "dependency_tree_depth", "avg_dependency_distance")


@_query(f"with t as (select len({WORDS_OF}) - len({TOKENS_OF}) as difference from documents) select difference::int as difference, count(*) as n from t group by 1")
def token_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.token_differences(_measures(spark, sf_dir), "word_count", "lexical_token_count")


@_query(f"with {MEASURES_SQL} select msttr_10 is not null as available, count(*) as n, round(avg(word_count), 6) as mean, round(stddev_samp(word_count), 6) as std, min(word_count)::double as min, max(word_count)::double as max from measures group by 1")
def by_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.by_availability(_measures(spark, sf_dir), "msttr_10", "word_count"))


@_query("select l_orderkey, l_linenumber, l_partkey, l_quantity from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_quantity) as r from lineitem) where r = 1")
def first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return stats.first_by_key(items, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity"])


@_query("select distinct p_type as value from part where p_type is not null order by 1")
def unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unique_values(_table(spark, sf_dir, "part"), "p_type")


@_query()
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sample(_table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, ["doc_id"])


@_query("select user_id::varchar as source_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as label_idx, round(epoch(ts), 3) as start, round(epoch(ts) + 1, 3) as \"end\", value from events")
def enumerate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir).select("source_id", "start", "pos").join(_table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), "value"), "pos")
    held = F.transform(F.array_sort(F.collect_list(F.struct("start", "pos", "value"))), lambda x: F.struct(x["start"].alias("start"), (x["start"] + 1).alias("end"), x["value"].alias("label")))
    found = align.enumerate_labels(rows.groupBy("source_id").agg(held.alias("intervals")))
    return found.select("source_id", "label_idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.col("label").alias("value"))


@_query("select user_id::varchar as source_id, event_id as pos, trim(event_type) as word from events")
def decoded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" ").cast("binary"), F.col("event_type").cast("binary"), F.lit("\n").cast("binary"))
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("pos"), X.decoded(raw).alias("word"))


#: The seventy features of a user: simple functions of the events' mean; some users' are broken on purpose.
RECORDS_SQL = """recs as (select user_id, avg(value) as m, count(*) as n from events group by user_id), speech as (select user_id::varchar as session_id, user_id, m, n, (user_id % 11 = 3) as bad_feature, (user_id % 13 = 5) as bad_quality from recs)"""


def _speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    bad = F.when(F.col("user_id") % 11 == 3, float("nan")).otherwise(F.col("m"))
    quality = F.struct((F.col("n") / F.col("n")).alias("speech_ratio"), F.col("m").alias("snr_estimate"), F.when(F.col("user_id") % 13 == 5, 1.5).otherwise(0.5).alias("quality_score"))
    named = {n: (bad if k == 0 else F.col("m") + k).alias(n) for k, n in enumerate(speech.FEATURES)}
    ids = [F.col("user_id").cast("string").alias(c) for c in ("participant_id", "session_id", "segment_id")]
    return held.select(*ids, F.lit(0).alias("label_idx"), F.lit(0.0).alias("start"), F.when(F.col("user_id") % 17 == 2, 0.0).otherwise(1.0).alias("end"), *named.values(), quality.alias("quality"))


@_query(f"with {RECORDS_SQL} select session_id, concat_ws(',', case when bad_feature then 'features aren''t finite' end, case when bad_quality then 'quality_score outside [0, 1]' end) as errors, 70 as n_features, round(m + 69, 4) as last_feature from speech")
def speech_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _speech(spark, sf_dir)
    records = speech.speech_records(rows, "events").join(rows.select("session_id", "quality"), "session_id")
    found = records.select("session_id", F.array_join(validate.speech_errors(F.col("features"), F.col("quality")), ",").alias("errors"), F.size("features").alias("n_features"), F.element_at("features", speech.FEATURES[-1]).alias("last_feature"))
    return _rounded(found, 4)


@_query(f"with {RECORDS_SQL} select session_id, round(case when bad_feature then null else m end, 3) as mfcc_1_mean, round(m + 52, 3) as f0_mean, round(m + 60, 3) as hnr_mean from speech")
def speech_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = speech.speech_records(_speech(spark, sf_dir), "events").select("session_id", assemble.speech_summary(F.col("features")).alias("s"))
    return shown.select("session_id", *(F.round(F.col(f"s.{c}"), 3).alias(c) for c in ("mfcc_1_mean", "f0_mean", "hnr_mean")))


@_query(f"with {RECORDS_SQL} select session_id, round(m + 1, 3) as mfcc_1_std, round(m + 69, 3) as spectral_centroid_std from speech")
def widened_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = speech.widened(speech.speech_records(_speech(spark, sf_dir), "events"), ["session_id"])
    return wide.select("session_id", F.round("mfcc_1_std", 3).alias("mfcc_1_std"), F.round("spectral_centroid_std", 3).alias("spectral_centroid_std"))


@_query(f"""with {RECORDS_SQL} select session_id, concat_ws(',', case when user_id % 19 = 4 then 'source_dataset is empty' end, case when bad_quality then 'quality_score outside [0, 1]' end,
case when user_id % 17 = 2 then 'times are wrong' end, case when bad_feature then 'features aren''t finite' end) as errors from speech""")
def common_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = speech.speech_records(_speech(spark, sf_dir), "events").withColumn("modality", F.lit("speech"))
    rows = rows.withColumn("source_dataset", F.when(F.col("session_id").cast("long") % 19 == 4, " \n").otherwise(F.col("source_dataset")))
    return rows.select("session_id", F.array_join(validate.common_record_errors(), ",").alias("errors"))


@_query("""with e as (select vec_id, embedding::double[] as v, label from embeddings)
select vec_id, concat_ws(',', case when vec_id % 10 = 1 then 'empty' end, case when label % 2 = 1 then 'rate' end, case when vec_id % 10 = 2 then 'not finite' end) as errors from e""")
def audio_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    audio = F.when(F.col("vec_id") % 10 == 1, F.array().cast("array<double>")).when(F.col("vec_id") % 10 == 2, F.array_append(v, F.lit(float("nan")))).otherwise(v)
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", audio.alias("a"), F.when(F.col("label") % 2 == 1, 8000).otherwise(16_000).alias("rate"))
    return rows.select("vec_id", F.array_join(validate.audio_errors(F.col("a"), F.col("rate")), ",").alias("errors"))


@_query(f"""with {FRAMES_SQL}, f as (select session_id, count(*) as n, count(*) filter (where face_detected = 1 and pitch is null) as bad_pitch, count(*) filter (where face_detected = 1) as d from frames group by session_id)
select session_id, concat_ws(',', case when session_id::int % 5 = 0 then 'frame count differs' end, case when bad_pitch > 0 then 'pitch isn''t finite on a detected frame' end, case when session_id::int % 7 = 0 then 'fps isn''t positive' end,
case when session_id::int % 3 = 0 then 'openface status isn''t explicit' end) as errors from f""")
def video_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir)
    summary = frames.session_summary(frames.temporal_features(rows), 25.0)
    number = F.col("session_id").cast("int")
    summary = summary.select(
        "session_id", F.when(number % 5 == 0, -1).otherwise(F.col("frame_count")).alias("frame_count"), "face_coverage_percent", "ear_mean", "pitch_mean",
        F.when(number % 7 == 0, 0.0).otherwise(25.0).alias("fps"), F.struct(F.lit("face_detection_coverage_percent").alias("metric"), F.col("face_coverage_percent").alias("value")).alias("quality_indicator"),
        F.when(number % 3 == 0, "unknown").otherwise("not_run").alias("openface_status"),
    )
    return validate.video_errors(summary, rows).select("session_id", F.array_join("errors", ",").alias("errors"))


_FINAL_SQL = f"""final as (select conv_id::varchar as segment_id, turn::int as label_idx, {WORDS_OF} as w, {TOKENS_OF} as t, text from conversations)"""


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _segments(spark, sf_dir)
    parse = F.transform(X.tokens(F.col("text")), lambda _, i: F.struct(i.alias("i"), F.floor(i / 2).cast("int").alias("head"), F.lit(False).alias("is_space"), F.lit(False).alias("is_punct")))
    whole = turns.withColumns({"start": F.col("label_idx") * 2.0, "end": F.col("label_idx") * 2.0 + 1, "parse": parse, "label": F.array((F.col("label_idx") % 8 - 3).cast("double")), "labse_embedding": F.array_repeat(F.lit(0.125).cast("float"), 64)})
    return text_pipeline.final_features(whole)


@_query(f"with {_FINAL_SQL} select segment_id, label_idx, len(w)::int as word_count, round(case when abs(label_idx % 8 - 3) <= 3 then (label_idx % 8 - 3) / 3.0 end, 4)::double as sentiment, (case when len(w) > 1 then length(ltrim(bin(len(w) - 1), '0')) else 0 end)::int as dependency_tree_depth, 64 as dimensions from final")
def final_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir).select("segment_id", "label_idx", "word_count", F.round(F.col("sentiment_normalized").cast("double"), 4).alias("sentiment"), "dependency_tree_depth", F.size("labse_embedding").alias("dimensions"))


@_query(f"with {_FINAL_SQL} select 0::bigint as embedding, count(*) filter (where abs(label_idx % 8 - 3) > 3) as sentiment, 0::bigint as word_count, count(*) filter (where regexp_full_match(text, '\\s*')) as text from final")
def feature_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.violations(_final(spark, sf_dir), validate.feature_table_rules(64, strict=True)).select("embedding", "sentiment", "word_count", "text")


@_query("select count(*) filter (where c_custkey is null) as missing_keys, count(*) - count(distinct c_nationkey) as doubled_keys, count(*) filter (where c_acctbal <= 0) as bad_intervals from customer")
def manifest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("segment_id"), F.lit(0).alias("label_idx"), F.lit(0.0).alias("start"), F.col("c_acctbal").alias("end"))
    return media.manifest_errors(rows)


@_query("""with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r from orders)
select count(*) - count(distinct o_custkey) as doubled_rows, (count(*) filter (where r > 1)) - count(distinct o_custkey) filter (where r > 1) as doubled_files, 0::bigint as wrong_availability, count(*) filter (where r = 2) as wrong_status, count(*) filter (where r > 2) as missing_paths from o""")
def mapping_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("segment_id"), F.lit(0).alias("label_idx"), r.alias("r"))
    taken = F.col("r") > 1
    mapped = rows.select("segment_id", "label_idx", F.when(taken, "1").alias("local_video_id"), taken.alias("media_available"), F.when(F.col("r") > 2, "MAPPED").otherwise("MEDIA_UNAVAILABLE").alias("mapping_status"), F.when(F.col("r") == 2, "p").alias("video_path"))
    return media.mapping_errors(mapped)


#: Whole records, each kind broken in some: the real checks of text, speech and facial parts, and of their alignment.
@_query("""select conv_id::varchar as segment_id, turn::int as label_idx,
concat_ws(';', case when turn % 5 = 1 then 'text.feature_dim must be 774' end, case when turn % 5 = 2 then 'text.labse_embedding has a wrong size' end, case when role = 'system' then 'speech is missing' end,
case when turn % 11 = 4 then 'facial.openface.status is invalid' end) as validation_errors, case when turn % 13 = 6 then 'facial segment_id differs' else '' end as alignment_errors,
case when turn % 13 = 6 then 'FAIL' else 'PASS' end as alignment_status from conversations""")
def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("label_idx")
    ids = _segments(spark, sf_dir).select("segment_id", "label_idx", F.lit("conversations").alias("source_dataset"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    keys = _segments(spark, sf_dir).select("segment_id", "label_idx", "role")
    scalars = ("sentiment_normalized", "word_count", "avg_word_length", "dependency_tree_depth", "avg_dependency_distance")
    size = F.when(turn % 5 == 2, 3).otherwise(768)
    text = F.struct(F.lit("available").alias("status"), F.when(turn % 5 == 1, 5).otherwise(774).alias("feature_dim"), F.struct(*(F.lit(0.5).alias(c) for c in scalars), F.array_repeat(F.lit(0.1), size).alias("labse_embedding")).alias("features"))
    said = F.struct(F.lit("available").alias("status"), F.lit(70).alias("feature_dim"), F.map_from_arrays(F.array(*map(F.lit, speech.FEATURES)), F.array_repeat(F.lit(1.0), 70)).alias("features"), F.struct(F.lit(0.5).alias("quality_score"), F.lit(0.5).alias("speech_ratio"), F.lit(1.0).alias("snr_estimate")).alias("quality"))
    face = F.struct(
        F.lit("available").alias("status"), F.lit(90.0).alias("face_coverage_percent"), F.struct(F.when(turn % 11 == 4, "maybe").otherwise("not_run").alias("status")).alias("openface"),
        F.create_map().cast("map<string,double>").alias("au_statistics"), F.struct(F.lit(0.3).alias("mean")).alias("ear_statistics"), F.when(turn % 13 == 6, "other").otherwise(F.col("segment_id")).alias("segment_id"), turn.alias("label_idx"),
    )
    record = lambda c, where="true": keys.where(where).select("segment_id", "label_idx", c.alias("record"))
    whole = assemble.with_integration(assemble.assemble(ids, record(text), record(said, "role <> 'system'"), record(face)), facial_names_segment=True)
    i = F.col("integration")
    return whole.select("segment_id", "label_idx", F.array_join(i["validation_errors"], ";").alias("validation_errors"), F.array_join(i["alignment_errors"], ";").alias("alignment_errors"), i["alignment_status"].alias("alignment_status"))


@_query(f"""with {SEGMENTS_SQL}, d as (select *, {WORDS_OF} as w, {TOKENS_OF} as t, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as c from segments)
select segment_id, label_idx, case when length(c) > 0 then 'available' else 'unavailable' end as status, case when length(c) > 0 then length(c) end as transcript_length, case when length(c) > 0 then len(w) end as word_count,
round(case when len(t) >= 10 then list_avg(list_transform(range(0, len(t) // 10), lambda i: len(list_distinct(t[i * 10 + 1:i * 10 + 10]))::double / 10)) end, 6) as msttr_10, case when length(c) > 0 then 'not_computed' end as sentiment from d""")
def demo_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _segments(spark, sf_dir).select("segment_id", "label_idx", assemble.demo_text(F.col("text")).alias("d"))
    return _rounded(shown.select("segment_id", "label_idx", "d.status", F.col("d.transcript_length").cast("long").alias("transcript_length"), F.col("d.word_count").cast("long").alias("word_count"), "d.msttr_10", F.col("d.sentiment_normalized.status").alias("sentiment")))


@_query('''select event_id, '{"a":' || floor(value)::bigint || ',"b":' || case when event_type = 'view' then 'null' else '"' || event_type || '"' end || '}' as record from events''')
def records_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct(F.floor("value").alias("a"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("b"))
    return _table(spark, sf_dir, "events").select("event_id", assemble.as_json(record).alias("record"))


@_query("select 'label' as pair, round(corr(quality, toxic), 6) as r, count(*) as n, round(corr(quality, toxic) * sqrt((count(*) - 2) / (1 - corr(quality, toxic) ** 2)), 4) as t, true as small from labels")
def correlation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, its t, and whether the p-value lies where t says: beyond |t| = 3.3 it is below 0.002, within 1.9 above 0.04."""
    found = _table(spark, sf_dir, "labels").agg(F.corr("quality", "toxic").alias("r"), F.count("*").alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.pow("r", 2)))
    with_p = found.select("r", "n", t.alias("t"), stats.p_value(F.col("r"), F.col("n")).alias("p"))
    fits = F.when(F.abs("t") > 3.3, F.col("p") < 0.002).when(F.abs("t") < 1.9, F.col("p") > 0.04).otherwise(F.col("p").between(0.0005, 0.1))
    return with_p.select(F.lit("label").alias("pair"), F.round("r", 6).alias("r"), "n", F.round("t", 4).alias("t"), fits.alias("small"))


#: Degrees of freedom are whole, so Student's distribution has a closed sum: of powers of the squared cosine, the sine being |r|.
_P_SQL = """with every as (select lang, covar_pop(quality, length(text)) / nullif(stddev_pop(quality) * stddev_pop(length(text)), 0) as r, count(*) as n from labels join documents using (doc_id) group by lang
    union all select 'all', covar_pop(quality, toxic) / nullif(stddev_pop(quality) * stddev_pop(toxic), 0), count(*) from labels),
c as (select * from every where n > 2 and abs(r) < 1 - 1e-9),
t as (select lang, r, n, n - 2 as v, unnest(range(0, (n - 2 + (n % 2)) // 2)) as j from c),
s as (select lang, r, n, v, j, case when j = 0 then 0 when v % 2 = 0 then ln((2 * j - 1) / (2.0::double * j)) else ln(2 * j / (2.0::double * j + 1)) end as step from t),
p as (select lang, r, n, v, exp(sum(step) over (partition by lang order by j) + j * ln(1 - r * r)) as term, j from s where v % 2 = 0 or j < (v - 1) // 2)
select lang, round(r, 6) + 0.0 as r, n, round(1 - case when v % 2 = 0 then abs(r) * sum(term) else 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * sum(term)) end, 6) + 0.0 as p from p group by lang, r, n, v"""


@_query(_P_SQL)
def correlation_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents")
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("r")  # noqa: E731  corr fails where a value never changes
    by_lang = labels.join(docs, "doc_id").withColumn("size", F.length("text")).groupBy("lang").agg(r("quality", "size"), F.count("*").alias("n"))
    found = by_lang.unionByName(labels.agg(r("quality", "toxic"), F.count("*").alias("n")).withColumn("lang", F.lit("all"))).where("n > 2 and abs(r) < 1 - 1e-9")
    return _rounded(found.select("lang", "r", "n", stats.p_value(F.col("r"), F.col("n")).alias("p")))


#: Angles in degrees that follow from an event's value and number.
_ANGLES = {"pitch": "50 * sin(value)", "yaw": "60 * cos(value)", "roll": "cast(event_id % 37 - 18 as double)"}


@_query("select event_id, " + ", ".join(f"round({x}, 4) + 0.0 as {n}" for n, x in _ANGLES.items()) + " from events")
def head_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model heads turned by known angles and projected; the angles are found again."""
    events = _table(spark, sf_dir, "events")
    a, b, c = (F.radians(F.expr(x)) for x in _ANGLES.values())
    sin, cos = F.sin, F.cos
    r = [[cos(c) * cos(b), cos(c) * sin(b) * sin(a) - sin(c) * cos(a), cos(c) * sin(b) * cos(a) + sin(c) * sin(a)], [sin(c) * cos(b), sin(c) * sin(b) * sin(a) + cos(c) * cos(a), sin(c) * sin(b) * cos(a) - cos(c) * sin(a)], [-sin(b), cos(b) * sin(a), cos(b) * cos(a)]]
    at = [[sum(r[i][k] * x for k, x in enumerate(point)) + shift for i, shift in enumerate((30.0, -20.0, 1500.0))] for point in pose.MODEL]
    width, height = F.lit(1280), F.lit(720)
    flat = [v for x, y, z in at for v in (1280 * x / z + 640, 1280 * y / z + 360)]
    found = events.select("event_id", geometry.euler_degrees(pose.rotation(F.array(*flat), width, height)).alias("e")).select("event_id", "e.*")
    return _rounded(found, 4)


@_query("""select event_id, round(degrees(case when value > 50 then atan2(sin(value), cos(value)) else atan2(-sin(value), cos(value)) end), 6) + 0.0 as pitch,
    (case when value > 50 then 90.0 else -90.0 end)::double as yaw, 0.0::double as roll from events""")
def gimbal_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads turned aside by a right angle, where roll can't be told from pitch."""
    v, side = F.col("value"), F.when(F.col("value") > 50, 1.0).otherwise(-1.0)
    zero = F.lit(0.0)
    r = F.array(F.array(zero, F.sin(v), side * F.cos(v)), F.array(zero, F.cos(v), -side * F.sin(v)), F.array(-side, zero, zero))
    return _rounded(_table(spark, sf_dir, "events").select("event_id", geometry.euler_degrees(r).alias("e")).select("event_id", "e.*"))


_PIECES = [("", 1, 3), ("", 1, 2), ("", 1, 1), (subwords.LATER, 4, 2), (subwords.LATER, 6, 2), (subwords.LATER, 3, 1), (subwords.LATER, 5, 1)]


@_query(f"""with recursive words as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{subwords._WORD}')) as word from documents),
vocabulary as ({" union ".join(f"select '{p}' || substr(word, {a}, {n}) as piece from words where length(word) >= {a + n - 1} and length(word) < 9" for p, a, n in _PIECES)}),
cut as (select word, 1 as pos, 0 as n from (select distinct word from words) where length(word) <= {subwords.MOST} union all
    select word, pos + step, n + 1 from (select word, pos, n, case when pos = 1 and length(word) >= 3 and substr(word, 1, 3) in (select piece from vocabulary) then 3
        when pos = 1 and length(word) >= 2 and substr(word, 1, 2) in (select piece from vocabulary) then 2 when pos = 1 and substr(word, 1, 1) in (select piece from vocabulary) then 1
        when pos > 1 and length(word) > pos and '{subwords.LATER}' || substr(word, pos, 2) in (select piece from vocabulary) then 2
        when pos > 1 and '{subwords.LATER}' || substr(word, pos, 1) in (select piece from vocabulary) then 1 else 0 end as step from cut where pos <= length(word)) where step > 0),
counts as (select word, max(n) filter (where pos > length(word)) as n from cut group by word)
select d.doc_id, (2 + coalesce(sum(case when w.word is null then 0 else coalesce(n, 1) end), 0))::int as token_count from documents d left join (words left join counts using (word)) w on w.doc_id = d.doc_id and w.word is not null group by d.doc_id""")
def subword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents over a vocabulary made of short words' parts."""
    docs = _table(spark, sf_dir, "documents")
    words = docs.select(F.explode(subwords.words_of(F.col("text"))).alias("w")).distinct().where("length(w) < 9")
    parts = F.array(*(F.when(F.length("w") >= a + n - 1, F.concat(F.lit(p), F.substr("w", F.lit(a), F.lit(n)))) for p, a, n in _PIECES))
    return subwords.subword_counts(docs, ["doc_id"], "text", words.select(F.explode(parts).alias("piece")))


@_query("""with t as (select doc_id, concat(chr(160), text, chr(8195), chr(160), lang, chr(10)) as text from documents)
select doc_id, length(regexp_replace(text, '^[\\s\\x{00A0}\\x{2003}]+|[\\s\\x{00A0}\\x{2003}]+$', '', 'g'))::int as char_count, len(list_filter(string_split_regex(text, '[\\s\\x{00A0}\\x{2003}]+'), lambda w: w <> ''))::int as word_count from t""")
def unicode_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts between no-break and wide spaces, which are white space as any other."""
    text = F.concat(F.lit("\u00a0"), "text", F.lit("\u2003\u00a0"), "lang", F.lit("\n"))
    return text_pipeline.surface_features(_table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).select("doc_id", "char_count", "word_count")
