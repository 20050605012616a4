"""The engine's own queries over the driver's tables, with DuckDB SQL for each that SQL can express.

The tables stand in for session data: conversations are segments with text, events are timestamped words, frames, speech intervals
or pitch values of a user, line items are a manifest and its media files or action units, labels are ground truth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry, intervals, scores
from .functions import text as X
from .operators import align, assemble, evaluation, frames, media, speech, stats, validate, vectors
from .plans import text_pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on the order of rows; minus zero becomes zero."""
    return df.withColumns({f.name: F.round(F.col(f.name), digits) + F.lit(0.0) for f in df.schema if f.dataType.typeName() == "double"})


def _seconds(ts: Column) -> Column:
    """Seconds since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")).cast("double") / 1e6


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("segment_id"), F.col("turn").cast("int").alias("label_idx"), "text", "role")


SEGMENTS_SQL = "segments as (select conv_id::varchar as segment_id, turn::int as label_idx, text, role from conversations)"
WORDS_OF = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')"
TOKENS_OF = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_](?:[\p{L}\p{N}_'']*[\p{L}\p{N}_])?')"
#: Text measures of documents: t is the token list, w the words.
MEASURES_SQL = f"""toks as (select doc_id, text, {TOKENS_OF} as t, {WORDS_OF} as w from documents),
measures as (select doc_id, len(w)::int as word_count, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'))::int as char_count,
    case when len(w) > 0 then list_sum(list_transform(w, lambda x: length(x)))::double / len(w) else 0.0 end as avg_word_length,
    len(t)::int as lexical_token_count, len(list_distinct(t))::int as unique_word_count,
    case when len(t) > 0 then len(list_distinct(t))::double / len(t) end as ttr,
    case when len(t) >= 10 then list_avg(list_transform(range(0, len(t) // 10), lambda i: len(list_distinct(t[i * 10 + 1:i * 10 + 10]))::double / 10)) end as msttr_10,
    case when len(t) > 0 then list_avg(list_transform(range(0, len(t), 10), lambda i: len(list_distinct(t[i + 1:i + 10]))::double / least(10, len(t) - i))) end as msttr_10_remainder from toks)"""


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return text_pipeline.lexical_features(text_pipeline.surface_features(docs)).drop("text")


@_query(f"with {MEASURES_SQL} select doc_id, word_count, char_count, round(avg_word_length, 6) as avg_word_length from measures")
def text_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(text_pipeline.surface_features(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


@_query(f"with {MEASURES_SQL} select doc_id, lexical_token_count, unique_word_count, round(ttr, 6) as ttr, round(msttr_10, 6) as msttr_10, round(msttr_10_remainder, 6) as msttr_10_remainder from measures")
def lexical_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(text_pipeline.lexical_features(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


@_query(f"""with {SEGMENTS_SQL}, w as (select *, {WORDS_OF} as w, length(text)::int // 4 as tokens from segments)
select segment_id, label_idx, (case when len(w) = 0 then 0.0 else (case when len(w) < 3 then 0.75 else 1.0 end) * (case when tokens > 256 then 0.5 else 1.0 end) end)::double as quality,
round(case when len(w) > 0 and label_idx > 0 then len(w)::double / label_idx else 0.0 end, 6) as words_per_second,
case when length(text) > 120 then substr(text, 1, 120) || '...' else text end as shown from w""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    out = _segments(spark, sf_dir).select("segment_id", "label_idx", X.text_quality(t, F.expr("length(text) div 4")).alias("quality"), X.speaking_rate(t, F.col("label_idx").cast("double")).alias("words_per_second"), X.preview(t).alias("shown"))
    return _rounded(out)


WORDS_SQL = "words as (select user_id::varchar as source_id, event_id as pos, epoch(ts) as ws, epoch(ts) + 3600 as we, case when event_type = 'error' then 'sp' else event_type end as word from events)"
LABELS_SQL = """labels_ as (select source_id, (row_number() over (partition by source_id order by day) - 1)::int as label_idx, day as s, day + 86400 as e
from (select distinct user_id::varchar as source_id, floor(epoch(ts) / 86400) * 86400 as day from events))"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = _seconds(F.col("ts"))
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("pos"), start.alias("start"), (start + 3600).alias("end"), F.when(F.col("event_type") == "error", "sp").otherwise(F.col("event_type")).alias("word"))


def _day_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _words(spark, sf_dir).select("source_id", (F.floor(F.col("start") / 86400) * 86400.0).alias("start")).distinct()
    return days.select("source_id", (F.row_number().over(Window.partitionBy("source_id").orderBy("start")) - 1).alias("label_idx"), "start", (F.col("start") + 86400).alias("end"))


ALIGN_SQL = f"""with {WORDS_SQL}, {LABELS_SQL}
select l.source_id, label_idx, s as start, e as "end", coalesce(string_agg(word, ' ' order by ws, pos) filter (where word <> 'sp'), '') as text
from labels_ l left join words w on w.source_id = l.source_id and we > s and ws < e group by all"""


@_query(ALIGN_SQL)
def align_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_words(_day_labels(spark, sf_dir), _words(spark, sf_dir))


@_query(ALIGN_SQL)
def align_segments_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_words(_day_labels(spark, sf_dir), _words(spark, sf_dir), bucket_seconds=21_600)


@_query(f"""with words_ as ({WORDS_SQL.removeprefix("words as (").removesuffix(")")}), words as (select source_id, pos, ws, word,
    case word when 'click' then 'infinity'::double when 'view' then ws + 1e10 when 'purchase' then 'nan'::double else we end as we from words_), {LABELS_SQL},
lasting as (select source_id, label_idx, s, e from labels_ union all select source_id, -1, '-infinity'::double, 'infinity'::double from (select distinct source_id from labels_))
select l.source_id, label_idx, coalesce(string_agg(word, ' ' order by ws, pos) filter (where word <> 'sp'), '') as text
from lasting l left join words w on w.source_id = l.source_id and not isnan(we) and we > s and ws < e group by all""")
def align_lasting_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that never end, end in 300 years or have no number as end, and a label for all time beside each source's days."""
    end = F.when(F.col("word") == "click", float("inf")).when(F.col("word") == "view", F.col("start") + 1e10).when(F.col("word") == "purchase", float("nan")).otherwise(F.col("end"))
    days = _day_labels(spark, sf_dir)
    ever = days.select("source_id", F.lit(-1).alias("label_idx"), F.lit(float("-inf")).alias("start"), F.lit(float("inf")).alias("end")).distinct()
    return align.align_words(days.unionByName(ever), _words(spark, sf_dir).withColumn("end", end)).select("source_id", "label_idx", "text")


@_query(f"with {WORDS_SQL} select source_id, string_agg(word, ' ' order by pos) as text from words where word <> 'sp' group by source_id")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.transcripts(_words(spark, sf_dir))


@_query(rf"with {SEGMENTS_SQL} select segment_id, label_idx, trim(regexp_replace(regexp_replace(text, '\bsp\b', ' ', 'g'), '\s+', ' ', 'g')) as text from segments")
def clean_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("segment_id", "label_idx", X.clean_transcript(F.col("text")).alias("text"))


@_query(f"with {SEGMENTS_SQL}, n as (select *, len({TOKENS_OF})::int as token_count from segments) select segment_id, label_idx, token_count, case when token_count <= 64 then 'ready' else 'excluded' end as side from n")
def token_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _segments(spark, sf_dir).select("segment_id", "label_idx", F.size(X.lexical_tokens(F.col("text"))).alias("token_count"))
    ready, excluded = align.split_by_tokens(counted, 64)
    return ready.withColumn("side", F.lit("ready")).unionByName(excluded.withColumn("side", F.lit("excluded")))


#: A parse that stands in for a model's: each token's head is the token at half its place, every seventh token a mark.
@_query(f"""with {SEGMENTS_SQL}, w as (select *, {WORDS_OF} as w from segments), real as (select *, list_filter(range(0, len(w)), lambda i: i % 7 <> 6) as r from w)
select segment_id, label_idx, (case when len(r) > 1 then length(ltrim(bin(list_max(r)), '0')) else 0 end)::int as dependency_tree_depth,
round(case when len(r) > 1 then list_avg(list_transform(list_filter(r, lambda i: i > 0), lambda i: (i - i // 2)::double)) else 0.0 end, 6) as avg_dependency_distance,
len(list_filter(r, lambda i: i > 0))::int as dependency_count from real""")
def dependency_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    parse = F.transform(X.tokens(F.col("text")), lambda _, i: F.struct(i.alias("i"), F.floor(i / 2).cast("int").alias("head"), F.lit(False).alias("is_space"), (i % 7 == 6).alias("is_punct")))
    parsed = _segments(spark, sf_dir).select("segment_id", "label_idx", parse.alias("parse"))
    return _rounded(text_pipeline.complexity_features(parsed).drop("parse"))


EDGES, BINS = [0.0, 100.0, 200.0, 400.0, 800.0, 1e9], ["0-100", "101-200", "201-400", "401-800", "801+"]
BIN_SQL = "case " + " ".join(f"when word_count {'>=' if k == 0 else '>'} {EDGES[k]} and word_count <= {EDGES[k + 1]} then '{b}'" for k, b in enumerate(BINS)) + " end"
BINS_SQL = f"binned as (select *, {BIN_SQL} as bin from measures), bins as (select * from (values {', '.join(f'({k}::int, {chr(39)}{b}{chr(39)})' for k, b in enumerate(BINS))}) v(ordinal, bin))"


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir).withColumn("bin", stats.right_closed_bin(F.col("word_count"), EDGES, BINS, include_lowest=True))


@_query(f"""with {MEASURES_SQL}, {BINS_SQL} select bins.bin, ordinal, count(doc_id) as n, round(avg(ttr), 6) as mean, round(stddev_samp(ttr), 6) as std, round(median(ttr), 6) as median,
round(count(doc_id) * 100.0 / sum(count(doc_id)) over (), 6)::double as share_percent from bins left join binned on bins.bin = binned.bin group by bins.bin, ordinal""")
def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.bin_table(_binned(spark, sf_dir), "bin", BINS, "ttr"))


@_query(f"""with {MEASURES_SQL}, {BINS_SQL} select bins.bin, count(doc_id) as n, round(avg(msttr_10), 6) as mean, round(avg((msttr_10 is not null)::int) filter (where doc_id is not null), 6) as flag_share
from bins left join binned on bins.bin = binned.bin group by bins.bin""")
def bin_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.bin_table(_binned(spark, sf_dir), "bin", BINS, "msttr_10", F.col("msttr_10").isNotNull())).select("bin", "n", "mean", "flag_share")


DESCRIBED = ["word_count", "char_count", "avg_word_length", "ttr", "msttr_10"]


def _each(sql: str) -> str:
    return " union all ".join(sql.format(c=c) for c in DESCRIBED)


@_query(f"with {MEASURES_SQL} " + _each("select '{c}' as feature, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c})::double, 6) as min, round(quantile_cont({c}::double, 0.25), 6) as q25, round(quantile_cont({c}::double, 0.5), 6) as q50, round(quantile_cont({c}::double, 0.75), 6) as q75, round(max({c})::double, 6) as max from measures"))
def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.describe(_measures(spark, sf_dir), DESCRIBED))


@_query(f"with {MEASURES_SQL} " + _each("select '{c}' as feature, count({c}) as valid, count(*) - count({c}) as missing, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std from measures"))
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.feature_summary(_measures(spark, sf_dir), DESCRIBED))


@_query(f"with {MEASURES_SQL} " + _each("select '{c}' as feature, count(*) - count({c}) as missing from measures"))
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.missing_counts(_measures(spark, sf_dir), DESCRIBED)


@_query(f"with {MEASURES_SQL} " + _each("select '{c}' as feature, round(var_samp({c}), 3) as variance from measures"))
def variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.variances(_measures(spark, sf_dir), DESCRIBED), 3)


@_query(" union all ".join(f"select {p}::double as p, round(quantile_cont(value, {p}), 6) as value from events" for p in (0.01, 0.25, 0.5, 0.9, 0.99)))
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.quantiles(_table(spark, sf_dir, "events"), "value", [0.01, 0.25, 0.5, 0.9, 0.99]))


@_query("select event_type as value, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 3) as percent from events group by event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stats.value_counts(_table(spark, sf_dir, "events"), "event_type")
    return counted.withColumn("percent", F.col("percent").cast("double"))


@_query(f"with {MEASURES_SQL}, d as (select abs(msttr_10 - msttr_10_remainder) as d from measures) select round(avg(d), 6) as mean_abs, round(max(d), 6) as max_abs, count(*) filter (where round(d, 12) > 0) as n_different from d")
def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measures(spark, sf_dir).select(F.round("msttr_10", 13).alias("a"), F.round("msttr_10_remainder", 13).alias("b"))
    return _rounded(stats.differences(m.where("a is not null"), "a", "b"))


CORRELATED = ["word_count", "char_count", "unique_word_count", "ttr", "msttr_10"]


@_query(f"with {MEASURES_SQL} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from measures" for k, a in enumerate(CORRELATED) for b in CORRELATED[k + 1 :]))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.correlation_matrix(_measures(spark, sf_dir), CORRELATED))


@_query(f"""with {MEASURES_SQL}, m as (select * from measures where ttr is not null),
r as (select rank() over (order by word_count) + (count(*) over (partition by word_count) - 1) / 2.0 as a, rank() over (order by ttr) + (count(*) over (partition by ttr) - 1) / 2.0 as b from m)
select round(corr(a, b), 6) as rho, count(*) as n from r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.spearman(_measures(spark, sf_dir), "word_count", "ttr"))


@_query(f"""with {MEASURES_SQL}, c as (select corr(ttr, char_count) as ab, corr(ttr, word_count) as ac, corr(char_count, word_count) as bc, count(*) as n from measures where ttr is not null)
select round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) as r, n from c""")
def partial_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.partial_correlation(_measures(spark, sf_dir), "ttr", "char_count", "word_count"))


@_query(f"""with {MEASURES_SQL}, f as (select regr_slope(char_count, word_count) as slope, regr_intercept(char_count, word_count) as intercept, regr_r2(char_count, word_count) as r2 from measures)
select round(slope, 4) as slope, round(intercept, 4) as intercept, round(r2, 4) as r2, round((select stddev_samp(char_count - (intercept + slope * word_count)) from measures), 4) as residual_std from f""")
def ols_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.fit_line(_measures(spark, sf_dir), "char_count", "word_count"), 4)


@_query("""with e as (select min(value) as low, (max(value) - min(value)) / 20 as width from events), b as (select unnest(range(0, 20))::int as bin),
h as (select least(floor((value - low) / width), 19)::int as bin, count(*) as n from events, e where value is not null group by 1)
select b.bin, round(low + b.bin * width, 6) as low, round(low + (b.bin + 1) * width, 6) as high, coalesce(n, 0) as n from b cross join e left join h on h.bin = b.bin""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.histogram(_table(spark, sf_dir, "events"), "value", 20))


FRAMES_SQL = """frames as (select user_id::varchar as session_id, row_number() over (partition by user_id order by ts, event_id)::int as frame_index, (event_type <> 'error')::int as face_detected,
value / 250 as ear, value / 100 as gaze, case when event_type <> 'signup' then value - 50 end as pitch, value * 2 as yaw, value / 3 as roll from events)"""
TEMPORAL_SQL = FRAMES_SQL + """, valid as (select session_id, frame_index, face_detected, case when face_detected = 1 then ear end as ear, case when face_detected = 1 then gaze end as gaze,
    case when face_detected = 1 then pitch end as pitch from frames),
s as (select *, face_detected = 1 and coalesce(ear < 0.21, false) as closed,
    case when pitch is not null then avg(pitch) over (partition by session_id, pitch is not null order by frame_index rows between 4 preceding and current row) end as pitch_smooth,
    case when gaze is not null then avg(gaze) over (partition by session_id, gaze is not null order by frame_index rows between 4 preceding and current row) end as gaze_smooth from valid),
b as (select *, (face_detected = 1 and not closed and coalesce(lag(closed) over (partition by session_id, face_detected order by frame_index), false))::int as blink from s),
temporal as (select *, sum(blink) over (partition by session_id order by frame_index)::bigint as cumulative_blinks,
    case when gaze_smooth is null then 'UNKNOWN' when gaze_smooth < 0.4 then 'LEFT' when gaze_smooth > 0.6 then 'RIGHT' else 'CENTER' end as gaze_label from b)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), index.alias("frame_index"), (F.col("event_type") != "error").cast("int").alias("face_detected"), (v / 250).alias("ear"), (v / 100).alias("gaze"), F.when(F.col("event_type") != "signup", v - 50).alias("pitch"), (v * 2).alias("yaw"), (v / 3).alias("roll"))


@_query(f"with {TEMPORAL_SQL} select session_id, frame_index, blink, cumulative_blinks, round(pitch_smooth, 6) as pitch_smooth, round(gaze_smooth, 6) as gaze_smooth, gaze_label from temporal")
def frame_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.temporal_features(_frames(spark, sf_dir))
    return _rounded(out.select("session_id", "frame_index", "blink", "cumulative_blinks", "pitch_smooth", "gaze_smooth", "gaze_label"))


@_query(f"""with {TEMPORAL_SQL}, g as (select session_id, count(*) as frame_count, count(*) filter (where face_detected = 1) as detected_frames, sum(blink)::bigint as blink_count,
    avg(ear) as ear_mean, stddev_pop(ear) as ear_std, min(ear) as ear_min, max(ear) as ear_max, count(*) filter (where gaze_label = 'LEFT') as gl, count(*) filter (where gaze_label <> 'UNKNOWN') as gt from temporal group by session_id)
select session_id, frame_count, detected_frames, blink_count, round(ear_mean, 6) as ear_mean, round(ear_std, 6) as ear_std, round(ear_min, 6) as ear_min, round(ear_max, 6) as ear_max,
round(detected_frames * 100.0::double / frame_count, 6) as face_coverage_percent, round(frame_count / 25.0::double, 6) as duration_seconds, round(blink_count / (frame_count / 25.0::double / 60), 6) as blink_rate_per_minute,
round(case when gt > 0 then gl * 100.0::double / gt else 0.0 end, 6) as gaze_left_percent from g""")
def face_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.session_summary(frames.temporal_features(_frames(spark, sf_dir)), 25.0)
    return _rounded(out.select("session_id", "frame_count", "detected_frames", "blink_count", "ear_mean", "ear_std", "ear_min", "ear_max", "face_coverage_percent", "duration_seconds", "blink_rate_per_minute", "gaze_left_percent"))


@_query(f"with {FRAMES_SQL} select session_id, frame_index, trunc(frame_index / 30.0::double * 1000)::bigint as timestamp_ms from frames")
def frame_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts", "event_id")
    return frames.frame_clock(events, F.lit(30.0), ["ts", "event_id"]).select("session_id", "frame_index", "timestamp_ms")


def _au_sql(name: str, column: str, paired: bool) -> str:
    presence = "avg((l_discount >= 0.05)::int) * 100" if paired else "null::double"
    return f"select '{name}' as name, round(avg({column}), 6) as mean, round(stddev_pop({column}), 6) as std, round(min({column}), 6) as min, round(max({column}), 6) as max, round(avg(({column} > 0)::int) * 100, 6) as activity_rate, round({presence}, 6) as presence_rate from lineitem"


@_query(" union all ".join([_au_sql("AU01_r", "l_quantity", False), _au_sql("AU02_r", "l_discount", True), _au_sql("AU04_r", "l_tax", False), "select 'AU28_c', null, null, null, null, null, round(avg((l_tax >= 0.04)::int) * 100, 6) from lineitem"]))
def au_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias(" AU01_r"), F.col("l_discount").alias(" AU02_r"), F.col("l_tax").alias("AU04_r "), (F.col("l_discount") >= 0.05).cast("int").alias("AU02_c"), (F.col("l_tax") >= 0.04).cast("int").alias("AU28_c"))
    return _rounded(frames.action_unit_stats(wide))


#: Speech intervals of a user's day: ten minutes from each event, those that touch being one; a day is 86,400 samples.
INTERVALS_SQL = """ev as (select user_id::varchar as session_id, floor(epoch(ts) / 86400)::bigint as day, floor(epoch(ts))::bigint - floor(epoch(ts) / 86400)::bigint * 86400 as s, value from events),
m as (select *, least(s + 600, 86400) as e, max(least(s + 600, 86400)) over (partition by session_id, day order by s, value rows between unbounded preceding and 1 preceding) as prev from ev),
k as (select *, sum((prev is null or s > prev)::int) over (partition by session_id, day order by s, value rows unbounded preceding) as island from m),
iv as (select session_id, day, island, min(s) as s, max(e) as e from k group by all)"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.floor(_seconds(F.col("ts")))
    day = F.floor(second / 86400)
    ev = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), day.alias("day"), (second - day * 86400).alias("s"), "value").withColumn("e", F.least(F.col("s") + 600, F.lit(86400)))
    order = Window.partitionBy("session_id", "day").orderBy("s", "value")
    previous = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ev.withColumn("new", (previous.isNull() | (F.col("s") > previous)).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("session_id", "day", "island").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return islands.groupBy("session_id", "day").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("intervals"))


@_query(f"""with {INTERVALS_SQL}, gaps as (select session_id, day, s - lag(e, 1, 0) over (partition by session_id, day order by s) as gap from iv union all select session_id, day, 86400 - max(e) from iv group by session_id, day),
p as (select session_id, day, count(*) filter (where gap >= 1800) as n, coalesce(sum(gap) filter (where gap >= 1800), 0) as total from gaps group by session_id, day),
c as (select session_id, day, sum(e - s) as speech, count(*) as k from iv group by session_id, day)
select session_id, day, n::double as pause_count, round(total::double, 6) as pause_total_duration, round(case when n > 0 then total::double / n else 0.0 end, 6) as pause_mean_duration, round(n / 86400.0::double, 6) as pause_rate, speech::bigint as speech_samples from p join c using (session_id, day)""")
def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.lit(86400).cast("long")
    found = _intervals(spark, sf_dir).withColumn("p", intervals.pauses(F.col("intervals"), total, rate=1, least_seconds=1800.0))
    return _rounded(found.select("session_id", "day", *intervals.pause_features(F.col("p"), total, rate=1), intervals.speech_samples(F.col("intervals")).alias("speech_samples")))


@_query(f"""with {INTERVALS_SQL}, e as (select session_id, avg(value * value) filter (where value > 20) as sig, avg(value * value) filter (where value <= 20) as noise, count(*) as n, count(*) filter (where value > 20) as sp from ev group by session_id),
q as (select session_id, sp::double / n as ratio, 10 * log10(greatest(coalesce(sig, 1e-9) / (coalesce(noise, 1e-9) + 1e-9), 1e-3)) as snr from e)
select session_id, round(ratio, 6) as speech_ratio, round(snr, 6) as snr_estimate, round(least(greatest(0.4 * ratio + 0.6 / (1 + exp(-0.2 * (snr - 10))), 0), 1), 6) as quality_score from q""")
def speech_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    held = _table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.avg(F.when(v > 20, v * v)).alias("sig"), F.avg(F.when(v <= 20, v * v)).alias("noise"), F.count("*").alias("n"), F.count_if(v > 20).alias("sp"))
    return _rounded(held.select("session_id", scores.audio_quality(F.col("sp"), F.col("n"), F.col("sig"), F.col("noise")).alias("q")).select("session_id", "q.*"))


@_query("""with v as (select user_id::varchar as session_id, case when event_type <> 'error' and value > 0 then value end as f0 from events)
select session_id, round(coalesce(avg(f0), 0), 6) as f0_mean, round(coalesce(stddev_pop(f0), 0), 6) as f0_std, round(coalesce(min(f0), 0), 6) as f0_min, round(coalesce(max(f0), 0), 6) as f0_max,
round(coalesce(max(f0) - min(f0), 0), 6) as f0_range, round(coalesce(stddev_pop(f0) / avg(f0), 0), 6) as f0_variability from v group by session_id""")
def pitch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    voiced = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_type") != "error", F.col("value")).otherwise(0.0).alias("f0"))
    return _rounded(speech.pitch_stats(voiced, ["session_id"]))


#: Line items as a manifest, and as files but for some of the returned ones; numbers come from a total order over all columns used.
_ORDER = "l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax"
MEDIA_SQL = f"""man as (select l_orderkey::varchar as segment_id, (row_number() over (partition by l_orderkey order by {_ORDER}) - 1)::int as label_idx, epoch(l_shipdate) as s, epoch(l_shipdate) + l_quantity as e from lineitem),
raw as (select l_orderkey::varchar as segment_id, row_number() over (partition by l_orderkey order by {_ORDER}) as num, l_quantity + l_tax * 30 as dur, l_linenumber % 2 = 0 as has_audio from lineitem where l_returnflag <> 'R' or l_tax > 0.02),
mr as (select *, row_number() over (partition by segment_id order by s, e, label_idx) - 1 as rk, count(*) over (partition by segment_id) as mc from man),
rr as (select *, num::varchar as vid, row_number() over (partition by segment_id order by num) - 1 as rk, count(*) over (partition by segment_id) as rc from raw),
pairs as (select mr.segment_id, label_idx, vid, mr.rk::int as rk from mr join rr on mr.segment_id = rr.segment_id and mr.rk = rr.rk and mc = rc
    union all select mr.segment_id, label_idx, vid, mr.rk::int from mr join rr on mr.segment_id = rr.segment_id and mr.label_idx = 0 and rr.num = 1 and mc <> rc),
mapped as (select mr.segment_id, mr.label_idx, s, e, p.rk as chronological_rank, p.vid as local_video_id, dur, has_audio, abs(dur - (e - s)) as gap, mc from mr left join pairs p on p.segment_id = mr.segment_id and p.label_idx = mr.label_idx left join rr on rr.segment_id = p.segment_id and rr.vid = p.vid)"""


_HAS_FILE = "l_returnflag <> 'R' or l_tax > 0.02"


def _media(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = _table(spark, sf_dir, "lineitem").withColumn("segment_id", F.col("l_orderkey").cast("string"))
    number = F.row_number().over(Window.partitionBy("segment_id").orderBy(*_ORDER.split(", ")))
    start = _seconds(F.col("l_shipdate"))
    manifest = items.select("segment_id", (number - 1).alias("label_idx"), start.alias("start"), (start + F.col("l_quantity")).alias("end"))
    raw = items.where(_HAS_FILE).select("segment_id", number.cast("string").alias("local_video_id"), (F.col("l_quantity") + F.col("l_tax") * 30).alias("duration_sec"), (F.col("l_linenumber") % 2 == 0).alias("has_audio"))
    raw = raw.withColumn("video_path", F.concat_ws("/", "segment_id", "local_video_id")).withColumn("has_video", F.lit(True))
    counts = items.groupBy("segment_id").agg(F.count("*").alias("rows"), F.count_if(F.expr(_HAS_FILE)).alias("files"))
    exceptions = counts.where("files > 0 and rows <> files").select("segment_id", F.lit(0).alias("label_idx"), F.lit("1").alias("local_video_id"))
    return manifest, raw, exceptions


@_query(f"""with {MEDIA_SQL} select segment_id, label_idx, round(s, 3) as start, round(e, 3) as "end", chronological_rank, local_video_id, case when local_video_id is not null then segment_id || '/' || local_video_id end as video_path,
round(dur, 6) as media_duration_sec, round(e - s, 6) as manifest_duration_sec, round(gap, 6) as duration_difference_sec, local_video_id is not null as has_video, coalesce(has_audio, false) as has_audio, local_video_id is not null as media_available,
case when local_video_id is not null then 'MAPPED' else 'MEDIA_UNAVAILABLE' end as mapping_status, case when gap <= 1 then 'CLOSE' when gap > 1 then 'WARNING' else 'NOT_AVAILABLE' end as duration_validation from mapped""")
def media_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, raw, exceptions = _media(spark, sf_dir)
    out = media.mapped_manifest(media.map_media(manifest, raw, exceptions))
    return _rounded(out.withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3)))


@_query(f"""with {MEDIA_SQL}, n as (select coalesce(a.segment_id, b.segment_id) as segment_id, coalesce(mc, 0) as mc, coalesce(rc, 0) as rc from (select segment_id, count(*) as mc from man group by 1) a full join (select segment_id, count(*) as rc from raw group by 1) b on a.segment_id = b.segment_id)
select m.segment_id, case when local_video_id is not null then 'DURATION_WARNING' when rc = 0 then 'MISSING_RAW_SOURCE' else 'MEDIA_UNAVAILABLE' end as reason, n.mc as manifest_count, n.rc as raw_count, label_idx, local_video_id, round(gap, 6) as duration_difference_sec from mapped m join n on n.segment_id = m.segment_id where local_video_id is null or gap > 1
union all select rr.segment_id, case when n.mc = 0 then 'RAW_ONLY_SOURCE' else 'EXTRA_RAW_MEDIA' end, n.mc, n.rc, null, vid, null from rr join n on n.segment_id = rr.segment_id where not exists (select 1 from pairs p where p.segment_id = rr.segment_id and p.vid = rr.vid)""")
def media_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, raw, exceptions = _media(spark, sf_dir)
    return _rounded(media.mapped_diagnostics(media.map_media(manifest, raw, exceptions, check=False)))


@_query(f"with {MEDIA_SQL} select man.segment_id, man.label_idx, null::varchar as video_path, vid as local_video_id, p.segment_id || '/' || vid as video_path_mapped from man left join pairs p on p.segment_id = man.segment_id and p.label_idx = man.label_idx")
def attach_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, raw, exceptions = _media(spark, sf_dir)
    mapping = media.pair_media(manifest, raw, exceptions, check=False).select("segment_id", "label_idx", "local_video_id", F.concat_ws("/", "segment_id", "local_video_id").alias("video_path"))
    return media.attach_media(media.build_manifest(manifest).select("segment_id", "label_idx", "video_path"), mapping, check=False)


@_query(f"with {MEDIA_SQL} select segment_id, label_idx, round(s, 3) as start, round(e, 3) as \"end\" from man")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = media.build_manifest(_media(spark, sf_dir)[0])
    return built.select("segment_id", "label_idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


#: Truth and a rule's prediction in three classes, and as numbers.
JUDGED_SQL = f"judged as (select l.doc_id, (l.quality + l.toxic)::int as truth, (case when length(text) > 1500 then 2 when length(text) > 600 then 1 else 0 end)::int as said, (l.quality + l.toxic)::double as y, length(text) / 1000.0::double as p from labels l join documents d on d.doc_id = l.doc_id)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    both = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    truth = F.col("quality") + F.col("toxic")
    return both.select("doc_id", truth.cast("int").alias("truth"), F.when(n > 1500, 2).when(n > 600, 1).otherwise(0).alias("said"), truth.cast("double").alias("y"), (n / 1000.0).alias("p"))


@_query(f"with {JUDGED_SQL} select t.truth, p.predicted, count(j.doc_id) as n from (select unnest([0, 1, 2])::int as truth) t cross join (select unnest([0, 1, 2])::int as predicted) p left join judged j on j.truth = t.truth and j.said = p.predicted group by all")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_judged(spark, sf_dir), "truth", "said", [0, 1, 2])


REPORT_SQL = """ls as (select truth as label from j union select said from j), f as (select label, 2.0::double * count(*) filter (where truth = label and said = label) / (count(*) filter (where truth = label) + count(*) filter (where said = label)) as f1 from ls, j group by label)
select round(avg((truth = said)::int), 6) as accuracy, round((select avg(f1) from f), 6) as macro_f1, count(*) as n from j"""


@_query(f"with {JUDGED_SQL}, j as (select * from judged), {REPORT_SQL}")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.classification_report(_judged(spark, sf_dir), "truth", "said"))


@_query(f"with {JUDGED_SQL}, j as (select * from judged where truth <> 1), {REPORT_SQL}")
def binary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.classification_report(evaluation.without_neutral(_judged(spark, sf_dir), "truth"), "truth", "said"))


@_query(f"with {JUDGED_SQL} select doc_id, y, p, round(abs(y - p), 6) as abs_error from judged order by abs(y - p) desc, doc_id limit 20")
def error_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.worst_errors(_judged(spark, sf_dir), "y", "p", ["doc_id"]))


_MODEL_SQL = "select '{m}' as model, round(avg(abs(y - {c})), 6) as mae, round(sqrt(avg((y - {c}) * (y - {c}))), 6) as rmse, round(corr(y, {c}), 6) as pearson, count(*) as n from judged"


@_query(f"with {JUDGED_SQL} {_MODEL_SQL.format(m='length', c='p')} union all {_MODEL_SQL.format(m='steps', c='said')}")
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.compare_models(_judged(spark, sf_dir), "y", {"length": "p", "steps": "said"}))


@_query(f"with {JUDGED_SQL}, r as (select y, p, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as a, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as b from judged) select round(avg(abs(y - p)), 6) as mae, round(sqrt(avg((y - p) * (y - p))), 6) as rmse, round(corr(y, p), 6) as pearson, count(*) as n, round(corr(a, b), 6) as spearman from r")
def continuous_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.continuous_report(_judged(spark, sf_dir), "y", "p"))


@_query("""with s as (select event_id, value / 10 - 3 as v from events) select event_id, round(case when v / 3 between -1 and 1 then v / 3 end, 6) as normalised, case when v < 0 then 'negative' when v > 0 then 'positive' else 'neutral' end as polarity,
(case when v < 0 then -1 when v > 0 then 1 else 0 end)::int as sign, (case when v < 0 then 0 when v > 0 then 2 else 1 end)::int as class from s""")
def polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") / 10 - 3
    named = _table(spark, sf_dir, "events").select("event_id", scores.normalised_sentiment(v).alias("normalised"), scores.polarity(v).alias("polarity"), scores.polarity_class(v).alias("class"))
    return _rounded(named.withColumn("sign", scores.polarity_sign(F.col("polarity"))))


@_query("""with l as (select event_id, [value / 50, 1.0, 2 - value / 40] as x from events), e as (select event_id, list_transform(x, lambda v: exp(v - list_max(x))) as r from l), p as (select event_id, list_transform(r, lambda v: v / list_sum(r)) as q from e)
select event_id, round(q[3] - q[1], 6) as score, (list_position(q, list_max(q)) - 1)::int as predicted from p""")
def softmax_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, names = F.col("value"), ["Negative", "Neutral", "Positive"]
    p = _table(spark, sf_dir, "events").select("event_id", scores.softmax(F.array(v / 50, F.lit(1.0), 2 - v / 40)).alias("p"))
    return _rounded(p.select("event_id", scores.continuous_sentiment(F.col("p"), names).alias("score"), scores.predicted_polarity(F.col("p"), names).alias("predicted")))


@_query("""with a as (select event_id, value / 50 - 1 as a, value / 80 as b from events)
select event_id, round(degrees(atan2(sin(b) * cos(a), cos(b) * cos(a))), 6) + 0.0 as pitch, round(degrees(atan2(sin(a), sqrt(pow(cos(a) * cos(b), 2) + pow(cos(a) * sin(b), 2)))), 6) + 0.0 as yaw, round(degrees(atan2(cos(a) * sin(b), cos(a) * cos(b))), 6) + 0.0 as roll from a""")
def euler_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("value") / 50 - 1, F.col("value") / 80
    zero = F.lit(0.0)
    r = F.array(F.array(F.cos(a) * F.cos(b), zero, zero), F.array(F.cos(a) * F.sin(b), zero, zero), F.array(-F.sin(a), F.sin(b) * F.cos(a), F.cos(b) * F.cos(a)))
    return _rounded(_table(spark, sf_dir, "events").select("event_id", geometry.euler_degrees(r).alias("e")).select("event_id", "e.*"))


#: A face of 478 points whose coordinates follow from the point's number and the event's value.
_X, _Y = "(({k} * 37 + event_id) % 101 + value)", "(({k} * 53 + event_id) % 97 - value / 2)"


def _point_sql(k: int) -> tuple[str, str]:
    return _X.format(k=k), _Y.format(k=k)


def _ear_sql(eye: tuple[int, ...]) -> str:
    d = lambda a, b: f"sqrt(pow({_point_sql(a)[0]} - {_point_sql(b)[0]}, 2) + pow({_point_sql(a)[1]} - {_point_sql(b)[1]}, 2))"
    return f"(({d(eye[1], eye[5])} + {d(eye[2], eye[4])}) / (2 * {d(eye[0], eye[3])}))"


def _side_sql(iris: tuple[int, ...], corners: tuple[int, ...]) -> str:
    a, b = (_point_sql(k)[0] for k in corners)
    return f"case when abs({a} - {b}) > 0 then ((({' + '.join(_point_sql(k)[0] for k in iris)}) / 5.0) - least({a}, {b})) / abs({a} - {b}) end"


@_query(f"with g as (select event_id, ({_ear_sql(geometry.LEFT_EYE)} + {_ear_sql(geometry.RIGHT_EYE)}) / 2 as ear, (({_side_sql(geometry.LEFT_IRIS, geometry.LEFT_CORNERS)}) + ({_side_sql(geometry.RIGHT_IRIS, geometry.RIGHT_CORNERS)})) / 2 as ratio from events) select event_id, round(ear, 5) as ear, round(ratio, 5) as gaze_ratio, case when ratio is null then 'UNKNOWN' when ratio < 0.4 then 'LEFT' when ratio > 0.6 then 'RIGHT' else 'CENTER' end as gaze_label from g")
def eye_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    face = F.transform(F.sequence(F.lit(0), F.lit(477)), lambda k: F.struct(((k * 37 + F.col("event_id")) % 101 + F.col("value")).alias("x"), ((k * 53 + F.col("event_id")) % 97 - F.col("value") / 2).alias("y")))
    marks = _table(spark, sf_dir, "events").select("event_id", face.alias("l"))
    g = marks.select("event_id", geometry.mean_eye_aspect_ratio(F.col("l")).alias("ear"), geometry.gaze_ratio(F.col("l")).alias("gaze_ratio"))
    return _rounded(g.withColumn("gaze_label", geometry.gaze_label(F.col("gaze_ratio"))), 5)


@_query("select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 5) as norm, len(embedding) = 64 and abs(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) - 1) <= 1e-4 as sound from embeddings")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return _rounded(_table(spark, sf_dir, "embeddings").select("vec_id", vectors.norm(e).alias("norm"), validate.embedding_ok(e, 64).alias("sound")), 5)


_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@_query(f"with e as (select vec_id, embedding::double[] as v from embeddings) select a.vec_id as a, b.vec_id as b, round({_COS}, 5) + 0.0 as similarity, round(1 - {_COS}, 5) as distance from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return _rounded(vectors.cosine_pairs(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding"), 5)


@_query(f"with e as (select vec_id, embedding::double[] as v from embeddings), s as (select a.vec_id as query, b.vec_id as neighbour, {_COS} as similarity from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) select query, neighbour, round(similarity, 5) as similarity, rank from (select *, (row_number() over (partition by query order by similarity desc, neighbour))::int as rank from s) where rank <= 5")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return _rounded(vectors.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding"), 5)


@_query()
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, explained = vectors.principal_components(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return _rounded(points.select("vec_id", F.abs(F.get("components", 0)).alias("pc1_abs"), F.abs(F.get("components", 1)).alias("pc2_abs"), F.lit(explained[0]).alias("explained_1"), F.lit(explained[1]).alias("explained_2")))


@_query("""select count(*) filter (where value is null or value < 0) as value_ok, count(*) filter (where event_type is null or event_type not in ('click', 'view', 'purchase', 'signup')) as type_known, count(*) filter (where props is null or length(props) < 2) as props_given from events""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"value_ok": F.col("value") >= 0, "type_known": F.col("event_type").isin("click", "view", "purchase", "signup"), "props_given": F.length("props") >= 2}
    return validate.violations(_table(spark, sf_dir, "events"), rules)


@_query("select count(*) as n_rows, count(*) filter (where l_orderkey is null or l_linenumber is null) as missing_keys, count(*) - count(distinct (l_orderkey, l_linenumber)) as doubled_keys from lineitem")
def key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.key_report(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("""select 'documents' as artifact, count(*)::bigint as n_rows, 0::bigint as missing, 0::bigint as extra from documents
union all select 'labels', count(*), (select count(*) from (select doc_id from documents except select doc_id from labels)), (select count(*) from (select doc_id from labels except select doc_id from documents)) from labels
union all select 'conversations', count(*), (select count(*) from (select doc_id from documents except select conv_id from conversations)), (select count(*) from (select conv_id from conversations except select doc_id from documents)) from conversations""")
def artifact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: _table(spark, sf_dir, n).select(F.col(c).cast("long").alias("doc_id")) for n, c in (("documents", "doc_id"), ("labels", "doc_id"), ("conversations", "conv_id"))}
    return validate.compare_keys(tables, ["doc_id"])


@_query("""with ids as (select conv_id::varchar as segment_id, turn::int as label_idx, role from conversations), t as (select doc_id::varchar as segment_id, quality, toxic from labels),
r as (select i.*, case when t.segment_id is null then 'unavailable' else 'available' end as text, case when i.role = 'user' then 'available' when i.role = 'assistant' then 'error' end as speech from ids i left join t on t.segment_id = i.segment_id)
select segment_id, label_idx, text as text_status, coalesce(speech, 'not_present') as speech_status, case when text in ('available', 'not_applicable') and speech = 'available' then 'PASS' else 'PARTIAL' end as demo_status,
case when speech is null then 'FAIL' else 'PASS' end as validation_status from r""")
def assembled_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _segments(spark, sf_dir).select("segment_id", "label_idx", F.lit("conversations").alias("source_dataset"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    turns = ids.select("segment_id", "label_idx")
    known = turns.join(_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("segment_id"), "quality", "toxic"), "segment_id")
    text = assemble.lookup(turns, known, ["quality", "toxic"]).select("segment_id", "label_idx", F.struct("status", "error", "value").alias("record"))
    spoken = _segments(spark, sf_dir).where("role in ('user', 'assistant')")
    heard = spoken.select("segment_id", "label_idx", F.struct(F.when(F.col("role") == "user", "available").otherwise("error").alias("status")).alias("record"))
    status = lambda name: lambda r: validate.error_array({f"{name} is missing": r.isNull(), f"{name}.status is invalid": r.isNotNull() & ~r["status"].isin(*assemble.STATUSES)})
    out = assemble.with_integration(assemble.assemble(ids, text, heard), checks={"text": status("text"), "speech": status("speech")})
    up = F.col("integration.modality_availability")
    return out.select("segment_id", "label_idx", up["text"].alias("text_status"), up["speech"].alias("speech_status"), assemble.demo_status(F.col("text.status"), F.col("speech.status"), F.lit(None)).alias("demo_status"), F.col("integration.validation_status").alias("validation_status"))


from . import file_queries, record_queries, sound_queries  # noqa: E402, F401  register further queries
