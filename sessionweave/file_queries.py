"""Queries of readers and sinks over files that they write themselves from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import assemble, frames, media, stats, validate
from .queries import MEDIA_SQL, TEMPORAL_SQL, _frames, _media, _query, _rounded, _segments, _table
from .sources import audio, readers, sinks
from .sources.stages import Stages


@_query("select c_custkey as id, trim(c_name) as name, c_acctbal as balance, null::int as absent from customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV without their array, read again by a schema in another order and with a column that isn't there."""
    path = sinks.scratch_folder(spark, "customers")
    rows = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.array("c_nationkey").alias("dropped"), F.col("c_acctbal").alias("balance"))
    sinks.save_csv(rows, path, ["id"])
    schema = T.StructType().add("id", T.LongType()).add("name", T.StringType()).add("balance", T.DoubleType()).add("absent", T.IntegerType())
    return readers.read_csv(spark, path, schema, ["id", "name", "balance"])


@_query("select event_type as unit, count(*) as frames, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from events group by event_type")
def action_unit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action units as a wide CSV, a column each, read again with other cells as NULL."""
    path = sinks.scratch_folder(spark, "units")
    kinds = [r[0] for r in _table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]
    cells = [F.coalesce(F.when(F.col("event_type") == k, F.col("value")).cast("string"), F.lit("none")).alias(f" AU_{k}") for k in kinds]
    sinks.save_csv(_table(spark, sf_dir, "events").select("event_id", *cells), path)
    units = readers.read_action_units(spark, path)
    long = stats.unpivoted(units, [c for c in units.columns if c.startswith("AU_")]).where("value is not null")
    return _rounded(long.groupBy(F.substr("feature", F.lit(4)).alias("unit")).agg(F.count("*").alias("frames"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))


@_query("select user_id, count(*) as n, 'counted' as rerun from events where value > 50 group by user_id")
def resumed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages, of which a second run with another last step does the last one only."""
    folder = sinks.scratch_folder(spark, "stages")

    def go(stages: Stages, name: str) -> DataFrame:
        read = stages.run("events", lambda: _table(spark, sf_dir, "events").select("user_id", "value"))
        large = stages.run("large", lambda: read.where("value > 50"), {"least": 50})
        return stages.run(name, lambda: large.groupBy("user_id").agg(F.count("*").alias("n")))

    go(Stages(spark, folder), "first")
    again = Stages(spark, folder)
    return go(again, "counted").withColumn("rerun", F.lit(",".join(again.ran)))


@_query("""with x as (select vec_id, greatest(-32768, least(32767, round_even(v * 32768, 0))) / 32768.0 as s from (select vec_id, unnest(embedding)::double as v from embeddings))
select vec_id, count(*) as samples, count(*) / 16000.0::double as duration_sec, round(sqrt(avg(s * s)), 6) as rms, round(max(abs(s)), 6) as peak from x group by vec_id""")
def audio_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips written as 16-bit files by the tasks and loaded again."""
    folder = sinks.scratch_folder(spark, "clips")
    written = audio.write_audio(_table(spark, sf_dir, "embeddings"), folder, "vec_id", "embedding")
    written.write.format("noop").mode("overwrite").save()
    clips = audio.read_audio(spark, folder)
    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1).cast("long").alias("vec_id")
    x = F.transform("audio", lambda v: v.cast("double"))
    rms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size("audio"))
    return _rounded(clips.select(name, F.size("audio").cast("long").alias("samples"), "duration_sec", rms.alias("rms"), F.array_max(F.transform(x, F.abs)).alias("peak")))


@_query("""with q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as m, quantile_cont(value, 0.75) as q3 from events group by event_type),
e as (select event_type, value, q1, m, q3, value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from events join q using (event_type))
select event_type, round(q1, 6) as q1, round(m, 6) as median, round(q3, 6) as q3, count(*) as n, round(min(value) filter (where inside), 6) as low, round(max(value) filter (where inside), 6) as high, count(*) filter (where not inside) as outliers from e group by event_type, q1, m, q3""")
def box_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.box_plot(_table(spark, sf_dir, "events"), "event_type", "value"))


@_query("""with c as (select case when l_quantity >= 40 then 3 when l_quantity >= 25 then 2 when l_quantity >= 10 then 1 else 0 end as x_bin, case when l_discount >= 0.08 then 2 when l_discount >= 0.05 then 1 else 0 end as y_bin
    from lineitem where l_quantity between 1 and 50 and l_discount between 0.02 and 0.1)
select x.b::int as x_bin, y.b::int as y_bin, count(c.x_bin) as n from (select unnest([0, 1, 2, 3]) as b) x cross join (select unnest([0, 1, 2]) as b) y left join c on c.x_bin = x.b and c.y_bin = y.b group by all""")
def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.heat_map(_table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", [1, 10, 25, 40, 50], [0.02, 0.05, 0.08, 0.1])


@_query(f"""with {TEMPORAL_SQL}, g as (select session_id, count(*) as n, count(*) filter (where face_detected = 1) as d, sum(blink)::bigint as b from temporal group by session_id)
select session_id, unnest([format('Frames: {{}}', n), format('Faces detected: {{}}', d), printf('Coverage: %.2f%%', round(d * 100.0::double / n, 2)), printf('Duration: %.2f s', round(n / 25.0::double, 2)), format('Blinks: {{}}', b), printf('Blinks per minute: %.2f', round(b / (n / 25.0::double / 60), 2))]) as line from g""")
def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable summaries, written as text files of one line a measure and read again."""
    summary = frames.session_summary(frames.temporal_features(_frames(spark, sf_dir)), 25.0)
    rounded = summary.withColumns({c: F.round(c, 2) for c in ("face_coverage_percent", "duration_seconds", "blink_rate_per_minute")})
    path = sinks.scratch_folder(spark, "lines")
    sinks.save_records(sinks.session_text(rounded), path)
    return readers.read_records(spark, path, "session_id string, line string")


@_query("select 'documents' as name, count(*)::bigint as n from documents union all select 'labels', count(*) from labels union all select 'features', 2")
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run written as JSON and read again, pinned to what the tables hold."""
    path = sinks.scratch_folder(spark, "metadata")
    counts = {n: _table(spark, sf_dir, n).count() for n in ("documents", "labels")}
    for n, expected in counts.items():
        validate.require_count(_table(spark, sf_dir, n), expected)
    sinks.save_metadata(spark, path, 0.0, counts, ["word_count", "char_count"], {"documents": sf_dir})
    said = readers.read_records(spark, path, "counts map<string,bigint>, features array<string>, runtime_seconds double").where("runtime_seconds > 0")
    return said.select(F.explode(F.map_concat("counts", F.create_map(F.lit("features"), F.size("features").cast("long")))).alias("name", "n"))


@_query(f"""with {MEDIA_SQL}, wrong as (select segment_id, label_idx, vid from pairs union all select segment_id, 0, '1' from (select distinct segment_id from man) union all select segment_id, 99, '99' from (select distinct segment_id from raw)),
n as (select a.segment_id from (select segment_id, count(*) as c from man group by 1) a join (select segment_id, count(*) as c from raw group by 1) b on a.segment_id = b.segment_id and a.c = b.c),
e as (select w.*, count(*) over (partition by w.segment_id, w.label_idx) > 1 as rows_, count(*) over (partition by w.segment_id, vid) > 1 as files_ from wrong w)
select segment_id, label_idx, vid as local_video_id, concat_ws(',', case when rows_ then 'doubled row' end, case when files_ then 'doubled file' end, case when not exists (select 1 from man m where m.segment_id = e.segment_id and m.label_idx = e.label_idx) then 'no such row' end,
    case when not exists (select 1 from raw r where r.segment_id = e.segment_id and r.num::varchar = e.vid) then 'no such file' end, case when segment_id in (select segment_id from n) then 'counts agree' end) as errors from e
where errors <> ''""")
def exception_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions that name pairs of even sources, doubled ones and ones of nothing, each with all that is wrong with it."""
    manifest, raw, exceptions = _media(spark, sf_dir)
    pairs = media.pair_media(manifest, raw, exceptions, check=False).select("segment_id", "label_idx", "local_video_id")
    first = manifest.select("segment_id").distinct().select("segment_id", F.lit(0).alias("label_idx"), F.lit("1").alias("local_video_id"))
    nothing = raw.select("segment_id").distinct().select("segment_id", F.lit(99).alias("label_idx"), F.lit("99").alias("local_video_id"))
    found = media.exception_errors(manifest, raw, pairs.unionByName(first).unionByName(nothing))
    return found.withColumn("errors", F.concat_ws(",", "errors"))


@_query("""with s as (select conv_id::varchar as segment_id, turn::int as label_idx, text, role from conversations)
select segment_id, label_idx, case role when 'user' then 'available' when 'assistant' then 'error' else 'unavailable' end as status, case when role = 'user' then case when length(text) > 120 then substr(text, 1, 120) || '...' else text end end as shown,
    case when role = 'user' then length(text)::int end as word_count, case when role = 'user' then 3 end as dims, case when role = 'user' then round(length(text) / 7.0::double, 6) end as quality, case when role = 'user' then 2 end as units from s""")
def display_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a screen shows of records of which some are there, some failed and some are missing."""
    status = F.when(F.col("role") == "user", "available").when(F.col("role") == "assistant", "error").otherwise("unavailable")
    n = F.length("text")
    scalars = [n.alias("word_count"), (n / 3).alias("avg_word_length"), F.lit(0.5).alias("sentiment_normalized"), F.lit(None).cast("double").alias("msttr_10"), F.array_repeat(F.lit(0.1), 3).alias("labse_embedding")]
    text = F.struct(status.alias("status"), "text", F.struct(*scalars).alias("features"))
    speech = F.struct(status.alias("status"), F.lit(70).alias("feature_dim"), F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.lit(2.0)).alias("features"), F.struct((n / 7).alias("quality_score"), F.lit(0.5).alias("speech_ratio"), F.lit(1.0).alias("snr_estimate")).alias("quality"))
    face = F.struct(status.alias("status"), F.lit(90.0).alias("face_coverage_percent"), F.lit(3).alias("blink_count"), F.lit(4.0).alias("blink_rate_per_minute"), F.struct(F.lit("not_run").alias("status")).alias("openface"), F.create_map(F.lit("AU01"), F.lit(1.0), F.lit("AU02"), F.lit(2.0)).alias("au_statistics"))
    rows = _segments(spark, sf_dir).select("segment_id", "label_idx", assemble.display_text(text).alias("t"), assemble.display_speech(speech).alias("s"), assemble.display_facial(face).alias("f"))
    return _rounded(rows.where("t.status = s.status and s.status = f.status").select("segment_id", "label_idx", "t.status", F.col("t.text_preview").alias("shown"), "t.word_count", F.col("t.labse_dim").alias("dims"), F.col("s.quality_score").alias("quality"), F.col("f.au_count").alias("units")))
