"""Queries of sound measures: embeddings stand for short clips of audio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import sound
from .queries import _query, _rounded, _table

RATE, FRAME, HOP, MELS, COEFFICIENTS, BELOW = 16_000, 32, 8, 6, 5, 3.0
FRAMES_SQL = f"""samples as (select vec_id, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as x from embeddings),
frames as (select e.vec_id, k, j, coalesce(x, 0.0) as x from (select vec_id, unnest(range(0, 1 + len(embedding) // {HOP})) as k from embeddings) e cross join (select unnest(range(0, {FRAME})) as j) w
    left join samples s on s.vec_id = e.vec_id and s.i = k * {HOP} - {FRAME // 2} + j),
energy as (select vec_id, k, sqrt(avg(x * x)) as rms from frames group by all)"""
SPECTRUM_SQL = f"""{FRAMES_SQL}, waves as (select j, b, (0.5 - 0.5 * cos(2 * pi() * j / {FRAME})) * cos(2 * pi() * b * j / {FRAME}) as c, (0.5 - 0.5 * cos(2 * pi() * j / {FRAME})) * sin(2 * pi() * b * j / {FRAME}) as s
    from (select unnest(range(0, {FRAME})) as j) cross join (select unnest(range(0, {FRAME // 2 + 1})) as b)),
spectrum as (select vec_id, k, b, sqrt(pow(sum(x * c), 2) + pow(sum(x * s), 2)) as m from frames join waves using (j) group by all)"""


@_query(f"""with {SPECTRUM_SQL} select vec_id, k::int as frame, round(rms, 6) + 0.0 as rms, round(sum(m * b * {RATE / FRAME}) / sum(m), 4) + 0.0 as centroid from spectrum join energy using (vec_id, k) group by vec_id, k, rms""")
def spectrum_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sound.spectrum_frames(_table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", RATE, FRAME, HOP)
    return _rounded(found.withColumn("centroid", F.round("centroid", 4)))


@_query(f"""with {SPECTRUM_SQL}, edges as (select i, case when mel < 15 then mel * 200 / 3 else 1000 * exp((mel - 15) * ln(6.4) / 27) end as hz
    from (select i, i * (15 + 27 * ln({RATE / 2} / 1000) / ln(6.4)) / {MELS + 1} as mel from (select unnest(range(0, {MELS + 2})) as i))),
bands as (select a.i, b, greatest(0.0, least((b * {RATE / FRAME} - a.hz) / (m.hz - a.hz), (z.hz - b * {RATE / FRAME}) / (z.hz - m.hz))) * 2 / (z.hz - a.hz) as weight
    from edges a join edges m on m.i = a.i + 1 join edges z on z.i = a.i + 2 cross join (select unnest(range(0, {FRAME // 2 + 1})) as b)),
loud as (select vec_id, k, i, 10 * log10(greatest(1e-10, sum(m * m * weight))) as db from spectrum join bands using (b) group by all),
kept as (select vec_id, k, i, greatest(db, max(db) over (partition by vec_id) - 80) as db from loud)
select vec_id, k::int as frame, {", ".join(f"round(sum(db * cos(pi() * {c} * (2 * i + 1) / {2 * MELS})) * sqrt({1 if c == 0 else 2} / {MELS}), 6) + 0.0 as c{c + 1}" for c in range(COEFFICIENTS))} from kept group by vec_id, k""")
def mfcc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sound.mfcc_frames(_table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", RATE, FRAME, HOP, MELS, COEFFICIENTS)
    return _rounded(found.select("vec_id", "frame", *(F.get("mfcc", c).alias(f"c{c + 1}") for c in range(COEFFICIENTS))))


@_query(f"""with {FRAMES_SQL}, power as (select vec_id, k, greatest(1e-10, rms * rms) as p from energy),
loud as (select vec_id, k from (select *, max(p) over (partition by vec_id) as most from power) where 10 * log10(p) - 10 * log10(most) > -{BELOW}),
runs as (select vec_id, min(k) * {HOP} as a, least((max(k) + 1) * {HOP}, 64) as b from (select *, k - row_number() over (partition by vec_id order by k) as g from loud) group by vec_id, g)
select vec_id, string_agg(a || '-' || b, ',' order by a) as regions from runs group by vec_id""")
def speech_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sound.speech_regions(_table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", FRAME, HOP, BELOW)
    return found.select("vec_id", F.concat_ws(",", F.transform("intervals", lambda i: F.concat_ws("-", i["start"], i["end"]))).alias("regions"))
