"""Tables and media listings by explicit schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import finite_or_null
from ..operators.validate import require_columns
from ..schemas import PROBE, RAW_MEDIA, Settings


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Also stands for earlier pickled artifacts, which have to be converted once."""
    df = spark.read.parquet(path)
    return require_columns(df, columns).select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None, strict: bool = False) -> DataFrame:
    """CSV with a header in any column order; columns of the schema that aren't required may be absent and are NULL then. A cell
    that is not of its column's type is NULL, or with `strict` fails the read."""
    header = spark.read.option("header", True).csv(path).columns
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path).toDF(*(c.strip().lstrip("﻿") for c in header))
    require_columns(raw, list(schema.names if required is None else required))
    typed = lambda c, f: c.cast(f.dataType) if strict else c.try_cast(f.dataType)
    return raw.select(*(typed(F.col(f.name) if f.name in raw.columns else F.lit(None), f).alias(f.name) for f in schema))


def read_action_units(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV of action units with doubles; byte-order marks and spaces in names are dropped, other cells are NULL."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    return named.select(*(finite_or_null(F.col(c)).alias(c) if c.startswith("AU") else F.col(c) for c in named.columns))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Word or label sequences kept as Parquet: one row per source with arrays `intervals` and `features`, as rows by position.

    Sources without both arrays are left out. Byte strings are decoded.
    """
    df = require_columns(spark.read.parquet(path), ["source_id", "intervals", "features"]).where("intervals is not null and features is not null")
    both = df.select("source_id", F.posexplode(F.arrays_zip("intervals", "features")).alias("pos", "x"))
    feature = F.col("x.features")
    inner = both.schema["x"].dataType["features"].dataType
    if isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.BinaryType):
        feature = F.transform(feature, lambda b: F.trim(F.decode(b, "UTF-8")))
    return both.select("source_id", "pos", F.get("x.intervals", 0).alias("start"), F.get("x.intervals", 1).alias("end"), feature.alias("features"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON text a row, by schema; a text that isn't JSON fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def list_media(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """(segment_id, local_video_id, video_path) of files below path: the first folder and the file's name without its ending.

    Only names are read, not contents. Files directly in path are left out.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("video_path"))
    root = "/" + path.split("://")[-1].strip("/") + "/"
    inner = F.substr(F.col("video_path"), F.locate(root, F.col("video_path")) + len(root))  # the first place: the name may recur below
    parts = F.split(inner, "/")
    return listed.where(F.size(parts) >= 2).select(parts[0].alias("segment_id"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("local_video_id"), "video_path").orderBy("video_path")


def parse_probe(text: Column) -> Column:
    """A media probe's JSON as a struct of the index's columns: first video and audio stream, duration of file else of video."""
    p = F.from_json(text, PROBE)
    first = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), 0)
    video, audio = first("video"), first("audio")
    rate = F.split(video["r_frame_rate"], "/")
    fps = F.try_divide(rate[0].try_cast("double"), F.nullif(F.coalesce(F.get(rate, 1).try_cast("double"), F.lit(1.0)), F.lit(0.0)))
    return F.struct(
        F.coalesce(p["format"]["duration"].try_cast("double"), video["duration"].try_cast("double")).alias("duration_sec"),
        video.isNotNull().alias("has_video"), audio.isNotNull().alias("has_audio"), video["width"].alias("width"), video["height"].alias("height"),
        fps.alias("fps"), video["codec_name"].alias("video_codec"), audio["codec_name"].alias("audio_codec"), audio["sample_rate"].alias("sample_rate"), audio["channels"].alias("channels"),
    )


def index_media(files: DataFrame, probe: Callable[[str], str]) -> DataFrame:
    """The raw media index. probe gives a file's JSON; what it raises becomes that row's index_status and never fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said, status = [], []
            for path in pdf["video_path"]:
                try:
                    said.append(probe(path))
                    status.append("OK")
                except Exception as error:  # noqa: BLE001  any failure is reported in its row
                    said.append(None)
                    status.append(f"ERROR: {error}")
            yield pdf.assign(probed=said, index_status=status)

    probed = files.mapInPandas(run, "segment_id string, local_video_id string, video_path string, probed string, index_status string")
    return probed.select("segment_id", "local_video_id", "video_path", parse_probe(F.col("probed")).alias("p"), "index_status").select("segment_id", "local_video_id", "video_path", "p.*", "index_status").select(*RAW_MEDIA.names)


def newest(files: DataFrame) -> DataFrame:
    """path of the file that changed last; files: path, modificationTime."""
    return files.agg(F.max_by("path", "modificationTime").alias("path"))


def load_settings(path: str) -> Settings:
    """Settings from a YAML file; unknown keys are refused, missing ones have their defaults."""
    import yaml

    return Settings(**(yaml.safe_load(Path(path).read_text()) or {}))
