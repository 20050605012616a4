"""Results as Parquet, CSV and JSON."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.assemble import as_json


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below spark.checkpoint.dir; a local master may leave that unset and gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(found or 'file://' + tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save_stage(df: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """Writes a stage's result and reads it back, or passes it on if it isn't to be kept."""
    if not keep:
        return df
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_csv(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """CSV with a header; arrays, maps and structs, which CSV can't hold, are dropped."""
    flat = df.drop(*(f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))))
    (flat.orderBy(*sort) if sort else flat).write.mode("overwrite").option("header", True).csv(path)


def save_action_units(stats: DataFrame, path: str) -> None:
    save_csv(stats.withColumnRenamed("name", "ActionUnit"), path, ["ActionUnit"])


def save_records(records: DataFrame, path: str) -> None:
    """One JSON text a row, nulls written out."""
    records.select(as_json(F.struct(*records.columns)).alias("value")).write.mode("overwrite").text(path)


def save_metadata(spark: SparkSession, path: str, began: float, counts: dict[str, int], features: list[str], artifacts: dict[str, str]) -> dict:
    """Run metadata as JSON beside the artifacts, in whatever store holds them."""
    said = {"counts": counts, "features": features, "artifacts": artifacts, "runtime_seconds": time.time() - began}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return said


def session_text(summary: DataFrame) -> DataFrame:
    """A readable line per measure of each session: session_id, line."""
    lines = F.array(
        F.format_string("Frames: %d", "frame_count"), F.format_string("Faces detected: %d", "detected_frames"), F.format_string("Coverage: %.2f%%", "face_coverage_percent"),
        F.format_string("Duration: %.2f s", "duration_seconds"), F.format_string("Blinks: %d", "blink_count"), F.format_string("Blinks per minute: %.2f", "blink_rate_per_minute"),
    )
    return summary.select("session_id", F.explode(lines).alias("line"))
