"""Explicit schemas; ids are strings and times are seconds as doubles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "array<double>": T.ArrayType(T.DoubleType()), "array<float>": T.ArrayType(T.FloatType())}


def _schema(text: str) -> T.StructType:
    """From "name type, ..."; works before there is a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in text.split(", "))])


WORDS = _schema("source_id string, pos int, start double, end double, word string")
LABELS = _schema("source_id string, label_idx int, start double, end double, label array<double>")
MANIFEST = _schema("segment_id string, label_idx int, start double, end double, audio_path string, video_path string")
RAW_MEDIA = _schema("segment_id string, local_video_id string, video_path string, duration_sec double, has_video boolean, has_audio boolean, width int, height int, fps double, video_codec string, audio_codec string, sample_rate string, channels int, index_status string")
EXCEPTIONS = _schema("segment_id string, label_idx int, local_video_id string, reason string")
DIAGNOSTICS = _schema("segment_id string, reason string, manifest_count int, raw_count int, label_idx int, local_video_id string, duration_difference_sec double")
FRAMES = _schema("session_id string, frame_index int, timestamp_ms bigint, face_detected int, ear double, pitch double, yaw double, roll double, gaze double")
TEXT_FEATURES = _schema("segment_id string, label_idx int, start double, end double, text string, sentiment_normalized float, word_count int, avg_word_length double, dependency_tree_depth int, avg_dependency_distance double, msttr_10 double, labse_embedding array<float>")
MEDIA_MAPPING = _schema("segment_id string, label_idx int, audio_path string, video_path string")
#: What a media probe prints, as far as it is used.
PROBE = ("streams array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,duration:string,sample_rate:string,channels:int>>, format struct<duration:string>")


@dataclass(frozen=True)
class Settings:
    """Thresholds of the pipelines."""

    most_tokens: int = 256
    embedding_dimensions: int = 768
    msttr_size: int = 10
    warning_seconds: float = 1.0
    least_pause_seconds: float = 0.15
    sample_rate: int = 16_000
    device: str = "auto"

    def device_name(self) -> str | None:
        """What models are told: None leaves the choice to them."""
        if self.device not in ("auto", "cpu", "cuda"):
            raise ValueError(f"device must be auto, cpu or cuda, not {self.device}")
        return None if self.device == "auto" else self.device
