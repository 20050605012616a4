"""Sound measures of audio columns: each clip is one row, measured as a whole in vectorised steps inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sound

#: Rows of an output batch of frames.
_ROWS = 4096


def _by_clip(clips: DataFrame, keys: Sequence[str], audio: str, schema: str, measure: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Keys and what measure gives for each clip, one row for each entry of its arrays; a null clip has no samples."""
    own = T._parse_datatype_string(schema)
    source = clips.select(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keys)), F.col(audio).cast("array<double>").alias("samples"))
    fields = [source.schema[f"k{n}"] for n in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.float64()) if isinstance(f.dataType, T.ArrayType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() for f in own]
        for batch in batches:
            for row in range(batch.num_rows):
                samples = batch.column(len(keys))[row]
                values = np.asarray(samples.values.fill_null(0.0)) if samples.is_valid else np.zeros(0)
                found = measure(np.where(np.isfinite(values), values, 0.0))
                n = len(next(iter(found.values())))
                for at in range(0, n, _ROWS):
                    size = min(_ROWS, n - at)
                    same = [batch.column(k).take(pa.array([row] * size)) for k in range(len(keys))]
                    parts = [v[at : at + size] for v in found.values()]
                    columns = [pa.array(list(v), t) if v.ndim > 1 else pa.array(v, t) for v, t in zip(parts, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*same, *columns], names=[*(f.name for f in fields), *own.names])

    out = source.mapInArrow(run, T.StructType([*fields, *own]))
    return out.select(*(F.col(f"k{n}").alias(k) for n, k in enumerate(keys)), *own.names)


def spectrum_frames(clips: DataFrame, keys: Sequence[str], audio: str, rate: int = 16_000, frame: int = sound.FRAME, hop: int = sound.HOP) -> DataFrame:
    """(keys, frame, rms, centroid), a row for each frame of each clip; a clip without samples is one silent frame."""

    def measure(samples: np.ndarray) -> dict[str, np.ndarray]:
        rms = sound.energies(samples, frame, hop)
        return {"frame": np.arange(len(rms)), "rms": rms, "centroid": sound.centroids(sound.magnitudes(samples, frame, hop), rate)}

    return _by_clip(clips, keys, audio, "frame int, rms double, centroid double", measure)


def mfcc_frames(clips: DataFrame, keys: Sequence[str], audio: str, rate: int = 16_000, frame: int = sound.FRAME, hop: int = sound.HOP, mels: int = sound.MELS, coefficients: int = sound.COEFFICIENTS) -> DataFrame:
    """(keys, frame, mfcc), a row for each frame of each clip."""

    def measure(samples: np.ndarray) -> dict[str, np.ndarray]:
        found = sound.cepstra(sound.magnitudes(samples, frame, hop), rate, mels, coefficients)
        return {"frame": np.arange(len(found)), "mfcc": found}

    return _by_clip(clips, keys, audio, "frame int, mfcc array<double>", measure)


def speech_regions(clips: DataFrame, keys: Sequence[str], audio: str, frame: int = sound.FRAME, hop: int = sound.HOP, below: float = sound.SPEECH_DB) -> DataFrame:
    """(keys, intervals): the clip's loud stretches in samples, in order; a silent clip is loud as a whole, one without samples nowhere."""

    def measure(samples: np.ndarray) -> dict[str, np.ndarray]:
        found = np.array(sound.speech(samples, frame, hop, below), np.int64).reshape(-1, 2)
        found = np.concatenate([found, [[-1, -1]]])  # the clip itself
        return {"start": found[:, 0], "end": found[:, 1]}

    rows = _by_clip(clips, keys, audio, "start long, end long", measure)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("start") >= 0, F.struct("start", "end")))).alias("intervals"))


def pitch_frames(clips: DataFrame, keys: Sequence[str], audio: str, rate: int = 16_000, floor: float = sound.PITCH_FLOOR, ceiling: float = sound.PITCH_CEILING) -> DataFrame:
    """(keys, frame, time, f0), f0 in Hz or 0.0 where unvoiced; a clip shorter than three periods of the lowest pitch has no frames."""

    def measure(samples: np.ndarray) -> dict[str, np.ndarray]:
        times, hz = sound.pitch(samples, rate, floor, ceiling)
        return {"frame": np.arange(len(times)), "time": times, "f0": hz}

    return _by_clip(clips, keys, audio, "frame int, time double, f0 double", measure)


def voice_quality(clips: DataFrame, keys: Sequence[str], audio: str, rate: int = 16_000) -> DataFrame:
    """(keys, jitter_local, shimmer_local, hnr_mean) of each clip, 0.0 where a clip has no voiced periods to measure."""

    def measure(samples: np.ndarray) -> dict[str, np.ndarray]:
        values = (*sound.perturbation(samples, rate, sound.periods(samples, rate)), sound.harmonicity(samples, rate)) if len(samples) else (0.0,) * 3
        return dict(zip(("jitter_local", "shimmer_local", "hnr_mean"), (np.array([v if np.isfinite(v) else 0.0]) for v in values), strict=True))

    return _by_clip(clips, keys, audio, "jitter_local double, shimmer_local double, hnr_mean double", measure)
