"""Audio files (RIFF): loaded as mono clips at one rate, and normalised clips written as 16-bit files."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..functions.sound import resampled

RATE = 16_000
#: Fixed values of the format: whole numbers, floats, and either by a longer description.
_WHOLE, _FLOAT, _LONG = 1, 3, 0xFFFE


def parse_riff(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (n, channels) between -1 and 1, and the rate. A file that was cut off gives its whole frames."""
    if len(data) < 12 or data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF audio file")
    at, form, rate, channels, bits, sound = 12, 0, 0, 0, 0, None
    while at + 8 <= len(data) and sound is None:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = memoryview(data)[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if form == _LONG and len(body) >= 26:
                form = struct.unpack_from("<H", body, 24)[0]
        elif name == b"data":
            sound = body
        at += 8 + size + size % 2
    if not rate or not channels:
        raise ValueError("no description of the sound")
    if sound is None:
        raise ValueError("no sound in the file")
    width = bits // 8
    sound = sound[: len(sound) - len(sound) % max(1, width * channels)]
    if form == _FLOAT and bits in (32, 64):
        values = np.frombuffer(sound, f"<f{width}").astype(np.float64)
    elif form == _WHOLE and bits == 8:
        values = (np.frombuffer(sound, np.uint8) - 128.0) / 128
    elif form == _WHOLE and bits == 24:
        wide = np.zeros((len(sound) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(sound, np.uint8).reshape(-1, 3)
        values = wide.view("<i4").ravel() / 2.0**31
    elif form == _WHOLE and bits in (16, 32):
        values = np.frombuffer(sound, f"<i{width}") / 2.0 ** (bits - 1)
    else:
        raise ValueError(f"sound of form {form} and {bits} bits")
    return values.reshape(-1, channels), rate


def riff(samples: np.ndarray, rate: int) -> bytes:
    """A file of one channel and 16 bits; samples beyond -1 and 1 are cut."""
    data = np.clip(np.rint(np.asarray(samples, np.float64) * 32768), -32768, 32767).astype("<i2").tobytes()
    head = struct.pack("<HHIIHH", _WHOLE, 1, rate, 2 * rate, 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data


def read_audio(spark: SparkSession, path: str, pattern: str = "*.wav", rate: int = RATE) -> DataFrame:
    """(path, audio, rate, duration_sec, status, error) of the files below path: channels are averaged and resampled to `rate`.

    A file that can't be read, or has no samples, has status `error`, the reason, and no audio; it never fails the job.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    kinds = [pa.string(), pa.list_(pa.float32()), pa.int32(), pa.float64(), pa.string(), pa.string()]

    def loaded(data: bytes) -> tuple:
        try:
            samples, own = parse_riff(data)
            if not len(samples):
                raise ValueError("the audio is empty")
            mono = resampled(samples.mean(axis=1), own, rate).astype(np.float32)
            return mono, rate, len(mono) / rate, "available", None
        except (ValueError, struct.error) as error:
            return None, None, None, "error", str(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                row = (name.as_py(), *loaded(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["path", "audio", "rate", "duration_sec", "status", "error"])

    return files.mapInArrow(run, "path string, audio array<float>, rate int, duration_sec double, status string, error string")


def write_audio(clips: DataFrame, folder: str, name_col: str, audio_col: str = "audio", rate: int = RATE) -> DataFrame:
    """Writes a file `folder`/name.wav for each clip with samples, and gives (name, path, samples) of them.

    Files are written by the tasks under temporary names and moved, so that a task that is repeated leaves whole files only. The folder is one
    that pyarrow.fs reaches on every machine. Nothing is written before the result is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(inner, recursive=True)
        for batch in batches:
            done: list[tuple] = []
            for name, clip in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name is None or not clip.is_valid or not len(clip.values):
                    continue
                final, hidden = f"{inner}/{name}.wav", f"{inner}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(riff(np.asarray(clip.values.fill_null(0.0)), rate))
                store.move(hidden, final)
                done.append((name, f"{folder.rstrip('/')}/{name}.wav", len(clip.values)))
            columns = zip(*done, strict=True) if done else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["name", "path", "samples"])

    return clips.selectExpr(f"cast(`{name_col}` as string) as name", f"cast(`{audio_col}` as array<double>) as audio").mapInArrow(run, "name string, path string, samples long")
