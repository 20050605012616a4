"""Word and label sequences of hierarchical data files as a Spark data source.

    spark.dataSource.register(SequenceFile)
    spark.read.format("sequence_file").option("path", path).load()

A file holds, somewhere below its root, a group `data` with a group for each source, which holds the datasets `intervals` (start and end in
seconds) and `features`. Rows are (source_id, pos, start, end, features). Sources without both datasets are left out. Byte strings are
decoded; features are an array of strings or of doubles, as the first source has them.

The driver reads the names of the sources only; these are dealt to partitions of `sources_per_partition` (200 by default), each of which
opens the file itself and reads its sources' ranges of bytes. The path is one that pyarrow.fs opens on every machine: a local or shared
file, hdfs://, s3:// or gs://.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.text import stripped
from .container import Container

NAME, GROUP = "sequence_file", "data"
_SCHEMA = "source_id string, pos int, start double, end double, features array<{}>"
#: Rows of an Arrow batch.
_BATCH = 4096


def _opened(path: str) -> Container:
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"sequence file not found: {path}")
    if info.type != fs.FileType.File:
        raise ValueError(f"not a file: {path}")
    return Container(store.open_input_file(inner))


def _sources(container: Container, path: str) -> list[tuple[str, int]]:
    """Names and addresses of the sources, those without both datasets included."""
    group = container.find(GROUP)
    if group is None:
        raise KeyError(f"no group '{GROUP}' in {path}")
    return sorted((container.members(group) or {}).items())


def _parts(container: Container, address: int) -> tuple[int, int] | None:
    members = container.members(address) or {}
    return (members["intervals"], members["features"]) if {"intervals", "features"} <= members.keys() else None


@dataclass
class Sources(InputPartition):
    sources: list[tuple[str, int]]


class SequenceFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        container = _opened(self.options["path"])
        for _, address in _sources(container, self.options["path"]):
            parts = _parts(container, address)
            if parts:
                return _SCHEMA.format("string" if container.dataset(parts[1]).dtype == object else "double")
        raise ValueError(f"no sequences in {self.options['path']}")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("sources_per_partition", 200)), schema["features"].dataType.elementType.typeName() == "string")


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: int, text: bool) -> None:
        self.path, self.most, self.text = path, most, text

    def partitions(self) -> list[Sources]:
        sources = _sources(_opened(self.path), self.path)
        return [Sources(sources[k : k + self.most]) for k in range(0, len(sources), self.most)]

    def read(self, partition: Sources) -> Iterator[pa.RecordBatch]:
        container = _opened(self.path)
        for source, address in partition.sources:
            parts = _parts(container, address)
            if parts is None:
                continue
            intervals, features = (container.dataset(a) for a in parts)
            if not len(features):
                continue
            features = features.reshape(len(features), -1)
            for at in range(0, min(len(intervals), len(features)), _BATCH):
                times, own = intervals[at : at + _BATCH].astype(np.float64), features[at : at + _BATCH]
                n = min(len(times), len(own))
                values = pa.array([x.decode("utf-8", "replace") for x in own[:n].ravel()], pa.string()) if self.text else pa.array(own[:n].ravel().astype(np.float64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * own.shape[1]), values)
                yield pa.RecordBatch.from_arrays([pa.array([source] * n), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(times[:n, 0]), pa.array(times[:n, 1]), lists], names=["source_id", "pos", "start", "end", "features"])


def read_sequence_file(spark: SparkSession, path: str, sources_per_partition: int = 200) -> DataFrame:
    """(source_id, pos, start, end, features) of one file."""
    spark.dataSource.register(SequenceFile)
    return spark.read.format(NAME).option("path", path).option("sources_per_partition", sources_per_partition).load()


def load_pair(spark: SparkSession, words_path: str, labels_path: str) -> tuple[DataFrame, DataFrame]:
    """Words (source_id, pos, start, end, word) and labels (source_id, label_idx, start, end, label) as alignment takes them, of two files."""
    words, labels = (read_sequence_file(spark, p) for p in (words_path, labels_path))
    word = words.select("source_id", "pos", "start", "end", stripped(F.get("features", 0)).alias("word"))
    return word, labels.select("source_id", F.col("pos").alias("label_idx"), "start", "end", F.col("features").cast("array<double>").alias("label"))
