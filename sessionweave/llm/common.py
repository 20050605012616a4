"""Helpers shared by the training-data operators: shared scratch tables and Arrow text views."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; bounds a Python worker's memory.
STEP_BYTES = 2 << 20
_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may leave it unset; it gets a temporary folder then."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _OWN_DIR[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def own_shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run meanwhile are deleted as each query ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Queries that run meanwhile pass so many rows at a time to Python, which bounds the executors' memory besides the heap, too."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows if before is None or int(before) < 1 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Table:
    """A scratch table in the shared folder: `df` reads it. It goes with drop(), or at the latest when the driver ends."""

    def __init__(self, df: DataFrame, name: str, compression: str | None = None, by: str | None = None) -> None:
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        with own_shuffles_end(self.spark):
            df.write.parquet(self.path, compression=compression, partitionBy=by)
        target, store = _file(self.spark, self.path)
        store.deleteOnExit(target)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self, part: str = "") -> None:
        """Deletes the table, or one part (`column=value`) of a partitioned one."""
        remove(self.spark, f"{self.path}/{part}".rstrip("/"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later steps don't depend on its lineage."""
    return Table(df, name).df


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join by equal keys that is never broadcast. Spark sizes rows that an explode makes, arrays and what files hold in few bytes
    too low, and would send such a table through the driver."""
    return df.hint("merge")


def with_few(df: DataFrame, rows: DataFrame, on: list[str], how: str, most: int) -> DataFrame:
    """df joined with rows, which are broadcast if there are at most so many."""
    few = rows.limit(most + 1).count() <= most
    return df.join(F.broadcast(rows) if few else shuffled(rows), on, how)


def _file(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table once nothing reads it any more."""
    target, store = _file(spark, path)
    store.delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about `limit` bytes of `column`, or one longer text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(byte_lengths(batch.column(column)))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def byte_lengths(column: pa.Array) -> np.ndarray:
    if len(column) == 0:
        return np.zeros(0, np.int64)
    lengths = np.diff(_offsets(column))
    if column.null_count:
        lengths[np.asarray(column.is_null())] = 0
    return lengths


def joined_bytes(column: pa.Array, separator: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, a separator after each; their starts and ends. Null counts as empty."""
    texts = [(x.as_buffer() if x.is_valid else b"") for x in column]
    data = np.frombuffer(separator.join([*texts, b""]), np.uint8)
    lengths = byte_lengths(column)
    ends = np.cumsum(lengths + len(separator)) - len(separator)
    return data, ends - lengths, ends


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text) with a unique key in the order of the ids: the id itself, or where ids repeat or are null (or aren't whole
    numbers) a number in the order of id (nulls first), then a hash of the text.

    For such numbers the rows are dealt by ranges of id and hash, equal rows by chance among themselves, sorted within the ranges,
    numbered there and written once; neither one task nor Python sees them all.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    whole = rows.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and rows.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return rows.select(F.col("id").cast("long").alias("key"), "id", "text")
    order = ["id", "h", "g", "salt"]
    hashed = rows.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text"), "salt": F.rand(5)})
    ranked = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranked.select(F.monotonically_increasing_id().alias("key"), "id", "text"), "keyed")


def source_of(docs: DataFrame, id_col: str, text_col: str, carry: Iterable[str], results: Iterable[str]) -> tuple[DataFrame, list[F.Column], list[F.Column]]:
    """The text as `t`, the id as `i` and the columns to carry under names of their own; then the id and the carried columns by
    their first names again. A text to carry is `t` itself, so that it moves once. A column named like a result isn't carried."""
    names = [c for c in dict.fromkeys(carry) if c != id_col and c not in set(results)]
    same = docs.schema[text_col].dataType.typeName() == "string"
    inner = {c: "t" if same and c == text_col else f"c{k}" for k, c in enumerate(names)}
    moved = [F.col(c).alias(n) for c, n in inner.items() if n != "t"]
    source = docs.select(F.col(text_col).cast("string").alias("t"), F.col(id_col).alias("i"), *moved)
    return source, [F.col("i").alias(id_col)], [F.col(n).alias(c) for c, n in inner.items()]
