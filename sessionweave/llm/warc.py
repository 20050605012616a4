"""Deterministic sharded WARC archives.

Records are dealt to shards by ranges of their integer key, each of about `shard_bytes` of payload, and sorted by key within a shard.
The ranges come from counts of payload bytes: equal steps between the least and greatest key, and where a step holds too much, equal
steps between the least and greatest key in it. They depend on the rows alone, not on how Spark has laid them out, and a
far-off key doesn't spoil them. What is still too much after that, hardly more than one key, is split by a hash of payload and URL.
Each shard is one task and is written as gzip members, one for each record, in files that are rolled when the next record would
take the compressed size beyond `roll_bytes`. Headers, record ids and digests are made anew from key and payload alone, so the same rows
give the same files however Spark lays them out. Files are written under temporary names; what the successful tasks wrote is
recorded, then renamed, and the manifest of final names is written last. A lost task leaves an unrecorded temporary file only.

Of records with equal payloads of at least `least_revisit` bytes the one with the smallest key holds the payload; the others are
revisit records that refer to it.

Nulls and edge cases: a null payload is empty; a null URL leaves out the target header and is read back as null; a record with a
null key never is the one referred to unless all have null keys, when all hold their payloads; rows that share key and payload
are equals, all of them written alike; rows equal in key, payload and URL share a shard however many there are, which is rolled over
as many files as it takes; line breaks in URLs are percent-encoded in headers and decoded again; empty tables make an
archive without files. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, remove

#: Steps that a range of keys is cut into when its payload bytes are counted.
STEPS = 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain_value(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(key: int | None, url: str | None, payload: bytes, first: int | None, date: str, level: int) -> bytes:
    """A response record, or with `first` a revisit of that key's record, as a gzip member."""
    digest = payload_digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    named = lambda k: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{k} {digest}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {named(key)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if first is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {named(first)}", f"X-Refers-To-Key: {first}"]
    if key is not None:
        head.append(f"X-Key: {key}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", level, mtime=0)


def parse_records(data: bytes) -> Iterator[tuple[int | None, str | None, bytes | None, int, str, str, int | None]]:
    """(key, url, payload, payload bytes, payload digest, type, key referred to); checks every digest."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))
    while line := stream.readline():
        if not line.strip():
            continue
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")) :
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        held = head["WARC-Type"] == "response"
        if head["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}" or held and (digest != payload_digest(payload) or size != len(payload)):
            raise ValueError(f"record {head['WARC-Record-ID']} doesn't match its digests")
        key, first, url = head.get("X-Key"), head.get("X-Refers-To-Key"), head.get("WARC-Target-URI")
        yield None if key is None else int(key), None if url is None else _plain_value(url), payload if held else None, size, digest, head["WARC-Type"], None if first is None else int(first)


def _sharded(rows: DataFrame, shard_bytes: int | None) -> tuple[DataFrame, int, int]:
    """rows with a shard number from ranges of `key`, each of about so many bytes; how many shards; their bytes."""
    spark = rows.sparkSession
    rows = rows.withColumn("size", F.octet_length("payload") + F.lit(400).cast("long"))
    low, high, total = (int(x or 0) for x in rows.agg(F.min("key"), F.max("key"), F.sum("size")).first())
    shard_bytes = shard_bytes or max(32 << 20, total // 20_000)
    step = lambda low, width: F.expr(f"cast((cast(key as decimal(20,0)) - {low}) div {width} as int)")
    exact = lambda n: f"cast('{n}' as decimal(20,0))"
    coarse = rows.withColumn("step", F.coalesce(step(exact(low), exact((high - low) // STEPS + 1)), F.lit(-1)))  # null keys come first
    full = coarse.groupBy("step").agg(F.sum("size").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).where((F.col("n") > shard_bytes) & (F.col("low") < F.col("high"))).collect()
    finer = [(r[0], r[2], (r[3] - r[2]) // max(4, min(STEPS, 4 * r[1] // shard_bytes)) + 1) for r in full]  # a quarter of a shard each
    cut = F.broadcast(spark.createDataFrame(finer, "step int, low long, width long"))
    fine = coarse.join(cut, "step", "left").withColumn("part", F.coalesce(step("low", "width"), F.lit(0))).drop("low", "width")
    sizes = sorted(fine.groupBy("step", "part").agg(F.sum("size")).collect())  # about STEPS rows and four for each shard
    ranges, shard, filled = [], 0, 0
    for number, part, size in sizes:
        pieces = max(1, round(size / shard_bytes))
        if filled and (filled + size > shard_bytes or pieces > 1):
            shard, filled = shard + 1, 0
        ranges.append((number, part, shard, pieces))
        filled += size
        if pieces > 1:
            shard, filled = shard + pieces, 0
    table = F.broadcast(spark.createDataFrame(ranges, "step int, part int, shard int, pieces int"))
    piece = F.pmod(F.xxhash64("sha", "url"), F.col("pieces")).cast("int")
    return fine.join(table, ["step", "part"]).withColumn("shard", F.col("shard") + piece).drop("step", "part", "pieces", "size"), shard + 1, shard_bytes


def write_warc(records: DataFrame, path: str, key_col: str, url_col: str, payload_col: str, least_revisit: int = 0, shard_bytes: int | None = None, roll_bytes: int | None = None, date: str = "2026-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes the archive and returns its manifest: file, records, bytes, sha256, first_key, last_key.

    By default a shard has 32 MB of payload, or more where that would make over about 20,000 of them, and files are rolled at a
    sixteenth of that (compressed), at most at 1 GB.
    """
    spark = records.sparkSession
    rows = records.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows, shards, shard_bytes = _sharded(rows.withColumn("sha", F.sha2("payload", 256)), shard_bytes)
    roll_bytes = roll_bytes or min(1 << 30, shard_bytes // 16)
    narrow = rows.select("shard", "key", "sha", F.octet_length("payload").alias("size"))
    firsts = narrow.where(F.col("size") >= least_revisit).groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    revisits = Table(narrow.join(firsts.select("sha", "first"), "sha").where("key is null or key <> first").select("shard", "key", "sha", "first").distinct(), "revisits")
    # Payloads are shuffled once, by shard; a row that says what to refer to is sorted before the records it holds for.
    held = rows.select("shard", "key", "sha", F.lit(1).alias("kind"), "url", F.col("payload").cast("binary").alias("payload"), F.lit(None).cast("long").alias("first"))
    notes = revisits.df.select("shard", "key", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first")
    dealt = held.unionByName(notes).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "sha", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = arrow_fs.FileSystem.from_uri(path)
        store.create_dir(f"{base}/_temporary", recursive=True)
        attempt = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        done: list[tuple] = []
        note: tuple = (None,) * 4
        out, shard, number, size, count, sha, first_key, key = None, None, 0, 0, 0, hashlib.sha256(), None, None

        def close() -> None:
            out.close()
            done.append((f"{shard:06d}-{number:04d}.warc.gz", f"{base}/_temporary/{attempt}-{shard}-{number}", count, size, sha.hexdigest(), first_key, key))

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                own, own_key, own_sha, kind, url, payload, first = (x.as_py() for x in row)
                if kind == 0:
                    note = (own, own_key, own_sha, first)
                    continue
                first = note[3] if note[:3] == (own, own_key, own_sha) else None
                member = record_bytes(own_key, url, payload, first, date, level)
                if out is None or own != shard or size + len(member) > roll_bytes:
                    if out is not None:
                        close()
                    number = number + 1 if own == shard else 0
                    shard, size, count, sha, first_key = own, 0, 0, hashlib.sha256(), own_key
                    out = store.open_output_stream(f"{base}/_temporary/{attempt}-{shard}-{number}")
                out.write(member)
                sha.update(member)
                size, count, key = size + len(member), count + 1, own_key
        if out is not None:
            close()
        names = ["file", "temporary", "records", "bytes", "sha256", "first_key", "last_key"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names=names)

    made = Table(dealt.mapInArrow(write, "file string, temporary string, records long, bytes long, sha256 string, first_key long, last_key long"), "archived")
    revisits.drop()

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = arrow_fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if store.get_file_info(temporary).type != arrow_fs.FileType.NotFound:  # else an earlier attempt has renamed it
                    store.move(temporary, f"{base}/{name}")
            yield batch

    manifest = f"{path}/_manifest"
    made.df.mapInArrow(commit, made.df.schema).drop("temporary").write.parquet(manifest)
    remove(spark, f"{path}/_temporary")
    made.drop()
    return spark.read.parquet(manifest)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: key, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    schema = "key long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if spark.read.parquet(f"{path}/_manifest").isEmpty():
        return spark.createDataFrame([], schema)
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["key", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for record in parse_records(content.as_py()):
                    rows.append(record)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content").mapInArrow(parse, schema)
