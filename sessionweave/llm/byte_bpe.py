"""Byte-level BPE encoding and decoding with one encoding of each distinct pre-token.

Texts are split into pre-tokens in blocks of some megabytes. A block lists each of its distinct pre-tokens once, the frequent ones first, and
keeps its texts as sequences of places in that list. The lists are dealt to buckets by the words' hashes, so that all blocks' copies of a word
meet in one bucket, which encodes each distinct word once and joins the ids back to every block and place. Blocks then put the ids of their
texts together by position. The ids that occur in a block are joined with the table of the tokens' bytes, from which the block decodes
its finished ids.

A frequent word makes one entry a block, not one an occurrence, so no word gathers more entries than there are blocks. Lists travel
packed, words sorted and numbers by their bytes' rank; as rows of words they took four times as much disk. A block's size has a bound
(`BLOCK_BYTES` of text, or one longer text), and there is a bucket for every `BUCKET_BYTES` of text; the vocabulary's table is the
only one that is sent to every task.

Splitting follows the tokenizer library's own tables of letters, digits and white space, which it is asked for once a worker; other
libraries know other versions of Unicode.

Nulls and edge cases: a null or empty text has no ids and decodes to nothing; bytes that aren't UTF-8 count as U+FFFD; repeated and null ids
are carried along, one row a document; very long texts are split in parts that end before white space; other columns aren't read; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, as_bytes, slices

#: Text of a block, and text whose blocks' words make up one bucket.
BLOCK_BYTES, BUCKET_BYTES = 32 << 20, 32 << 20
#: Characters that are split at once.
_STEP = 4 << 20
#: What stands for letters, digits and other characters beyond U+FFFF while a text is split.
_PLAIN = ("a", "0", "\ue000")


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def _classes() -> dict[str, str]:
    """All characters of the classes that patterns name, by the tokenizer library's tables."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    some = ["".join(every[k : k + 8192]) for k in range(0, len(every), 8192)]
    engines = {c: tiktoken.Encoding(c, pat_str=c + "+", mergeable_ranks=single, special_tokens={}) for c in (r"\p{L}", r"\p{N}", r"\s")}
    return {c: "".join(e.decode_bytes(e.encode_ordinary(x)).decode() for x in some) for c, e in engines.items()}


def _ranges(chars: str) -> str:
    """Characters up to U+FFFF as ranges of a regular expression's class."""
    codes = np.array([ord(c) for c in chars if c <= "\uffff"])
    first = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
    last = np.append(first[1:], len(codes)) - 1
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(codes[first], codes[last], strict=True))


class PreTokens:
    """Splits texts as the tokenizer library does by `pattern`."""

    def __init__(self, pattern: str) -> None:
        found = _classes()
        inside = {c: _ranges(chars) for c, chars in found.items()}
        named = re.compile(r"\\p\{L\}|\\p\{N\}|\\s")
        plain = re.sub(r"\[[^]]*\]", lambda m: named.sub(lambda c: inside[c[0]].replace("\\", "\0"), m[0]), pattern)
        plain = named.sub(lambda c: f"[{inside[c[0]]}]", plain.replace(r"\S", "[^\\s]".replace(r"\s", inside[r"\s"])))
        plain = plain.replace("\0", "\\")
        if r"\p" in plain:
            raise ValueError(f"a pattern of letters, digits and white space is needed, not {pattern}")
        self.words = re.compile(plain)
        self.gap = re.compile(f"[^{inside[chr(92) + 's']}][{inside[chr(92) + 's']}]")
        self.far = re.compile("[\U00010000-\U0010ffff]")
        self.letters, self.digits = ({c for c in found[k] if c > "\uffff"} for k in (r"\p{L}", r"\p{N}"))

    def _plain(self, match: re.Match) -> str:
        return _PLAIN[0] if match[0] in self.letters else _PLAIN[1] if match[0] in self.digits else _PLAIN[2]

    def __call__(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens in lists; a pre-token always ends between a character and white space after it, so long texts are cut there."""
        split = text if text.isascii() or not self.far.search(text) else self.far.sub(self._plain, text)
        at = 0
        while at < len(text):
            cut = self.gap.search(split, at + _STEP) if len(text) - at > _STEP else None
            end = cut.start() + 1 if cut else len(text)
            if split is text:
                yield self.words.findall(text, at, end)
            else:
                yield [text[m.start() : m.end()] for m in self.words.finditer(split, at, end)]
            at = end


class _Places(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers by their bytes' rank, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def pretokens(docs: DataFrame, pattern: str, id_col: str, text_col: str, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds for each block: its texts as sequences of places (`kind` 0: keys, counts, seq), and its distinct words by
    buckets of their hash (`kind` 1: bucket, n, size, words, lengths, places), all packed."""
    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    kind = source.schema["i"].dataType
    numbers, packed = ("n", "size"), ("seq", "words", "lengths", "places")
    schema = T.StructType().add("kind", T.IntegerType()).add("block", T.LongType()).add("keys", T.ArrayType(kind)).add("counts", T.ArrayType(T.LongType())).add("bucket", T.IntegerType())
    for name in numbers:
        schema = schema.add(name, T.LongType())
    for name in packed:
        schema = schema.add(name, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, made = PreTokens(pattern), 0
        places, runs, held = _Places(), [], 0

        def row(key_type: pa.DataType, **values: pa.Array) -> pa.RecordBatch:
            kinds = {"kind": pa.int32(), "block": pa.int64(), "keys": pa.list_(key_type), "counts": pa.list_(pa.int64()), "bucket": pa.int32()} | dict.fromkeys(numbers, pa.int64()) | dict.fromkeys(packed, pa.binary())
            return pa.RecordBatch.from_arrays([values[n] if isinstance(values.get(n), pa.Array) else pa.array([values.get(n)], k) for n, k in kinds.items()], names=list(kinds))

        def rows() -> Iterator[pa.RecordBatch]:
            block = (TaskContext.get().partitionId() << 24) + made
            codes = np.concatenate([c for _, _, c in runs])
            order = np.argsort(-np.bincount(codes, minlength=len(places)), kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            key_type = runs[0][0].type
            for keys, counts, own in runs:
                yield row(key_type, kind=0, block=block, keys=pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), counts=counts, seq=_packed(place[own]))
            words = [w.encode() for w in places]
            dealt: list[list] = [[] for _ in range(buckets)]
            for word, at in zip(words, place.tolist(), strict=True):
                dealt[zlib.crc32(word) % buckets].append((word, at))
            for bucket, own in enumerate(dealt):
                if own:
                    own.sort()
                    data = b"".join(w for w, _ in own)
                    lengths, at = np.array([len(w) for w, _ in own]), np.array([k for _, k in own])
                    yield row(key_type, kind=1, block=block, bucket=bucket, n=len(own), size=len(data), words=pa.compress(data, codec="zstd", asbytes=True), lengths=_packed(lengths), places=_packed(at))

        for part in slices(batches, "t"):
            counts, codes = [], []
            for text in as_bytes(part.column(1)):
                held += len(text)
                own = [np.fromiter(map(places.__getitem__, words), np.uint32, len(words)) for words in split(text.decode("utf-8", "replace"))]
                counts.append(sum(map(len, own)))
                codes += own
            runs.append((part.column(0), counts, np.concatenate([np.zeros(0, np.uint32), *codes])))
            if held >= block_bytes:
                yield from rows()
                made += 1
                places, runs, held = _Places(), [], 0
        if runs:
            yield from rows()

    return source.mapInArrow(run, schema)


def encoded_bucket(path: str) -> Callable[[pa.Table], pa.Table]:
    """Encodes each distinct word of a bucket once and gives its ids to all blocks that have it."""

    def run(rows: pa.Table) -> pa.Table:
        import tiktoken

        whole = tiktoken.Encoding("whole", pat_str="(?s:.+)", mergeable_ranks=ranks_of(path), special_tokens={})
        numbers = rows.column("n").to_pylist()
        lists = []
        for n, size, words, lengths in zip(numbers, *(rows.column(c).to_pylist() for c in ("size", "words", "lengths")), strict=True):
            ends = np.concatenate([[0], np.cumsum(_unpacked(lengths, n), dtype=np.int64)])
            lists.append(pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.decompress(words, decompressed_size=size, codec="zstd")]))
        coded = pa.concat_arrays(lists).dictionary_encode()
        ids = [whole.encode_ordinary(w.decode()) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, first = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), np.cumsum(sizes) - sizes
        codes, cuts = np.asarray(coded.indices), np.cumsum([0, *numbers])
        made = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = sizes[codes[a:b]]
            got = flat[_spread(first[codes[a:b]], own)]
            made.append((_packed(own), len(got), _packed(got), np.unique(got).astype(np.int32)))
        return pa.table([rows.column("block"), rows.column("n"), rows.column("places"), *(pa.array([m[k] for m in made], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()))))], names=["block", "n", "places", "sizes", "n_flat", "flat", "tokens"])

    return run


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... sizes[k] times, for each k."""
    upto = np.cumsum(sizes)
    return np.repeat(first - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


def token_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(token, bytes) of the vocabulary."""
    ranks = ranks_of(path)
    return spark.createDataFrame(pa.table({"token": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks, pa.binary())}))


def _texts_of(texts: pa.Table, known: pa.Table) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Keys, ids and decoded bytes of a block's texts."""
    lists = known.filter(pc.is_valid(known.column("flat"))).to_pylist()
    named = known.filter(pc.is_valid(known.column("bytes"))).sort_by("token").combine_chunks()
    tokens, pieces = np.asarray(named.column("token")), named.column("bytes").combine_chunks().cast(pa.large_binary())
    sizes, first = (np.zeros(sum(x["n"] for x in lists), np.int64) for _ in "ab")
    flat, before = [np.zeros(0, np.uint32)], 0
    for x in lists:
        places, own = _unpacked(x["places"], x["n"]), _unpacked(x["sizes"], x["n"]).astype(np.int64)
        sizes[places], first[places] = own, before + np.cumsum(own) - own
        flat.append(_unpacked(x["flat"], x["n_flat"]))
        before += x["n_flat"]
    flat = np.concatenate(flat)
    for row in range(texts.num_rows):
        counts = np.array(texts.column("counts")[row].as_py(), np.int64)
        seq = _unpacked(texts.column("seq")[row].as_py(), int(counts.sum()))
        own = sizes[seq]
        ids = flat[_spread(first[seq], own)]
        found = pieces.take(pa.array(np.searchsorted(tokens, ids)))
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        cuts = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(counts)])]
        yield texts.column("keys")[row].values, _cut(pa.py_buffer(ids.astype("<u4")), 4 * cuts), _cut(found.buffers()[2] if len(ids) else pa.py_buffer(b""), ends[cuts])


def _cut(data: pa.Buffer, cuts: np.ndarray) -> pa.Array:
    """The bytes between the cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), data])


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, ids, decoded) of each document: its ids as little-endian unsigned 32-bit integers, and the bytes that these decode to."""
    kind = docs.schema[id_col].dataType
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    split = Table(pretokens(docs, pattern, id_col, text_col, 1 + size // bucket_bytes, block_bytes), "pretokens", "zstd", "kind")
    words = split.df.where("kind = 1").select("block", "bucket", "n", "size", "words", "lengths", "places")
    lists = Table(words.groupBy("bucket").applyInArrow(encoded_bucket(path), "block long, n long, places binary, sizes binary, n_flat long, flat binary, tokens array<int>"), "block_ids", "zstd")
    split.drop("kind=1")
    bytes_of = F.broadcast(token_bytes(docs.sparkSession, path))  # one row a token of the vocabulary
    pieces = lists.df.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens")).select("block", F.explode("tokens").alias("token")).join(bytes_of, "token").select("block", "token", "bytes")
    right = lists.df.drop("tokens").unionByName(pieces, allowMissingColumns=True)
    schema = T.StructType().add("i", kind).add("ids", T.BinaryType()).add("decoded", T.BinaryType())

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        return pa.table([pa.chunked_array(x) for x in zip(*_texts_of(texts, own), strict=True)], names=["i", "ids", "decoded"])

    texts = split.df.where("kind = 0").select("block", "keys", "counts", "seq")
    return texts.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, schema).select(F.col("i").alias(id_col), "ids", "decoded")
