"""Benchmark decontamination by Wu-Manber multi-pattern search.

Benchmark texts become windows of consecutive words. Windows are byte strings of words between single spaces, and documents
are brought to the same form, so that a window occurs exactly where its bytes do. For windows of similar length the search
keeps a shift table over hashed blocks of bytes (how far the window's end may jump), buckets of windows by the hash of their last block
and their first bytes, and compares bytes directly before it reports an occurrence. A bucket is sorted and searched by halves, so windows
that end or begin alike cost no more than others. Many positions of a text are searched abreast, each
lane jumping by its own shifts.

The tables are built from at most `most_windows` windows and `most_bytes` of their bytes and items' names at a time (but one longer
window), which bounds what is broadcast and what a task holds. A larger benchmark is searched block by block: each block's scan gives
rows for documents with hits only, and these are put together and joined to the documents once.

Nulls and edge cases: a null or empty text has no words, n_hit 0 and is not contaminated; an item without words has no window;
a null item_id is reported as the empty string; repeated documents are judged alike, each giving a row; repeated items each
count; empty tables give no rows, or no hits. Columns other than the ids, the texts and those to carry are not read; a column to carry
that is named like a result is left out.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, as_bytes, slices, source_of

#: Upper-case A-Z to lower case, every other ASCII byte that isn't a digit or letter to a space; all other bytes stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
#: Windows are searched together with others of the same length class; these are the classes' least lengths in bytes.
LENGTH_CLASSES = (3, 8, 16, 32, 64, 128)
_MIX, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Search tables for windows whose lengths in bytes lie in one class."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = patterns
        self.least = min(map(len, patterns))
        self.block = min(8, self.least)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        self.most_shift = self.least - self.block + 1
        heads = np.frombuffer(b"".join(p[: self.least] for p in patterns), np.uint8).reshape(len(patterns), self.least)
        self.bits = min(22, max(16, int(heads.size).bit_length() + 1))
        self.shift = np.full(1 << self.bits, min(self.most_shift, 255), np.uint8)
        for end in range(self.block, self.least + 1):  # later ends shift less, so they overwrite
            self.shift[self._hash(self._words(heads, end))] = min(self.least - end, 255)
        buckets = self._bucket(self._hash(self._words(heads, self.least)), self._words(heads, self.block))
        ranked = np.array(sorted(range(len(patterns)), key=patterns.__getitem__), np.int64)
        self.order = ranked[np.argsort(buckets[ranked], kind="stable")]
        self.buckets = buckets[self.order]
        self.sorted = [patterns[k] for k in self.order]
        self.longest = max(map(len, patterns))
        self.shorter = self._shorter()

    @staticmethod
    def _bucket(suffix: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One number for the hash of the last block and the first block's bytes."""
        return ((suffix.astype(np.uint64) + np.uint64(1)) * _MIX) ^ (first * _OTHER)

    def _shorter(self) -> list[int]:
        """For each of the sorted windows the longest other one of its bucket that it starts with, or -1."""
        out, open_ = [], []
        for k, (bucket, pattern) in enumerate(zip(self.buckets.tolist(), self.sorted, strict=True)):
            while open_ and not (self.buckets[open_[-1]] == bucket and pattern.startswith(self.sorted[open_[-1]])):
                open_.pop()
            out.append(open_[-1] if open_ else -1)
            open_.append(k)
        return out

    def _words(self, heads: np.ndarray, end: int) -> np.ndarray:
        value = np.zeros(len(heads), np.uint64)
        for k in range(self.block):
            value |= heads[:, end - self.block + k].astype(np.uint64) << np.uint64(8 * k)
        return value

    def _hash(self, value: np.ndarray) -> np.ndarray:
        return ((value * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: bytes, lanes: int = 2048) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence in text, which must end in 8 bytes of padding."""
        size = len(text) - 8
        if size < self.least:
            return
        eight = np.lib.stride_tricks.as_strided(np.frombuffer(text, np.uint8)[:8].view(np.uint64), (size + 1,), (1,))
        edges = np.linspace(self.least, size + 1, min(lanes, max(1, size // 256)) + 1).astype(np.int64)
        at, stop = edges[:-1].copy(), edges[1:]
        places, hashes = [], []
        while len(at):
            h = self._hash(eight[at - self.block] & self.mask)
            jump = self.shift[h]
            hit = jump == 0
            if hit.any():
                places.append(at[hit])
                hashes.append(h[hit])
            at = at + np.maximum(jump, 1).astype(np.int64)
            alive = at < stop
            if not alive.all():
                at, stop = at[alive], stop[alive]
        if not places:
            return
        ends, hashed = np.concatenate(places), np.concatenate(hashes)
        starts = ends - self.least
        wanted = self._bucket(hashed, eight[starts] & self.mask)
        low, high = np.searchsorted(self.buckets, wanted, "left"), np.searchsorted(self.buckets, wanted, "right")
        held = low < high
        for start, first, last in zip(starts[held].tolist(), low[held].tolist(), high[held].tolist(), strict=True):
            # windows that the text goes on with are the last one not after it and those that this one starts with
            k = bisect_right(self.sorted, text[start : start + self.longest], first, last) - 1
            while k >= first:
                if text.startswith(self.sorted[k], start):
                    yield start, int(self.order[k])
                k = self.shorter[k]


class Windows:
    """All windows of a block of benchmark items, by length class."""

    def __init__(self, owners: dict[bytes, set[str]]) -> None:
        self.owners = [tuple(sorted(x)) for x in owners.values()]
        self.classes = []
        lengths = np.array([len(p) for p in owners], np.int64)
        everything = list(owners)
        kinds = np.searchsorted(LENGTH_CLASSES, lengths, "right")
        for kind in np.unique(kinds):
            numbers = np.flatnonzero(kinds == kind)
            self.classes.append((numbers, WuManber([everything[k] for k in numbers])))

    def search(self, texts: list[bytes]) -> tuple[list[int], dict[int, tuple[list[tuple[int, int]], set[str]]]]:
        """Number of words of each text, and for texts with hits the merged word spans and the items."""
        split = [words_of(t) for t in texts]
        counts = [len(w) for w in split]
        forms = [b" " + b" ".join(w) + b" " for w in split]
        joined = b"\n".join([*forms, b""]) + b"\0" * 8
        starts = np.cumsum([0, *(len(x) + 1 for x in forms)])
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for numbers, tables in self.classes:
            for start, k in tables.find(joined):
                doc = int(np.searchsorted(starts, start, "right")) - 1
                spans, items = found.setdefault(doc, ([], set()))
                spans.append((start, start + len(tables.patterns[k])))
                items.update(self.owners[numbers[k]])
        for doc, (spans, items) in found.items():
            form, base = forms[doc], int(starts[doc])
            marks = np.flatnonzero(np.frombuffer(form, np.uint8) == 32) + base  # the k-th word follows the k-th space
            first = np.searchsorted(marks, [s for s, _ in spans])
            last = np.searchsorted(marks, [e - 1 for _, e in spans])
            found[doc] = (merged(zip(first.tolist(), last.tolist(), strict=True)), items)
        return counts, found


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most_windows: int, most_bytes: int) -> Iterator[dict[bytes, set[str]]]:
    """The benchmark's windows and the items that have them, in blocks of bounded size; only one is held at a time."""
    owners: dict[bytes, set[str]] = {}
    size = 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        item, words = row[0] or "", words_of((row[1] or "").encode())
        for k in range(max(1, len(words) - window + 1) if words else 0):
            found = b" " + b" ".join(words[k : k + window]) + b" "
            if owners and (len(owners) >= most_windows or size + len(found) + len(item) > most_bytes):
                yield owners
                owners, size = {}, 0
            if found not in owners:
                owners[found] = set()
                size += len(found)
            if item not in owners[found]:
                owners[found].add(item)
                size += len(item)
    yield owners


RESULTS = ("n_words", "n_hit", "spans", "items", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, one_in: int = 20, most_windows: int = 1 << 16, most_bytes: int = 8 << 20, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans (merged [first, end) word numbers, flattened), items, contaminated, and the columns to carry along."""
    blocks = _blocks(benchmark, item_col, item_text_col, window, most_windows, most_bytes)
    first = next(blocks)
    second = next(blocks, None)
    shared = docs.sparkSession.sparkContext.broadcast
    source, name, carried = source_of(docs, id_col, text_col, carry, RESULTS)
    found_types = "n_words long, spans array<int>, items array<string>"

    def arrays(counts: list[int], spans: list[list[int]], items: list[list[str]]) -> list[pa.Array]:
        return [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

    if second is None:
        tables = shared(Windows(first))
        kept = source.columns if any(n == text_col for n in carry) else source.columns[1:]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "t"):
                counts, found = tables.value.search(as_bytes(part.column(0)))
                spans, items = [[]] * len(counts), [[]] * len(counts)
                for doc, (own, own_items) in found.items():
                    spans[doc], items[doc] = [x for s in own for x in s], sorted(own_items)
                yield pa.RecordBatch.from_arrays([*arrays(counts, spans, items), *(part.column(c) for c in kept)], names=["n_words", "spans", "items", *kept])

        state = source.mapInArrow(scan, T.StructType([*T._parse_datatype_string(found_types).fields, *(source.schema[c] for c in kept)]))
    else:
        state = _by_blocks(source, chain([first, second], blocks), arrays)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: x - total)  # over s1, e1, s2, e2: e2 - (s2 - (e1 - s1))
    return state.select(*name, "n_words", hit.alias("n_hit"), "spans", "items", ((hit > 0) & (F.lit(one_in) * hit >= F.col("n_words"))).alias("contaminated"), *carried)


def _by_blocks(source: DataFrame, blocks: Iterable[dict[bytes, set[str]]], arrays) -> DataFrame:
    """source with n_words, spans and items, the benchmark being searched block by block; texts move once, for the last join."""
    rows = _numbered(source)
    parts = []
    for block in blocks:
        tables = rows.sparkSession.sparkContext.broadcast(Windows(block))

        def scan(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "t"):
                _, found = tables.value.search(as_bytes(part.column(1)))
                keys = part.column(0).take(pa.array(list(found), pa.int64()))
                spans, items = [[x for s in own for x in s] for own, _ in found.values()], [sorted(own) for _, own in found.values()]
                yield pa.RecordBatch.from_arrays([keys, *arrays([0] * len(found), spans, items)[1:]], names=["key", "spans", "items"])

        parts.append(Table(rows.select("key", "t").mapInArrow(scan, "key long, spans array<int>, items array<string>"), "hits").df)
    hits = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = rows.join(hits, "key", "left").drop("key")
    kept = [f for f in joined.schema.fields if f.name not in ("spans", "items")]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            counts = [len(words_of(t)) for t in as_bytes(part.column("t"))]
            spans = [[x for s in merged((a, b) for own in found or [] for a, b in zip(own[::2], own[1::2], strict=True)) for x in s] for found in part.column("spans").to_pylist()]
            items = [x or [] for x in part.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([*arrays(counts, spans, items), *(part.column(f.name) for f in kept)], names=["n_words", "spans", "items", *(f.name for f in kept)])

    return joined.mapInArrow(together, T.StructType([*T._parse_datatype_string("n_words long, spans array<int>, items array<string>").fields, *kept]))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with a `key` of their own, written once so that it stays the same in every scan."""
    return Table(rows.withColumn("key", F.monotonically_increasing_id()).select("key", *rows.columns), "numbered").df
