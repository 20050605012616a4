"""Suffix-array deduplication with a logarithmic family of indexes.

Every byte covered by a string of `length` bytes that also starts earlier is removed, earlier meaning in a document of smaller
key, or further ahead in the same one.

The suffix arrays are sparse. They hold the suffixes that begin at minimizers: positions whose `anchor`-byte prefix has the least hash
in some window. A string of `length` bytes has its minimizers at the same places wherever it occurs, so equal strings always share an
indexed suffix; one position in about (length - anchor) / 2 is indexed. An entry has the suffix's first `anchor` bytes as numbers that
sort as the bytes do, a hash of its context, that is, of all bytes that a match through this suffix can reach (`length` onwards,
length - anchor back), and the first place where that context occurs. An array is a table sorted by leading bytes, then context, over
all its partitions; entries of one prefix, however many, spread over several.

Documents arrive in batches by key (`SuffixIndex.add`). Copies within a batch are folded, with partial aggregation. The batch's array is
merged with those of the existing levels in sorted order, and neighbours are compared: an entry whose neighbour from a level
agrees in prefix and context matches in full. The contexts that are new become a level of the smallest size, and levels of equal
size merge until all sizes differ, so that a batch meets a logarithmic number of levels; as the batch's scan goes through all of them in
order anyway, the merged level is what the scan puts out. The index stays open for further batches, unless one is added as the last:
its scan goes through all levels and puts out only what is still looked up, that is, entries whose prefix a neighbour has too.

Suffixes that share a prefix but not the context match in part. Only their contexts' bytes are fetched; within a prefix the windows
through it are compared at each offset, in sorted order, the first place of each window staying. A prefix with more contexts than
`most_contexts` isn't gathered in one task: its windows are hashed and grouped by Spark.

Nulls and edge cases: a null or empty text has no bytes; where ids repeat or are null, rows count as documents in the order of id
(nulls first) and a hash of the text; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, as_bytes, byte_lengths, joined_bytes, keyed, slices, written

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)])) for x in (_BASE, inverse))


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    ahead, _ = _powers(1 << max(22, len(data).bit_length()))
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ahead[: len(data)])])


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over values[p : p + width] for each p where that fits."""
    done, out = 1, values
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(values) - width + 1], out[width - done : width - done + len(values) - width + 1])


class Minimizers:
    def __init__(self, length: int, anchor: int) -> None:
        if anchor % 8 or not 0 < anchor < length:
            raise ValueError("anchor must be a multiple of 8 below length")
        self.length, self.anchor = length, anchor
        self.lead = [f"lead{k}" for k in range(anchor // 8)]
        self.windows = length - anchor + 1

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the indexed suffixes in the concatenated texts, and their first bytes as numbers in the bytes' order."""
        n, k, w = len(data), self.anchor, self.windows
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros((k // 8, 0), np.int64)
        sums = _prefix_sums(data)
        _, back = _powers(1 << max(22, n.bit_length()))
        with np.errstate(over="ignore"):
            hashed = (sums[k:] - sums[:-k]) * back[: n - k + 1]
            hashed ^= hashed >> np.uint64(32)
            hashed *= _MIX
            order = (hashed >> np.uint64(32)).astype(np.uint32)
        order = np.maximum(order, 1)
        least = _sliding(order, w, np.minimum)  # for each window of `length` bytes
        room = np.maximum(ends - self.length + 1, starts)
        inside = np.zeros(n + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, room, -1)
        least[np.cumsum(inside[:-1], dtype=np.int8)[: len(least)] == 0] = 0  # it would cross into the next text
        padded = np.concatenate([np.zeros(w - 1, np.uint32), least, np.zeros(w - 1, np.uint32)])
        at = np.flatnonzero(_sliding(padded, w, np.maximum) == order)
        eight = np.lib.stride_tricks.as_strided(data[:8].view(">u8"), (n - 7,), (1,))
        return at, np.stack([(eight[at + k].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64) for k in range(0, self.anchor, 8)])

    def context(self, text: bytes, at: int) -> tuple[bytes, int]:
        """The bytes that matches through the suffix at `at` can reach, and how many of them stand before it."""
        left = min(at, self.length - self.anchor)
        return text[at - left : at + self.length], left


def _suffixes(docs: DataFrame, kind: Minimizers) -> DataFrame:
    """(the leading bytes, context, key, at) of every indexed suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, starts, ends = joined_bytes(part.column(1))
            at, leads = kind.of(data, starts, ends)
            owner = np.searchsorted(starts, at, "right") - 1
            texts = as_bytes(part.column(1))
            local = at - starts[owner]
            context = np.fromiter(
                (xxhash.xxh3_64_intdigest(piece, left) for piece, left in (kind.context(texts[d], a) for d, a in zip(owner.tolist(), local.tolist(), strict=True))),
                np.uint64,
                len(at),
            )
            keys = part.column(0).to_numpy()[owner]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in leads), pa.array(context.view(np.int64)), pa.array(keys), pa.array(local.astype(np.int32))], names=[*kind.lead, "context", "key", "at"])

    return docs.select("key", "text").mapInArrow(run, "".join(f"{c} long, " for c in kind.lead) + "context long, key long, at int")


def _neighbours(order: list[str], shared: list[str] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A merge scan: rows sorted by `order`, then from older to newer levels and the batch (0) last, with whether the row before is
    alike; those of levels that don't merge (-1) are left out. With `shared`, the leading columns of `order`, so are rows that neither
    match nor agree in these with a neighbour; a row whose neighbour isn't at hand stays."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            same, near = np.ones(batch.num_rows, bool), None
            for k, c in enumerate(order):
                x = batch.column(c).to_numpy()
                same &= x == np.concatenate([[x[0] if last is None else last[k]], x[:-1]])
                if shared is not None and k == len(shared) - 1:
                    near = same | np.concatenate([same[1:], [True]])
                    near[0] |= last is None
            same[0] &= last is not None
            last = [batch.column(c)[-1].as_py() for c in order]
            level = batch.column("level").to_numpy()
            wanted = level >= 0
            if near is not None:
                wanted &= near | ((level == 0) & (same | (batch.column("n").to_numpy() > 1)))
            kept = np.flatnonzero(wanted)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, pa.array(same[kept])], names=[*batch.schema.names, "seen"])

    return scan


class SuffixIndex:
    """The index family. Keys must grow from batch to batch; close() deletes the tables."""

    def __init__(self, length: int = 100, anchor: int = 24, most_contexts: int = 20_000) -> None:
        self.kind, self.most_contexts = Minimizers(length, anchor), most_contexts
        self.order = [*self.kind.lead, "context"]
        self.levels: list[tuple[int, Table]] = []
        self.texts: DataFrame | None = None
        self.last_key: int | None = None
        self.complete = False

    def _entries(self, level: Table) -> DataFrame:
        """(order, key, at) of the contexts that were new in the level's scan, or came from the levels that it merged."""
        return level.df.where("level > 0 or not seen").select(*self.order, "key", "at")

    def extend(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """Indexes a batch (key, text); gives its places (key, at) whose context was seen earlier. After the last none may follow."""
        if self.complete:
            raise ValueError("the last batch was added")
        self.complete = last
        keys = docs.agg(F.min("key"), F.max("key")).first()
        if keys[0] is not None and self.last_key is not None and keys[0] <= self.last_key:
            raise ValueError("keys must grow from batch to batch")
        self.last_key = keys[1] if keys[1] is not None else self.last_key
        self.texts = docs if self.texts is None else self.texts.unionByName(docs)
        own = Table(_suffixes(docs, self.kind), "suffixes", "zstd")
        folded = Table(own.df.groupBy(*self.order).agg(F.min(F.struct("key", "at")).alias("place"), F.count("*").alias("n")).select(*self.order, "place.*", "n", F.lit(0).alias("level")), "folded", "zstd")
        rows, rank, merging = folded.df, 0, len(self.levels)
        while merging and (last or self.levels[merging - 1][0] == rank):
            rank, merging = rank + 1, merging - 1
        for k, (_, level) in enumerate(self.levels):
            rows = rows.unionByName(self._entries(level).withColumns({"n": F.lit(0).cast("long"), "level": F.lit(1 if k >= merging else -1)}))
        schema = ", ".join(f"{c} long" for c in self.order) + ", key long, at int, n long, level int, seen boolean"
        alike = rows.repartitionByRange(*self.order).sortWithinPartitions(*self.order, F.col("level") == 0)
        run = Table(alike.mapInArrow(_neighbours(self.order, self.kind.lead if last else None), schema), "level", "zstd")
        for table in (folded, *(level for _, level in self.levels[merging:])):  # run holds all that is needed of them
            table.drop()
        self.levels[merging:] = [(rank, run)]
        met = run.df.where("level = 0 and (seen or n > 1)").select(*self.order, "seen", F.struct("key", "at").alias("place"))
        found = written(own.df.join(met, self.order).where(F.col("seen") | (F.struct("key", "at") != F.col("place"))).select("key", "at"), "matches")
        own.drop()
        return found

    def shared(self, after: int | None = None) -> Table:
        """(prefix, key, at) of the contexts whose prefix has several, one of them of a key beyond `after`."""
        every = reduce(DataFrame.unionByName, (self._entries(level) for _, level in self.levels))
        several = every.groupBy(*self.kind.lead).agg(F.count("*").alias("n"), F.max("key").alias("newest")).where("n > 1")
        if after is not None:
            several = several.where(F.col("newest") > after)
        return Table(every.join(several.select(*self.kind.lead), self.kind.lead).select(F.xxhash64(*self.kind.lead).alias("prefix"), "key", "at"), "parts")

    def full(self, matches: DataFrame) -> DataFrame:
        """(key, begin, end): the bytes that matching places cover."""
        reach = self.kind.length - self.kind.anchor
        return matches.select("key", F.greatest(F.col("at") - reach, F.lit(0)).alias("begin"), (F.col("at") + self.kind.length).alias("end"))

    def add(self, docs: DataFrame) -> DataFrame:
        """Indexes a batch (key, text); gives (key, begin, end) of its bytes that occur earlier, in this batch or those before."""
        before = self.last_key
        matches = self.extend(docs)
        parts = self.shared(before)
        spans = _partial(self.texts, parts.df, self.kind, self.most_contexts)
        parts.drop()
        return self.full(matches).unionByName(spans if before is None else spans.where(F.col("key") > before))

    def close(self) -> None:
        for _, level in self.levels:
            level.drop()
        self.levels = []


def _batches(docs: DataFrame, number: int) -> list[DataFrame]:
    borders = docs.select(F.percentile_approx("key", [k / number for k in range(1, number)], 10_000)).first()[0] or []
    edges = sorted(set(borders))
    low, high = [None, *edges], [*edges, None]
    return [docs.where((F.lit(True) if a is None else F.col("key") > a) & (F.lit(True) if b is None else F.col("key") <= b)) for a, b in zip(low, high, strict=True)]


def _window_hashes(kind: Minimizers, contexts: list[bytes], lefts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context and each offset of a window before the suffix: the window's hash, and whether the window exists."""
    reach, size = kind.length - kind.anchor, 2 * kind.length - kind.anchor
    grid = np.zeros((len(contexts), size), np.uint64)
    sizes = np.array([len(c) for c in contexts], np.int64)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    row = np.repeat(np.arange(len(contexts)), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(reach - lefts, sizes)
    ahead, _ = _powers(1 << 22)
    with np.errstate(over="ignore"):
        grid[row, column] = (flat.astype(np.uint64) + np.uint64(1)) * _MIX * ahead[column]
        sums = np.concatenate([np.zeros((len(contexts), 1), np.uint64), np.cumsum(grid, axis=1)], axis=1)
        hashes = sums[:, kind.length :] - sums[:, : -kind.length]
    offsets = np.arange(reach + 1)[None, :]
    exists = (offsets >= reach - lefts[:, None]) & (offsets + kind.length <= (reach - lefts + sizes)[:, None])
    return hashes, exists


def _partial(docs: DataFrame, parts: DataFrame, kind: Minimizers, most_contexts: int) -> DataFrame:
    """(key, begin, end): bytes covered by windows of partly matching contexts that occur earlier."""
    spark, reach = docs.sparkSession, kind.length - kind.anchor
    places = parts.groupBy("key").agg(F.collect_list(F.struct("prefix", "at")).alias("places"))
    asked = docs.join(places, "key").select("key", "text", F.col("places.prefix").alias("prefixes"), F.col("places.at").alias("ats"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for key, text, prefixes, ats in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                rows += [(p, key, a, *kind.context(text, a)) for p, a in zip(prefixes, ats, strict=True)]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()], strict=True)], names=["prefix", "key", "at", "bytes", "left"])

    schema = "prefix long, key long, at int, bytes binary, left int"
    sizes = parts.groupBy("prefix").count()
    large = written(sizes.where(F.col("count") > most_contexts).select("prefix"), "large")
    store = Table(asked.mapInArrow(fetch, schema), "contexts")
    contexts = store.df
    together = contexts.join(large, "prefix", "left_anti").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "prefix").sortWithinPartitions("prefix", "key", "at")

    def spans(keys: np.ndarray, ats: np.ndarray, repeat: np.ndarray) -> pa.RecordBatch:
        row, offset = np.nonzero(repeat)
        begin = ats[row] + offset - reach
        # neighbouring windows of a context make one span
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        last = np.concatenate([first[1:] - 1, [len(row) - 1]]) if len(row) else first
        return pa.RecordBatch.from_arrays([pa.array(keys[row[first]]), pa.array(begin[first].astype(np.int32)), pa.array((begin[last] + kind.length).astype(np.int32))], names=["key", "begin", "end"])

    def compare(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(rows).combine_chunks()
        prefix, keys, ats, lefts = (block[c].to_numpy() for c in ("prefix", "key", "at", "left"))
        hashes, exists = _window_hashes(kind, block["bytes"].to_pylist(), lefts.astype(np.int64))
        repeat = np.zeros(hashes.shape, bool)
        group = np.cumsum(np.concatenate([[0], prefix[1:] != prefix[:-1]])).astype(np.uint64)
        for offset in range(reach + 1):
            own = np.flatnonzero(exists[:, offset])
            mixed = hashes[own, offset]
            order = np.lexsort((own, mixed, group[own]))  # the rows come in order of key and place
            same = (mixed[order][1:] == mixed[order][:-1]) & (group[own][order][1:] == group[own][order][:-1])
            repeat[own[order[1:][same]], offset] = True
        return spans(keys, ats.astype(np.int64), repeat)

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares rows in blocks that end where a prefix ends."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            prefix = batch.column(0).to_numpy()
            if not len(prefix):
                continue
            cut = int(np.searchsorted(prefix, prefix[-1]))  # the last prefix may go on
            if sum(b.num_rows for b in held) + cut >= 4000:
                held.append(batch.slice(0, cut))
                yield compare([b for b in held if b.num_rows]) if any(b.num_rows for b in held) else batch.slice(0, 0)
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield compare(held)

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lefts = batch.column(4).to_numpy().astype(np.int64)
            hashes, exists = _window_hashes(kind, batch.column(3).to_pylist(), lefts)
            row, offset = np.nonzero(exists)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(offset.astype(np.int32)), pa.array(hashes[row, offset].view(np.int64)), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row))], names=["prefix", "offset", "hash", "key", "at"])

    small = together.mapInArrow(whole_groups, "key long, begin int, end int")
    if large.isEmpty():
        spans_found = written(small, "spans")
        store.drop()
        return spans_found
    hashed = contexts.join(large, "prefix", "left_semi").mapInArrow(hash_windows, "prefix long, offset int, hash long, key long, at int")
    place = F.struct("key", "at")
    firsts = hashed.groupBy("prefix", "offset", "hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    begin = (F.col("at") + F.col("offset") - reach).cast("int")
    repeated = hashed.join(firsts, ["prefix", "offset", "hash"]).where(place != F.col("first")).select("key", begin.alias("begin"), (begin + kind.length).cast("int").alias("end"))
    spans_found = written(small.unionByName(repeated), "spans")
    store.drop()
    return spans_found


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, anchor: int = 24, batches: int = 4, most_contexts: int = 20_000) -> DataFrame:
    """One row per document: id, kept (the remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs)."""
    rows = keyed(docs, id_col, text_col)
    index = SuffixIndex(length, anchor, most_contexts)
    try:
        dealt = _batches(rows, batches)
        matches = reduce(DataFrame.unionByName, [index.extend(batch, batch is dealt[-1]) for batch in dealt])
        parts = index.shared()
    finally:
        index.close()
    spans = index.full(matches).unionByName(_partial(rows, parts.df, index.kind, most_contexts))
    covered = written(spans.groupBy("key").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends")), "covered")
    parts.drop()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            kept, removed, runs = [], [], []
            for text, begins, ends in zip(as_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if not begins:
                    kept.append(text), removed.append(0), runs.append(0)
                    continue
                b, e = np.array(begins, np.int64), np.minimum(np.array(ends, np.int64), len(text))
                marks = np.zeros(len(text) + 2, np.int64)
                np.add.at(marks, b, 1)
                np.add.at(marks, e, -1)
                out = np.cumsum(marks[: len(text)]) > 0
                kept.append(np.frombuffer(text, np.uint8)[~out].tobytes())
                removed.append(int(out.sum()))
                runs.append(int(np.count_nonzero(out & ~np.concatenate([[False], out[:-1]]))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(byte_lengths(part.column(1))), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=["id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = rows.join(covered, "key", "left").select("id", "text", "begins", "ends")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long"
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
