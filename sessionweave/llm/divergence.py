"""How far sources of a language diverge in their words, exactly, by tiles of group blocks.

A group is a language and source. Terms are runs of letters; a language keeps those in at least `least_docs` of its documents. Each group gives
each kept term p = 1 + floor(SCALE * (count + 5) / (N + 5 * V)), N being its count of kept terms and V their number. Two groups of a
language diverge by the sum of |p - q| over all kept terms; a group's own terms are those with a p over the language's.

Documents are counted in batches before anything is shuffled, so a source with most of the documents sends one row a batch and term. Kept terms are
dealt to chunks of about `CHUNK` terms, and a group's counts in a chunk are packed into one row. Groups are dealt to blocks of about `BLOCK`
groups; a tile compares two blocks. A packed row is replicated to the tiles of its block, one for each block of the language. A
tile takes its rows chunk by chunk and adds up the matrix of its pairs, so it holds one chunk of two blocks, whatever the vocabulary is.
What a term adds to a pair in which both groups lack it is the same for all such terms and is added at the end, so absent rows cost nothing.

All arithmetic is on whole numbers; counts of up to 9e15 in a group are exact. Ranks of terms are cut off while sorting, before the shuffle.

Nulls and edge cases: null text, language and source are empty strings; groups without terms take part in pairs and have no terms of their
own; a language without kept terms has pairs of value 0, and one with a single source has none; repeated documents count each; texts of
any length are read whole; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, as_bytes, slices, with_few

SCALE, EXTRA = 1_000_000_000, 5
#: Terms of a chunk and groups of a block, on average.
CHUNK, BLOCK = 1024, 32
#: Rows of a list of languages or groups that is broadcast.
SENT = 100_000
#: Bytes of text that are counted together.
_COUNTED = 16 << 20
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def group_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents with it."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "t"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", _COUNTED):
            counts, docs = defaultdict(Counter), defaultdict(Counter)
            for group, text in zip(zip(*(part.column(k).to_pylist() for k in (0, 1)), strict=True), as_bytes(part.column(2)), strict=True):
                terms = _TERM.findall(text.lower())
                counts[group].update(terms)
                docs[group].update(set(terms))
            for (lang, source), found in counts.items():
                terms = pa.array(list(found), pa.binary()).cast(pa.string())
                same = lambda x: pa.array([x]).take(pa.array(np.zeros(len(terms), np.int64)))
                own = docs[lang, source]
                yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array(found.values(), pa.int64()), pa.array([own[x] for x in found], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    partial = docs.select(*columns).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> F.Column:
    """p of a count, in whole numbers."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + {EXTRA} as decimal(19,0))) div ({total} + {EXTRA} * v)")


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """The same, three digits at a time, so that no product overflows."""
    whole, rest = np.divmod(counts + EXTRA, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return 1 + whole


class _Tile:
    """The pairs of two blocks of groups."""

    def __init__(self, key: tuple[str, int, int]) -> None:
        self.key, self.groups, self.chunk, self.rows = key, ({}, {}), None, {}
        self.sums: np.ndarray | None = None

    def add(self, source: str, block: int, total: int, v: int, chunk: int, places: np.ndarray, counts: np.ndarray) -> None:
        if chunk != self.chunk:
            self.end_chunk()
            self.chunk = chunk
        if chunk < 0:
            for side in (0, 1):
                if self.key[1 + side] == block:
                    self.groups[side][source] = (total + EXTRA * v, v)
        else:
            self.rows[source] = (places, counts)

    def _absent(self, side: int) -> np.ndarray:
        return np.array([shares(np.zeros(1, np.int64), d)[0] if d else 0 for d, _ in self.groups[side].values()], np.int64)

    def _dense(self, side: int, width: int) -> np.ndarray:
        out = np.repeat(self._absent(side)[:, None], width, axis=1)
        for k, (source, (total, _)) in enumerate(self.groups[side].items()):
            if source in self.rows:
                places, counts = self.rows[source]
                out[k, places] = shares(counts, total)
        return out

    def end_chunk(self) -> None:
        if self.sums is None and self.chunk is not None:
            a, b = self._absent(0), self._absent(1)
            self.apart = np.abs(a[:, None] - b[None])
            v = max((v for _, v in [*self.groups[0].values(), *self.groups[1].values()]), default=0)
            self.sums = v * self.apart
        if self.rows:
            width = 1 + max(int(p.max()) for p, _ in self.rows.values())
            left, right = self._dense(0, width), self._dense(1, width)
            for k, row in enumerate(left):
                self.sums[k] += np.abs(right - row).sum(axis=1) - width * self.apart[k]
            self.rows = {}

    def pairs(self) -> pa.RecordBatch:
        self.end_chunk()
        left, right = list(self.groups[0]), list(self.groups[1])
        i, j = (x.ravel() for x in np.indices(self.sums.shape))
        a, b, value = pa.array(left, pa.string()).take(pa.array(i)), pa.array(right, pa.string()).take(pa.array(j)), pa.array(self.sums.ravel())
        if self.key[1] == self.key[2]:
            both = (a, b, value)
        else:
            both = tuple(pa.concat_arrays(x) for x in ((a, b), (b, a), (value, value)))
        out = pa.RecordBatch.from_arrays([pa.array([self.key[0]]).take(pa.array(np.zeros(len(both[0]), np.int64))), *both], names=["lang", "source", "item", "value"])
        return out.filter(pa.compute.not_equal(out.column("source"), out.column("item")))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of tiles whose rows come one after another, by chunks."""
    tile = None
    for batch in batches:
        lang, first, second, chunk, source, block, total, v, cells = (batch.column(k) for k in range(9))
        ends = np.asarray(cells.offsets)
        places, counts = (np.asarray(cells.values.field(k)) for k in (0, 1))
        for k, (key, x) in enumerate(zip(zip(*(c.to_pylist() for c in (lang, first, second)), strict=True), zip(*(c.to_pylist() for c in (source, block, total, v, chunk)), strict=True), strict=True)):
            if tile is None or tile.key != key:
                if tile:
                    yield tile.pairs()
                tile = _Tile(key)
            tile.add(*x, places[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]])
    if tile:
        yield tile.pairs()


def pair_values(entries: DataFrame, sizes: DataFrame, block_of: int = BLOCK) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of different sources of a language."""
    blocks = sizes.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(block_of)).cast("int").alias("blocks"))
    heads = sizes.join(blocks, "lang").select("lang", "source", "total", "v", "blocks", F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("block"))
    packed = entries.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("cells"))
    empty = sizes.select("lang", "source", F.lit(-1).alias("chunk"), F.expr("cast(array() as array<struct<place:int,n:bigint>>)").alias("cells"))
    rows = with_few(packed.unionByName(empty), heads, ["lang", "source"], "inner", SENT).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = rows.select("lang", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "chunk", "source", "block", "total", "v", "cells")
    ordered = tiles.repartition("lang", "first", "second").sortWithinPartitions("lang", "first", "second", "chunk")
    return ordered.mapInArrow(_tiles, "lang string, source string, item string, value long")


def audit_sources(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chunk_of: int = CHUNK, block_of: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): of part `pair` all other sources of the language, the farthest first; of part `term` the
    `most_terms` terms by which a group exceeds its language most. Ties go by item."""
    counted = Table(group_counts(docs, text_col, lang_col, source_col), "group_counts")
    kept = Table(counted.df.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    langs = kept.df.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_total"))
    chunked = with_few(kept.df, langs, ["lang"], "inner", SENT).withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / F.lit(chunk_of))).cast("int"))
    dealt = chunked.repartition("lang", "chunk")  # else a window takes what is dealt by language alone
    named = dealt.select("lang", "term", "in_lang", "chunk", (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).alias("place"))
    entries = Table(counted.df.drop("docs").join(named, ["lang", "term"]), "entries")
    counted.drop()
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))).distinct()
    totals = entries.df.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = Table(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"]), "sizes")
    kept.drop()
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(own).alias("rank"))
    over = with_few(entries.df, sizes.df, ["lang", "source"], "inner", SENT).select("lang", "source", F.col("term").alias("item"), (_share("n", "total") - _share("in_lang", "lang_total")).alias("value")).where("value > 0")
    pairs = pair_values(entries.df.select("lang", "source", "chunk", "place", "n"), sizes.df, block_of)
    return ranked(pairs, "pair").unionByName(ranked(over, "term").where(F.col("rank") <= most_terms))
