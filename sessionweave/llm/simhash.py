"""SimHash near-duplicates through segment popcounts.

A fingerprint's 64 bits are cut into segments of equal width and each segment's set bits are counted. The Manhattan distance of two count
vectors never exceeds the Hamming distance of the fingerprints, so a range join on the counts' grid finds every pair that can
link. A fingerprint enters its own grid cell and those one step away: two vectors at most two steps apart always meet in such a
cell. Pairs that meet are verified exactly.

Narrower segments make smaller cells and more entries. The width is the largest of 4, 2 and 1 bits at which the fullest cell of that
many random fingerprints is expected to hold at most `DENSE_CELL` entries: 4 bits (16 segments, 31 entries each on average, the fullest
cell having (6/16)^16 of the fingerprints) up to about 14 million distinct fingerprints, 2 bits (32 segments, 49 entries, 2^-32) up to
about 5.6 billion, then 1 bit. Cells that are fuller all the same, say by a group of near copies, pass their fingerprints on to the grid
of 1 bit. There the counts are the bits themselves, a cell is a fingerprint, its 64 neighbours the single-bit changes, and any two that
enter one cell are within two bits; so each links to the least one there and no pairs are formed.

Copies are folded into one fingerprint first, components are found on the distinct fingerprints.

Nulls and edge cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; a null
id is ignored when the least id of a group is taken (a group of null ids only has a null component); repeated rows each give a
row; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, as_bytes, shuffled, slices, written
from .components import connected_components

#: Entries of a grid cell beyond which its fingerprints go on to the grid of one-bit segments.
DENSE_CELL = 64
#: Width of a segment to the distinct fingerprints up to which it is used.
WIDTHS = {4: 14_000_000, 2: 5_600_000_000}
#: Byte value to its eight bits, one in each byte of a 64-bit number.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    found = text.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = list(accumulate(len(w) + 1 for w in found))
    return [xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]


def fingerprints_of(texts: list[bytes], words: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints of the texts' shingles."""
    return fingerprints_of_hashes([np.array(shingle_hashes(t, words), np.uint64) for t in texts])


def fingerprints_of_hashes(hashes: list[np.ndarray]) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is set if over half of the hashes have it; zero of none."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate(hashes)
    octets = flat.view(np.uint8).reshape(-1, 8)
    first = np.cumsum(sizes[full]) - sizes[full]
    runs = [np.arange(a, a + n, 255) for a, n in zip(first, sizes[full], strict=True)]  # eight-bit counters hold 255
    starts, owner = np.concatenate(runs), np.cumsum([0, *(len(r) for r in runs[:-1])])
    for k in range(8):
        counts = np.add.reduceat(_SPREAD[octets[:, k]], starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(counts, owner, axis=0)
        byte = ((2 * ones > sizes[full][:, None]) << np.arange(8)).sum(axis=1).astype(np.uint64)
        out[full] |= byte << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, carry: Sequence[str] | None = None) -> DataFrame:
    """(id, fp): each row's fingerprint as a signed long; with `carry` also the text and those columns."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in carry or ()))
    kept = [] if carry is None else source.schema.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fp = pa.array(fingerprints_of(as_bytes(part.column(1)), words).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), fp, *(part.column(c) for c in kept)], names=["id", "fp", *kept])

    fields = [source.schema["id"], T.StructField("fp", T.LongType()), *(source.schema[c] for c in kept)]
    return source.mapInArrow(run, T.StructType(fields))


def entered(distinct: DataFrame, width: int) -> DataFrame:
    """(fp, rep, cell): each fingerprint's own grid cell and those one step away, for segments of so many bits."""
    size = width.bit_length()  # bits of a count
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for k in range(64 // width)]
    cell = reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(c, size * k) for k, c in enumerate(counts)))
    step = lambda c, to, k: F.col("cell").bitwiseXOR(F.shiftleft(c.bitwiseXOR(to), size * k))
    steps = [F.when(c < width, step(c, c + 1, k)) for k, c in enumerate(counts)] + [F.when(c > 0, step(c, c - 1, k)) for k, c in enumerate(counts)]
    return distinct.withColumn("cell", cell).select("fp", "rep", F.explode(F.array_compact(F.array("cell", *steps))).alias("cell"))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between the reps of distinct fingerprints (fp, rep) at most two bits apart, enough for all components."""
    n = distinct.count()
    width = next((w for w, most in WIDTHS.items() if n <= most), 1)
    found = []
    if width > 1:
        cells = entered(distinct, width)
        sizes = cells.groupBy("cell").count().where("count > 1")
        shared = Table(shuffled(cells).join(sizes, "cell"), "cells").df
        sparse, dense = shared.where(F.col("count") <= DENSE_CELL), shared.where(F.col("count") > DENSE_CELL).select("fp", "rep").distinct()
        left, right = sparse.select("cell", F.col("fp").alias("fp_a"), F.col("rep").alias("a")), sparse.select("cell", F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
        close = (F.col("fp_a") < F.col("fp_b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= 2)
        found.append(shuffled(left).join(right, "cell").where(close).select("a", "b"))
    else:
        dense = distinct
    cells = entered(dense, 1)
    least = cells.groupBy("cell").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1")
    found.append(shuffled(cells).join(least, "cell").select(F.col("rep").alias("a"), "b").where("a <> b"))
    return reduce(DataFrame.unionByName, found).distinct()


def groups(prints: DataFrame) -> DataFrame:
    """(fp, group): the distinct fingerprints and the least one that links of up to two bits reach, whatever the ids are."""
    distinct = written(prints.select("fp").distinct().withColumn("rep", F.col("fp")), "distinct")
    found = connected_components(links(distinct))
    return shuffled(distinct).join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("group"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: id, fp (signed long), component (least id that links of up to two bits reach)."""
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    grouped = written(shuffled(prints.groupBy("fp").agg(F.min("id").alias("rep"))).join(groups(prints), "fp"), "grouped")
    named = shuffled(grouped).join(grouped.groupBy("group").agg(F.min("rep").alias("component")), "group").select("fp", "component")
    return shuffled(prints).join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")


def fingerprint_hex(fp: str = "fp") -> F.Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
