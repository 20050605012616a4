"""Quality rules with suffix-array repetition.

A text's words become numbers and its suffixes are sorted by prefix doubling: each round compares twice as many words, and only
suffixes that are still tied stay in. All texts of a step are sorted together, a text's words never comparing equal to another's.
Longest common prefixes of neighbours then give each position's longest repeat, the larger of its two neighbours'. Every maximal repeated
substring, which is what an interval of common prefixes stands for, is at each of its places the longest repeat there or within it, so the
spans of the positions' longest repeats of at least `least_repeat` words have the same union, and intervals needn't be formed. A text fails if
they cover more than `most_covered` of its words or if the longest repeat exceeds `most_longest` words.

Nulls and edge cases: a null or empty text has no words and fails the base rules; repeated rows each give a row; an empty table
gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes that begin a code point outside white space.
_WORD_CHAR = ((np.arange(256) & 0xC0) != 0x80) & ~_SPACE
_SYMBOL = np.isin(np.arange(256), list(b"[#*$%&|<>]"[1:-1]))


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position of the concatenated texts, the longest run of words from there that begins elsewhere in its text too.

    words: word numbers; ends: for each position, where its text ends.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    owner = np.cumsum(np.concatenate([[0], ends[1:] != ends[:-1]]))
    keys = owner * (int(words.max()) + 1) + words
    suffixes = np.argsort(keys, kind="stable")
    ordered = keys[suffixes]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[suffixes] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, size = [rank.copy()], 1
    slots = np.flatnonzero(~fresh | np.concatenate([~fresh[1:], [False]]))  # places in the order that are still tied
    while len(slots):
        tied = suffixes[slots]
        ahead = tied + size
        inside = ahead < ends[tied]
        second = np.where(inside, rank[np.where(inside, ahead, 0)], -1)
        order = np.argsort(rank[tied] * (n + 1) + second + 1, kind="stable")
        tied, second = tied[order], second[order]
        suffixes[slots] = tied
        first = rank[tied]
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (second[1:] < 0)])
        rank[tied] = np.maximum.accumulate(np.where(fresh, slots, 0))
        slots = slots[~fresh | np.concatenate([~fresh[1:], [False]])]
        size *= 2
        levels.append(rank.copy())
    left, right = suffixes[:-1], suffixes[1:]
    pairs = np.flatnonzero(levels[0][left] == levels[0][right])
    left, right = left[pairs], right[pairs]
    common = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        room = (a < ends[left]) & (b < ends[right])
        same = room & (levels[k][np.where(room, a, 0)] == levels[k][np.where(room, b, 0)])
        common[same] += 1 << k
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def covered(longest: np.ndarray, least: int, length: int | None = None) -> np.ndarray:
    """Positions inside repeats of at least `least` words; with length, each counts for its first so many words only."""
    starts = np.flatnonzero(longest >= least)
    marks = np.zeros(len(longest) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + (longest[starts] if length is None else length), -1)
    return np.cumsum(marks[:-1]) > 0


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends] - total[starts]


def measures(texts: list[bytes], least_repeat: int) -> dict[str, np.ndarray]:
    """Each text's counts."""
    numbers: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in split for w in ws), np.int64, int(counts.sum()))
    ends = np.cumsum(counts)
    starts = ends - counts
    longest = longest_repeats(words, np.repeat(ends, counts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    byte_ends = np.cumsum(sizes)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    most = np.zeros(len(texts), np.int64)
    full = np.flatnonzero(counts)
    if len(full):
        most[full] = np.maximum.reduceat(longest, starts[full])
    return {
        "n_words": counts,
        "word_chars": _sums(_WORD_CHAR[data], byte_ends - sizes, byte_ends),
        "n_symbols": _sums(_SYMBOL[data], byte_ends - sizes, byte_ends),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": _sums(covered(longest, 3, 3), starts, ends),
        "n_covered_words": _sums(covered(longest, least_repeat), starts, ends),
        "longest_repeat": most,
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_repeat: int = 10, most_covered: float = 0.3, most_longest: int = 200, least_words: int = 50) -> DataFrame:
    """One row per document: id, the measures, base_failed and kept."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = measures(as_bytes(part.column(1)), least_repeat)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=["id", *MEASURES])

    counted = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repetitive = (F.col("n_covered_words") > most_covered * F.col("n_words")) | (F.col("longest_repeat") > most_longest)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repetitive).withColumnRenamed("id", id_col)
