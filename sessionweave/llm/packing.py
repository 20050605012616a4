"""Packing of tokenised documents into fixed sequences by cutting-stock column generation.

Documents are cut at multiples of the sequence length, and what remains is cut once more so that its first part is a multiple of
`grain` tokens and its second part shorter than that. Pieces then have few different lengths, and the short ones fill gaps. The
lengths form a histogram. A linear program over patterns, that is, multisets of lengths that fit one sequence, is solved by column
generation: the current basis's dual prices go into a knapsack dynamic program, whose best pattern enters the basis, until no
pattern can improve the bound by more than `tolerance`. Patterns are used as often as the solution's whole parts say, and what is
left is packed first-fit by decreasing length. Pieces are ranked among those of their length, and a rank determines pattern, copy
and sequence.

Only the histogram (length / grain + grain entries at most) reaches the driver, and only the plan (a few rows for each length) is
broadcast; both have the same bound at any input size.

Nulls and edge cases: a null or empty text is the closing id alone; repeated documents are packed each; a null id is carried
along; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP_BYTES, as_bytes, slices, small_batches, written

#: Pieces of one length that are ranked together; more of them are dealt to several groups.
RANKED_TOGETHER = 200_000
#: Distinct words whose ids a Python worker remembers.
REMEMBERED = 1_500_000


_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))


def _unlike(data: np.ndarray, first: np.ndarray, last: np.ndarray, other: np.ndarray, held: np.ndarray | None = None, edges: np.ndarray | None = None) -> np.ndarray:
    """Which words differ by length or any byte from the word that `other` names for each: one of them, or of those between `edges` in `held`."""
    size = last - first
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    if held is None:
        base, ends, theirs = first[other], last[other], padded
    else:
        base, ends, theirs = edges[other].astype(np.int64), edges[other + 1].astype(np.int64), held
    bad = size != ends - base
    rows = np.flatnonzero(~bad & (theirs is not padded or other != np.arange(len(other))))
    eight, their_eight = (np.lib.stride_tricks.as_strided(x[:8].view(np.uint64), (len(x) - 7,), (1,)) for x in (padded, theirs))
    for at in (0, 8):  # most words end here
        rest = np.minimum(size[rows] - at, 8).astype(np.uint64)
        mask = np.where(rest < 8, (np.uint64(1) << (np.uint64(8) * (rest % np.uint64(8)))) - np.uint64(1), ~np.uint64(0))
        bad[rows[((eight[first[rows] + at] ^ their_eight[base[rows] + at]) & mask) != 0]] = True
        rows = rows[size[rows] > at + 8]
    left = size[rows] - 16
    if len(rows):
        inner = np.arange(int(left.sum())) - np.repeat(np.cumsum(left) - left, left)
        same = data[np.repeat(first[rows] + 16, left) + inner] == theirs[np.repeat(base[rows] + 16, left) + inner]
        bad[rows[~np.logical_and.reduceat(same, np.cumsum(left) - left)]] = True
    return np.flatnonzero(bad)


def _hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of the words' bytes, the same wherever a word stands."""
    ahead, back = _powers(1 << max(21, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        valued = data.astype(np.uint64)
        valued += np.uint64(1)
        valued *= ahead[: len(data)]
        np.cumsum(valued, out=sums[1:])
        return (sums[last] - sums[first]) * back[first]


_RUNS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")


class WordTokenizer:
    """Ids of whole texts from the ids of their white-space separated words, which are remembered.

    For tokenizers that drop white space, lower-case, and split words into runs of letters, single digits and runs of marks: there
    a text's ids are its parts' ids one after another.
    """

    def __init__(self, path: str, closing_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.closing_id = Tokenizer.from_file(path), closing_id
        self._forget()

    def _forget(self) -> None:
        """Words are kept as bytes in one buffer, found by their hashes in order; those that share another's hash are kept apart."""
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.words, self.edges = bytearray(8), array("I", [0, 0])  # eight bytes follow the last word
        self.odd: dict[bytes, int] = {}
        self.flat, self.starts = array("I", [self.closing_id]), array("I", [0, 1])

    def _known(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word that is remembered by its hash, else -1."""
        if not len(self.hashes) or not len(first):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        codes = np.full(len(first), -1)
        codes[hit] = self.numbers[at[hit]]
        held, edges = np.frombuffer(self.words, np.uint8), np.frombuffer(self.edges, np.uint32)
        codes[hit[_unlike(data, first[hit], last[hit], codes[hit], held, edges)]] = -1
        return codes

    def _codes(self, words: list[bytes]) -> dict[bytes, int]:
        """The numbers of the words that are remembered."""
        last = np.cumsum([len(w) for w in words], dtype=np.int64)
        first = last - np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        found = self._known(data, first, last, _hashes(data, first, last)).tolist()
        return {w: c for w, code in zip(words, found, strict=True) if (c := self.odd.get(w, -1) if code < 0 else code) >= 0}

    def _learn(self, words: list[bytes]) -> dict[bytes, int]:
        """Gives every new word a number; a word of ASCII gets the ids of its runs of letters, its digits and its runs of marks."""
        joint, new = [], []
        for word in words:
            if word.isalpha() or not word.isascii() or b"'" in word or b"<|" in word or word != word.lower():
                new.append(word)
            else:
                joint.append((word, _RUNS.findall(word)))
        parts = list({p for _, ps in joint for p in ps}.difference(words))
        codes, flat, starts, before = self._codes(parts), self.flat, self.starts, len(self.starts) - 1
        new += [p for p in parts if p not in codes]
        added: list[bytes] = []

        def add(word: bytes, ids: list[int] | array) -> None:
            codes[word] = before + len(added)
            added.append(word)
            flat.extend(ids)
            starts.append(len(flat))

        for k in range(0, len(new), 2000):  # what the tokenizer gives for a word is large
            some = new[k : k + 2000]
            for word, found in zip(some, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                add(word, found.ids)
        joint.sort(key=lambda j: len(j[1]))  # a word that is a run itself comes before those it is part of
        for word, ps in joint:
            if len(ps) == 1:
                add(word, self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
            else:
                add(word, [i for p in ps for i in flat[starts[codes[p]] : starts[codes[p] + 1]]])
        self._remember(added, before)
        return codes

    def _remember(self, words: list[bytes], number: int) -> None:
        """Words whose ids have been put down, from that number on."""
        sizes = np.array([len(w) for w in words], np.int64)
        last = np.cumsum(sizes)
        joined = b"".join(words)
        hashes = _hashes(np.frombuffer(joined, np.uint8), last - sizes, last)
        numbers = np.arange(number, number + len(words), dtype=np.uint32)
        self.edges.extend((last + self.edges[-1]).tolist())
        self.words[-8:] = joined + bytes(8)
        order = np.argsort(hashes, kind="stable")
        hashes, numbers = hashes[order], numbers[order]
        at = np.searchsorted(self.hashes, hashes)
        taken = np.concatenate([[False], hashes[1:] == hashes[:-1]])
        if len(self.hashes):
            taken |= self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes
        self.odd.update((words[k - number], k) for k in numbers[taken].tolist())
        self.hashes = np.insert(self.hashes, at[~taken], hashes[~taken])
        self.numbers = np.insert(self.numbers, at[~taken], numbers[~taken])

    @staticmethod
    def _alike(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers words so that equal ones share one, and gives a word of each number and its hash. Words of one hash are compared byte by byte."""
        hashes = _hashes(data, first, last)
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes
        order = np.argsort(hashes)
        fresh = np.concatenate([[True], np.diff(hashes[order]) != 0])
        number = np.empty(len(first), np.int64)
        number[order] = np.cumsum(fresh) - 1
        sample = order[fresh]
        odd = _unlike(data, first, last, sample[number])
        if len(odd):
            more: dict[bytes, int] = {}  # words that share another's hash
            extra = []
            for k in odd.tolist():
                word = data[first[k] : last[k]].tobytes()
                if word not in more:
                    more[word] = len(sample) + len(more)
                    extra.append(k)
                number[k] = more[word]
            sample = np.concatenate([sample, np.array(extra, np.int64)])
        return number, sample, hashes[sample]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's closed by the closing id, and where each text ends."""
        if len(self.starts) > REMEMBERED or max(len(self.flat) // 2, len(self.words) // 8) > 4 * REMEMBERED:
            self._forget()
        joined = b" ".join([*(t if b"<|" in t else t.lower() for t in texts), b""])
        data = np.frombuffer(joined, np.uint8)
        edges = np.flatnonzero(np.diff(_BLANK[data], prepend=True, append=True))
        first, last = edges[::2], edges[1::2]  # of each word
        one, sample, hashes = self._alike(data, first, last)
        coded = self._known(data, first[sample], last[sample], hashes)
        new = np.flatnonzero(coded < 0)
        if len(new):
            words = [joined[a:b] for a, b in zip(first[sample[new]].tolist(), last[sample[new]].tolist(), strict=True)]
            learned = self._learn([w for w in words if w not in self.odd])
            coded[new] = [self.odd[w] if w in self.odd else learned[w] for w in words]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        words_before = np.searchsorted(first, text_ends)
        known = np.insert(coded[one], words_before, 0)
        starts, flat = np.frombuffer(self.starts, np.uint32), np.frombuffer(self.flat, np.uint32)
        begun = starts[known].astype(np.int64)
        sizes = starts[known + 1] - begun
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(begun - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, ends[words_before + np.arange(len(texts))]


@lru_cache(maxsize=2)
def _tokenizer(path: str, closing_id: int) -> WordTokenizer:
    """One for each Python worker."""
    return WordTokenizer(path, closing_id)


def pieces_of(docs: DataFrame, tokenizer_path: str, length: int = 2048, closing_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, grain: int = 32) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids, cut at multiples of `length` and of `grain`."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path, closing_id)
        for part in slices(batches, "text", STEP_BYTES // 2):
            ids, ends = tokenizer.encode(as_bytes(part.column(1)))
            raw, rows, owner, before = memoryview(ids.astype("<u4", copy=False)).cast("B"), [], [], 0
            for k, end in enumerate(ends.tolist()):
                whole, rest = divmod(end - before, length)
                cuts = [*range(0, whole * length + 1, length), whole * length + rest // grain * grain, end - before]
                for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                    if to > at:
                        rows.append((at, to - at, zlib.crc32(raw[4 * (before + at) : 4 * (before + to)]), end - before))
                        owner.append(k)
                before = end
            columns = [part.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))]
            if with_ids:
                sizes = np.array([r[1] for r in rows])
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value of a pattern, and how often it takes each class."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    padded = np.concatenate([np.full(capacity, -1e18), best])  # negative room is worthless
    for room in range(int(sizes.min()), capacity + 1):
        worth = padded[capacity + room - sizes] + prices
        k = int(worth.argmax())
        padded[capacity + room] = padded[capacity + room - 1]
        if worth[k] > padded[capacity + room]:
            padded[capacity + room], taken[room] = worth[k], k
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
            continue
        pattern[taken[room]] += 1
        room -= int(sizes[taken[room]])
    return float(padded[-1]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 5e-4, most_columns: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; together they hold exactly the demand."""
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(np.float64)
    inverse, x = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for step in range(most_columns):
        prices = inverse.sum(axis=0)
        value, pattern = _knapsack(sizes, prices, capacity)
        if value <= 1 + tolerance:  # total / value bounds the optimum from below
            break
        way = inverse @ pattern
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x -= theta * way
        x[out] = theta
        basis[:, out] = pattern
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
            x = inverse @ demand
    used: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    for k in np.argsort(-x):
        pattern = basis[:, k].round().astype(np.int64)
        times = int(min(np.floor(x[k] + 1e-6), (left[pattern > 0] // pattern[pattern > 0]).min()))
        if times > 0:
            used.append((pattern, times))
            left -= times * pattern
    return used + _first_fit(sizes, left, capacity)


def _first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Packs what is left by decreasing size, many equal pieces at a time."""
    bins: list[np.ndarray] = []
    room: list[int] = []
    for k in np.argsort(-sizes):
        size, n = int(sizes[k]), int(left[k])
        for b in range(len(bins)):
            if n and room[b] >= size:
                fits = min(n, room[b] // size)
                bins[b][k] += fits
                room[b] -= fits * size
                n -= fits
        while n:
            fits = min(n, capacity // size)
            bins.append(np.zeros(len(sizes), np.int64))
            bins[-1][k] = fits
            room.append(capacity - fits * size)
            n -= fits
    return [(b, 1) for b in bins]


def packing_plan(counts: dict[int, int], length: int) -> pd.DataFrame:
    """For each piece length and pattern: first_rank, last_rank, held (in a copy of the pattern), first_sequence."""
    sizes = np.array(sorted(counts), np.int64)
    demand = np.array([counts[s] for s in sorted(counts)], np.int64)
    rows, rank, sequence = [], np.zeros(len(sizes), np.int64), 0
    for pattern, times in cutting_stock(sizes, demand, length):
        for k in np.flatnonzero(pattern):
            slots = int(pattern[k]) * times
            rows.append((int(sizes[k]), int(rank[k]), int(rank[k]) + slots - 1, int(pattern[k]), sequence))
            rank[k] += slots
        sequence += times
    assert (rank == demand).all()
    return pd.DataFrame(rows, columns=["length", "first_rank", "last_rank", "held", "first_sequence"])


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, closing_id: int = 1, id_col: str = "doc_id", text_col: str = "text", grain: int = 32, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]."""
    spark = docs.sparkSession
    with small_batches(spark):
        pieces = written(pieces_of(docs, tokenizer_path, length, closing_id, id_col, text_col, with_ids, grain), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # length / grain + grain rows at most
    if not counts:
        return pieces.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
    plan = F.broadcast(spark.createDataFrame(packing_plan(counts, length)))
    groups = 1 + sum(counts.values()) // RANKED_TOGETHER
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(groups)))
    dealt_before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = dealt.groupBy("length", "deal").agg(F.count("*").alias("n")).select("length", "deal", dealt_before.alias("before"))
    within = Window.partitionBy("length", "deal").orderBy("id", "start", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(within) - 1).join(before, ["length", "deal"]).withColumn("rank", F.col("before") + F.col("place"))
    placed = ranked.join(plan, "length").where("rank between first_rank and last_rank").withColumn("sequence_id", F.expr("first_sequence + (rank - first_rank) div held"))
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
