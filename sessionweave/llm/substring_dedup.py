"""Substring deduplication by sliding sentence spans.

A text is cut into sentences, here also at commas, semicolons, colons, bars and line ends. Words without such a mark are cut after
the word of least hash among every `most_words` neighbours: inside a passage these cuts are the same wherever it stands, but for
less than `most_words` words at either end, and no piece is longer than that.

Every run of `run` consecutive sentences is a span; where those have fewer than `least_words` words, the span runs on until it has as
many, once forwards and once backwards, so that a passage's first and last sentences are inside spans that lie in it. A text of fewer
sentences or words than a span needs is one span itself. Spans are hashed (96 bits) and joined globally; all but the first occurrence
of a span (by document id, then place) are repeats, and every sentence inside a repeat is removed.

Hashes are counted with partial aggregation before they are shuffled, and the join back to the spans is an equi-join whose hot
keys Spark's adaptive execution splits. Cutting takes time in proportion to a text's length, whatever is in it.

Nulls and edge cases: a null text stays null; an empty or blank one has no sentences and stays as it is; where ids repeat or are
null, rows count as documents in the order of id (nulls first) and a hash of the text; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, as_bytes, keyed, slices

_LINE_ENDS = np.isin(np.arange(256), list(b"\n\r\f\x0b"))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\f\x0b"))
_MARKS = np.isin(np.arange(256), list(b".,;:!?|"))


def cuts_by_content(words: list[bytes], owner: np.ndarray, most_words: int) -> np.ndarray:
    """The words after which to cut: of every so many neighbours with one owner the (first) one of least hash.

    The hash is the first eight bytes of a word's MD5, which SQL has too.
    """
    if len(words) < most_words:
        return np.zeros(0, np.int64)
    known = {w: hashlib.md5(w).digest()[:8] for w in set(words)}
    hashes = np.frombuffer(b"".join(map(known.__getitem__, words)), ">u8").astype(np.uint64)
    least = np.arange(len(words) - most_words + 1) + np.lib.stride_tricks.sliding_window_view(hashes, most_words).argmin(axis=1)
    return np.unique(least[owner[: len(least)] == owner[most_words - 1 :]])


class Spans:
    def __init__(self, run: int, least_words: int, most_words: int) -> None:
        self.run, self.least_words, self.most_words = run, least_words, most_words

    def sentences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sentences of texts that end in a line end each: where the first word begins, where the last one ends, how many there are."""
        blank = _SPACE[data]
        edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        first, last = edges[::2], edges[1::2]  # of each word
        if not len(first):
            return first, last, np.zeros(0, np.int64)
        lines = np.concatenate([[0], np.cumsum(_LINE_ENDS[data])])
        ends = _MARKS[data[last - 1]] | (lines[np.append(first[1:], len(data))] > lines[last])
        ends[-1] = True
        stop = np.flatnonzero(ends) + 1
        counts = np.diff(stop, prepend=0)
        long = np.repeat(counts > self.most_words, counts)
        if long.any():
            chosen, text = np.flatnonzero(long), data.tobytes()
            words = [text[x:y] for x, y in zip(first[chosen].tolist(), last[chosen].tolist(), strict=True)]
            ends[chosen[cuts_by_content(words, np.repeat(np.arange(len(counts)), counts)[chosen], self.most_words)]] = True
        stop = np.flatnonzero(ends) + 1
        counts = np.diff(stop, prepend=0)
        return first[stop - counts], last[stop - 1], counts

    def bounds(self, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first sentence, end) of each span, sentences counted through all texts, from the sentences' numbers of words and the
        texts' numbers of sentences."""
        upto, ends = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(sizes)
        starts = ends - sizes
        small = (sizes > 0) & ((sizes < self.run) | (upto[ends] - upto[starts] < self.least_words))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        k = np.arange(len(counts))
        ahead = np.maximum(k + self.run, np.searchsorted(upto, upto[k] + self.least_words))
        back = np.minimum(k + 1 - self.run, np.searchsorted(upto, upto[k + 1] - self.least_words, "right") - 1)
        first = np.flatnonzero(~small[owner] & (ahead <= ends[owner]))
        last = np.flatnonzero(~small[owner] & (back >= starts[owner]))
        last = last[ahead[back[last]] != last + 1]  # the others are there already
        whole = np.flatnonzero(small)
        text = np.concatenate([owner[first], owner[last], whole])
        begin, end = np.concatenate([first, back[last], starts[whole]]), np.concatenate([ahead[first], last + 1, ends[whole]])
        return text, begin, end

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(text, first sentence in it, number of sentences, digest) of each span."""
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        first, last, counts = self.sentences(data)
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right")
        sizes = np.bincount(owner, minlength=len(texts))
        text, begin, end = self.bounds(counts, sizes)
        lengths = last - first + 1  # the sentences, a line end after each
        starts = np.concatenate([[0], np.cumsum(lengths)])
        bare = data[np.repeat(first - starts[:-1], lengths) + np.arange(starts[-1])]
        bare[starts[1:] - 1] = 10
        joined = bare.tobytes()
        digests = [xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(starts[begin].tolist(), (starts[end] - 1).tolist(), strict=True)]
        return text, begin - (np.cumsum(sizes) - sizes)[text], end - begin, digests

    def without(self, texts: list[bytes], firsts: list[list[int] | None], ns: list[list[int] | None]) -> list[tuple[bytes, int, int]]:
        """Each text without the n sentences from first on, for each of its spans, and how many sentences it had and lost."""
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        begin, _, _ = self.sentences(data)
        heads = np.cumsum([0, *(len(t) + 1 for t in texts)])
        before = np.searchsorted(begin, heads)
        out = []
        for k, (text, first, n) in enumerate(zip(texts, firsts, ns, strict=True)):
            size = int(before[k + 1] - before[k])
            if not first:
                out.append((text, size, 0))
                continue
            marks = np.zeros(size + 1, np.int64)
            np.add.at(marks, np.array(first), 1)
            np.add.at(marks, np.array(first) + np.array(n), -1)
            gone = np.cumsum(marks[:-1]) > 0
            edges = [0, *(begin[before[k] + 1 : before[k + 1]] - heads[k]).tolist(), len(text)]
            out.append((b"".join(text[a:b] for a, b, lost in zip(edges, edges[1:], gone.tolist(), strict=False) if not lost), size, int(gone.sum())))
        return out


def _spans(docs: DataFrame, spans: Spans) -> DataFrame:
    """(h, g, key, first, n): the spans of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            text, first, n, found = spans.of(as_bytes(part.column(1)))
            digests = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].astype(np.int32)), pa.array(part.column(0).to_numpy()[text]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["h", "g", "key", "first", "n"],
            )

    return docs.select("key", "text").mapInArrow(run, "h long, g int, key long, first int, n int")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, least_words: int = 14, most_words: int = 12) -> DataFrame:
    """One row per document: id, text without repeats, n_sentences, n_removed."""
    rows = keyed(docs, id_col, text_col)
    cutter = Spans(run, least_words, most_words)
    spans = _spans(rows, cutter)
    place = F.struct("key", "first")
    repeated = Table(spans.groupBy("h", "g").agg(F.min(place).alias("at"), F.count("*").alias("c")).where("c > 1").select("h", "g", "at"), "repeated")
    later = spans.join(repeated.df, ["h", "g"]).where(place != F.col("at"))
    removed = Table(later.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias("gone")), "removed")
    repeated.drop()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = cutter.without(as_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist())
            kept = [left.decode() if lost else text.as_py() for text, (left, _, lost) in zip(part.column(1), found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], names=["id", "text", "n_sentences", "n_removed"])

    joined = rows.join(removed.df, "key", "left").select("id", "text", F.col("gone.first").alias("first"), F.col("gone.n").alias("n"))
    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"id {kind}, text string, n_sentences long, n_removed long").withColumnRenamed("id", id_col)
