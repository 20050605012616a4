"""Numbers of subword pieces of texts by longest match over a vocabulary table.

A text's words are its runs of characters without white space, each mark of punctuation being a word of its own. A word is cut from the left into the longest pieces
of the vocabulary, later pieces having the prefix `##`; a word that can't be cut, or is over `most` characters long, is one unknown piece. A
vocabulary of up to LARGEST distinct pieces is compiled into a trie in each Python worker, which counts the words of its texts where they are,
each distinct word of a batch once. A larger one is joined with the parts of all distinct words, and the counts are joined back to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefix of later pieces, longest word, pieces that every text has besides (start and end).
LATER, MOST, SPECIALS = "##", 100, 2
#: Distinct pieces of a vocabulary; beyond that it isn't sent to the tasks.
LARGEST = 600_000
#: White space, and marks: ASCII ones that aren't letters or digits, and Unicode punctuation.
_WORD = r"[!-/:-@\[-`{-~\p{P}]|[^\s\p{Z}!-/:-@\[-`{-~\p{P}]+"


class Trie:
    """Pieces by their characters; the empty key marks an end."""

    def __init__(self, pieces: list[str]) -> None:
        self.first: dict = {}
        self.later: dict = {}
        for piece in pieces:
            node, rest = (self.later, piece[len(LATER) :]) if piece.startswith(LATER) and len(piece) > len(LATER) else (self.first, piece)
            for c in rest:
                node = node.setdefault(c, {})
            node[""] = {}

    def count(self, word: str, most: int = MOST) -> int:
        """Pieces of a word, 1 if it is unknown."""
        if len(word) > most:
            return 1
        at = n = 0
        while at < len(word):
            node, end = self.later if at else self.first, 0
            for k in range(at, len(word)):
                node = node.get(word[k])
                if node is None:
                    break
                if "" in node:
                    end = k + 1
            if not end:
                return 1
            at, n = end, n + 1
        return n


def words_of(text: F.Column) -> F.Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), 0)


def _by_trie(df: DataFrame, keys: list[str], text_col: str, pieces: list[str], most: int) -> DataFrame:
    """(keys, _sum), the pieces being sent to the tasks."""
    sent = df.sparkSession.sparkContext.broadcast(pieces)
    texts = df.select(*keys, words_of(F.col(text_col)).alias("_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = None
        for batch in batches:
            trie = trie or Trie(sent.value)
            lists = batch.column("_words")
            words = lists.flatten().dictionary_encode()
            counts = np.array([trie.count(w, most) for w in words.dictionary.to_pylist()], np.int64)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            before = np.concatenate([[0], np.cumsum(counts[words.indices.to_numpy()])])
            sums = before[ends] - before[np.concatenate([[0], ends[:-1]])] if len(ends) else before[:0]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(sums, pa.int64())], names=[*keys, "_sum"])

    return texts.mapInArrow(run, T.StructType([*df.select(*keys).schema.fields, T.StructField("_sum", T.LongType())]))


def _by_join(words: DataFrame, pieces: DataFrame, most: int) -> DataFrame:
    """(_word, _pieces) of distinct words, with any number of pieces: each word's parts, no longer than the longest piece, are joined with the
    pieces, and the longest part at each place is followed from the first on."""
    longest = pieces.agg(F.max(F.length("piece"))).first()[0]
    n = F.length("_word")
    places = words.where(n <= most).select("_word", F.explode(F.sequence(F.lit(0), n - 1)).alias("_at"))
    parts = places.select("_word", "_at", F.explode(F.sequence(F.col("_at") + 1, F.least(n, F.col("_at") + longest))).alias("_end"))
    part = F.substr("_word", F.col("_at") + 1, F.col("_end") - F.col("_at"))
    met = parts.withColumn("piece", F.concat(F.when(F.col("_at") > 0, LATER).otherwise(""), part)).join(pieces, "piece", "left_semi")
    ends = met.groupBy("_word", "_at").agg(F.max("_end").alias("_end")).groupBy("_word").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_end"))).alias("_ends"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"))
    follow = lambda s, k: F.when(s["at"] == k, F.struct(F.try_element_at("_ends", k).alias("at"), (s["n"] + 1).alias("n"))).otherwise(s)
    way = F.aggregate(F.sequence(F.lit(0), n - 1), start, follow)
    cut = ends.select("_word", F.when(way["at"] == n, way["n"]).alias("_pieces"))
    return words.join(cut, "_word", "left").select("_word", F.coalesce("_pieces", F.lit(1)).cast("long").alias("_pieces"))


def subword_counts(df: DataFrame, keys: list[str], text_col: str, vocabulary: DataFrame, specials: int = SPECIALS, most: int = MOST, out: str = "token_count") -> DataFrame:
    """(keys, out): pieces of each text, specials included. keys are unique together; vocabulary has the column `piece`. Null texts count as empty."""
    pieces = vocabulary.where("piece is not null").select("piece").distinct()
    some = pieces.limit(LARGEST + 1).toArrow().column(0)
    total = (F.coalesce("_sum", F.lit(0)) + specials).cast("int").alias(out)
    if len(some) <= LARGEST:
        return _by_trie(df, keys, text_col, some.to_pylist(), most).select(*keys, total)
    words = df.select(*keys, F.explode(words_of(F.col(text_col))).alias("_word")).groupBy(*keys, "_word").agg(F.count("*").alias("_n"))
    sums = words.join(_by_join(words.select("_word").distinct(), pieces, most), "_word").groupBy(*keys).agg(F.sum(F.col("_n") * F.col("_pieces")).alias("_sum"))
    return df.select(*keys).join(sums, keys, "left").select(*keys, total)
