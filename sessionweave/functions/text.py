"""Text features as column expressions; no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ratio

#: White space as Python's str.split sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: A lexical token: word characters and apostrophes, beginning and ending in a word character.
LEXICAL = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
PAUSE_TOKEN = "sp"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, even where it's needed inside a lambda or the optimizer inlines it."""
    return F.get(F.transform(F.array(value), use), 0)


def tokens(text: Column) -> Column:
    """White-space separated tokens; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_transcript(text: Column) -> Column:
    """Without pause tokens, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\bsp\b", " "), SPACE, " "))


def mean_length(words: Column) -> Column:
    """Mean code points of the words, 0.0 without any."""
    total = lambda ws: F.aggregate(ws, F.lit(0), lambda s, w: s + F.length(w))
    return bound(words, lambda ws: F.when(F.size(ws) > 0, total(ws) / F.size(ws)).otherwise(F.lit(0.0)))


def lexical_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LEXICAL), 0)


def type_token_ratio(words: Column) -> Column:
    return bound(words, lambda ws: ratio(F.size(F.array_distinct(ws)), F.size(ws)))


def _segment_ratios(words: Column, size: int, starts: Column) -> Column:
    return F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(words, i + 1, F.lit(size)))) / F.least(F.lit(size), F.size(words) - i).cast("double"))


def _mean(values: Column) -> Column:
    return bound(values, lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs))


def msttr(words: Column, size: int = 10) -> Column:
    """Mean type-token ratio over whole blocks of `size` tokens; NULL for fewer tokens than that."""
    starts = lambda ws: F.sequence(F.lit(0), F.size(ws) - F.lit(size), F.lit(size))
    return bound(words, lambda ws: F.when(F.size(ws) >= size, _mean(_segment_ratios(ws, size, starts(ws)))))


def msttr_with_remainder(words: Column, size: int = 10) -> Column:
    """As msttr, the last, shorter block counting too; NULL without tokens."""
    starts = lambda ws: F.sequence(F.lit(0), F.size(ws) - 1, F.lit(size))
    return bound(words, lambda ws: F.when(F.size(ws) > 0, _mean(_segment_ratios(ws, size, starts(ws)))))


def text_quality(text: Column, token_count: Column | None = None, most_tokens: int = 256) -> Column:
    """0 for empty texts; else 1, times 0.75 below three words and 0.5 above most_tokens tokens."""
    n = F.size(tokens(text))
    score = F.when(n == 0, 0.0).when(n < 3, 0.75).otherwise(1.0)
    if token_count is not None:
        score = score * F.when(token_count > most_tokens, 0.5).otherwise(1.0)
    return score


def speaking_rate(transcript: Column, seconds: Column) -> Column:
    """Words a second; 0.0 without a transcript or duration."""
    return F.when(transcript.isNotNull() & (seconds > 0), F.size(tokens(transcript)) / seconds).otherwise(F.lit(0.0))


def preview(text: Column, most: int = 120) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def numeric_id(value: Column) -> Column:
    """The id as a number; NULL where it isn't one, for reporting all such rows."""
    return value.try_cast("long")


def decoded(value: Column) -> Column:
    """Bytes as UTF-8 text without surrounding white space."""
    return stripped(F.decode(value, "UTF-8"))


def _real(parse: Column) -> Column:
    return F.filter(parse, lambda t: ~t["is_space"] & ~t["is_punct"])


def mean_dependency_distance(parse: Column) -> Column:
    """parse: array of structs i, head, is_space, is_punct over the whole text. 0.0 for at most one token."""

    def of(p: Column) -> Column:
        arcs = F.transform(F.filter(_real(p), lambda t: t["i"] != t["head"]), lambda t: F.abs(t["i"] - t["head"]).cast("double"))
        return F.when(F.size(_real(p)) > 1, F.coalesce(F.try_divide(F.aggregate(arcs, F.lit(0.0), lambda s, x: s + x), F.size(arcs)), F.lit(0.0))).otherwise(F.lit(0.0))

    return bound(parse, of)


def dependency_depth(parse: Column) -> Column:
    """The longest chain of heads from tokens that aren't space or punctuation, up to a root (a token that is its own head).

    Heads are followed for all tokens at once, twice as far in every round, so that a text of n tokens takes log2(n) rounds. A chain
    that runs into a circle counts the distinct tokens on it; only such parses, which aren't trees, take a slow way.
    """

    def of(p: Column) -> Column:
        heads = F.transform(p, lambda t, i: F.when((t["head"] >= 0) & (t["head"] < F.size(p)), t["head"]).otherwise(i).cast("int"))
        first = F.struct(heads.alias("up"), F.transform(heads, lambda h, i: (h != i).cast("int")).alias("steps"))

        def double(s: Column, _: Column) -> Column:
            further = F.zip_with(s["steps"], s["up"], lambda n, h: n + F.get(s["steps"], h))
            return F.struct(F.transform(s["up"], lambda h: F.get(s["up"], h)).alias("up"), further.alias("steps"))

        def longest(hs: Column) -> Column:
            def walk(i: Column) -> Column:
                begin = F.struct(i.alias("at"), F.array().cast("array<int>").alias("seen"))
                step = lambda s, _: F.when(F.array_contains(s["seen"], s["at"]), s).otherwise(F.struct(F.get(hs, s["at"]).alias("at"), F.array_append(s["seen"], s["at"]).alias("seen")))
                return F.size(F.aggregate(F.sequence(F.lit(1), F.size(hs)), begin, step)["seen"])

            def ended(s: Column) -> Column:
                root = lambda i: F.get(hs, F.get(s["up"], i)) == F.get(s["up"], i)
                return F.array_max(F.transform(_real(p), lambda t: F.when(root(t["i"]), F.get(s["steps"], t["i"])).otherwise(walk(t["i"].cast("int")))))

            return bound(F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(p)))), first, double), ended)

        return F.when(F.size(_real(p)) > 1, bound(heads, longest)).otherwise(F.lit(0))

    return bound(parse, of)


def dependency_count(parse: Column) -> Column:
    return F.size(F.filter(_real(parse), lambda t: t["i"] != t["head"]))
