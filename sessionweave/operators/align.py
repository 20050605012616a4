"""Alignment of timestamped words with labelled intervals.

Both sides are laid on a grid of time whose cells double in width from level to level. An interval's own level is the first at which it touches
two cells at most. Two intervals that meet do so in a cell of the longer one's level, so an interval enters the cells it touches at its
own level and at those longer levels that the other side has: at most two cells a level and some sixty levels, however long it is. A pair is kept
in the first cell of its level that both touch, so none is lost or doubled. A long source is neither one task nor a product of all its labels
and words, and a word that never ends costs a row a level and not one a label.

Ends may be infinite. As in any comparison with NaN, an interval with a NaN or null end meets nothing. Intervals that end before they start follow the rule
as it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PAUSE_TOKEN, stripped


def spoken(words: DataFrame) -> DataFrame:
    """Words that aren't pauses, whatever their case and surrounding space."""
    return words.where(F.lower(stripped(F.col("word"))) != PAUSE_TOKEN)


def common_sources(labels: DataFrame, words: DataFrame) -> DataFrame:
    """Labels of sources that have any word, pauses included."""
    return labels.join(words.select("source_id").distinct(), "source_id", "left_semi")


#: Seconds of a cell of level 0, and the cells from zero at which times are cut off.
UNIT, _FARTHEST = 1 / 1024, float(1 << 61)


def _on_grid(intervals: DataFrame, start: str, end: str, unit: float) -> DataFrame:
    """Intervals that aren't NaN or null, with their first and last cell of level 0 (lo, hi) and their own level."""
    cell = lambda t: F.floor(F.greatest(F.least(t / unit, F.lit(_FARTHEST)), F.lit(-_FARTHEST)))
    known = intervals.where(~F.isnan(start) & ~F.isnan(end))
    placed = known.withColumns({"lo": cell(F.least(start, end)), "hi": cell(F.greatest(start, end))})
    return placed.withColumn("own", F.when(F.col("hi") - F.col("lo") < 2, 0).otherwise(F.ceil(F.log2((F.col("hi") - F.col("lo")).cast("double")))).cast("int"))


def _in_cells(placed: DataFrame, others: list[int]) -> DataFrame:
    """A row for every cell (level, cell) in which an interval can meet one whose own level is among `others`."""
    levels = F.expr(f"array({', '.join(map(str, others))})") if others else F.expr("cast(array() as array<int>)")
    met = F.filter(levels, lambda x: x > F.col("own"))
    meets = F.when(F.lit(min(others, default=99)) <= F.col("own"), F.concat(F.array("own"), met)).otherwise(met)
    cells = F.expr("explode(flatten(transform(levels, l -> transform(sequence(shiftright(lo, l), shiftright(hi, l)), c -> struct(l as level, c as cell)))))")
    return placed.withColumn("levels", meets).withColumn("at", cells).select("*", "at.level", "at.cell").drop("at", "levels", "hi")


def overlapping(left: DataFrame, right: DataFrame, key: str, unit: float = UNIT) -> DataFrame:
    """Pairs of rows of equal `key` whose intervals overlap: left's (ls, le) and right's (rs, re) with re > ls and rs < le."""
    sides = [_on_grid(left, "ls", "le", unit), _on_grid(right, "rs", "re", unit)]
    found = sides[0].select("own", F.lit(0).alias("side")).union(sides[1].select("own", F.lit(1))).distinct().collect()  # a row a level and side
    levels = [sorted(r["own"] for r in found if r["side"] == k) for k in (0, 1)]
    a, b = (_in_cells(x.withColumnsRenamed({"lo": f"lo{k}", "own": f"own{k}"}).withColumns({"lo": F.col(f"lo{k}"), "own": F.col(f"own{k}")}), levels[1 - k]).drop("lo", "own") for k, x in enumerate(sides))
    longer = F.col("level") == F.greatest("own0", "own1")
    first = F.col("cell") == F.expr("greatest(shiftright(lo0, level), shiftright(lo1, level))")
    met = a.join(b, [key, "level", "cell"]).where(longer & first & (F.col("re") > F.col("ls")) & (F.col("rs") < F.col("le")))
    return met.drop("level", "cell", "lo0", "own0", "lo1", "own1")


def align_words(labels: DataFrame, words: DataFrame, bucket_seconds: float = UNIT) -> DataFrame:
    """A row per label of a source that has words, with the text of the words that overlap it.

    labels: source_id, label_idx (unique together), start, end and others, kept; words: source_id, pos, start, end, word. A word belongs if it
    ends after the label starts and starts before it ends; touching ends don't count. Text is by start, then pos; '' without words.
    Intervals up to `bucket_seconds` long count as equally long on the grid; it changes the work, not the result.
    """
    said = spoken(words).select("source_id", F.col("start").cast("double").alias("rs"), F.col("end").cast("double").alias("re"), "pos", "word")
    base = common_sources(labels, words)
    keys = ["source_id", "label_idx"]
    spans = base.select(*keys, F.col("start").cast("double").alias("ls"), F.col("end").cast("double").alias("le"))
    found = overlapping(spans, said, "source_id", bucket_seconds)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rs", "pos", "word"))), lambda w: w["word"]), " ")
    texts = found.groupBy(*keys).agg(text.alias("text"))
    return base.drop("text").join(texts, keys, "left").select(*labels.columns, F.coalesce("text", F.lit("")).alias("text"))


def transcripts(words: DataFrame) -> DataFrame:
    """(source_id, text): all spoken words of a source in order of pos."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return spoken(words).groupBy("source_id").agg(F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("text"))


def enumerate_labels(sequences: DataFrame) -> DataFrame:
    """source_id, label_idx, start, end, label from one row per source with an array `intervals` of structs start, end, label."""
    numbered = sequences.select("source_id", F.posexplode("intervals").alias("label_idx", "i"))
    return numbered.select("source_id", "label_idx", "i.start", "i.end", "i.label")


def split_by_tokens(segments: DataFrame, most_tokens: int = 256) -> tuple[DataFrame, DataFrame]:
    """Segments of at most most_tokens tokens, and those with more; rows without a count are in neither."""
    return segments.where(F.col("token_count") <= most_tokens), segments.where(F.col("token_count") > most_tokens)
