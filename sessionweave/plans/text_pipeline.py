"""From word and label sequences to the final text feature table, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scores import normalised_sentiment
from ..operators.align import align_words, split_by_tokens
from ..operators.validate import feature_table_rules, key_report, require_count, require_rules
from ..schemas import TEXT_FEATURES, Settings

KEYS = ["segment_id", "label_idx"]


def surface_features(df: DataFrame, text: str = "text") -> DataFrame:
    w = X.tokens(F.col(text))
    return df.withColumn("word_count", F.size(w)).withColumn("char_count", F.length(X.stripped(F.coalesce(F.col(text), F.lit(""))))).withColumn("avg_word_length", X.mean_length(w))


def lexical_features(df: DataFrame, text: str = "text", size: int = 10) -> DataFrame:
    """Tokens are found once and used by all measures."""
    found = df.withColumn("_tokens", X.lexical_tokens(F.col(text)))
    t = F.col("_tokens")
    return found.select(*df.columns, F.size(t).alias("lexical_token_count"), F.size(F.array_distinct(t)).alias("unique_word_count"), X.type_token_ratio(t).alias("ttr"), X.msttr(t, size).alias(f"msttr_{size}"), X.msttr_with_remainder(t, size).alias(f"msttr_{size}_remainder"))


def complexity_features(df: DataFrame, parse: str = "parse") -> DataFrame:
    p = F.col(parse)
    return df.withColumn("dependency_tree_depth", X.dependency_depth(p)).withColumn("avg_dependency_distance", X.mean_dependency_distance(p)).withColumn("dependency_count", X.dependency_count(p))


def aligned_segments(labels: DataFrame, words: DataFrame) -> DataFrame:
    return align_words(labels, words).withColumnRenamed("source_id", "segment_id")


def final_features(segments: DataFrame, settings: Settings = Settings(), sentiment: F.Column | None = None) -> DataFrame:
    """The final table's columns from segments with text, `parse`, `labse_embedding` and a sentiment, by default the label's."""
    score = normalised_sentiment(F.get("label", 0)) if sentiment is None else sentiment
    out = complexity_features(lexical_features(surface_features(segments), size=settings.msttr_size)).withColumn("sentiment_normalized", score)
    return out.select(*(F.col(f"msttr_{settings.msttr_size}" if f.name == "msttr_10" else f.name).cast(f.dataType).alias(f.name) for f in TEXT_FEATURES))


def check_features(table: DataFrame, settings: Settings = Settings(), expected_rows: int | None = None) -> DataFrame:
    """Raises unless keys are unique and complete and every rule holds; gives the key report."""
    if expected_rows is not None:
        require_count(table, expected_rows)
    require_rules(table, feature_table_rules(settings.embedding_dimensions))
    report = key_report(table, KEYS)
    require_rules(report, {"missing keys": F.col("missing_keys") == 0, "doubled keys": F.col("doubled_keys") == 0})
    return report


def ready_segments(segments: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    return split_by_tokens(segments, settings.most_tokens)
