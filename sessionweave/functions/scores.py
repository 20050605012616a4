"""Sentiment scales, model scores and audio quality as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import clamp, finite_or_null

#: The label vector's entries in order.
LABELS = ("sentiment", "happiness", "sadness", "anger", "surprise", "disgust", "fear")
POLARITIES = ("negative", "neutral", "positive")


def label_columns(label: Column) -> list[Column]:
    return [F.get(label, k).alias(name) for k, name in enumerate(LABELS)]


def normalised_sentiment(sentiment: Column) -> Column:
    """-3..3 to -1..1; NULL outside that range."""
    scaled = sentiment / 3.0
    return F.when(scaled.between(-1, 1), scaled)


def polarity(sentiment: Column) -> Column:
    """negative, neutral or positive; a missing value is neutral."""
    value = finite_or_null(sentiment)
    return F.when(value < 0, "negative").when(value > 0, "positive").otherwise("neutral")


def polarity_sign(name: Column) -> Column:
    """-1, 0 or 1 by name; NULL for other names."""
    return F.when(name == "negative", -1).when(name == "neutral", 0).when(name == "positive", 1)


def polarity_class(sentiment: Column) -> Column:
    """0, 1 or 2 for below, at and above zero; a missing value is 1."""
    value = finite_or_null(sentiment)
    return F.when(value < 0, 0).when(value > 0, 2).otherwise(1)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def label_index(labels: list[str], part: str) -> int:
    """Where the first label stands that contains part, upper or lower case alike."""
    found = [k for k, name in enumerate(labels) if part in name.lower()]
    if not found:
        raise ValueError(f"no label contains {part!r}")
    return found[0]


def continuous_sentiment(probabilities: Column, labels: list[str]) -> Column:
    """P(positive) - P(negative)."""
    return F.get(probabilities, label_index(labels, "pos")) - F.get(probabilities, label_index(labels, "neg"))


def predicted_polarity(probabilities: Column, labels: list[str]) -> Column:
    """0, 1 or 2 from the first label of greatest probability."""
    at = F.array_position(probabilities, F.array_max(probabilities)) - 1
    kinds = [0 if "neg" in name.lower() else 2 if "pos" in name.lower() else 1 for name in labels]
    return F.get(F.array(*map(F.lit, kinds)), at.cast("int"))


def positive_labels(label: Column) -> Column:
    """How many of the entries after the sentiment are positive."""
    return F.size(F.filter(F.slice(label, 2, len(LABELS) - 1), lambda x: x > 0))


def audio_quality(speech_samples: Column, total_samples: Column, signal_energy: Column, noise_energy: Column) -> Column:
    """Struct of speech_ratio, snr_estimate and quality_score; zeros for empty audio. A missing energy counts as 1e-9."""
    empty = F.coalesce(total_samples, F.lit(0)) <= 0
    share = F.least(F.lit(1.0), speech_samples / F.nullif(total_samples, F.lit(0)))
    quotient = F.coalesce(signal_energy, F.lit(1e-9)) / (F.coalesce(noise_energy, F.lit(1e-9)) + 1e-9)
    snr = 10.0 * F.log10(F.greatest(quotient, F.lit(1e-3)))
    score = clamp(0.4 * share + 0.6 / (1.0 + F.exp(-0.2 * (snr - 10.0))), 0.0, 1.0)
    parts = {"speech_ratio": share, "snr_estimate": snr, "quality_score": score}
    return F.struct(*(F.when(empty, 0.0).otherwise(x).alias(n) for n, x in parts.items()))
