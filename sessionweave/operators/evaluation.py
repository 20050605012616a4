"""Comparison of predictions with the truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import spearman


def confusion(df: DataFrame, truth: str, predicted: str, labels: list[int]) -> DataFrame:
    """(truth, predicted, n) for every pair of labels, absent ones with 0."""
    grid = df.sparkSession.createDataFrame([(t, p) for t in labels for p in labels], "truth int, predicted int")
    found = df.groupBy(F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(found, ["truth", "predicted"], "left").na.fill(0, ["n"])


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy, macro_f1 (over labels that occur on either side, undefined counting 0) and n; one row."""
    cells = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said"), hit.alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    label = sides.groupBy("label").agg(F.sum("true").alias("true"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    f1 = 2.0 * F.col("hit") / (F.col("true") + F.col("said"))
    return label.agg((F.sum("hit") / F.sum("true")).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.sum("true").alias("n"))


def regression_errors(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """mae, rmse, pearson and n; one row."""
    gap = F.col(truth) - F.col(predicted)
    return df.agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.corr(truth, predicted).alias("pearson"), F.count(gap).alias("n"))


def continuous_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return regression_errors(df, truth, predicted).crossJoin(spearman(df, truth, predicted).select(F.col("rho").alias("spearman")))  # one row each


def without_neutral(df: DataFrame, truth: str, neutral: int = 1) -> DataFrame:
    """Rows for a two-class evaluation: the truth isn't neutral."""
    return df.where(F.col(truth) != neutral)


def worst_errors(df: DataFrame, truth: str, predicted: str, keys: list[str], n: int = 20) -> DataFrame:
    """The n rows of greatest absolute error, ties by key."""
    return df.select(*keys, truth, predicted, F.abs(F.col(truth) - F.col(predicted)).alias("abs_error")).orderBy(F.desc_nulls_last("abs_error"), *keys).limit(n)


def compare_models(df: DataFrame, truth: str, models: dict[str, str]) -> DataFrame:
    """One row per model and column of predictions: model, mae, rmse, pearson, n."""
    parts = [regression_errors(df, truth, column).select(F.lit(name).alias("model"), "*") for name, column in models.items()]
    return reduce(DataFrame.unionByName, parts)
