"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, shuffled


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return shuffled(edges).join(least, "u").withColumn("m", F.least("u", "m"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b), component being the least node that can be reached.

    Each round rewires the edges towards least nodes; the edge table never grows beyond its first size, and a round's result is
    written to the shared folder. Loops and repeated edges are harmless; null ends are ignored; no edges give no rows.
    """
    table = Table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        edges = table.df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        last, table = table, Table(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        last.drop()
        now = table.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    edges = table.df
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
