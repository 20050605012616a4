"""Intervals of any length against brute force, and vectors that can't be compared."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from sessionweave.operators import align, vectors

INF, NAN = math.inf, math.nan


def brute(labels, words):
    texts = {}
    for source, idx, s, e in labels:
        if any(w[0] == source for w in words):
            met = sorted((ws, pos, word) for src, pos, ws, we, word in words if src == source and word != "sp" and None not in (s, e, ws, we) and we > s and ws < e)
            texts[source, idx] = " ".join(w for _, _, w in met)
    return texts


@pytest.mark.parametrize("unit", [align.UNIT, 1.0, 50.0])
def test_intervals_of_any_length_equal_brute_force(spark, unit):
    rng = random.Random(4)
    times = [0.0, -0.0, 1e-9, -1e10, 1e10, 1e300, -1e300, INF, -INF, NAN, None, 2.0**40]

    def interval():
        if rng.random() < 0.25:
            return rng.choice(times), rng.choice(times)
        start, length = rng.uniform(-50, 50), rng.choice([0, 0.001, 1, 3, 40, 1e5, -2])
        return start, start + length

    labels = [(s, k, *interval()) for s in "ab" for k in range(60)] + [("c", 0, 0.0, 1.0)]
    words = [(s, k, *interval(), rng.choice(["sp", f"w{k}"])) for s in "ab" for k in range(80)]
    df = spark.createDataFrame(labels, "source_id string, label_idx int, start double, end double")
    said = spark.createDataFrame(words, "source_id string, pos int, start double, end double, word string")
    assert {(r[0], r[1]): r["text"] for r in align.align_words(df, said, unit).collect()} == brute(labels, words)


def test_a_word_of_months_beside_short_labels_makes_few_rows(spark):
    labels = spark.range(2000).select(F.lit("a").alias("ls_source"), F.col("id").alias("label_idx"), F.col("id").cast("double").alias("ls"), (F.col("id") + 1.0).alias("le")).withColumnRenamed("ls_source", "k")
    word = spark.createDataFrame([("a", 0.5, 1e7), ("a", -INF, INF)], "k string, rs double, re double")
    assert align.overlapping(labels, word, "k").count() == 4000
    cells = align._in_cells(align._on_grid(word, "rs", "re", align.UNIT), list(range(64)))
    assert cells.count() <= 2 * 2 * 64


def test_empty_alignment(spark):
    labels = spark.createDataFrame([], "source_id string, label_idx int, start double, end double")
    words = spark.createDataFrame([("a", 1, 0.0, 1.0, "x")], "source_id string, pos int, start double, end double, word string")
    assert align.align_words(labels, words).collect() == []
    assert align.align_words(spark.createDataFrame([("a", 0, 0.0, 1.0)], labels.schema), words.limit(0)).collect() == []


def test_vectors_that_cannot_be_compared_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [NAN, 1.0]), (9, [INF, 1.0]), (None, [1.0, 0.0]), (10, []), (11, [1e300, 1e300]), (12, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = {(r["a"], r["b"]): round(r["similarity"], 6) for r in vectors.cosine_pairs(df, df, "id", "v", 2, 2).collect()}
    assert {i for p in found for i in p} == {1, 2, 3, 11, 12} and len(found) == 20
    assert found[3, 11] == 1.0 and found[1, 12] == 1.0 and found[1, 2] == 0.0
    near = vectors.nearest(df, df, "id", "v", 1).collect()
    assert {(r["query"], r["neighbour"]) for r in near} == {(1, 12), (2, 3), (3, 11), (11, 3), (12, 1)}


def test_components_of_an_empty_table(spark):
    df = spark.createDataFrame([(1, None)], "id long, v array<double>")
    for empty in (df, df.limit(0)):
        out, ratios = vectors.principal_components(empty, "id", "v")
        assert out.columns == ["id", "components"] and out.collect() == [] and ratios == []


def test_similarities_are_held_a_bounded_number_at_a_time(spark):
    """A block of queries meets a block of the corpus in steps, and none is left out by that."""
    rows = spark.range(1500).select("id", F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("v"))

    def held(ids, own, similar):
        return pd.DataFrame({"query": ids, "neighbour": own[: len(ids)], "similarity": float(similar.size)})

    sizes = vectors._in_blocks(rows, rows, "id", "v", held, 1, 1).collect()
    assert sorted(r["query"] for r in sizes) == list(range(1500))
    assert max(r["similarity"] for r in sizes) <= vectors.STEP < 1500 * 1500


def test_vectors_are_not_copied_for_each_block(spark):
    """Pairs of blocks are read from blocks stored once, of any lengths and numbers of rows; the pairs are those of a plain loop."""
    rnd = np.random.default_rng(5)
    rows = {k: rnd.normal(size=2 + k % 3) for k in range(61)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in rows.items()], "id long, v array<double>").repartition(3)
    pairs = vectors.cosine_pairs(df.where("id % 5 = 0"), df, "id", "v", 3, 7)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    wanted = {(a, b): x @ y / np.linalg.norm(x) / np.linalg.norm(y) for a, x in rows.items() for b, y in rows.items() if a % 5 == 0 and a != b and len(x) == len(y)}
    found = {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)
    packed, _ = vectors._packed(df, "id", "v", 2, 4)
    assert max(len(r["ids"]) for r in packed.collect()) <= 32
