"""Near copies by common shingles against all pairs by brute force, and the operator's edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionweave.llm import similarity

from .test_llm_queries import brute_components, brute_shingles, similar


def edited(rnd, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10**6)}"
    return " ".join(out)


def near_texts(rnd):
    """Families of near copies, texts that share half their words, and short ones."""
    texts = []
    for f in range(6):
        words = [f"w{f}x{i}" for i in range(rnd.randrange(60, 300))]
        texts += [edited(rnd, words, rnd.randrange(0, 6)) for _ in range(9)]
    passage = [f"p{i}" for i in range(120)]
    texts += [" ".join(passage + [f"u{k}y{i}" for i in range(100)]) for k in range(20)]
    return texts + ["", " ", "one", "One", "one two", "a b c d e", "a b c d e f", "the " * 400, "the " * 500]


@pytest.mark.parametrize("dense", [64, 4])
def test_groups_match_all_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(similarity, "DENSE_CELL", dense)
    texts = dict(enumerate(near_texts(random.Random(11))))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    components = brute_components({d: brute_shingles(t) for d, t in texts.items()}, similar)
    found = {r["doc_id"] for r in similarity.one_of_each_group(docs).collect()}
    assert found == {d for d, c in components.items() if d == c}


def test_similar_texts_share_a_sample():
    """Sets of similarity 0.8 have a sample in common with a chance of 0.9999."""
    rnd = np.random.default_rng(3)
    met = 0
    for _ in range(500):
        h = np.unique(rnd.integers(0, 1 << 63, 330).astype(np.uint64) * np.uint64(2))
        rnd.shuffle(h)
        a, b = (similarity.samples_of(np.sort(x)) for x in (h[:297], h[33:330]))  # 264 of 330
        met += any((np.sort(x) == np.sort(y)).all() for x, y in zip(a, b, strict=True))
    assert met >= 498


def test_nulls_repeats_and_an_empty_table(spark):
    rows = [(None, None, 1), (None, "", 2), (3, "x y", 3), (3, "x  Y", 4), (3, "z", 5), (None, "z", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = sorted(((r["doc_id"], (r["text"] or "").lower().split()) for r in similarity.one_of_each_group(docs).collect()), key=str)
    assert found == [(3, ["x", "y"]), (3, ["z"]), (None, [])]
    assert similarity.one_of_each_group(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "w " * 300_000)], "doc_id long, text string")
    assert {r["doc_id"] for r in similarity.one_of_each_group(docs).collect()} == {1, 3}


def test_carried_columns_of_any_name_and_stored_rows(spark, tmp_path, monkeypatch):
    names = ["row", "copy", "shingles", "fp", "samples", "sketch", "id", "file", "at", "node", "i", "t", "h", "least", "group", "_metadata", "c0"]
    texts = near_texts(random.Random(2))[::3]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({n: F.concat(F.lit(f"{n} "), "doc_id") for n in names})
    docs.drop("_metadata").repartition(5).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    components = brute_components({d: brute_shingles(t) for d, t in enumerate(texts)}, similar)
    wanted = {d for d, c in components.items() if d == c}
    twice = stored.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))
    for df, own, sent in ((docs, names, 500_000), (stored, [n for n in names if n != "_metadata"], 0), (twice, ["row", "twice"], 500_000)):
        monkeypatch.setattr(similarity, "SENT", sent)
        out = similarity.one_of_each_group(df, carry=own).collect()
        assert sorted(r["doc_id"] for r in out) == sorted(wanted)
        assert all(r[n] == f"{n} {r['doc_id']}" for r in out for n in own if n != "twice")


def test_sketches_allow_what_is_similar():
    """A pair at 0.8 or more passes; unlike texts seldom do."""
    rnd = np.random.default_rng(8)

    def allowed(a, b):
        (x, n), (y, m) = ((v[:-1].view(np.uint64), int(v[-1])) for v in (similarity.sketch_of(np.unique(v)) for v in (a, b)))
        count = lambda v: sum(int(k).bit_count() for k in v)
        k = similarity.SKETCH
        both, either = x[:k] & y[:k], count(x[:k] | y[:k])
        unlike, held = count(both & ((x[k : 2 * k] ^ y[k : 2 * k]) | (x[2 * k :] ^ y[2 * k :]))), count(both)
        spread = 0.16 * either * max(0, 1 - either / ((n + m) / 1.8)) + max(0, held - 0.8 * either) / 3
        return (3 * held - 4 * unlike) / 3 >= 0.8 * either - 4 * spread**0.5 - 1

    for size in (5, 40, 300, 5000):
        passed = [[], []]
        for _ in range(200):
            h = rnd.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2) + rnd.integers(0, 2, size).astype(np.uint64)
            cut = size // 10
            passed[0].append(allowed(h[: size - cut], h[cut:]))
            passed[1].append(allowed(h[: size // 2 + size // 8], h[size // 2 - size // 8 :]))
        assert all(passed[0]) and (size < 40 or sum(passed[1]) <= 2)


def test_the_sketch_column_is_the_plain_rule(spark):
    """Near pairs pass and far ones don't, as a column too."""
    rnd = np.random.default_rng(4)
    rows = []
    for k, (size, cut) in enumerate([(n, c) for n in (6, 60, 900) for c in (0.0, 0.1, 0.2, 0.35, 0.5)] * 20):
        h = rnd.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2) + rnd.integers(0, 2, size).astype(np.uint64)
        a, b = np.unique(h[: size - int(size * cut)]), np.unique(h[int(size * cut) :])
        rows.append((k, similarity.sketch_of(a).tolist(), similarity.sketch_of(b).tolist(), len(np.intersect1d(a, b)) / len(np.union1d(a, b)), size))
    df = spark.createDataFrame(rows, "k long, a array<long>, b array<long>, s double, size int")
    found = df.select("s", "size", similarity.similar_sketches("a", "b", 0.8).alias("passes")).collect()
    assert all(r["passes"] for r in found if r["s"] >= 0.8)
    assert not any(r["passes"] for r in found if r["s"] < 0.6 and r["size"] >= 60)

def test_a_large_family_makes_few_candidates(spark, monkeypatch):
    """Texts by few and by many changes of one text: the groups of brute force, without pairs of all those that are in none."""
    rnd = random.Random(21)
    base = [f"w{i}" for i in range(220)]
    texts = [edited(rnd, base, rnd.randrange(1, 14)) for _ in range(240)]
    made = []
    first = similarity.pairs_apart

    def counted(*args):
        made.append(first(*args).persist())
        return made[-1]

    monkeypatch.setattr(similarity, "pairs_apart", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"] for r in similarity.one_of_each_group(docs).collect()}
    components = brute_components({d: brute_shingles(t) for d, t in enumerate(texts)}, similar)
    assert found == {d for d, c in components.items() if d == c}
    assert len(made) == 2 and made[1].count() < 4 * len(texts)
