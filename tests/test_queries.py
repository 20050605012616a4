from __future__ import annotations

import pytest

from sessionweave.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLES[name])


def test_principal_components_match_a_decomposition(spark, sf_dir):
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.array([r[1] for r in rows])
    x -= x.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    found = {r["vec_id"]: r for r in QUERIES["pca_variance"](spark, sf_dir).collect()}
    assert abs(found[rows[0][0]]["explained_1"] - s[0] ** 2 / (s**2).sum()) < 1e-5
    scores = np.abs(u[:, :2] * s[:2])
    for k, r in enumerate(rows[:50]):
        assert np.allclose([found[r[0]]["pc1_abs"], found[r[0]]["pc2_abs"]], scores[k], atol=1e-4)


def test_entry_registers_every_query(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["source_id", "label_idx", "start", "end", "text"]
