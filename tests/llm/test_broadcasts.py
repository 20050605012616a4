"""Tables that Spark sizes too low, as after an explode, are not sent through the driver."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sessionweave.llm import common, similarity, simhash

from .test_similarity import near_texts


@pytest.fixture
def plans(monkeypatch):
    """The physical plans of all scratch tables that are written meanwhile."""
    seen = []
    first = common.Table.__init__

    def init(self, df, *more, **named):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        first(self, df, *more, **named)

    monkeypatch.setattr(common.Table, "__init__", init)
    return seen


def broadcast(plan: str) -> list[str]:
    """What stands below the broadcasts of a plan."""
    lines, found, depth = plan.splitlines(), [], None
    for line in lines:
        at = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        if depth is not None and at > depth:
            found.append(line)
            continue
        depth = at if "BroadcastExchange" in line else None
    return found


def test_exploded_cells_are_not_broadcast(spark, tmp_path, plans):
    rnd = random.Random(4)
    prints = [(rnd.getrandbits(63),) for _ in range(300)]
    spark.createDataFrame(prints, "fp long").withColumn("rep", F.col("fp")).write.parquet(str(tmp_path / "distinct"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "distinct")))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("Generate explode" in p for p in plans)
    assert not any("Generate" in line for p in plans for line in broadcast(p))


def test_nothing_that_grows_is_broadcast_among_near_copies(spark, tmp_path, plans, monkeypatch):
    """With lists too long to be sent, no scratch table of the stage has a broadcast of exploded rows, arrays or files of cells."""
    monkeypatch.setattr(similarity, "SENT", -1)
    monkeypatch.setattr(similarity, "DENSE_CELL", 4)
    texts = near_texts(random.Random(6))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    similarity.one_of_each_group(spark.read.parquet(str(tmp_path / "docs")))
    assert len(plans) > 15
    for line in (line for p in plans for line in broadcast(p)):
        assert not any(word in line for word in ("Generate", "MapInArrow", "array<", "/cells-", "/copies-", "/edges-", "/candidates-"))
