"""Head pose found again from projected points, p-values against the function, and mapped files against a listing."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionweave.functions import geometry, pose
from sessionweave.operators import media, stats


def turned(a, b, c):
    x = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    y = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    z = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    return z @ y @ x


def projected(r, t, width, height):
    p = np.asarray(pose.MODEL) @ r.T + t
    return p[:, :2] / p[:, 2:] * width + [width / 2, height / 2]


def test_rotations_are_found_again():
    rng = np.random.default_rng(0)
    true = np.array([turned(*rng.uniform(-0.9, 0.9, 3)) for _ in range(300)])
    shifts = np.stack([*rng.uniform(-300, 300, (2, 300)), rng.uniform(1200, 4000, 300)], axis=1)
    width, height = rng.choice([640.0, 1920.0], 300), rng.choice([480.0, 1080.0], 300)
    points = np.array([projected(*x) for x in zip(true, shifts, width, height, strict=True)])
    found = pose.rotations(points, width, height)
    angle = np.degrees(np.arccos(np.clip((np.einsum("nij,nij->n", found, true) - 1) / 2, -1, 1)))
    assert np.abs(found - true).max() < 1e-6 and angle.max() < 1e-4
    noisy = pose.rotations(points + rng.normal(0, 0.5, points.shape), width, height)
    assert np.degrees(np.arccos(np.clip((np.einsum("nij,nij->n", noisy, true) - 1) / 2, -1, 1))).max() < 5
    assert np.allclose(noisy @ noisy.transpose(0, 2, 1), np.eye(3)) and np.allclose(np.linalg.det(noisy), 1)


def test_no_step_leads_closer_to_noisy_points():
    """The solution is a least one: turning or shifting it a little never lessens the distance."""
    rng = np.random.default_rng(1)
    points = np.array([projected(turned(0.2, -0.4, 0.1), np.array([20.0, -30, 1500]), 1000.0, 800.0)]) + rng.normal(0, 1, (1, 6, 2))
    r = pose.rotations(points, np.array([1000.0]), np.array([800.0]))
    flat = (points - [500, 400]) / 1000

    def least(r):
        """Best shift for a rotation, by iteration."""
        t = np.array([[20.0, -30, 1500]])
        for _ in range(200):
            turned_, p, gap = pose._distances(r, t, flat)
            z = p[:, :, 2]
            j = np.stack([np.stack([1 / z, 0 * z, -p[:, :, 0] / z**2], -1), np.stack([0 * z, 1 / z, -p[:, :, 1] / z**2], -1)], 2).reshape(1, -1, 3)
            t = t - np.linalg.lstsq(j[0], gap[0], rcond=None)[0]
        return (pose._distances(r, t, flat)[2] ** 2).sum()

    here = least(r)
    for w in np.concatenate([np.eye(3), -np.eye(3)]) * 1e-3:
        assert least(pose._turned(w[None]) @ r) > here


def test_pose_column_and_missing_points(spark):
    flat = projected(turned(0.1, 0.2, -0.3), np.array([0.0, 0, 2000]), 640, 480)
    marks = [(0.0, 0.0)] * 478
    for k, (x, y) in zip(pose.POINTS, flat.tolist(), strict=True):
        marks[k] = (x, y)
    rows = [("a", marks, 640, 480), ("b", None, 640, 480), ("c", marks[:100], 640, 480), ("d", marks, None, 480), ("e", [(float("nan"), 0.0)] * 478, 640, 480), ("f", marks, 0, 0)]
    df = spark.createDataFrame(rows, "k string, face array<struct<x:double,y:double>>, w int, h int")
    found = {r["k"]: r for r in df.select("k", geometry.euler_degrees(pose.rotation(pose.pose_points(F.col("face")), F.col("w"), F.col("h"))).alias("e")).collect()}
    assert np.allclose([found["a"]["e"][k] for k in range(3)], np.degrees([0.1, 0.2, -0.3]), atol=1e-4)
    assert all(found[k]["e"] is None or found[k]["e"]["pitch"] is None for k in "bcdef")


@pytest.mark.parametrize("n", [3, 4, 7, 20, 399, 5000, 2_000_000])
def test_p_value_column(spark, n):
    rs = [0.0, 1e-9, -1e-4, 0.01, 0.3, -0.7, 0.999, 1.0, -1.0, float("nan")]
    if n == 2_000_000:
        rs = [0.0, 1e-6, 1e-4, -0.001, 0.002]
    df = spark.createDataFrame([(r, n) for r in rs], "r double, n long").coalesce(1)
    found = df.select("r", stats.p_value(F.col("r"), F.col("n")).alias("p")).collect()
    for r, p in found:
        wanted = math.erfc(abs(r) * math.sqrt(n / (1 - r * r)) / math.sqrt(2)) if n == 2_000_000 else stats.correlation_p_value(r, n)
        assert (math.isnan(p) and math.isnan(wanted)) or math.isclose(p, wanted, rel_tol=1e-4 if n > 10**6 else 1e-9, abs_tol=1e-12)


def test_missing_p_values(spark):
    df = spark.createDataFrame([(None, 5), (0.5, None), (0.5, 2)], "r double, n long")
    found = [r[0] for r in df.select(stats.p_value(F.col("r"), F.col("n"))).collect()]
    assert found[:2] == [None, None] and math.isnan(found[2])


def test_mapped_files_are_looked_up_in_a_listing(spark, tmp_path):
    for name in ("a/1.mp4", "a/2.mp4", "b b/1.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = media.listed_files(spark, str(tmp_path), "*.mp4")
    manifest = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 1.0, 2.0), ("b", 0, 0.0, 2.0)], "segment_id string, label_idx int, start double, end double")
    root = f"file://{tmp_path}"
    paths = [("a", "1", f"{tmp_path}/a/1.mp4"), ("a", "2", f"{root}/a/2.mp4"), ("b", "1", f"{tmp_path}/b b/1.mp4")]
    raw = spark.createDataFrame(paths, "segment_id string, local_video_id string, video_path string").withColumns({"duration_sec": F.lit(1.0), "has_video": F.lit(True), "has_audio": F.lit(False)})
    mapped = media.media_manifest(manifest, raw, media.pair_media(manifest, raw))
    assert media.check_mapping(mapped, files) is mapped
    gone = mapped.withColumn("video_path", F.when(F.col("label_idx") == 1, "/nowhere/2.mp4").otherwise(F.col("video_path")))
    assert [r["label_idx"] for r in media.missing_files(gone, files).collect()] == [1]
    with pytest.raises(ValueError, match="mapped files that don't exist"):
        media.check_mapping(gone, files)
    with pytest.raises(ValueError, match="doubled_rows"):
        media.check_mapping(mapped.union(mapped), files)


def counted_jobs(spark, action):
    """Jobs that an action runs."""
    group = "counted"
    spark.sparkContext.setJobGroup(group, group)
    action()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def test_a_sound_mapping_is_checked_in_one_pass(spark):
    """All contracts hold: they are looked at together, not one job or more for each."""
    manifest = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 1.0, 2.0), ("b", 0, 0.0, 2.0)], "segment_id string, label_idx int, start double, end double")
    raw = spark.createDataFrame([("a", "2"), ("b", "1")], "segment_id string, local_video_id string")
    exceptions = spark.createDataFrame([("a", 1, "2")], "segment_id string, label_idx int, local_video_id string")
    assert counted_jobs(spark, lambda: media.pair_media(manifest, raw, exceptions)) <= 4
    assert {tuple(r) for r in media.pair_media(manifest, raw, exceptions).select("segment_id", "label_idx", "local_video_id").collect()} == {("a", 1, "2"), ("b", 0, "1")}


@pytest.mark.parametrize("named", [[("a", 1, "02")], [("a", None, "2")], [("a", 1, None)], [("b", 0, "1")], [("a", 1, "x")], [("a", 7, "2")], [("a", 1, "2"), ("a", 0, "2")], [("a", 1, "2"), ("a", 1, "2")]])
def test_each_wrong_exception_is_refused_and_named(spark, named):
    manifest = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 1.0, 2.0), ("b", 0, 0.0, 2.0)], "segment_id string, label_idx int, start double, end double")
    raw = spark.createDataFrame([("a", "2"), ("b", "1")], "segment_id string, local_video_id string")
    exceptions = spark.createDataFrame(named, "segment_id string, label_idx int, local_video_id string")
    with pytest.raises(ValueError):
        media.pair_media(manifest, raw, exceptions)
    assert media.exception_errors(manifest, raw, exceptions).count() == len(named)


def test_exceptions_are_looked_up_with_few_shuffles(spark):
    """Each table is dealt once for each key, not once more for distinct keys."""
    manifest = spark.range(4).select(F.lit("a").alias("segment_id"), F.col("id").cast("int").alias("label_idx"))
    raw = spark.range(3).select(F.lit("a").alias("segment_id"), F.col("id").cast("string").alias("local_video_id"))
    exceptions = spark.createDataFrame([("a", 1, "2"), (None, 1, "2"), ("a", 9, "9")], "segment_id string, label_idx int, local_video_id string")
    found = media.exception_errors(manifest, raw, exceptions)
    assert {tuple(r)[:3]: r["errors"] for r in found.collect()} == {(None, 1, "2"): ["no such row", "no such file"], ("a", 9, "9"): ["no such row", "no such file"]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
