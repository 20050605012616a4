"""A stream of frames in files, run to its end, against the batch measures."""

from __future__ import annotations

import math
import random

from sessionweave.operators import frames as batch
from sessionweave.streaming.frames import stream_temporal_features

SCHEMA = "session_id string, frame_index int, face_detected int, ear double, pitch double, yaw double, roll double, gaze double"


def test_a_stream_that_ends_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    value = lambda *odd: rng.choice([rng.uniform(0, 0.6), *odd])
    rows = [(s, k, rng.choice([1, 1, 1, 0]), value(None, 0.1), value(None, math.nan), value(math.inf), value(), value(None)) for s in "abc" for k in range(1, 41)]
    for part in range(4):
        kept = [r for r in rows if (r[1] - 1) // 10 == part]
        rng.shuffle(kept)
        spark.createDataFrame(kept, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "frames"))
    query = stream_temporal_features(source, None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    assert query.exception() is None and len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    streamed = {(r["session_id"], r["frame_index"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    wanted = batch.temporal_features(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(streamed) == len(wanted) == len(rows)
    for r in wanted:
        s = streamed[r["session_id"], r["frame_index"]]
        assert (s["blink"], s["cumulative_blinks"], s["gaze_label"]) == (r["blink"], r["cumulative_blinks"], r["gaze_label"])
        for c in ("pitch_smooth", "yaw_smooth", "roll_smooth", "gaze_smooth"):
            assert (s[c] is None) == (r[c] is None) and (s[c] is None or math.isclose(s[c], r[c], abs_tol=1e-12))
