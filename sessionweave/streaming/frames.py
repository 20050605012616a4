"""The frame state of unbounded sessions, kept by Structured Streaming. This is an extension; batches use operators.frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geometry import CLOSED_BELOW, LEFT_BELOW, RIGHT_ABOVE
from ..operators.frames import KEPT_VALUES, SMOOTHED

OUTPUT = "session_id string, frame_index int, blink int, cumulative_blinks long, pitch_smooth double, yaw_smooth double, roll_smooth double, gaze_smooth double, gaze_label string"
STATE = "closed boolean, blinks long, pitch array<double>, yaw array<double>, roll array<double>, gaze array<double>"


def _label(value: float | None) -> str:
    if value is None:
        return "UNKNOWN"
    return "LEFT" if value < LEFT_BELOW else "RIGHT" if value > RIGHT_ABOVE else "CENTER"


def _finite(value: object) -> float | None:
    return float(value) if value is not None and abs(value) < float("inf") else None


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None = 600_000) -> Iterator[pd.DataFrame]:
    """One session's next frames, taken in order of frame_index; the state is five values a measure, the eye and the count."""
    if state.hasTimedOut:
        state.remove()
        return
    closed, blinks, *kept = state.get if state.exists else (False, 0, [], [], [], [])
    history = {c: list(x) for c, x in zip(SMOOTHED, kept, strict=True)}
    frames = pd.concat(list(batches)).sort_values("frame_index")
    rows = []
    for frame in frames.to_dict("records"):
        means: dict[str, float | None] = dict.fromkeys(SMOOTHED)
        blink = 0
        if frame["face_detected"] == 1:
            ear = _finite(frame["ear"])
            now = ear is not None and ear < CLOSED_BELOW
            blink = int(closed and not now)
            closed, blinks = now, blinks + blink
            for c in SMOOTHED:
                value = _finite(frame[c])
                if value is not None:
                    history[c] = [*history[c], value][-KEPT_VALUES:]
                    means[c] = sum(history[c]) / len(history[c])
        rows.append((key[0], frame["frame_index"], blink, blinks, *(means[c] for c in SMOOTHED), _label(means["gaze"])))
    state.update((closed, blinks, *(history[c] for c in SMOOTHED)))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUTPUT.split(", ")])


def stream_temporal_features(frames: DataFrame, idle_minutes: int | None = 10) -> DataFrame:
    """Streaming frames (session_id, frame_index, face_detected, ear, pitch, yaw, roll, gaze), in order within a session across
    micro-batches, to the columns OUTPUT. Sessions idle for that long are forgotten; with None none are, for streams that end."""
    idle_ms = idle_minutes and idle_minutes * 60_000
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    step = lambda key, batches, state: advance(key, batches, state, idle_ms)
    return frames.groupBy("session_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)
