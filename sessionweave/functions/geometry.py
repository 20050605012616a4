"""Facial geometry as column expressions over landmarks: array of structs x, y, counted from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Landmark numbers of the face mesh.
LEFT_EYE = (33, 160, 158, 133, 153, 144)
RIGHT_EYE = (362, 385, 387, 263, 373, 380)
LEFT_IRIS = (468, 469, 470, 471, 472)
RIGHT_IRIS = (473, 474, 475, 476, 477)
LEFT_CORNERS = (33, 133)
RIGHT_CORNERS = (362, 263)
# Thresholds.
CLOSED_BELOW = 0.21
LEFT_BELOW = 0.40
RIGHT_ABOVE = 0.60


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def eye_aspect_ratio(landmarks: Column, eye: tuple[int, ...]) -> Column:
    """Sum of the two heights over twice the width; 0.0 for an eye without width."""
    p = [F.get(landmarks, k) for k in eye]
    width = distance(p[0], p[3])
    return F.when(width == 0, 0.0).otherwise((distance(p[1], p[5]) + distance(p[2], p[4])) / (2.0 * width))


def mean_eye_aspect_ratio(landmarks: Column) -> Column:
    return (eye_aspect_ratio(landmarks, LEFT_EYE) + eye_aspect_ratio(landmarks, RIGHT_EYE)) / 2.0


def _side(landmarks: Column, iris: tuple[int, ...], corners: tuple[int, ...]) -> Column:
    x = [F.get(landmarks, k)["x"] for k in corners]
    low, width = F.least(*x), F.greatest(*x) - F.least(*x)
    middle = sum(F.get(landmarks, k)["x"] for k in iris) / float(len(iris))
    return F.when(width > 0, (middle - low) / width)


def gaze_ratio(landmarks: Column) -> Column:
    """Where the irises stand between the eyes' corners; NULL if either eye has no width."""
    return (_side(landmarks, LEFT_IRIS, LEFT_CORNERS) + _side(landmarks, RIGHT_IRIS, RIGHT_CORNERS)) / 2.0


def gaze_label(value: Column) -> Column:
    return F.when(value.isNull(), "UNKNOWN").when(value < LEFT_BELOW, "LEFT").when(value > RIGHT_ABOVE, "RIGHT").otherwise("CENTER")


def euler_degrees(r: Column) -> Column:
    """Struct pitch, yaw, roll in degrees from a 3 x 3 rotation matrix, array of rows; near gimbal lock roll is 0."""
    at = lambda i, j: F.get(F.get(r, i), j)
    sy = F.sqrt(F.pow(at(0, 0), 2) + F.pow(at(1, 0), 2))
    free = sy >= 1e-6
    pitch = F.when(free, F.atan2(at(2, 1), at(2, 2))).otherwise(F.atan2(-at(1, 2), at(1, 1)))
    roll = F.when(free, F.atan2(at(1, 0), at(0, 0))).otherwise(F.lit(0.0))
    return F.struct(F.degrees(pitch).alias("pitch"), F.degrees(F.atan2(-at(2, 0), sy)).alias("yaw"), F.degrees(roll).alias("roll"))
