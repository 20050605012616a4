"""Head pose from six points of a face: the rotation that brings a model of a head onto the image with least squared distance.

All faces of an Arrow batch are solved together by Levenberg-Marquardt steps, each face with a damping of its own. Steps start from a linear
solution of the projection that is made a rotation, and from four heads that look straight or aside by half a turn, as points with noise can
mislead the linear one; the least distance of a head before the camera counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Landmark numbers (nose, chin, eyes' outer corners, mouth's corners) and their places on the model.
POINTS = (1, 152, 33, 263, 61, 291)
MODEL = ((0.0, 0.0, 0.0), (0.0, -330.0, -65.0), (-225.0, 170.0, -135.0), (225.0, 170.0, -135.0), (-150.0, -150.0, -125.0), (150.0, -150.0, -125.0))
#: Steps, and how little a step may still change the squared distance.
_STEPS, _SETTLED = 60, 1e-14
#: Squared distance, in focal lengths, at which no other start is tried.
_EXACT = 1e-16


def _linear(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and shifts from the projection's homogeneous equations; flat: image points over the focal length."""
    model = np.asarray(MODEL)
    n = len(flat)
    scale = np.abs(model).max()
    wide = np.concatenate([model / scale, np.ones((len(model), 1))], axis=1)
    rows = np.zeros((n, 2 * len(model), 12))
    rows[:, 0::2, 0:4] = rows[:, 1::2, 4:8] = wide
    rows[:, 0::2, 8:] = -flat[:, :, :1] * wide
    rows[:, 1::2, 8:] = -flat[:, :, 1:] * wide
    solved = np.linalg.svd(rows)[2][:, -1].reshape(n, 3, 4)
    solved *= np.sign(np.linalg.det(solved[:, :, :3]) + 1e-300)[:, None, None]
    u, size, v = np.linalg.svd(solved[:, :, :3])
    r = u @ v
    mirrored = np.linalg.det(r) < 0
    u[mirrored, :, 2] *= -1
    return u @ v, solved[:, :, 3] * scale / np.maximum(size.mean(axis=1, keepdims=True), 1e-300)


def _turned(w: np.ndarray) -> np.ndarray:
    """Rotations by vectors."""
    angle = np.linalg.norm(w, axis=1)[:, None, None]
    x, y, z = w.T
    o = np.zeros_like(x)
    k = np.stack([o, -z, y, z, o, -x, -y, x, o], axis=1).reshape(-1, 3, 3)
    small = angle < 1e-12
    safe = np.where(small, 1, angle)
    return np.eye(3) + np.where(small, 1, np.sin(safe) / safe) * k + np.where(small, 0.5, (1 - np.cos(safe)) / safe**2) * (k @ k)


def _distances(r: np.ndarray, t: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned model points, their places before the camera, and their distances from the image points."""
    turned = np.asarray(MODEL) @ r.transpose(0, 2, 1)
    p = turned + t[:, None]
    z = np.where(np.abs(p[:, :, 2]) < 1e-9, 1e-9, p[:, :, 2])
    return turned, p, (p[:, :, :2] / z[:, :, None] - flat).reshape(len(r), -1)


def rotations(points: np.ndarray, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """(n, 3, 3) of image points (n, 6, 2); NaN where points or sizes aren't finite. The camera's focal length is the image's width, its
    centre the image's."""
    out = np.full((len(points), 3, 3), np.nan)
    fine = np.flatnonzero(np.isfinite(points).all(axis=(1, 2)) & (width > 0) & (height > 0))
    if not len(fine):
        return out
    flat = (points[fine] - np.stack([width, height], axis=1)[fine, None] / 2) / width[fine, None, None]
    model = np.asarray(MODEL)
    spread = lambda x: np.sqrt(((x - x.mean(axis=-2, keepdims=True)) ** 2).sum(axis=(-2, -1)))
    depth = spread(model[:, :2]) / np.maximum(spread(flat), 1e-12)
    shift = np.concatenate([flat.mean(axis=1) * depth[:, None], depth[:, None]], axis=1)
    starts = [_linear(flat), *((np.broadcast_to(np.diag(d), (len(fine), 3, 3)).copy(), shift.copy()) for d in ((1.0, 1, 1), (1.0, -1, -1), (-1.0, 1, -1), (-1.0, -1, 1)))]
    best, least = _refined(*starts[0], flat)
    open_ = np.flatnonzero(least > _EXACT)
    for r, t in starts[1:] if len(open_) else ():
        r, cost = _refined(r[open_], t[open_], flat[open_])
        best[open_] = np.where((cost < least[open_])[:, None, None], r, best[open_])
        least[open_] = np.minimum(cost, least[open_])
    out[fine] = best
    return out


def _refined(r: np.ndarray, t: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations that steps from there lead to, and their squared distances, infinite if a point lies behind the camera."""
    damp = np.full(len(r), 1e-3)
    turned, p, gap = _distances(r, t, flat)
    cost = (gap**2).sum(axis=1)
    for _ in range(_STEPS):
        x, y = p[:, :, 0], p[:, :, 1]
        z = np.where(np.abs(p[:, :, 2]) < 1e-9, 1e-9, p[:, :, 2])
        o = np.zeros_like(x)
        project = np.stack([1 / z, o, -x / z**2, o, 1 / z, -y / z**2], axis=-1).reshape(*x.shape, 2, 3)
        a, b, c = (turned[:, :, k] for k in range(3))
        spin = np.stack([o, c, -b, -c, o, a, b, -a, o], axis=-1).reshape(*x.shape, 3, 3)
        j = np.concatenate([project @ spin, project], axis=-1).reshape(len(r), -1, 6)
        normal, slope = j.transpose(0, 2, 1) @ j, (j.transpose(0, 2, 1) @ gap[:, :, None])[:, :, 0]
        normal[~np.isfinite(normal).all(axis=(1, 2))] = np.eye(6)
        size = np.einsum("nii->ni", normal)
        step = np.linalg.solve(normal + np.eye(6) * (damp[:, None] * size + 1e-12 * size.max(axis=1, keepdims=True) + 1e-300)[:, None], -slope[:, :, None])[:, :, 0]
        near_r, near_t = _turned(step[:, :3]) @ r, t + step[:, 3:]
        near = _distances(near_r, near_t, flat)
        less = (near[2] ** 2).sum(axis=1)
        better = less < cost
        settled = ~better | (cost - less <= _SETTLED * cost)
        for old, new in zip((r, t, turned, p, gap), (near_r, near_t, *near), strict=True):
            old[better] = new[better]
        cost = np.where(better, less, cost)
        damp = np.where(better, np.maximum(damp / 10, 1e-10), np.minimum(damp * 10, 1e12))
        if (settled & (damp > 1e8) | (cost < 1e-28)).all():
            break
    return r, np.where((p[:, :, 2] > 0).all(axis=1) & np.isfinite(cost), cost, np.inf)


def pose_points(landmarks: Column) -> Column:
    """The six points (x, y) of a face's landmarks, as an array of twelve numbers."""
    return F.array(*(F.get(landmarks, k)[c].cast("double") for k in POINTS for c in ("x", "y")))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _rotation(points: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    known = [p is not None and len(p) == 12 and not any(v is None for v in p) for p in points]
    flat = np.array([np.asarray(p, np.float64) if k else np.full(12, np.nan) for p, k in zip(points, known, strict=True)]).reshape(-1, 6, 2)
    found = rotations(flat, width.to_numpy(np.float64, na_value=np.nan), height.to_numpy(np.float64, na_value=np.nan))
    return pd.Series([m.tolist() if np.isfinite(m[0, 0]) else None for m in found])


def rotation(points: Column, width: Column, height: Column) -> Column:
    """The head's rotation (three rows of three) from `pose_points` and the image's size; NULL if any is missing. `geometry.euler_degrees`
    makes pitch, yaw and roll of it."""
    return _rotation(points, width.cast("double"), height.cast("double"))
