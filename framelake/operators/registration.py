"""Landmarks and affine transforms; a handful of points, so that all of it is done on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators import frames as fr
from framelake.operators.stencils import warp


def paired(template: dict[str, tuple[float, float]], recording: dict[str, tuple[float, float]], by_place: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Points of both sets in the template's order: by name, or by place in the sets."""
    if by_place:
        if len(template) != len(recording):
            raise ValueError("the sets have different numbers of landmarks")
        return np.array(list(template.values()), dtype=float), np.array(list(recording.values()), dtype=float)
    if set(template) != set(recording):
        raise ValueError(f"landmarks of one set only: {sorted(set(template) ^ set(recording))}")
    return np.array([template[k] for k in template], dtype=float), np.array([recording[k] for k in template], dtype=float)


def _normalised(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = points.mean(axis=0)
    spread = np.sqrt(((points - middle) ** 2).sum(axis=1)).mean()
    s = np.sqrt(2) / spread if spread else 1.0
    return (points - middle) * s, np.array([[s, 0, -s * middle[0]], [0, s, -s * middle[1]], [0, 0, 1]])


def estimate_affine(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes source points to target points: the least singular vector of the normalised homogeneous equations."""
    if len(source) < 3:
        raise ValueError("an affine transform needs three landmarks at least")
    a, ta = _normalised(np.asarray(source, dtype=float))
    b, tb = _normalised(np.asarray(target, dtype=float))
    n = len(a)
    rows = np.zeros((2 * n, 7))
    rows[0::2, 0:2], rows[0::2, 2], rows[0::2, 6] = a, 1, b[:, 0]
    rows[1::2, 3:5], rows[1::2, 5], rows[1::2, 6] = a, 1, b[:, 1]
    _, values, v = np.linalg.svd(rows)
    if values[5] < 1e-10 * values[0]:
        raise ValueError("the landmarks lie on a line")
    p = -v[-1] / v[-1, 6]
    inner = np.array([[p[0], p[1], p[2]], [p[3], p[4], p[5]], [0, 0, 1]])
    return np.linalg.inv(tb) @ inner @ ta


def transformed(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    """points (x, y, ...) after a 3 x 3 affine matrix."""
    m = np.asarray(matrix, dtype=float)
    of = lambda i: F.col("x") * float(m[i, 0]) + F.col("y") * float(m[i, 1]) + float(m[i, 2])
    return points.withColumns({"x": of(0), "y": of(1)})


def register(frames: DataFrame, recording: dict, template: dict, rows: int = 0, columns: int = 0, by_place: bool = False) -> tuple[DataFrame, np.ndarray]:
    """Frames in the template's space, and the matrix from template to recording."""
    matrix = estimate_affine(*paired(template, recording, by_place))
    return warp(fr.keep_corner(frames, rows, columns), matrix), matrix


def parameters_over_time(times: DataFrame, matrix: np.ndarray) -> DataFrame:
    """times with the matrix in every row."""
    return times.withColumn("affine", F.array(*[F.lit(float(v)) for v in np.asarray(matrix).reshape(-1)]))
