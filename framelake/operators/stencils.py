"""Filters over a frame's neighbourhoods, and warps. A frame stays in its row; weights are made once and sent along."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType


def kernels(sigma: float = 2.0, truncate: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """The Gaussian and its second derivative at whole distances; the latter is not made to sum to zero."""
    r = int(truncate * sigma + 0.5)
    d = np.arange(-r, r + 1, dtype=float)
    phi = np.exp(-(d**2) / (2 * sigma**2))
    phi /= phi.sum()
    return phi, (d**2 / sigma**4 - 1 / sigma**2) * phi


def along(a: np.ndarray, weights: np.ndarray, axis: int, mode: str = "symmetric") -> np.ndarray:
    """Correlation along one axis; beyond an edge frames are mirrored (the edge pixel twice) or go on with the edge's value."""
    r = len(weights) // 2
    padded = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(a.ndim)], mode=mode)
    out = np.zeros_like(a, dtype=float)
    for i, w in enumerate(weights):
        out += w * np.take(padded, range(i, i + a.shape[axis]), axis=axis)
    return out


def each_frame(frames: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """session_id, frame_idx, height, width, pixels of ``work`` on each frame; a task holds some dozens of frames at a time."""
    schema = StructType([f for f in frames.schema.fields if f.name in ("session_id", "frame_idx")] + [StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("pixels", ArrayType(DoubleType()))])
    names = [f.name for f in schema.fields]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                made = []
                for h, w, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                    made.append(work(p.values.to_numpy(zero_copy_only=False).reshape(h, w)))
                pixels = pa.array([m.reshape(-1) for m in made], pa.list_(pa.float64()))
                sides = [pa.array([m.shape[i] for m in made], pa.int32()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sides, pixels], names=names)

    return frames.select("session_id", "frame_idx", "height", "width", "pixels").mapInArrow(run, schema)


def gaussian_laplace(frames: DataFrame, sigma: float = 2.0, truncate: float = 4.0, mode: str = "symmetric") -> DataFrame:
    """Each frame's Gaussian plus its second derivatives along both sides: time is not smoothed, so that the time axis adds the plain Gaussian."""
    phi, second = kernels(sigma, truncate)

    def work(frame: np.ndarray) -> np.ndarray:
        across, bent = along(frame, phi, 1, mode), along(frame, second, 1, mode)
        return along(across, phi, 0, mode) + along(across, second, 0, mode) + along(bent, phi, 0, mode)

    return each_frame(frames, work)


def cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours at a place between the middle two."""
    return np.stack([(-(t**3) + 2 * t**2 - t) / 2, (3 * t**3 - 5 * t**2 + 2) / 2, (-3 * t**3 + 4 * t**2 + t) / 2, (t**3 - t**2) / 2])


def taps(matrix: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of the result comes from: 16 places (0 with weight 0 outside the frame) and weights. matrix takes (x, y, 1) of the result to the source."""
    y, x = np.mgrid[0:height, 0:width].reshape(2, -1).astype(float)
    sx, sy = (matrix[i, 0] * x + matrix[i, 1] * y + matrix[i, 2] for i in (0, 1))
    bx, by = np.floor(sx), np.floor(sy)
    wx, wy = cubic(sx - bx), cubic(sy - by)
    at, weight = [], []
    for j in range(4):
        for i in range(4):
            cx, cy = bx + i - 1, by + j - 1
            inside = (cx >= 0) & (cx < width) & (cy >= 0) & (cy < height)
            at.append(np.where(inside, cy * width + cx, 0).astype(np.int64))
            weight.append(np.where(inside, wx[i] * wy[j], 0.0))
    return np.stack(at), np.stack(weight)


def warp(frames: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Each frame through an affine transform by cubic convolution, within the range of its own values; what comes from outside is 0."""
    matrix = np.asarray(matrix, dtype=float)
    made: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def work(frame: np.ndarray) -> np.ndarray:
        if frame.shape not in made:
            made[frame.shape] = taps(matrix, *frame.shape)
        at, weight = made[frame.shape]
        out = (frame.reshape(-1)[at] * weight).sum(axis=0)
        return np.where(out == 0, 0.0, np.clip(out, frame.min(), frame.max())).reshape(frame.shape)

    return each_frame(frames, work)
