"""Table functions for users of SQL: tile places, blend weights, shifts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class TileCoords:
    def eval(self, height: int, width: int, size: int, stride: int) -> Iterator[tuple[int, int]]:
        from gridloom.operators.geometry import starts

        for r0 in starts(height, size, stride):
            for c0 in starts(width, size, stride):
                yield r0, c0


class BlendWeights:
    def eval(self, method: str, size: int) -> Iterator[tuple[int, int, float]]:
        k = np.arange(size)
        far = (k - (size - 1) / 2) / (size / 2)
        shapes = {"hanning": 0.5 - 0.5 * np.cos(2 * np.pi * k / max(1, size - 1)), "linear": np.maximum(1 - np.abs(far), 1e-6), "gaussian": np.exp(-0.5 * (far / 0.7) ** 2)}
        if method not in shapes:
            raise ValueError(f"no blend is named {method}")
        w = np.maximum(np.outer(shapes[method], shapes[method]), 1e-6 if method != "linear" else 0)
        for i in range(size):
            for j in range(size):
                yield i, j, float(w[i, j])


class Shifts:
    def eval(self, reach: int) -> Iterator[tuple[int, int]]:
        for dr in range(-reach, reach + 1):
            for dc in range(-reach, reach + 1):
                yield dr, dc


def register(spark: SparkSession) -> None:
    """Makes ``tile_coords(height, width, size, stride)`` (r0, c0), ``blend_weights(method, size)`` (i, j, w) and ``shifts(reach)`` (dr, dc) known to SQL, for LATERAL joins with the grids of a table."""
    spark.udtf.register("tile_coords", udtf(TileCoords, returnType="r0 bigint, c0 bigint"))
    spark.udtf.register("blend_weights", udtf(BlendWeights, returnType="i bigint, j bigint, w double"))
    spark.udtf.register("shifts", udtf(Shifts, returnType="dr bigint, dc bigint"))
