"""Neighbourhood operators: terrain, smoothing, texture and morphology.

Dense grids are cut into tiles that borrow a border from their neighbours (only border
cells are copied), and one NumPy kernel works on each tile. Sparse masks are handled by
offsets alone, in Spark's own operators.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.distance import nearest_cell

Kernel = Callable[[np.ndarray], Mapping[str, np.ndarray]]


def wrap(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """The cell that stands for index ``i`` of a row of ``n``: clamp (a a | a b c), reflect (b a | a b c), mirror (c b | a b c); constant gives -1 outside."""
    i = np.asarray(i)
    if mode == "clamp":
        return np.clip(i, 0, n - 1)
    if mode == "constant":
        return np.where((i < 0) | (i >= n), -1, i)
    if mode == "reflect":
        j = np.mod(i, 2 * n)
        return np.where(j < n, j, 2 * n - 1 - j)
    if mode == "mirror":
        j = np.mod(i, max(1, 2 * n - 2))
        return np.where(j < n, j, 2 * n - 2 - j)
    raise ValueError(f"no border mode is named {mode}")


def focal(df: DataFrame, by: Sequence[str], col: str, shape: tuple[int, int], radius: int, kernel: Kernel, outputs: Sequence[str], mode: str = "clamp", tile: int = 256) -> DataFrame:
    """by, r, c and the kernel's outputs for every cell of ``df``.

    The kernel gets a tile with ``radius`` more cells on each side and returns arrays of
    the tile's own size. Holes are NaN. Cells outside ``shape`` follow ``mode``. The
    result does not depend on ``tile``, which bounds what a task holds.
    """
    if radius > tile:
        raise ValueError("the radius may not exceed the tile")
    height, width = shape
    low = lambda x: F.greatest(F.floor((F.col(x) - radius) / F.lit(tile)), F.lit(0))
    high = lambda x, n: F.least(F.floor((F.col(x) + radius) / F.lit(tile)), F.lit((n - 1) // tile))
    copies = df.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(col).cast("double").alias("__z"))
    copies = copies.withColumn("__tr", F.explode(F.sequence(low("r"), high("r", height)))).withColumn("__tc", F.explode(F.sequence(low("c"), high("c", width))))
    schema = T.StructType([*(df.schema[b] for b in by), T.StructField("r", T.LongType()), T.StructField("c", T.LongType()), *(T.StructField(o, T.DoubleType()) for o in outputs)])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(part["__tr"].iloc[0]) * tile, int(part["__tc"].iloc[0]) * tile
        h, w = min(tile, height - r0), min(tile, width - c0)
        own = np.full((h + 2 * radius, w + 2 * radius), np.nan)
        own[part["r"] - r0 + radius, part["c"] - c0 + radius] = part["__z"]
        rows, cols = wrap(np.arange(r0 - radius, r0 + h + radius), height, mode), wrap(np.arange(c0 - radius, c0 + w + radius), width, mode)
        padded = own[np.clip(rows - r0 + radius, 0, h + 2 * radius - 1)[:, None], np.clip(cols - c0 + radius, 0, w + 2 * radius - 1)[None, :]]
        if mode == "constant":
            padded[rows < 0] = 0.0
            padded[:, cols < 0] = 0.0
        found = kernel(padded)
        mine = part[(part["r"] >= r0) & (part["r"] < r0 + h) & (part["c"] >= c0) & (part["c"] < c0 + w)]
        out = mine[[*by, "r", "c"]].copy()
        for o in outputs:
            out[o] = found[o][mine["r"] - r0, mine["c"] - c0]
        return out

    return copies.groupBy(*by, "__tr", "__tc").applyInPandas(run, schema)


def _ring(z: np.ndarray, k: int = 1) -> dict[tuple[int, int], np.ndarray]:
    """The grid shifted by each of the nine offsets, without its border of ``k``."""
    h, w = z.shape
    return {(i, j): z[k + i : h - k + i, k + j : w - k + j] for i in (-1, 0, 1) for j in (-1, 0, 1)}


def slope_aspect(cell: float, downslope: bool = False) -> Kernel:
    """Degrees of slope (Horn's weights) and the azimuth that it faces, clockwise from north; ``downslope`` turns it round."""

    def run(z: np.ndarray) -> dict[str, np.ndarray]:
        n = _ring(z)
        east = ((n[-1, 1] + 2 * n[0, 1] + n[1, 1]) - (n[-1, -1] + 2 * n[0, -1] + n[1, -1])) / (8 * cell)
        south = ((n[1, -1] + 2 * n[1, 0] + n[1, 1]) - (n[-1, -1] + 2 * n[-1, 0] + n[-1, 1])) / (8 * cell)
        facing = np.mod(90 - np.degrees(np.arctan2(-south, east)) + (180 if downslope else 0), 360)
        return {"slope": np.degrees(np.arctan(np.hypot(east, south))), "aspect": facing}

    return run


def curvature(cell: float) -> Kernel:
    """Plan and profile curvature of a quadratic surface; 0 where the ground is level."""

    def run(z: np.ndarray) -> dict[str, np.ndarray]:
        n = _ring(z)
        d = (n[0, 1] - 2 * n[0, 0] + n[0, -1]) / (2 * cell**2)
        e = (n[1, 0] - 2 * n[0, 0] + n[-1, 0]) / (2 * cell**2)
        f = (n[1, 1] - n[1, -1] - n[-1, 1] + n[-1, -1]) / (4 * cell**2)
        g, h = (n[0, 1] - n[0, -1]) / (2 * cell), (n[1, 0] - n[-1, 0]) / (2 * cell)
        steep = g * g + h * h
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = -2 / (steep * np.sqrt(steep + 1))
            level = steep <= 1e-10
            return {"plan": np.where(level, 0.0, scale * (d * h * h - f * g * h + e * g * g)), "profile": np.where(level, 0.0, scale * (d * g * g + f * g * h + e * h * h))}

    return run


def roughness(window: int = 3) -> Kernel:
    """The standard deviation of a square window."""

    def run(z: np.ndarray) -> dict[str, np.ndarray]:
        seen = np.lib.stride_tricks.sliding_window_view(z, (window, window))
        mean = seen.mean(axis=(2, 3))
        return {"roughness": np.sqrt(np.maximum((seen * seen).mean(axis=(2, 3)) - mean * mean, 0))}

    return run


def gaussian_taps(sigma: float) -> np.ndarray:
    """Weights out to four standard deviations."""
    k = int(4 * sigma + 0.5)
    x = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    return x / x.sum()


def gaussian(sigma: float) -> Kernel:
    taps = gaussian_taps(sigma)

    def run(z: np.ndarray) -> dict[str, np.ndarray]:
        rows = np.lib.stride_tricks.sliding_window_view(z, len(taps), axis=0) @ taps
        return {"smooth": np.lib.stride_tricks.sliding_window_view(rows, len(taps), axis=1) @ taps}

    return run


def morphometrics(df: DataFrame, by: Sequence[str], col: str, shape: tuple[int, int], cell: float, features: Sequence[str] = ("slope", "aspect", "plan", "profile", "roughness"), tile: int = 256) -> DataFrame:
    """The chosen terrain features in one pass: curvature after smoothing by one cell, the others as the ground is.

    Cells without a number get that of the nearest one first. Borders reflect: one cell
    deep that is the same as repeating the edge, before and after smoothing.
    """
    empty = F.col(col).isNull() | F.isnan(col) | (F.abs(F.col(col)) == F.lit(float("inf")))
    fine = df.where(~empty).select(*by, "r", "c", col)
    whole = fine.unionByName(fill_nearest(fine, by, df.where(empty).select(*by, "r", "c"), col).select(*by, "r", "c", col))
    border = len(gaussian_taps(1.0)) // 2

    def run(z: np.ndarray) -> dict[str, np.ndarray]:
        bare = z[border:-border, border:-border]
        return slope_aspect(cell)(bare) | curvature(cell)(gaussian(1.0)(z)["smooth"]) | roughness()(bare)

    return focal(whole, by, col, shape, border + 1, run, features, "reflect", tile)


SQUARE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
CROSS = [(i, j) for i, j in SQUARE if not i or not j]


def _offsets(n: int, cross: bool) -> list[tuple[int, int]]:
    """Where ``n`` rounds of a 3 x 3 element reach: a square, or a diamond for the cross."""
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if not cross or abs(i) + abs(j) <= n]


def _lines(n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    return [(i, 0) for i in range(-n, n + 1)], [(0, j) for j in range(-n, n + 1)]


def _spread(mask: DataFrame, by: Sequence[str], offsets) -> DataFrame:
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets)))
    return mask.select(*by, "r", "c", shift.alias("o")).select(*by, (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))


def inside(mask: DataFrame, shape: tuple[int, int]) -> DataFrame:
    return mask.where(F.col("r").between(0, shape[0] - 1) & F.col("c").between(0, shape[1] - 1))


def dilate(mask: DataFrame, by: Sequence[str], shape: tuple[int, int], n: int = 1, cross: bool = False) -> DataFrame:
    """The cells within reach of a foreground cell; a square's reach is taken along rows, then columns."""
    if n > 1 and not cross:
        rows, cols = _lines(n)
        return inside(_spread(_spread(mask, by, rows).distinct(), by, cols), shape).distinct()
    return inside(_spread(mask, by, _offsets(n, cross)), shape).distinct()


def erode(mask: DataFrame, by: Sequence[str], shape: tuple[int, int], n: int = 1, cross: bool = False) -> DataFrame:
    """The cells whose whole neighbourhood is foreground; outside the image counts as background."""
    if n > 1 and not cross:
        for line in _lines(n):
            mask = _spread(mask, by, line).groupBy(*by, "r", "c").count().where(F.col("count") == len(line)).drop("count")
        return inside(mask, shape)
    offsets = _offsets(n, cross)
    return inside(_spread(mask, by, offsets).groupBy(*by, "r", "c").count().where(F.col("count") == len(offsets)).drop("count"), shape)


def close(mask: DataFrame, by: Sequence[str], shape: tuple[int, int], n: int = 2) -> DataFrame:
    """Dilation, then erosion, by a square of side 2 n + 1; a full image loses a frame of ``n`` cells."""
    return erode(dilate(mask, by, shape, n), by, shape, n)


TEXTURES = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "entropy")


def cooccurrence(windows: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Texture measures of right-hand neighbours, counted both ways, of many windows of levels at once: (windows, rows, columns)."""
    count = len(windows)
    code = (windows[:, :, :-1] * n + windows[:, :, 1:]).reshape(count, -1) + np.arange(count)[:, None] * (n * n)
    pairs = np.bincount(code.ravel(), minlength=count * n * n).reshape(count, n, n).astype(float)
    p = pairs + pairs.transpose(0, 2, 1)
    p /= np.maximum(p.sum(axis=(1, 2), keepdims=True), 1)
    i, j = np.indices((n, n))
    total = lambda x: x.sum(axis=(1, 2))
    mi, mj = (total(k * p)[:, None, None] for k in (i, j))
    si, sj = np.sqrt(total((i - mi) ** 2 * p)), np.sqrt(total((j - mj) ** 2 * p))
    flat = (si < 1e-15) | (sj < 1e-15)
    return {
        "contrast": total((i - j) ** 2 * p),
        "dissimilarity": total(np.abs(i - j) * p),
        "homogeneity": total(p / (1 + (i - j) ** 2)),
        "energy": np.sqrt(total(p * p)),
        "correlation": np.where(flat, 1.0, total((i - mi) * (j - mj) * p) / np.where(flat, 1.0, si * sj)),
        "entropy": -total(p * np.log2(p + 1e-10)),
    }


def texture(df: DataFrame, by: Sequence[str], col: str, shape: tuple[int, int], window: int = 5, levels: int = 16, stride: int = 4, features: Sequence[str] = ("entropy", "contrast", "homogeneity", "dissimilarity"), tile: int = 128) -> DataFrame:
    """Texture of a moving window at every ``stride``-th cell, copied to the block of cells that it stands for. Holes count as 0. A stride under 4 is taken as 4, as results are stored at that step."""
    stride = max(4, stride)
    if tile % stride:
        raise ValueError("the tile must be a multiple of the stride")
    pad = window // 2

    def run(z: np.ndarray) -> dict[str, np.ndarray]:
        q = np.floor(np.clip(np.nan_to_num(z), 0, 1) * (levels - 1)).astype(int)
        h, w = z.shape[0] - 2 * pad, z.shape[1] - 2 * pad
        seen = np.lib.stride_tricks.sliding_window_view(q, (window, window))[::stride, ::stride]
        rows, cols = seen.shape[:2]
        found = cooccurrence(seen.reshape(-1, window, window), levels)
        wide = lambda x: np.repeat(np.repeat(x.reshape(rows, cols), stride, axis=0), stride, axis=1)[:h, :w]
        return {f: wide(found[f]) for f in features}

    return focal(df, by, col, shape, pad, run, features, "mirror", tile)


def multiscale_texture(df: DataFrame, by: Sequence[str], col: str, shape: tuple[int, int], windows: Sequence[int] = (3, 5, 7), levels: int = 16, features: Sequence[str] = ("entropy", "contrast")) -> DataFrame:
    """Columns {feature}_w{window} for several windows."""
    out = None
    for w in windows:
        part = texture(df, by, col, shape, w, levels, 4, features)
        part = part.select(*by, "r", "c", *(F.col(f).alias(f"{f}_w{w}") for f in features))
        out = part if out is None else out.join(part, [*by, "r", "c"])
    return out


def fill_nearest(df: DataFrame, by: Sequence[str], holes: DataFrame, col: str, reach: int | None = None, widen: int = 0) -> DataFrame:
    """Values (doubles) for the holes (by, r, c): that of the nearest cell, ties to the smaller row and column.

    Within ``reach`` only, unless it is null or ``widen`` is given; the cost does not depend on it.
    """
    found = nearest_cell(df, by, holes, col)
    if reach is not None and not widen:
        found = found.where(F.col("d2") <= reach * reach)
    return found.select(*by, "r", "c", F.col("near_value").alias(col))
