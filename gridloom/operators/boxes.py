"""Statistics of square windows of any size, by running sums along rows, then columns.

A window's sum is the difference of two running sums, so it costs the same whatever its size.
Rows are dealt out in strips, their sums in strips of columns; every cell moves twice, as part
of an array, and a task holds a strip of whole rows or columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.distance import STRIP
from gridloom.operators.focal import wrap

_SUMS = ("n", "s", "q")


def sliding(x: np.ndarray, window: int, mode: str) -> np.ndarray:
    """Sums of ``window`` columns round each column of (rows, columns); beyond the ends follows ``mode``."""
    n, half = x.shape[1], window // 2
    at = wrap(np.arange(-half, n + window - half - 1), n, mode)
    padded = x[:, at]
    sums = np.zeros((len(x), padded.shape[1] + 1), np.longdouble)
    np.cumsum(padded, axis=1, dtype=np.longdouble, out=sums[:, 1:])
    return (sums[:, window:] - sums[:, :-window]).astype(np.float64)


def box_deviation(df: DataFrame, by: Sequence[str], col: str, shape: tuple[int, int], window: int, name: str = "roughness", mode: str = "reflect", strip: int = STRIP) -> DataFrame:
    """by, r, c and the standard deviation of the square window round every cell of ``df``; NaN where the window has a hole.

    Cells outside ``shape`` follow ``mode`` (clamp, reflect or mirror, see ``focal.wrap``). Cells are unique by (by, r, c).
    """
    by, (height, width) = list(by), shape
    tall, across = int(np.clip(strip // width, 1, 4096)), int(np.clip(strip // height, 8, 512))
    strips = -(-width // across)
    keys = [T.StructField(b, df.schema[b].dataType) for b in by]
    cells = df.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(col).cast("double").alias("z"))
    shift = cells.where(~F.isnan("z")).groupBy(*by).agg(F.avg("z").alias("__mean"))  # a row a group: keeps the squares small
    if by:
        met = F.lit(True)
        for b in by:
            met = met & F.col(b).eqNullSafe(F.col(f"__{b}"))
        cells = cells.join(shift.withColumnsRenamed({b: f"__{b}" for b in by}), met, "left")
    else:
        cells = cells.crossJoin(shift)  # one row
    cells = cells.select(*by, "r", "c", (F.col("z") - F.coalesce("__mean", F.lit(0.0))).alias("z"))
    reals = [T.StructField(s, T.ArrayType(T.DoubleType())) for s in _SUMS]
    lines_type = T.StructType([*keys, T.StructField("r", T.LongType()), T.StructField("at", T.LongType()), *reals, T.StructField("seen", T.ArrayType(T.BooleanType()))])

    def along_rows(group: pa.Table) -> pa.Table:
        r, c, z = (group.column(k).to_numpy(zero_copy_only=False) for k in ("r", "c", "z"))
        rows, at = np.unique(r, return_inverse=True)
        grid, seen = np.full((len(rows), width), np.nan), np.zeros((len(rows), strips * across), bool)
        grid[at, c], seen[at, c] = z, True
        fine = ~np.isnan(grid)
        value = np.where(fine, grid, 0.0)
        n = len(rows) * strips
        ends = pa.array(np.arange(n + 1) * across, pa.int32())
        lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(np.pad(x, ((0, 0), (0, strips * across - x.shape[1]))).ravel()))
        sums = [lists(sliding(x, window, mode)) for x in (fine.astype(float), value, value * value)]
        head = [pa.repeat(group.column(b)[0], n) for b in by]
        return pa.table([*head, pa.array(np.repeat(rows, strips)), pa.array(np.tile(np.arange(strips), len(rows))), *sums, lists(seen)], names=lines_type.names)

    lines = cells.withColumn("__strip", F.floor(F.col("r") / tall)).groupBy(*by, "__strip").applyInArrow(along_rows, lines_type)
    out_type = T.StructType([*keys, T.StructField("r", T.LongType()), T.StructField("c", T.LongType()), T.StructField(name, T.DoubleType())])

    def along_columns(group: pa.Table) -> pa.Table:
        r = group.column("r").to_numpy()

        def grid(k: str) -> np.ndarray:
            flat = group.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, across)
            whole = np.zeros((height, across), flat.dtype)
            whole[r] = flat
            return whole

        n, s, q = (sliding(grid(k).T, window, mode).T for k in _SUMS)
        full = window * window
        mean = s / full
        found = np.where(n == full, np.sqrt(np.maximum(q / full - mean * mean, 0)), np.nan)
        row, column = np.nonzero(grid("seen"))
        base = int(group.column("at")[0].as_py()) * across
        head = [pa.repeat(group.column(b)[0], len(row)) for b in by]
        return pa.table([*head, pa.array(row), pa.array(column + base), pa.array(found[row, column])], names=out_type.names)

    return lines.groupBy(*by, "at").applyInArrow(along_columns, out_type)
