"""Exact Euclidean distance transform: the nearest of some cells for each of others, however far.

Along rows the nearest cell in the same row is known from the sorted run of a row's cells; along
columns each row is a parabola, and the nearest of all is on their lower envelope. Rows are
dealt out in strips, then columns, so the cost is that of the grid and does not depend on
how far away anything is. A task holds a strip of whole rows or columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a strip.
STRIP = 1 << 21


def nearest_in_row(cells: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The place in ``cells`` (sorted columns) of the nearest one to each of ``columns``, ties to the smaller."""
    return np.searchsorted((cells[:-1] + cells[1:]) // 2, columns, side="left")


def envelope(rows: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower envelope of (r - rows)**2 + height for each column of ``height`` (rows, columns).

    Returns the rows on it (places in ``rows``), the last r where each is least, and their number in each column; ties go to the earlier row.
    """
    n, width = height.shape
    on, until = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    count = np.zeros(width, np.int64)
    every = np.arange(width)
    for q in range(n):
        open_ = every[count > 0]
        while len(open_):
            top = on[count[open_] - 1, open_]
            far = rows[q] - rows[top]
            meets = (height[q, open_] - height[top, open_] + rows[q] * rows[q] - rows[top] * rows[top]) // (2 * far)
            low = np.where(count[open_] > 1, until[np.maximum(count[open_] - 2, 0), open_], np.iinfo(np.int64).min)
            hidden = meets <= low
            shown = open_[~hidden]
            until[count[shown] - 1, shown] = meets[~hidden]
            open_ = open_[hidden]
            count[open_] -= 1
            open_ = open_[count[open_] > 0]
        on[count, every] = q
        count += 1
    return on, until, count


def nearest_cell(cells: DataFrame, by: Sequence[str], asked: DataFrame, col: str | None = None, strip: int = STRIP) -> DataFrame:
    """by, r, c (of ``asked``), near_r, near_c, d2 and, with ``col``, near_value: the nearest of ``cells`` in each group.

    ``cells`` are unique by (by, r, c); ties go to the smaller row, then column. A group without
    cells has no rows. ``col`` is taken as a double.
    """
    by = list(by)
    edge = asked.agg(F.max("r"), F.max("c")).first()
    if edge[0] is None:
        edge = (0, 0)
    wide = max(1, edge[1] + 1)
    tall = int(np.clip(strip // wide, 1, 4096))
    across = int(np.clip(strip // max(1, edge[0] + 1), 8, 512))
    keys = [T.StructField(b, cells.schema[b].dataType) for b in by]
    value = F.col(col).cast("double") if col else F.lit(None).cast("double")
    placed = cells.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), value.alias("x"))
    named = [*by, "r", "at", "near", "x"]
    rows_type = T.StructType([*keys, T.StructField("r", T.LongType()), T.StructField("at", T.LongType()), T.StructField("near", T.ArrayType(T.LongType())), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def along_rows(group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("c").to_numpy(), group.column("r").to_numpy()))
        r, c, x = (group.column(k).to_numpy()[order] for k in ("r", "c", "x"))
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        strips = -(-wide // across)
        columns = np.arange(strips * across)
        near, values = [], []
        for low, high in zip(first, [*first[1:], len(r)], strict=True):
            at = low + nearest_in_row(c[low:high], columns)
            near.append(c[at])
            values.append(x[at])
        n = len(first) * strips
        lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * across, pa.int32()), pa.array(np.concatenate(parts), kind))
        head = [pa.repeat(group.column(b)[0], n) for b in by]
        return pa.table([*head, pa.array(np.repeat(r[first], strips)), pa.array(np.tile(np.arange(strips), len(first))), lists(near, pa.int64()), lists(values, pa.float64())], names=named)

    lines = placed.withColumn("__strip", F.floor(F.col("r") / tall)).groupBy(*by, "__strip").applyInArrow(along_rows, rows_type)
    numbers = [T.StructField(n, T.LongType()) for n in ("r", "c", "near_r", "near_c", "d2")]

    def along_columns(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left.column("r").to_numpy())
        rows = left.column("r").to_numpy()[order]
        grid = lambda k: left.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, across)[order]
        r, c = right.column("r").to_numpy(), right.column("c").to_numpy()
        if not len(rows) or not len(r):
            return pa.table({f.name: pa.array([], t) for f, t in zip(out_type, arrow, strict=True)})
        base = int(right.column("at")[0].as_py()) * across
        near = grid("near")
        on, until, count = envelope(rows, (near - (base + np.arange(across))) ** 2)
        place = np.empty(len(r), np.int64)
        for k in np.unique(c - base):
            mine = np.flatnonzero(c - base == k)
            place[mine] = on[np.searchsorted(until[: count[k] - 1, k], r[mine], side="left"), k]
        near_r, near_c = rows[place], near[place, c - base]
        return pa.table([*(right.column(b) for b in by), pa.array(r), pa.array(c), pa.array(near_r), pa.array(near_c), pa.array((r - near_r) ** 2 + (c - near_c) ** 2), pa.array(grid("x")[place, c - base])], names=[f.name for f in out_type])

    out_type = T.StructType([*keys, *numbers, T.StructField("near_value", T.DoubleType())])
    holes = asked.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.floor(F.col("c") / across).alias("at"))
    arrow = [asked.select(*by).limit(0).toArrow().schema.field(b).type for b in by] + [pa.int64()] * 5 + [pa.float64()]
    out = lines.groupBy(*by, "at").cogroup(holes.groupBy(*by, "at")).applyInArrow(along_columns, out_type)
    return out if col else out.drop("near_value")


def class_distance(cells: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """by, label, r, c, d2: the squared distance of each cell from the nearest one of the other class (``label`` is 0 or 1); none in a group of one class."""
    other = cells.withColumn(label, 1 - F.col(label))
    return nearest_cell(other.select(*by, label, "r", "c"), [*by, label], cells.select(*by, label, "r", "c")).drop("near_r", "near_c")
