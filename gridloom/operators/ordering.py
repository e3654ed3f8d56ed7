"""Ranks and running sums of tables that no task can hold: rows are dealt out by range, and parts know what lies before them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources.scratch import stored


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "n", weight: str | None = None) -> DataFrame:
    """``df`` with the number (from 0) of each row in its group's order, and ``{name}_total``, the group's rows.

    Rows are range-partitioned and sorted; only the counts of parts are added up over a
    group, so a group may hold any share of the rows. Rows that are equal in ``order``
    get different numbers, in any order. With ``weight`` a row counts for so many: its
    number is that of the first.
    """
    by = list(by)
    rows = F.lit(1) if weight is None else F.col(weight)
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranged = stored(ranged.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "ranged")
    parts = ranged.groupBy(*by, "__part").agg(F.sum(rows).alias("__rows"), F.min("__id").alias("__first"))
    group = Window.partitionBy(*by)
    before = F.sum("__rows").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__rows")
    parts = parts.select(*by, "__part", before.alias("__before"), "__first", F.sum("__rows").over(group).alias(f"{name}_total"))
    out = ranged.join(parts, [*by, "__part"])
    inside = F.col("__id") - F.col("__first")
    if weight is not None:
        inside = F.sum(weight).over(Window.partitionBy(*by, "__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    return out.withColumn(name, F.col("__before") + inside).drop("__part", "__id", "__before", "__first")


def running_share(df: DataFrame, key: str, weight: str) -> tuple[DataFrame, list[tuple[int, float]]]:
    """part, key, low, high: the piece of [0, 1) that each row's weight takes, in order of key; and where each part begins.

    A piece begins exactly where the one before it ends, the first of a part where the part does.
    Parts are ranges of keys. What reaches the driver is one number a part.
    """
    ranged = stored(df.select(key, F.col(weight).alias("w")).where("w > 0").repartitionByRange(key).withColumns({"part": F.spark_partition_id(), "id": F.monotonically_increasing_id()}), "ranged")
    sums = sorted((r["part"], r["w"]) for r in ranged.groupBy("part").agg(F.sum("w").alias("w")).collect())
    total, at, begin = sum(w for _, w in sums), 0.0, []
    for part, w in sums:
        begin.append((part, at / total))
        at += w
    if not begin:
        return ranged.select("part", key, F.col("w").alias("low"), F.col("w").alias("high")), begin
    offset = F.element_at(F.create_map(*(F.lit(x) for p in begin for x in p)), F.col("part"))
    inside = Window.partitionBy("part").orderBy(key, "id")
    ranged = ranged.withColumn("high", offset + F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, 0)) / total)
    return ranged.select("part", key, F.coalesce(F.lag("high").over(inside), offset).alias("low"), "high"), begin


def changes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before it, from the second on; nulls are equal."""
    x = column.to_pandas(integer_object_nulls=True) if column.null_count else column.to_pandas()
    void, x = x.isna().to_numpy(), x.to_numpy()
    return (x[1:] != x[:-1]) & ~(void[1:] & void[:-1])


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``df`` with running sums over each group in order, the row itself included; values are whole numbers, none negative or null.

    Rows are sorted by range and summed where they lie, so they move once and a group may
    hold any share of them. A group goes on from an earlier range at most once a range: what
    such groups had before is a table of at most one row a range, and is broadcast. Rows that
    are equal in ``order`` come in any order; null keys are a group. Columns may not begin with two underscores.
    """
    by, names = list(by), list(sums)
    schema = T.StructType([*df.schema, *(T.StructField(n, T.LongType()) for n in names), T.StructField("__part", T.IntegerType())])
    wide = df.withColumns({n: e.cast("long") for n, e in sums.items()})
    ranged = wide.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, dict.fromkeys(names, 0)
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for k in by:
                new[1:] |= changes(b.column(k))
            new[0] = last is None or last != [b.column(k)[0].as_py() for k in by]
            starts = np.flatnonzero(new)
            counts = np.diff(np.concatenate([starts, [b.num_rows]]))
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            for n in names:
                x = b.column(n).to_numpy()
                y = np.cumsum(x) + (0 if new[0] else carried[n])
                if len(starts):
                    y[starts[0] :] -= np.repeat(y[starts] - x[starts], counts)
                columns[n], carried[n] = pa.array(y), int(y[-1])
            last = [b.column(k)[b.num_rows - 1].as_py() for k in by]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    local = stored(ranged.mapInArrow(run, schema), "running")
    parts = local.groupBy(*by, "__part").agg(*(F.max(n).alias(n) for n in names))
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*(F.col(k).alias(f"__{k}") for k in by), F.col("__part").alias("__own"), *(F.sum(n).over(earlier).alias(f"__before_{n}") for n in names)).where(F.col(f"__before_{names[0]}").isNotNull())
    met = local["__part"] == F.col("__own")
    for k in by:
        met = met & local[k].eqNullSafe(F.col(f"__{k}"))
    out = local.join(F.broadcast(before), met, "left")
    return out.select(*df.columns, *((F.col(n) + F.coalesce(f"__before_{n}", F.lit(0))).alias(n) for n in names))
