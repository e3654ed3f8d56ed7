"""A constant-velocity Kalman filter over ordered series, as a scan over ranges of rows.

What a range of one series does to the state before it is a Gaussian with an affine mean, and
such pieces follow each other associatively (the filtering elements of parallel
Kalman filters). Every range of rows is filtered at once where it lies: a series that begins
there has its results, one that goes on has the coefficients that give them once the state before
the range is known. Those states are one row a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.ordering import changes
from gridloom.sources.scratch import stored

#: Process noise of value and velocity, measurement noise, and the least step in time.
Q_VALUE, Q_SPEED, R_NOISE, MIN_DT = 0.01, 0.005, 0.1, 0.01

#: t, value, velocity and the upper half of their covariance.
State = tuple[float, float, float, float, float, float]


def advance(state: State | None, t: float, a: float, update_first: bool = False) -> State:
    """The state after one more observation.

    Steps of time shorter than 0.01, or backwards, count as 0.01. ``update_first`` lets the
    first observation shrink the uncertainty, as a series does; a tracker leaves it.
    """
    if state is None:
        return (t, a, 0.0, 1.0 - 1.0 / (1.0 + R_NOISE) if update_first else 1.0, 0.0, 1.0)
    before, x, v, p, q, r = state
    dt = max(t - before, MIN_DT)
    x, p, q, r = x + dt * v, p + dt * (q + q + dt * r) + Q_VALUE, q + dt * r, r + Q_SPEED
    gain = p + R_NOISE
    left, k, m = a - x, p / gain, q / gain
    return (t, x + k * left, v + m * left, (1 - k) * p, (1 - k) * q, r - m * q)


def elements(t: np.ndarray, a: np.ndarray) -> np.ndarray:
    """For each observation of a range, what those after the first do to the state at the first: (n, 14).

    The mean becomes A (1 + P J)^-1 (m + P e) + b and the covariance A (1 + P J)^-1 P A' + C. Columns:
    A by rows (4), b (2), C (3, upper half), e (2), J (3, upper half). b and C are a filter that begins at zero.
    """
    out = np.empty((len(t), 14))
    now = [1.0, 0.0, 0.0, 1.0, *([0.0] * 10)]
    out[0] = now
    for i in range(1, len(t)):
        a00, a01, a10, a11, x, v, p, q, r, e0, e1, j00, j01, j11 = now
        dt = max(float(t[i]) - float(t[i - 1]), MIN_DT)
        w0, w1 = a00 + dt * a10, a01 + dt * a11
        x, p, q, r = x + dt * v, p + dt * (q + q + dt * r) + Q_VALUE, q + dt * r, r + Q_SPEED
        gain = p + R_NOISE
        left, k, m = float(a[i]) - x, p / gain, q / gain
        now = [(1 - k) * w0, (1 - k) * w1, a10 - m * w0, a11 - m * w1, x + k * left, v + m * left, (1 - k) * p, (1 - k) * q, r - m * q,
               e0 + w0 * left / gain, e1 + w1 * left / gain, j00 + w0 * w0 / gain, j01 + w0 * w1 / gain, j11 + w1 * w1 / gain]
        out[i] = now
    return out


def _solved(e, p, q, r, y0, y1):
    """(1 + P J)^-1 y for numbers or columns."""
    m00, m01 = 1 + p * e[11] + q * e[12], p * e[12] + q * e[13]
    m10, m11 = q * e[11] + r * e[12], 1 + q * e[12] + r * e[13]
    det = m00 * m11 - m01 * m10
    return (m11 * y0 - m01 * y1) / det, (m00 * y1 - m10 * y0) / det


def mean_after(e, x, v, p, q, r):
    """Value and velocity after an element, from those before it; numbers or columns."""
    y0, y1 = _solved(e, p, q, r, x + p * e[9] + q * e[10], v + q * e[9] + r * e[10])
    return e[0] * y0 + e[1] * y1 + e[4], e[2] * y0 + e[3] * y1 + e[5]


def state_after(e, state: State, t: float) -> State:
    _, x, v, p, q, r = state
    (c00, c10), (c01, c11) = _solved(e, p, q, r, p, q), _solved(e, p, q, r, q, r)
    d00, d01, d10, d11 = e[0] * c00 + e[1] * c10, e[0] * c01 + e[1] * c11, e[2] * c00 + e[3] * c10, e[2] * c01 + e[3] * c11
    x, v = mean_after(e, x, v, p, q, r)
    return (t, x, v, d00 * e[0] + d01 * e[1] + e[6], d00 * e[2] + d01 * e[3] + e[7], d10 * e[2] + d11 * e[3] + e[8])


def smooth_long(df: DataFrame, key: list[str], t: str = "t", a: str = "area", update_first: bool = True, order: list[str] | None = None) -> DataFrame:
    """key, t, a, smoothed, velocity for each observation of each key, in order of t, ``order`` and a.

    Rows are sorted by range once, so a key may hold any share of them; only the first key of a
    range may have begun in an earlier one. Values and times may not be null.
    """
    rows = df.select(*key, F.col(t).cast("double").alias("t"), F.col(a).cast("double").alias("a"), *(F.col(o).alias(f"__{o}") for o in order or []))
    by = [*key, "t", *(f"__{o}" for o in order or []), "a"]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*key, "t", "a", F.spark_partition_id().alias("__part"))
    reals, lists = ("smoothed", "velocity"), ("__element", "__end")
    schema = T.StructType([*ranged.schema, *(T.StructField(n, T.DoubleType()) for n in reals), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        x = pa.Table.from_batches(got).combine_chunks()
        n = x.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for k in key:
            new[1:] |= changes(x.column(k))
        times, values = x.column("t").to_numpy(), x.column("a").to_numpy()
        smoothed, speed = np.empty(n), np.empty(n)
        begins = np.flatnonzero(new)
        ends: dict[int, State] = {}
        state = None
        for i, (fresh, at, value) in enumerate(zip(new.tolist(), times.tolist(), values.tolist(), strict=True)):
            if fresh and i:
                ends[i - 1] = state
            state = advance(None if fresh else state, at, value, update_first)
            smoothed[i], speed[i] = state[1], state[2]
        first = int(begins[1]) if len(begins) > 1 else n
        kept = {n - 1: list(state)} | ({first - 1: list(ends[first - 1])} if first < n else {})
        part = elements(times[:first], values[:first])
        element = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(n + 1), first) * 14, pa.int32()), pa.array(part.ravel()))
        end = pa.array([kept.get(i) for i in range(n)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in x.columns), pa.array(smoothed), pa.array(speed), element, end], schema=pa.schema([*x.schema, *((k, pa.float64()) for k in reals), ("__element", element.type), ("__end", end.type)]))

    local = stored(ranged.mapInArrow(run, schema), "filtered")
    # The observations at the ends of a range's first and last series: at most three rows a range.
    tips = local.where(F.col("__end").isNotNull() | (F.col("__element") == F.array(*(F.lit(float(i in (0, 3))) for i in range(14)))))
    pieces = tips.groupBy(*key, "__part").agg(F.min_by(F.struct("t", "a"), F.col("__end").isNotNull()).alias("first"), F.max_by(F.struct("t", "__element", "__end"), F.col("__end").isNotNull()).alias("last"))
    begun = _states(stored(pieces, "pieces"), key)
    met = local["__part"] == begun["__own"]
    for k in key:
        met = met & local[k].eqNullSafe(begun[f"__{k}"])
    e, s = (lambda i: F.col("__element")[i]), (lambda i: F.col("__state")[i])
    value, velocity = mean_after([e(i) for i in range(14)], *(s(i) for i in range(1, 6)))
    pick = lambda later, own: F.round(F.when(F.col("__state").isNotNull(), later).otherwise(F.col(own)), 6).alias(own)
    return local.join(F.broadcast(begun), met, "left").select(*key, "t", "a", pick(value, "smoothed"), pick(velocity, "velocity"))


def _states(pieces: DataFrame, key: list[str]) -> DataFrame:
    """__own, __{key}, __state: the state at the first observation of every range in which a key goes on; at most one row a range."""
    schema = T.StructType([T.StructField("__own", T.IntegerType()), *(T.StructField(f"__{k}", pieces.schema[k].dataType) for k in key), T.StructField("__state", T.ArrayType(T.DoubleType()))])

    def run(x: pd.DataFrame) -> pd.DataFrame:
        out, state = [], None
        for r in x.sort_values("__part").to_dict("records"):
            if state is None:
                state = tuple(r["last"]["__end"])
                continue
            state = advance(state, r["first"]["t"], r["first"]["a"])
            out.append({"__own": r["__part"], **{f"__{k}": r[k] for k in key}, "__state": list(state)})
            state = state_after(r["last"]["__element"], state, r["last"]["t"])
        return pd.DataFrame(out, columns=schema.names)

    several = pieces.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1")
    met = None
    for k in key:
        same = pieces[k].eqNullSafe(several[k])
        met = same if met is None else met & same
    return pieces.join(several, met, "left_semi").groupBy(*key).applyInPandas(run, schema)


def smooth_series(df: DataFrame, key: list[str], t: str = "t", a: str = "area", update_first: bool = True, order: list[str] | None = None) -> DataFrame:
    """The same as ``smooth_long``."""
    return smooth_long(df, key, t, a, update_first, order)
