"""Operators on ordered series: cumulative change, steps of time, summaries, early stopping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative_area(changes: DataFrame, by: Sequence[str], t: str, net: str, lead_in: bool = True) -> DataFrame:
    """by, t, area: the running sum of net change, shown no lower than 0.

    NaN and values beyond 1e12 count as no change. With ``lead_in`` a point of area 0
    stands before the first one, at its own time less one step of nothing: the first t.
    """
    x = F.col(net)
    fine = F.when(x.isNull() | F.isnan(x) | (F.abs(x) > 1e12), 0.0).otherwise(x)
    w = Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    out = changes.select(*by, F.col(t).cast("double").alias("t"), F.greatest(F.sum(fine).over(w), F.lit(0.0)).alias("area"), F.lit(1).alias("step"))
    if lead_in:
        first = changes.groupBy(*by).agg(F.min(t).cast("double").alias("t")).select(*by, "t", F.lit(0.0).alias("area"), F.lit(0).alias("step"))
        out = first.unionByName(out)
    return out


def clamped_steps(df: DataFrame, by: Sequence[str], t: str, least: float = 0.01) -> DataFrame:
    """``df`` with dt: the time since the row before, at least ``least``; null for the first."""
    w = Window.partitionBy(*by).orderBy(t)
    return df.withColumn("dt", F.greatest(F.col(t) - F.lag(t).over(w), F.lit(least)))


def pair_velocity(smoothed: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, pair, velocity: the velocity at a point, given to the pair of points that it ends."""
    w = Window.partitionBy(*by).orderBy("t")
    return smoothed.withColumn("pair", (F.row_number().over(w) - 2).cast("long")).where("pair >= 0").select(*by, "pair", "velocity")


def track_summary(smoothed: DataFrame, by: Sequence[str]) -> DataFrame:
    """First and last time, observations, gain over the first area, mean velocity."""
    return smoothed.groupBy(*by).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n_obs"), F.round(F.max("smoothed") - F.min_by("smoothed", "t"), 4).alias("total_gain"), F.round(F.avg("velocity"), 4).alias("mean_velocity"))


def latest(df: DataFrame, by: Sequence[str], t: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.max_by(c, t).alias(c) for c in cols))


def early_stop(history: DataFrame, by: Sequence[str], step: str, score: str, patience: int) -> DataFrame:
    """by, best (running), since (steps without a better score), stop (whether patience has run out by then)."""
    w = Window.partitionBy(*by).orderBy(step)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.col(score) > before)
    out = history.withColumn("better", better.cast("int")).withColumn("best", F.max(score).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("grp", F.sum("better").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("since", (F.row_number().over(Window.partitionBy(*by, "grp").orderBy(step)) - 1).cast("long"))
    return out.select(*by, step, "best", "since", (F.max("since").over(w.rowsBetween(Window.unboundedPreceding, 0)) >= patience).alias("stop"))


def expansion_rate(series: DataFrame, by: Sequence[str], t: str, area: str, span: float) -> DataFrame:
    """``series`` with rate: change of area for a unit of time over the last ``span``; null for a single point."""
    over = f"OVER (PARTITION BY {', '.join(by)} ORDER BY {t} RANGE BETWEEN {span!r}D PRECEDING AND CURRENT ROW)"
    dt = F.col(t) - F.expr(f"first({t}) {over}")
    return series.withColumn("rate", F.when(dt > 0, (F.col(area) - F.expr(f"first({area}) {over}")) / dt))


def uncertainty_band(smoothed: DataFrame, sigma: float) -> DataFrame:
    """``smoothed`` with low, high and the sign of its velocity."""
    v = F.col("velocity")
    sign = F.when(v > 0, "growing").when(v < 0, "shrinking").otherwise("stable")
    return smoothed.withColumns({"low": F.greatest(F.col("smoothed") - sigma, F.lit(0.0)), "high": F.col("smoothed") + sigma, "trend": sign})


def top_by_gain(summary: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` tracks of largest gain, ties to the smaller key."""
    return summary.orderBy(F.desc("total_gain"), F.asc(key)).limit(n)
