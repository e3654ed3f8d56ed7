"""Queries on ordered series."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.kalman import smooth_long, smooth_series
from gridloom.operators import series as O
from gridloom.registry import query


def _kalman(first: bool) -> str:
    x0 = "area, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) * (1 - 1 / 1.1), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)" if first else "area, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)"
    return f"""s AS (SELECT k, t, area, row_number() OVER (PARTITION BY k ORDER BY t, area) AS n FROM {{series}}),
      kf(k, n, t, area, x, v, p00, p01, p10, p11) AS (SELECT k, n, t, area, {x0} FROM s WHERE n = 1
        UNION ALL SELECT k, n, t, area, xp + p0 / (p0 + 0.1) * (area - xp), v + q10 / (p0 + 0.1) * (area - xp), (1 - p0 / (p0 + 0.1)) * p0, (1 - p0 / (p0 + 0.1)) * q01, q10 - q10 / (p0 + 0.1) * p0, q11 - q10 / (p0 + 0.1) * q01
          FROM (SELECT s.k, s.n, s.t, s.area, kf.x + dt * kf.v AS xp, kf.v, kf.p00 + dt * kf.p10 + dt * (kf.p01 + dt * kf.p11) + 0.01 AS p0, kf.p01 + dt * kf.p11 AS q01, kf.p10 + dt * kf.p11 AS q10, kf.p11 + 0.005 AS q11
            FROM kf JOIN (SELECT *, greatest(t - lag(t) OVER (PARTITION BY k ORDER BY n), 0.01) AS dt FROM s) s ON s.k = kf.k AND s.n = kf.n + 1) u),
      sm AS (SELECT k, n, t, area AS a, round(x, 6) AS smoothed, round(v, 6) AS velocity FROM kf)""".replace(" 0.1)", " CAST(0.1 AS DOUBLE))").replace("0.01 AS p0", "CAST(0.01 AS DOUBLE) AS p0").replace(", 0.01)", ", CAST(0.01 AS DOUBLE))").replace("0.005 AS", "CAST(0.005 AS DOUBLE) AS").replace("1 / 1.1", "1 / CAST(1.1 AS DOUBLE)")


SERIES, TRACKER = _kalman(True), _kalman(False)


@query(f"WITH {SERIES} SELECT k, t, a, smoothed, velocity FROM sm", recursive=True)
def kalman_series(v):
    return smooth_series(v.series, ["k"])


@query(f"WITH {SERIES} SELECT k, t, a, smoothed, velocity FROM sm", recursive=True)
def kalman_long(v):
    """The same for series too long for one array."""
    return smooth_long(v.series, ["k"])


@query(f"WITH {TRACKER} SELECT k, t, a, smoothed, velocity FROM sm", recursive=True)
def kalman_tracker(v):
    return smooth_series(v.series, ["k"], update_first=False)


@query("WITH d AS (SELECT k, t, area - lag(area) OVER (PARTITION BY k ORDER BY t) AS net FROM {series}), g AS (SELECT k, t, CASE WHEN net IS NULL OR abs(net) > 1e12 THEN 0 ELSE net END AS net FROM d) SELECT k, t, 1 AS step, round(greatest(sum(net) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING), 0), 6) AS area FROM g UNION ALL SELECT k, min(t), 0, CAST(0 AS DOUBLE) FROM g GROUP BY k")
def cumulative_area(v):
    from pyspark.sql import Window

    net = v.series.withColumn("net", F.col("area") - F.lag("area").over(Window.partitionBy("k").orderBy("t")))
    return O.cumulative_area(net, ["k"], "t", "net").withColumn("area", F.round("area", 6))


@query("SELECT k, t, round(greatest(t - lag(t) OVER (PARTITION BY k ORDER BY t), 0.01), 9) AS dt FROM {series}".replace(", 0.01)", ", CASE WHEN lag(t) OVER (PARTITION BY k ORDER BY t) IS NULL THEN 0.01 ELSE CAST(0.01 AS DOUBLE) END)"))
def dt_clamped(v):
    return O.clamped_steps(v.series, ["k"], "t").select("k", "t", F.round("dt", 9).alias("dt"))


@query(f"WITH {SERIES} SELECT k, n - 2 AS pair, velocity FROM sm WHERE n >= 2", recursive=True)
def pair_velocity(v):
    return O.pair_velocity(smooth_series(v.series, ["k"]), ["k"])


@query(f"WITH {TRACKER} SELECT k, min(t) AS first_t, max(t) AS last_t, count(*) AS n_obs, round(max(smoothed) - arg_min(smoothed, t), 4) AS total_gain, round(avg(velocity), 4) AS mean_velocity FROM sm GROUP BY k", recursive=True)
def track_summary(v):
    return O.track_summary(smooth_series(v.series, ["k"], update_first=False), ["k"])


@query(f"WITH {TRACKER} SELECT k, arg_max(smoothed, t) AS smoothed, arg_max(velocity, t) AS velocity FROM sm GROUP BY k", recursive=True)
def track_latest(v):
    return O.latest(smooth_series(v.series, ["k"], update_first=False), ["k"], "t", ["smoothed", "velocity"])


@query(f"WITH {TRACKER}, g AS (SELECT k, round(max(smoothed) - arg_min(smoothed, t), 4) AS total_gain FROM sm GROUP BY k) SELECT k, total_gain FROM g ORDER BY total_gain DESC, k LIMIT 10", recursive=True)
def top_tracks(v):
    return O.top_by_gain(O.track_summary(smooth_series(v.series, ["k"], update_first=False), ["k"]), 10, "k").select("k", "total_gain")


@query(f"WITH {SERIES} SELECT k, t, smoothed, velocity, round(greatest(smoothed - 0.5, 0), 6) AS low, round(smoothed + 0.5, 6) AS high, CASE WHEN velocity > 0 THEN 'growing' WHEN velocity < 0 THEN 'shrinking' ELSE 'stable' END AS trend FROM sm", recursive=True)
def series_band(v):
    out = O.uncertainty_band(smooth_series(v.series, ["k"]).drop("a"), 0.5)
    return out.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query("""WITH h AS (SELECT *, max(iou) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {history}),
  f AS (SELECT *, CASE WHEN b IS NULL OR iou > b THEN 1 ELSE 0 END AS better FROM h), g AS (SELECT *, sum(better) OVER (PARTITION BY run ORDER BY epoch) AS grp FROM f),
  s AS (SELECT run, epoch, max(iou) OVER (PARTITION BY run ORDER BY epoch) AS best, row_number() OVER (PARTITION BY run, grp ORDER BY epoch) - 1 AS since FROM g)
  SELECT run, epoch, round(best, 6) AS best, since, max(since) OVER (PARTITION BY run ORDER BY epoch) >= 5 AS stop FROM s""")
def early_stop(v):
    return O.early_stop(v.history, ["run"], "epoch", "iou", 5).withColumn("best", F.round("best", 6))


@query("SELECT k, t, round(CASE WHEN t > first_value(t) OVER w THEN (area - first_value(area) OVER w) / (t - first_value(t) OVER w) END, 4) AS rate FROM {series} WINDOW w AS (PARTITION BY k ORDER BY t RANGE BETWEEN CAST(0.05 AS DOUBLE) PRECEDING AND CURRENT ROW)")
def expansion_rate_window(v):
    return O.expansion_rate(v.series, ["k"], "t", "area", 0.05).select("k", "t", F.round("rate", 4).alias("rate"))
