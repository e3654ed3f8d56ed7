"""Operators on tables of pixels: rescaling, composites, change, statistics, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import clip, to_metres
from gridloom.sources.scratch import stored


#: Equal steps in which the values of an interval are counted, and values of an interval that are few enough to be sorted as they are.
STEPS, FEW = 4096, 4096


def percentiles(df: DataFrame, by: Sequence[str], col: str, shares: Sequence[float], exact: bool = True) -> DataFrame:
    """by, p: the percentiles of ``col`` in each group, between two values in proportion; nulls are left out.

    Exact ones are found by counting (see ``order_statistics``), so nothing is sorted; infinities and NaN (the
    largest) count as values. ``exact=False`` takes a KLL sketch of bounded size, see ``sketches``.
    """
    by = list(by)
    if not exact:
        return quantiles(sketches(df, by, col), by, shares)
    rows = stored(df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("__x")), "values")
    counts = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    at = F.array(*(F.lit(float(s)) for s in shares))
    spots = counts.select(*by, F.posexplode(F.transform(at, lambda s: s * (F.col("__n") - 1))).alias("__k", "__at"))
    ends = F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))
    wanted = stored(spots.select(*by, "__k", "__at", F.explode(ends).alias("__rank")), "wanted")
    found = order_statistics(rows, by, wanted.select(*by, "__rank").distinct())
    part = F.col("__at") - F.floor("__at")
    weight = F.when(F.col("__rank") == F.floor("__at"), 1 - part).otherwise(part)
    near = _met(wanted, found, [*by, "__rank"]).groupBy(*by, "__k").agg(F.sum(F.when(weight > 0, weight * F.col("__value")).otherwise(0.0)).alias("__p"))
    return near.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__p"))), lambda x: x["__p"]).alias("p"))


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with those of ``right`` by equal keys, null keys too."""
    right = right.withColumnsRenamed({k: f"__r{k}" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__r{k}"))
    return left.join(right, met).drop(*(f"__r{k}" for k in keys))


def order_statistics(rows: DataFrame, by: Sequence[str], wanted: DataFrame) -> DataFrame:
    """by, __rank, __value: of each group (by, __x) the values of the wanted ranks (from 0; -inf first, +inf and NaN last).

    The interval that holds a rank is cut into equal steps whose values are counted where they lie;
    the step that holds the rank is the next interval, until its values are equal or few. What is
    moved are counts, at most STEPS an interval, and few values; a group may hold any share of the rows.
    """
    by, x, inf = list(by), F.col("__x"), float("inf")
    sides = rows.groupBy(*by).agg(F.count_if(x == -inf).alias("__under"), F.count_if((x == inf) & ~F.isnan(x)).alias("__over"), F.count_if(F.isnan(x)).alias("__nan"), F.count("*").alias("__n"), F.min(F.when(F.abs(x) < inf, x)).alias("__lo"), F.max(F.when(F.abs(x) < inf, x)).alias("__hi"))
    at = _met(wanted, sides, by)
    outer = F.when(F.col("__rank") < F.col("__under"), -inf).when(F.col("__rank") >= F.col("__n") - F.col("__nan"), float("nan")).when(F.col("__rank") >= F.col("__n") - F.col("__nan") - F.col("__over"), inf)
    held = F.col("__n") - F.col("__nan") - F.col("__over") - F.col("__under")
    # __left: the rank inside the interval; __held: its values.
    open_ = stored(at.select(*by, "__rank", (F.col("__rank") - F.col("__under")).alias("__left"), held.alias("__held"), outer.alias("__outer"), "__lo", "__hi"), "ranks")
    done = [open_.where("__outer IS NOT NULL").select(*by, "__rank", F.col("__outer").alias("__value"))]
    open_ = open_.where("__outer IS NULL").drop("__outer")
    inside = (x >= F.col("__lo")) & (x <= F.col("__hi"))
    while True:
        done.append(open_.where("__lo = __hi").select(*by, "__rank", F.col("__lo").alias("__value")))
        wide = open_.where(f"__lo < __hi AND __held > {FEW}")
        if not wide.limit(1).count():
            break
        span = F.col("__hi") - F.col("__lo")
        share = F.when(span < inf, (x - F.col("__lo")) / span).otherwise((x / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2))
        step = F.least(F.floor(share * STEPS), F.lit(STEPS - 1)).alias("__step")
        intervals = wide.select(*by, "__lo", "__hi").distinct()
        counted = _met(rows, intervals, by).where(inside).groupBy(*by, "__lo", "__hi", step).agg(F.count("*").alias("__c"), F.min(x).alias("__a"), F.max(x).alias("__b"))
        before = F.sum("__c").over(Window.partitionBy(*by, "__lo", "__hi").orderBy("__step")) - F.col("__c")
        counted = counted.select(*by, "__lo", "__hi", "__c", "__a", "__b", before.alias("__before"))
        cut = _met(wide, counted, [*by, "__lo", "__hi"]).where("__left >= __before AND __left < __before + __c")
        cut = cut.select(*by, "__rank", (F.col("__left") - F.col("__before")).alias("__left"), F.col("__c").alias("__held"), F.col("__a").alias("__lo"), F.col("__b").alias("__hi"))
        open_ = stored(cut.union(open_.where(f"__lo < __hi AND __held <= {FEW}").select(*cut.columns)), "ranks")
    few = open_.where("__lo < __hi")
    lists = _met(rows, few.select(*by, "__lo", "__hi").distinct(), by).where(inside).groupBy(*by, "__lo", "__hi").agg(F.array_sort(F.collect_list("__x")).alias("__all"))
    last = _met(few, lists, [*by, "__lo", "__hi"]).select(*by, "__rank", F.get("__all", F.col("__left").cast("int")).alias("__value"))
    for d in done:
        last = last.union(d)
    return last


def sketches(df: DataFrame, by: Sequence[str], col: str, k: int = 4000) -> DataFrame:
    """by, sketch: a KLL sketch of each group's values, which can be kept and merged with those of more rows (``merged``)."""
    x = F.col(col).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(F.kll_sketch_agg_double(x, k).alias("sketch"))


def merged(parts: DataFrame, by: Sequence[str], k: int = 4000) -> DataFrame:
    """by, sketch: the sketches of coarser groups from those of finer ones, without the values."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(parts: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """by, p: values at those shares of each sketch."""
    return parts.select(*by, F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(float(s)) for s in shares))).alias("p"))


def rescale(df: DataFrame, by: Sequence[str], col: str, low: float = 0.02, high: float = 0.98, eps: float = 0.0, positive: bool = False, nodata: float | None = None, on_null: float | None = 0.0, exact: bool = True) -> Column | DataFrame:
    """``col`` clipped to two percentiles of its group and scaled to [0, 1].

    Nulls, NaN, the ``nodata`` value and (with ``positive``) values not above zero are
    left out of the percentiles and become ``on_null``. A range under 1e-9 gives zeros.
    The groups' percentiles are few and join back by the group.
    """
    x = F.col(col)
    fine = x.isNotNull() & ~F.isnan(x)
    if nodata is not None:
        fine &= x != nodata
    if positive:
        fine &= x > 0
    p = percentiles(df.where(fine), by, col, (low, high), exact).select(*by, F.col("p")[0].alias("__lo"), F.col("p")[1].alias("__hi"))
    lo, hi = F.col("__lo"), F.col("__hi")
    scaled = F.when(hi - lo < 1e-9, 0.0).otherwise(clip((F.least(F.greatest(x, lo), hi) - lo) / (hi - lo + eps)))
    out = F.when(fine, scaled).otherwise(F.lit(on_null).cast("double"))
    return df.join(p, list(by), "left").withColumn(col, out).drop("__lo", "__hi")


def minmax(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """``col`` less the group's minimum, over its range; a range under 1e-9 gives zeros. No group meets in one task."""
    edges = df.groupBy(*by).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    lo, hi = F.col("__lo"), F.col("__hi")
    return df.join(edges, list(by)).withColumn(col, F.when(hi - lo < 1e-9, 0.0).otherwise((F.col(col) - lo) / (hi - lo))).drop("__lo", "__hi")


def max_normalise(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """``col`` over the group's maximum, between 0 and 1."""
    top = df.groupBy(*by).agg(F.max(col).alias("__hi"))
    return df.join(top, list(by)).withColumn(col, clip(F.col(col) / F.col("__hi"))).drop("__hi")


def median_composite(df: DataFrame, by: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """The median of each band over the scenes of a group, cell by cell; nulls are skipped."""
    return df.groupBy(*by, "r", "c").agg(*(F.median(b).alias(b) for b in bands))


def statistics(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Extremes, mean, deviation and the 2nd and 98th percentile of each group."""
    out = df.groupBy(*by).agg(F.min(col).alias("low"), F.max(col).alias("high"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std")).join(percentiles(df, by, col, (0.02, 0.98)), list(by))
    return out.select(*by, "low", "high", "mean", "std", F.col("p")[0].alias("p2"), F.col("p")[1].alias("p98"))


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (0 ..), n: equal bins, the last one closed; values outside are left out."""
    b = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return df.where(F.col(col).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def binarise(df: DataFrame, prob: str, thresholds: Sequence[float], strict: bool = False) -> DataFrame:
    """One sparse mask for each threshold: the rows at or above it, with ``threshold`` and ``mask_name``."""
    t = F.explode(F.array(*map(F.lit, thresholds)))
    out = df.withColumn("threshold", t)
    hit = F.col(prob) > F.col("threshold") if strict else F.col(prob) >= F.col("threshold")
    return out.where(hit).withColumn("mask_name", F.concat(F.lit("thr"), F.lpad(F.floor(F.col("threshold") * 100 + 1e-9).cast("string"), 2, "0")))


def scene_pairs(scenes: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """t0, t1: consecutive scenes of a group."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    return scenes.select(*by, F.col(order).alias("t0"), F.lead(order).over(w).alias("t1")).where(F.col("t1").isNotNull())


def change(mask: DataFrame, pairs: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """by, t0, t1, r, c, gain, loss, stable: the cells in either mask of a pair.

    ``mask`` is sparse and is read once: a scene's cells are marked for the pair that it
    ends and the pair that it begins, and the two marks meet by the cell: one shuffle, with
    map-side aggregation, does the work of a full outer join. The pairs are written
    first, so that Spark knows their size and sends them to all tasks only if they are small.
    """
    pairs = stored(pairs, "pairs")
    roles = pairs.select(*by, F.col("t0").alias(order), "t0", "t1", F.lit(1).alias("m0"), F.lit(0).alias("m1")).union(pairs.select(*by, F.col("t1").alias(order), "t0", "t1", F.lit(0), F.lit(1)))
    both = mask.join(roles, [*by, order]).groupBy(*by, "t0", "t1", "r", "c").agg(F.max("m0").alias("m0"), F.max("m1").alias("m1"))
    m0, m1 = F.col("m0"), F.col("m1")
    return both.select(*by, "t0", "t1", "r", "c", (m1 * (1 - m0)).cast("long").alias("gain"), (m0 * (1 - m1)).cast("long").alias("loss"), (m0 * m1).cast("long").alias("stable"))


def change_summary(changed: DataFrame, by: Sequence[str], pixel_ha: float) -> DataFrame:
    """Cells and hectares gained, lost and kept by each pair, and the net change."""
    out = changed.groupBy(*by, "t0", "t1").agg(*(F.sum(k).alias(f"{k}_px") for k in ("gain", "loss", "stable")))
    ha = {f"{k}_ha": F.round(F.col(f"{k}_px") * F.lit(pixel_ha), 4) for k in ("gain", "loss", "stable")}
    return out.withColumns(ha | {"net_ha": F.round((F.col("gain_px") - F.col("loss_px")) * F.lit(pixel_ha), 4)})


def block_average(df: DataFrame, by: Sequence[str], col: str, factor: int) -> DataFrame:
    """The mean of ``factor`` x ``factor`` cells."""
    f = F.lit(factor)
    return df.groupBy(*by, F.floor(F.col("r") / f).alias("r"), F.floor(F.col("c") / f).alias("c")).agg(F.avg(col).alias(col))


def overviews(df: DataFrame, by: Sequence[str], col: str, factors: Sequence[int] = (2, 4, 8, 16)) -> DataFrame:
    """All levels of an average pyramid in one aggregation."""
    levels = df.withColumn("factor", F.explode(F.array(*(F.lit(f).cast("long") for f in factors))))
    return levels.groupBy(*by, "factor", F.floor(F.col("r") / F.col("factor")).alias("r"), F.floor(F.col("c") / F.col("factor")).alias("c")).agg(F.avg(col).alias(col))


def degree_window(bounds: Sequence[Column], origin: tuple[float, float], cell: tuple[float, float], shape: tuple[int, int]) -> dict[str, Column]:
    """Rows r0 <= r < r1 and columns c0 <= c < c1 of a raster in metres for a box of degrees (west, south, east, north), and the new origin x0, y0.

    Places are cut towards 0, kept inside the raster, and at least one cell wide and high.
    """
    west, south, east, north = map(to_metres, bounds)
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")

    def ends(low: Column, high: Column, n: int) -> tuple[Column, Column]:
        first = F.greatest(F.lit(0), F.least(whole(low), F.lit(n - 1))).cast("long")
        return first, F.greatest(first + 1, F.least(whole(high) + 1, F.lit(n))).cast("long")

    c0, c1 = ends((west - origin[0]) / cell[0], (east - origin[0]) / cell[0], shape[1])
    r0, r1 = ends((F.lit(origin[1]) - north) / cell[1], (F.lit(origin[1]) - south) / cell[1], shape[0])
    return {"r0": r0, "r1": r1, "c0": c0, "c1": c1, "x0": F.lit(origin[0]) + c0 * F.lit(cell[0]), "y0": F.lit(origin[1]) - r0 * F.lit(cell[1])}


def read_windows(df: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """key, r, c (in the window) and the other columns of ``df`` for the cells of each window. Windows are spread over their cells and meet by equal cell."""
    cells = windows.select(key, "r0", "c0", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("r"), "c1").select(key, "r0", "c0", "r", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("c"))
    return df.join(cells, ["r", "c"]).select(key, (F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), *(x for x in df.columns if x not in ("r", "c")))


def downsample(df: DataFrame, by: Sequence[str], col: str, side: int, longest: int) -> DataFrame:
    """Reduced resolution: at most ``longest`` cells a side by area average, at least 64 where the source has them."""
    out = min(side, max(64, int(side * min(1.0, longest / side)))) if side > longest else side
    target = lambda x: F.floor(F.col(x) * F.lit(out) / F.lit(side))
    return df.groupBy(*by, target("r").alias("r"), target("c").alias("c")).agg(F.avg(col).alias(col))
