"""Accuracy of scores: counts, curves, losses, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6
METRICS = ("iou", "f1", "precision", "recall", "accuracy")


def confusion(df: DataFrame, by: Sequence[str], prob: str, target: str, threshold: float, strict: bool = False) -> DataFrame:
    """tp, fp, fn, tn for each group, in one pass."""
    yes = F.col(prob) > threshold if strict else F.col(prob) >= threshold
    t = F.col(target) > 0
    return df.groupBy(*by).agg(F.count_if(yes & t).alias("tp"), F.count_if(yes & ~t).alias("fp"), F.count_if(~yes & t).alias("fn"), F.count_if(~yes & ~t).alias("tn"))


def metrics(counts: DataFrame) -> DataFrame:
    """The rates of a confusion table, with a small constant on both sides of each fraction."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    over = lambda a, b: (a + EPS) / (b + EPS)
    return counts.withColumns({"iou": over(tp, tp + fp + fn), "f1": over(2 * tp, 2 * tp + fp + fn), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "accuracy": over(tp + tn, tp + fp + fn + tn), "support": F.col("tp") + F.col("fn")})


def cumulative(df: DataFrame, by: Sequence[str], prob: str, target: str, thresholds: Sequence[float]) -> DataFrame:
    """by, k, threshold, tp, fp, positives, negatives: counts of scores at or above each threshold.

    Scores are binned once by the thresholds (the same comparisons for all), and the
    few bins are summed from the top, so any number of thresholds costs one scan.
    """
    marks = F.array(*map(F.lit, sorted(thresholds)))
    bin_of = F.size(F.filter(marks, lambda t: t <= F.col(prob))) - 1
    t = F.when(F.col(target) > 0, 1).otherwise(0)
    binned = df.groupBy(*by, bin_of.alias("k")).agg(F.sum(t).alias("p"), F.sum(1 - t).alias("n"))
    grid = binned.select(*by).distinct().select(*by, F.posexplode(marks).alias("k", "threshold"))
    total = binned.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    w = Window.partitionBy(*by).orderBy(F.desc("k")) if by else Window.orderBy(F.desc("k"))
    join = lambda a, b, on, how="inner": a.join(b, on, how) if on else a.crossJoin(F.broadcast(b))  # noqa: E731  b is one row without groups
    full = join(grid.join(binned, [*by, "k"], "left"), total, list(by))
    return full.select(*by, "k", "threshold", F.sum(F.coalesce("p", F.lit(0))).over(w).alias("tp"), F.sum(F.coalesce("n", F.lit(0))).over(w).alias("fp"), "positives", "negatives")


def sweep(df: DataFrame, by: Sequence[str], prob: str, target: str, thresholds: Sequence[float]) -> DataFrame:
    """All metrics at each threshold."""
    c = cumulative(df, by, prob, target, thresholds)
    return metrics(c.select(*by, "threshold", "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn"), (F.col("negatives") - F.col("fp")).alias("tn")))


def best_threshold(swept: DataFrame, by: Sequence[str]) -> DataFrame:
    """The threshold with the largest F1, the smallest of equals."""
    return swept.groupBy(*by).agg(F.max_by("threshold", F.struct(F.round("f1", 12), -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def even(n: int) -> list[float]:
    return [k / (n - 1) for k in range(n)]


def roc(df: DataFrame, by: Sequence[str], prob: str, target: str, n: int = 50) -> DataFrame:
    c = cumulative(df, by, prob, target, even(n))
    return c.select(*by, "k", "threshold", (F.col("tp") / (F.col("positives") + EPS)).alias("tpr"), (F.col("fp") / (F.col("negatives") + EPS)).alias("fpr"))


def pr(df: DataFrame, by: Sequence[str], prob: str, target: str, n: int = 50) -> DataFrame:
    c = cumulative(df, by, prob, target, even(n))
    return c.select(*by, "k", "threshold", ((F.col("tp") + EPS) / (F.col("tp") + F.col("fp") + EPS)).alias("precision"), ((F.col("tp") + EPS) / (F.col("positives") + EPS)).alias("recall"))


def trapezoid(curve: DataFrame, by: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    """The area under y over x, along falling thresholds."""
    w = Window.partitionBy(*by).orderBy(F.desc("k")) if by else Window.orderBy(F.desc("k"))
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return curve.select(*by, part.alias("__part")).groupBy(*by).agg(F.abs(F.sum("__part")).alias(name))


def aggregate_folds(folds: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """metric, mean, std, low, high over the rows of a table of folds."""
    long = folds.unpivot([], [F.col(n).cast("double").alias(n) for n in names], "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))


def log_sigmoid(x: Column) -> Column:
    """log(1 / (1 + exp(-x))) without overflow."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def bce(logit: Column, target: Column) -> Column:
    return -(target * log_sigmoid(logit) + (1 - target) * log_sigmoid(-logit))


def focal_loss(logit: Column, target: Column, alpha: float = 0.8, gamma: float = 2.0) -> Column:
    """Cross-entropy weighted down where the score is already right."""
    ce = bce(logit, target)
    weight = F.lit(alpha) * target + F.lit(1 - alpha) * (1 - target)
    return weight * F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce


def overlap_losses(df: DataFrame, by: Sequence[str], logit: str, target: str, smooth: float = 1.0, fp_weight: float = 0.3, fn_weight: float = 0.7) -> DataFrame:
    """dice and tversky losses of each image."""
    p, t = F.lit(1.0) / (1 + F.exp(-F.col(logit))), F.col(target).cast("double")
    sums = df.groupBy(*by).agg(F.sum(p * t).alias("i"), F.sum(p).alias("p"), F.sum(t).alias("t"))
    i, ps, ts = F.col("i"), F.col("p"), F.col("t")
    return sums.select(*by, (1 - (2 * i + smooth) / (ps + ts + smooth)).alias("dice"), (1 - (i + smooth) / (i + fp_weight * (ps - i) + fn_weight * (ts - i) + smooth)).alias("tversky"))
