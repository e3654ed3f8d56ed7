"""Queries on scores and targets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.operators import evaluation as E
from gridloom.operators.distance import class_distance
from gridloom.registry import query
from gridloom.sources.scratch import shared_dir

D = "CAST({} AS DOUBLE)".format


def rounded(df, *keep):
    return df.select(*keep, *(F.round(x, 6).alias(x) for x, t in df.dtypes if t == "double" and x not in keep), *(x for x, t in df.dtypes if t != "double" and x not in keep))


_RATES = "round((tp + 1e-6) / (tp + fp + fn + 1e-6), 6) AS iou, round((2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), 6) AS f1, round((tp + 1e-6) / (tp + fp + 1e-6), 6) AS precision, round((tp + 1e-6) / (tp + fn + 1e-6), 6) AS recall, round((tp + tn + 1e-6) / (tp + fp + fn + tn + 1e-6), 6) AS accuracy"
_COUNTS = "count(*) FILTER (prob >= {t} AND target > 0) AS tp, count(*) FILTER (prob >= {t} AND target = 0) AS fp, count(*) FILTER (prob < {t} AND target > 0) AS fn, count(*) FILTER (prob < {t} AND target = 0) AS tn"


@query(f"WITH k AS (SELECT fold, {_COUNTS.format(t=0.5)} FROM {{scored}} GROUP BY fold) SELECT fold, tp, fp, fn, tn, {_RATES}, tp + fn AS support FROM k")
def pixel_metrics(v):
    return rounded(E.metrics(E.confusion(v.scored, ["fold"], "prob", "target", 0.5)), "fold")


@query(f"WITH k AS (SELECT fold, {_COUNTS.format(t=0.5)} FROM {{scored}} GROUP BY fold) SELECT fold, tp, fp, fn, tn, {_RATES}, tp + fn AS support FROM k")
def metrics_json(v):
    """The same as JSON documents that were written and read again."""
    from gridloom.operators.reports import write_json

    m = E.metrics(E.confusion(v.scored, ["fold"], "prob", "target", 0.5))
    path = f"{shared_dir(v.spark)}/metrics-{uuid.uuid4().hex}"
    write_json(m, path)
    return rounded(v.spark.read.schema(m.schema).json(path), "fold")


@query(f"SELECT {_COUNTS.format(t=0.5)} FROM {{scored}}")
def confusion_matrix(v):
    return E.confusion(v.scored, [], "prob", "target", 0.5)


_NINE = ", ".join(f"({D(t / 10)})" for t in range(1, 10))
_SWEEP = f"th(threshold) AS (VALUES {_NINE}), k AS (SELECT threshold, {_COUNTS.format(t='threshold')} FROM {{scored}}, th GROUP BY 1)"


def swept(v):
    return E.sweep(v.scored, [], "prob", "target", [t / 10 for t in range(1, 10)])


@query(f"WITH {_SWEEP} SELECT threshold, tp, fp, fn, tn, {_RATES}, tp + fn AS support FROM k")
def threshold_sweep(v):
    return rounded(swept(v), "threshold")


@query(f"WITH {_SWEEP}, m AS (SELECT threshold, (2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6) AS f1 FROM k) SELECT threshold, round(f1, 6) AS f1 FROM m ORDER BY round(f1, 12) DESC, threshold LIMIT 1")
def best_threshold(v):
    return E.best_threshold(swept(v), []).withColumn("f1", F.round("f1", 6))


_EVEN = ", ".join(f"({k}, {D(repr(t))})" for k, t in enumerate(E.even(50)))
_CUM = f"th(k, threshold) AS (VALUES {_EVEN}), q AS (SELECT k, threshold, count(*) FILTER (prob >= threshold AND target > 0) AS tp, count(*) FILTER (prob >= threshold AND target = 0) AS fp, count(*) FILTER (target > 0) AS pos, count(*) FILTER (target = 0) AS neg FROM {{scored}}, th GROUP BY 1, 2), rc AS (SELECT *, tp / (pos + 1e-6) AS tpr, fp / (neg + 1e-6) AS fpr, (tp + 1e-6) / (tp + fp + 1e-6) AS precision, (tp + 1e-6) / (pos + 1e-6) AS recall FROM q)"


@query(f"WITH {_CUM} SELECT k, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM rc")
def roc_curve(v):
    return rounded(E.roc(v.scored, [], "prob", "target"))


@query(f"WITH {_CUM}, a AS (SELECT (fpr - lag(fpr) OVER (ORDER BY k DESC)) * (tpr + lag(tpr) OVER (ORDER BY k DESC)) / 2 AS x FROM rc) SELECT round(abs(sum(x)), 6) AS auc FROM a")
def roc_auc(v):
    return E.trapezoid(E.roc(v.scored, [], "prob", "target"), [], "fpr", "tpr", "auc").withColumn("auc", F.round("auc", 6))


@query(f"WITH {_CUM} SELECT k, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM rc")
def pr_curve(v):
    return rounded(E.pr(v.scored, [], "prob", "target"))


@query(f"WITH {_CUM}, a AS (SELECT (recall - lag(recall) OVER (ORDER BY k DESC)) * (precision + lag(precision) OVER (ORDER BY k DESC)) / 2 AS x FROM rc) SELECT round(abs(sum(x)), 6) AS ap FROM a")
def average_precision(v):
    return E.trapezoid(E.pr(v.scored, [], "prob", "target"), [], "recall", "precision", "ap").withColumn("ap", F.round("ap", 6))


@query(f"WITH k AS (SELECT site, scene, {_COUNTS.format(t=0.5)} FROM {{px}} GROUP BY 1, 2), m AS (SELECT {_RATES.replace('round(', '(').replace(', 6)', ')')} FROM k) SELECT round(avg(iou), 6) AS iou, round(avg(f1), 6) AS f1 FROM m")
def batch_iou_f1(v):
    m = E.metrics(E.confusion(v.px, ["site", "scene"], "prob", "target", 0.5))
    return m.agg(F.round(F.avg("iou"), 6).alias("iou"), F.round(F.avg("f1"), 6).alias("f1"))


_FOLDS = f"k AS (SELECT fold, {_COUNTS.format(t=0.5)} FROM {{scored}} GROUP BY fold), m AS (SELECT {_RATES.replace('round(', '(').replace(', 6)', ')')} FROM k), u AS (UNPIVOT m ON iou, f1, precision, recall, accuracy INTO NAME metric VALUE x)"


@query(f"WITH {_FOLDS} SELECT metric, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high FROM u GROUP BY metric")
def fold_aggregate(v):
    return rounded(E.aggregate_folds(E.metrics(E.confusion(v.scored, ["fold"], "prob", "target", 0.5))))


@query(f"WITH k AS (SELECT fold = 0 AS test, {_COUNTS.format(t=0.5)} FROM {{scored}} GROUP BY 1), m AS (SELECT test, (tp + 1e-6) / (tp + fp + fn + 1e-6) AS iou, (2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6) AS f1 FROM k) SELECT round(max(iou) FILTER (NOT test) - max(iou) FILTER (test), 4) AS iou_gap, round(max(f1) FILTER (NOT test) - max(f1) FILTER (test), 4) AS f1_gap FROM m")
def generalisation_gap(v):
    m = E.metrics(E.confusion(v.scored.withColumn("test", F.col("fold") == 0), ["test"], "prob", "target", 0.5))
    gap = lambda x: F.round(F.max(F.when(~F.col("test"), F.col(x))) - F.max(F.when(F.col("test"), F.col(x))), 4)
    return m.agg(gap("iou").alias("iou_gap"), gap("f1").alias("f1_gap"))


_LOGIT = "lg AS (SELECT site, scene, prob * 8 - 4 AS x, CAST(target AS DOUBLE) AS t FROM {px}), ce AS (SELECT *, -(t * (least(x, 0) - ln(1 + exp(-abs(x)))) + (1 - t) * (least(-x, 0) - ln(1 + exp(-abs(x))))) AS b, 1 / (1 + exp(-x)) AS p FROM lg)"
_FOCAL = "avg((0.8 * t + 0.2 * (1 - t)) * power(1 - exp(-b), 2) * b)"
_DICE = "di AS (SELECT 1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1) AS dice, 1 - (sum(p * t) + 1) / (sum(p * t) + 0.3 * (sum(p) - sum(p * t)) + 0.7 * (sum(t) - sum(p * t)) + 1) AS tversky FROM ce GROUP BY site, scene)"


def logits(v):
    return v.px.select("site", "scene", "r", "c", (F.col("prob") * 8 - 4).alias("x"), F.col("target").cast("double").alias("t"))


@query(f"WITH {_LOGIT} SELECT round({_FOCAL}, 6) AS focal FROM ce")
def loss_focal(v):
    return logits(v).agg(F.round(F.avg(E.focal_loss(F.col("x"), F.col("t"))), 6).alias("focal"))


@query(f"WITH {_LOGIT}, {_DICE} SELECT round(avg(dice), 6) AS dice FROM di")
def loss_dice(v):
    return E.overlap_losses(logits(v), ["site", "scene"], "x", "t").agg(F.round(F.avg("dice"), 6).alias("dice"))


@query(f"WITH {_LOGIT}, {_DICE} SELECT round(avg(tversky), 6) AS tversky FROM di")
def loss_tversky(v):
    return E.overlap_losses(logits(v), ["site", "scene"], "x", "t").agg(F.round(F.avg("tversky"), 6).alias("tversky"))


@query(f"WITH {_LOGIT}, {_DICE} SELECT round(0.5 * (SELECT {_FOCAL} FROM ce) + 0.5 * (SELECT avg(dice) FROM di), 6) AS combined")
def loss_combined(v):
    x = logits(v)
    dice = E.overlap_losses(x, ["site", "scene"], "x", "t").agg(F.avg("dice").alias("d"))
    one = x.agg(F.avg(E.focal_loss(F.col("x"), F.col("t"))).alias("f")).crossJoin(dice)  # one row each
    return one.select(F.round(0.5 * F.col("f") + 0.5 * F.col("d"), 6).alias("combined"))


@query(f"""WITH {_LOGIT.replace('SELECT site, scene, prob', 'SELECT site, scene, r, c, prob')}, o3(d) AS (VALUES (-1), (0), (1)),
  ed AS (SELECT DISTINCT a.site, a.scene, a.r, a.c FROM lg a, o3 i, o3 j, lg b WHERE b.site = a.site AND b.scene = a.scene AND b.r = a.r + i.d AND b.c = a.c + j.d AND b.t <> a.t)
  SELECT round(sum(CASE WHEN ed.r IS NULL THEN 1 ELSE 2 END * b) / count(*), 6) AS boundary FROM ce LEFT JOIN ed USING (site, scene, r, c)""")
def loss_boundary(v):
    """Pixels that touch one of the other class count twice."""
    near = class_distance(logits(v).select("site", "scene", "r", "c", "t"), ["site", "scene"], "t").where("d2 <= 2")
    x = logits(v).join(near.select("site", "scene", "r", "c", "d2"), ["site", "scene", "r", "c"], "left")
    w = F.when(F.col("d2").isNotNull(), 2.0).otherwise(1.0)
    return x.agg(F.round(F.sum(w * E.bce(F.col("x"), F.col("t"))) / F.count("*"), 6).alias("boundary"))


@query(f"WITH k AS (SELECT fold, {_COUNTS.format(t=0.5)} FROM {{scored}} GROUP BY fold), {_CUM.replace('SELECT k, threshold, count', 'SELECT fold, k, threshold, count').replace('GROUP BY 1, 2)', 'GROUP BY 1, 2, 3)')}, a AS (SELECT fold, (fpr - lag(fpr) OVER (PARTITION BY fold ORDER BY k DESC)) * (tpr + lag(tpr) OVER (PARTITION BY fold ORDER BY k DESC)) / 2 AS x FROM rc), b AS (SELECT fold, round(abs(sum(x)), 6) AS auc FROM a GROUP BY fold) SELECT fold, tp, fp, fn, tn, {_RATES}, auc FROM k JOIN b USING (fold)".replace("th(k, threshold)", "th(k, threshold)").replace(", q AS (SELECT fold, k,", ", q AS (SELECT fold, th.k,"))
def spatial_cv(v):
    m = E.metrics(E.confusion(v.scored, ["fold"], "prob", "target", 0.5)).drop("support")
    return rounded(m.join(E.trapezoid(E.roc(v.scored, ["fold"], "prob", "target"), ["fold"], "fpr", "tpr", "auc"), "fold"), "fold")


@query(f"WITH k AS (SELECT CASE WHEN scene <= 1995 THEN 'train' ELSE 'test' END AS split, {_COUNTS.format(t=0.5)} FROM {{px}} WHERE scene <> 1996 GROUP BY 1) SELECT split, tp, fp, fn, tn, {_RATES}, tp + fn AS support FROM k")
def temporal_holdout(v):
    x = v.px.where("scene <> 1996").withColumn("split", F.when(F.col("scene") <= 1995, "train").otherwise("test"))
    return rounded(E.metrics(E.confusion(x, ["split"], "prob", "target", 0.5)), "split")


_GOALS = {"iou": 0.65, "f1": 0.75, "precision": 0.70, "recall": 0.72}


@query(f"WITH {_FOLDS}, g(metric, goal) AS (VALUES {', '.join(f'({k!r}, {D(x)})' for k, x in _GOALS.items())}) SELECT metric, goal, round(avg(x), 6) AS mean, avg(x) >= goal AS reached FROM u JOIN g USING (metric) GROUP BY 1, 2")
def target_check(v):
    goals = v.spark.createDataFrame(list(_GOALS.items()), "metric string, goal double")
    m = E.aggregate_folds(E.metrics(E.confusion(v.scored, ["fold"], "prob", "target", 0.5)))
    return m.join(F.broadcast(goals), "metric").select("metric", "goal", F.round("mean", 6).alias("mean"), (F.col("mean") >= F.col("goal")).alias("reached"))


_LINEAR = "SELECT vec_id, round(1 / (1 + exp(-(list_sum(list_transform(list_zip(embedding, range(64)), lambda p: CAST(p[1] AS DOUBLE) * (CAST(p[2] AS DOUBLE) / 64 - 0.5)))))), 6) AS prob FROM embeddings"


@query(_LINEAR)
def score_linear(v):
    w = F.array(*(F.lit(i / 64 - 0.5) for i in range(64)))
    dot = F.aggregate(F.zip_with(F.col("embedding"), w, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return v.embeddings.select("vec_id", F.round(F.lit(1.0) / (1 + F.exp(-dot)), 6).alias("prob"))


@query(_LINEAR)
def score_tiles(v):
    """The same score by a model that works on batches of tiles."""
    import numpy as np

    from gridloom.operators.scoring import score_tiles as run

    return run(v.embeddings, lambda x: 1 / (1 + np.exp(-(x @ (np.arange(64) / 64 - 0.5))))).withColumn("prob", F.round("prob", 6))


@query()
def fit_pixel_classifier(v):
    from gridloom.operators.scoring import fit_classifier

    model = fit_classifier(v.px, ["red", "blue", "nir", "prob"], "target")
    return model.transform(v.px).groupBy("target", F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))
