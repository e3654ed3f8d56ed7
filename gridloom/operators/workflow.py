"""Steps of a mapping campaign, composed of the other operators: preprocessing, labels, scoring, thresholds, export."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.scalar import blend_weight
from gridloom.operators import focal, geometry, objects, pixels, reports
from gridloom.operators.flow import downstream, flow_next
from gridloom.sources.scratch import stored


def preprocess(scenes: DataFrame, by: Sequence[str], order: str, bands: Sequence[str], reach: int = 1) -> DataFrame:
    """by, r, c and the composite of each band over a group's scenes.

    Every scene is registered to the group's first one by the whole-cell shift, within
    ``reach``, that correlates best on the first band; a scene without a score keeps its
    place. Each scene is then rescaled to its 2nd and 98th percentile, and cells take the
    median over the scenes.
    """
    by = list(by)
    first = stored(scenes.groupBy(*by).agg(F.min(order).alias("__first")), "first")
    marked = scenes.join(first, by)
    fixed = marked.where(F.col(order) == F.col("__first")).select(*by, "r", "c", bands[0])
    moving = marked.where(F.col(order) != F.col("__first")).select(*by, order, "r", "c", bands[0])
    shifts = stored(geometry.best_shift(geometry.register_shift(fixed, moving, bands[0], reach, by, [order]), [*by, order]), "shifts")
    placed = scenes.join(shifts, [*by, order], "left")
    placed = placed.select(*by, order, *((F.col(x) + F.coalesce(f"d{x}", F.lit(0))).alias(x) for x in "rc"), *bands)
    for band in bands:
        placed = pixels.rescale(placed, [*by, order], band)
    return pixels.median_composite(placed, by, bands)


def labels(dem: DataFrame, col: str, shape: tuple[int, int], cell: float, target: tuple[int, int], slope: float = 15.0, facing: tuple[float, float] = (135.0, 315.0), radius: int = 2, length: int = 0, width: int = 3) -> DataFrame:
    """r, c: a mask on the ``target`` grid of the steep cells that face between two azimuths, each with a disc round it and the channel that runs from it.

    A channel follows the azimuth of each cell it comes to for ``length`` cells (0: no channels) and is ``width`` wide.
    """
    terrain = focal.focal(dem, [], col, shape, 1, focal.slope_aspect(cell), ["slope", "aspect"])
    if length:
        terrain = stored(terrain, "terrain")
    steep = terrain.where((F.col("slope") > slope) & (F.col("aspect") > facing[0]) & (F.col("aspect") < facing[1]))
    drawn = geometry.draw_discs(steep.select((F.col("r") * shape[1] + F.col("c")).alias("id"), "r", "c"), shape, radius).select("r", "c")
    if length:
        drawn = drawn.union(focal.dilate(downstream(steep, flow_next(terrain, shape), length), [], shape, width // 2))
    on_target = geometry.nearest(drawn.distinct().withColumn("on", F.lit(1)), [], "on", geometry.zoom_targets(dem.sparkSession, shape, target))
    return on_target.where(F.col("on") == 1).select(F.col("tr").alias("r"), F.col("tc").alias("c"))


def score_scenes(df: DataFrame, by: Sequence[str], col: str, shape: tuple[int, int], size: int, stride: int, model: Callable[[np.ndarray], np.ndarray], method: str = "hanning") -> DataFrame:
    """by, r, c, prob for every cell: overlapping tiles scored by the model and blended.

    The model gets one tile (a square, NaN where there is no cell) and returns a
    probability for each of its cells. Weighted sums of a cell's tiles are added up by
    Spark, so a task holds one tile.
    """
    by = list(by)
    tiles = df.select(*by, F.explode(geometry.starts_over(F.col("r"), shape[0], size, stride)).alias("r0"), "r", "c", F.col(col).cast("double").alias("z"))
    tiles = tiles.select(*by, "r0", F.explode(geometry.starts_over(F.col("c"), shape[1], size, stride)).alias("c0"), "r", "c", "z")
    schema = T.StructType([*(df.schema[b] for b in by), *(T.StructField(n, T.LongType()) for n in ("r", "c", "i", "j")), T.StructField("p", T.DoubleType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        i, j = (part["r"] - part["r0"]).to_numpy(), (part["c"] - part["c0"]).to_numpy()
        tile = np.full((size, size), np.nan)
        tile[i, j] = part["z"]
        return part[[*by, "r", "c"]].assign(i=i, j=j, p=model(tile)[i, j])

    scored = tiles.groupBy(*by, "r0", "c0").applyInPandas(run, schema).withColumn("w", blend_weight(method, F.col("i"), F.col("j"), size))
    return scored.groupBy(*by, "r", "c").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("prob"))


def threshold(probabilities: DataFrame, by: Sequence[str], shape: tuple[int, int], at: Sequence[float], min_pixels: int, closing: int = 2, eight: bool = True, tile: int = 256) -> DataFrame:
    """by, threshold, r, c: masks at several thresholds, without small components, then closed."""
    keys = [*by, "threshold"]
    masks = pixels.binarise(probabilities, "prob", at).select(*keys, "r", "c")
    big = objects.remove_small(stored(objects.components(masks, keys, shape[1], eight, tile), "cells"), keys, min_pixels)
    return focal.close(big.select(*keys, "r", "c"), keys, shape, closing) if closing else big.select(*keys, "r", "c")


def export(path: str, by: Sequence[str], masks: DataFrame, probabilities: DataFrame, outlines: DataFrame, summary: DataFrame, metrics: DataFrame) -> Mapping[str, DataFrame]:
    """Writes a campaign's results and returns each artefact as it reads back.

    Masks and probabilities are Parquet in folders of their scenes, with a pyramid of the
    probabilities; outlines are GeoJSON features, one a line; the summary is CSV with a
    header; metrics are JSON, one object a line. ``outlines`` has a ``feature`` column.
    """
    spark = masks.sparkSession
    reports.write_pixels(masks, f"{path}/masks", by)
    reports.write_pixels(probabilities, f"{path}/probabilities", by)
    pixels.overviews(probabilities, by, "prob").write.mode("overwrite").parquet(f"{path}/overviews")
    reports.write_lines(outlines, "feature", f"{path}/outlines")
    reports.write_report(summary, f"{path}/summary")
    reports.write_json(metrics, f"{path}/metrics")
    return {
        "masks": spark.read.parquet(f"{path}/masks"),
        "probabilities": spark.read.parquet(f"{path}/probabilities"),
        "overviews": spark.read.parquet(f"{path}/overviews"),
        "outlines": spark.read.text(f"{path}/outlines"),
        "summary": spark.read.schema(summary.schema).option("header", True).csv(f"{path}/summary"),
        "metrics": spark.read.schema(metrics.schema).json(f"{path}/metrics"),
    }
