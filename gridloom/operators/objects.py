"""Objects in masks: connected components, matching over time, tracks, outlines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.ordering import numbered, running
from gridloom.operators.ranking import ring_places
from gridloom.sources.scratch import stored


def _label(cells: np.ndarray, ids: np.ndarray, eight: bool) -> np.ndarray:
    """For foreground cells of a tile the smallest id of the cells each is connected with.

    Trees of cells are hung under the smallest neighbouring tree and flattened, all at
    once, so the rounds follow the logarithm of the longest way and not its length.
    """
    order = np.argsort(ids)
    r, c = (cells[order, k] - cells[:, k].min() + 1 for k in (0, 1))
    grid = np.full((r.max() + 2, c.max() + 2), -1)
    grid[r, c] = np.arange(len(order))
    ends = []
    for i, j in [(0, 1), (1, 0), (1, 1), (1, -1)] if eight else [(0, 1), (1, 0)]:
        near = grid[r + i, c + j]
        have = np.flatnonzero(near >= 0)
        ends.append((have, near[have]))
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    top = np.arange(len(order))
    while True:
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(top, high[apart], low[apart])
        while (top[top] != top).any():
            top = top[top]
    out = np.empty(len(order), np.int64)
    out[order] = np.asarray(ids)[order][top]
    return out


def components(mask: DataFrame, by: Sequence[str], width: int, eight: bool = True, tile: int = 256) -> DataFrame:
    """by, r, c, comp: foreground cells with the smallest linear index (r * width + c) of their component.

    Tiles are labelled for themselves; then labels that touch across a border are one
    graph, solved by passing on the smallest label and jumping over known ones, so the
    number of rounds follows the logarithm of the longest chain of tiles. A round is
    written to shared storage. No task holds more than a tile.
    """
    by = list(by)
    schema = T.StructType([*(mask.schema[b] for b in by), T.StructField("r", T.LongType()), T.StructField("c", T.LongType()), T.StructField("part", T.LongType())])

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        out = cells[[*by, "r", "c"]].copy()
        out["part"] = _label(out[["r", "c"]].to_numpy(), (out["r"] * width + out["c"]).to_numpy(np.int64), eight)
        return out

    tiles = mask.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"))
    local = stored(tiles.groupBy(*by, "tr", "tc").applyInPandas(run, schema), "local")

    edge = (F.pmod("r", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("c", F.lit(tile)).isin(0, tile - 1))
    border = local.where(edge)
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if eight else [(0, 1), (1, 0)]
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    moved = border.select(*by, "r", "c", "part", shift.alias("o")).select(*by, (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), F.col("part").alias("a"))
    links = moved.join(border.withColumnRenamed("part", "b"), [*by, "r", "c"]).where("a <> b").select(*by, "a", "b").distinct()
    links = stored(links.union(links.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = stored(links.select(*by, F.col("a").alias("part")).distinct().withColumn("root", F.col("part")), "roots")
    while True:
        near = links.join(roots.select(*by, F.col("part").alias("b"), F.col("root").alias("nr")), [*by, "b"]).groupBy(*by, F.col("a").alias("part")).agg(F.min("nr").alias("nr"))
        step = roots.join(near, [*by, "part"], "left").withColumn("new", F.least("root", F.coalesce("nr", "root")))
        jump = step.select(*by, F.col("part").alias("new"), F.col("new").alias("beyond"))
        out = stored(step.join(jump, [*by, "new"], "left").select(*by, "part", F.least("new", F.coalesce("beyond", "new")).alias("next"), "root"), "roots")
        moved_on = out.where("next <> root").limit(1).count()
        roots = out.select(*by, "part", F.col("next").alias("root"))
        if not moved_on:
            break
    return local.join(roots, [*by, "part"], "left").select(*by, "r", "c", F.coalesce("root", "part").alias("comp"))


def component_stats(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Size, centroid and bounding box of each component."""
    return cells.groupBy(*by, "comp").agg(F.count("*").alias("area_px"), F.avg("r").alias("row"), F.avg("c").alias("col"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def remove_small(cells: DataFrame, by: Sequence[str], min_pixels: int) -> DataFrame:
    """Cells of components with at least ``min_pixels`` cells."""
    big = cells.groupBy(*by, "comp").count().where(F.col("count") >= min_pixels).drop("count")
    return cells.join(big, [*by, "comp"], "left_semi")


def elongated(cells: DataFrame, by: Sequence[str], at_least: float, min_pixels: int = 10) -> DataFrame:
    """Cells of components whose box is that much longer than wide."""
    h, w = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    fine = component_stats(cells, by).where((F.col("area_px") >= min_pixels) & (F.greatest(h, w) / (F.least(h, w) + 1) >= at_least))
    return cells.join(fine.select(*by, "comp"), [*by, "comp"], "left_semi")


def match(cells: DataFrame, pairs: DataFrame, by: Sequence[str], order: str, threshold: float, one_to_one: bool = False) -> DataFrame:
    """For each component of a later scene the component before it that it overlaps most.

    by, t0, t1, comp, prev, iou: only matches of at least ``threshold``; ties go to the
    smaller prev. Components meet through the cells they share. ``one_to_one`` leaves a
    previous component to the current one with the larger overlap.
    """
    by = list(by)
    area = cells.groupBy(*by, order, "comp").agg(F.count("*").alias("area"))
    now = cells.join(pairs.withColumn(order, F.col("t1")), [*by, order]).select(*by, "t0", "t1", "r", "c", "comp")
    then = cells.join(pairs.withColumn(order, F.col("t0")), [*by, order]).select(*by, "t0", "t1", "r", "c", F.col("comp").alias("prev"))
    both = now.join(then, [*by, "t0", "t1", "r", "c"]).groupBy(*by, "t0", "t1", "comp", "prev").agg(F.count("*").alias("inter"))
    both = both.join(area.select(*by, F.col(order).alias("t1"), "comp", F.col("area").alias("a")), [*by, "t1", "comp"]).join(area.select(*by, F.col(order).alias("t0"), F.col("comp").alias("prev"), F.col("area").alias("b")), [*by, "t0", "prev"])
    both = both.withColumn("iou", F.col("inter") / (F.col("a") + F.col("b") - F.col("inter")))
    w = Window.partitionBy(*by, "t1", "comp").orderBy(F.desc("iou"), F.asc("prev"))
    best = both.withColumn("n", F.row_number().over(w)).where((F.col("n") == 1) & (F.col("iou") >= threshold))
    if one_to_one:
        w = Window.partitionBy(*by, "t0", "prev").orderBy(F.desc("iou"), F.asc("comp"))
        best = best.withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select(*by, "t0", "t1", "comp", "prev", "iou")


def tracks(nodes: DataFrame, matches: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """by, scene, comp, first_scene, first_comp, track: the chain of matches that each component is in.

    Every component has at most one parent, so chains are a forest; each round makes a
    component point to its parent's parent, and half the longest chain is gone.
    """
    by = list(by)
    up = matches.select(*by, F.col("t1").alias(order), "comp", F.col("t0").alias("ps"), F.col("prev").alias("pc"))
    at = nodes.select(*by, order, "comp").join(up, [*by, order, "comp"], "left")
    at = stored(at.select(*by, order, "comp", F.coalesce("ps", order).alias("fs"), F.coalesce("pc", "comp").alias("fc")), "tracks")
    while True:
        beyond = at.select(*by, F.col(order).alias("fs"), F.col("comp").alias("fc"), F.col("fs").alias("ns"), F.col("fc").alias("nc"))
        out = stored(at.join(beyond, [*by, "fs", "fc"]).select(*by, order, "comp", F.col("ns").alias("fs"), F.col("nc").alias("fc"), ((F.col("ns") != F.col("fs")) | (F.col("nc") != F.col("fc"))).alias("moved")), "tracks")
        again = out.where("moved").limit(1).count()
        at = out.drop("moved")
        if not again:
            break
    number = numbered(at.select(*by, "fs", "fc").distinct(), by, ["fs", "fc"], "track").drop("track_total")
    return at.join(number, [*by, "fs", "fc"]).select(*by, order, "comp", F.col("fs").alias("first_scene"), F.col("fc").alias("first_comp"), "track")


def polygon_edges(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unit edges (x0, y0, x1, y1) between a component and what is not of it, with the component on the right."""
    by = list(by)
    sides = [(-1, 0, 0, 0, 1, 0), (0, 1, 1, 0, 1, 1), (1, 0, 1, 1, 0, 1), (0, -1, 0, 1, 0, 0)]
    names = ("dr", "dc", "x0", "y0", "x1", "y1")
    each = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(s, names, strict=True))) for s in sides)))
    asked = cells.select(*by, "comp", "r", "c", each.alias("__s")).select(*by, "comp", (F.col("r") + F.col("__s.dr")).alias("nr"), (F.col("c") + F.col("__s.dc")).alias("nc"), *((F.col(a) + F.col(f"__s.{n}")).alias(n) for a, n in (("c", "x0"), ("r", "y0"), ("c", "x1"), ("r", "y1"))))
    own = cells.select(*by, "comp", F.col("r").alias("nr"), F.col("c").alias("nc"))
    return asked.join(own, [*by, "comp", "nr", "nc"], "left_anti").select(*by, "comp", "x0", "y0", "x1", "y1")


def ring_points(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, comp, ring, place, x, y: the corners of each component's closed rings in order, without the first one again at the end.

    A ring begins at its first corner (smallest y, then x); a component's rings are numbered by
    that, from 0. Where two corners touch, a ring turns right and stays with the same
    cell. Every edge names the next one and rings are ranked as linked lists, so
    a ring of any length is spread over tasks.
    """
    by = [*by, "comp"]
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    numbers = running(edges, [], [*by, "y0", "x0", "y1", "x1"], {"id": F.lit(1)})
    outs = F.collect_list(F.struct("id", dx.alias("dx"), dy.alias("dy")))  # of a corner: two at most
    corners = numbers.groupBy(*by, F.col("x0").alias("x1"), F.col("y0").alias("y1")).agg(outs.alias("outs"))
    right = F.filter("outs", lambda o: (o["dx"] == -dy) & (o["dy"] == dx))
    items = stored(numbers.join(corners, [*by, "x1", "y1"]).select("id", F.coalesce(F.get(right, F.lit(0)), F.get("outs", F.lit(0)))["id"].alias("next")), "next")
    found = stored(ring_places(items), "places")
    named = stored(numbers.join(found, "id").select(*by, "leader", "left", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("id") == F.col("leader")).alias("first")), "named")
    rings = running(named.where("first").select(*by, "leader", F.col("left").alias("size")), by, ["leader"], {"nth": F.lit(1)})
    rings = rings.select("leader", "size", (F.col("nth") - 1).cast("int").alias("ring"))
    return named.join(rings, "leader").select(*by, "ring", (F.col("size") - F.col("left")).alias("place"), "x", "y")


def polygon_rings(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Closed rings of each component's edges as one row each: by, comp, ring, points (x, y; the first again at the end); see ``ring_points``."""
    corners = F.array_sort(F.collect_list(F.struct("place", F.array("x", "y").alias("p"))))
    rings = ring_points(edges, by).groupBy(*by, "comp", "ring").agg(F.transform(corners, lambda c: c["p"]).alias("points"))
    return rings.withColumn("points", F.concat("points", F.slice("points", 1, 1)))
