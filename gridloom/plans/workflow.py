"""Queries of whole steps: preprocessing, features, labels, scoring, export, and table functions in SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import tables
from gridloom.operators import focal, geometry, objects, workflow
from gridloom.operators import reports as R
from gridloom.operators.evaluation import confusion, metrics
from gridloom.plans.geometry import _PLACES, _TILES, extent
from gridloom.plans.objects import _comp
from gridloom.plans.terrain import _SLOPE, _ring
from gridloom.registry import query
from gridloom.sources.scratch import shared_dir, stored

BY = ["site", "scene"]


@query("""WITH fs AS (SELECT site, min(scene) AS f FROM {px} GROUP BY 1), o(d) AS (VALUES (-1), (0), (1)),
  mv AS (SELECT p.site, p.scene, p.r + a.d AS r, p.c + b.d AS c, a.d AS dr, b.d AS dc, p.red AS m, f FROM {px} p JOIN fs ON fs.site = p.site AND p.scene <> f, o a, o b),
  sc AS (SELECT mv.site, mv.scene, dr, dc, corr(x.red, m) AS s FROM mv JOIN {px} x ON x.site = mv.site AND x.scene = f AND x.r = mv.r AND x.c = mv.c GROUP BY 1, 2, 3, 4),
  bs AS (SELECT site, scene, dr, dc FROM (SELECT *, row_number() OVER (PARTITION BY site, scene ORDER BY round(s, 6) DESC, dr * dr + dc * dc, dr, dc) AS n FROM sc WHERE s IS NOT NULL AND NOT isnan(s)) q WHERE n = 1),
  pl AS (SELECT p.site, p.scene, p.r + coalesce(dr, 0) AS r, p.c + coalesce(dc, 0) AS c, red, nir FROM {px} p LEFT JOIN bs ON bs.site = p.site AND bs.scene = p.scene),
  q AS (SELECT site, scene, quantile_cont(red, 0.02) AS rl, quantile_cont(red, 0.98) AS rh, quantile_cont(nir, 0.02) AS nl, quantile_cont(nir, 0.98) AS nh FROM pl GROUP BY 1, 2),
  n AS (SELECT site, scene, r, c, CASE WHEN rh - rl < 1e-9 THEN 0 ELSE (least(greatest(red, rl), rh) - rl) / (rh - rl) END AS red, CASE WHEN nh - nl < 1e-9 THEN 0 ELSE (least(greatest(nir, nl), nh) - nl) / (nh - nl) END AS nir FROM pl JOIN q USING (site, scene))
  SELECT site, r, c, round(median(red), 5) AS red, round(median(nir), 5) AS nir FROM n GROUP BY 1, 2, 3""")
def workflow_preprocess(v):
    out = workflow.preprocess(v.px.select(*BY, "r", "c", "red", "nir"), ["site"], "scene", ["red", "nir"])
    return out.select("site", "r", "c", F.round("red", 5).alias("red"), F.round("nir", 5).alias("nir"))


@query(f"""WITH {_ring()}, {_SLOPE}, ex AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM {{dem}})
  SELECT p.site, p.scene, p.r, p.c, p.red, d.elev, round(t.slope, 6) AS slope FROM (SELECT *, CAST(floor(r * (CAST(h - 1 AS DOUBLE) / (side - 1)) + 0.5) AS BIGINT) AS lr, CAST(floor(c * (CAST(w - 1 AS DOUBLE) / (side - 1)) + 0.5) AS BIGINT) AS lc FROM {{px}}, {{grid_side}}, ex) p
  LEFT JOIN {{dem}} d ON d.r = lr AND d.c = lc LEFT JOIN t ON t.r = lr AND t.c = lc""")
def workflow_features(v):
    """Pixels with terrain from another grid; a sensor that has no table is left out."""
    own, side = extent(v), (v.side, v.side)
    steep = focal.focal(v.dem, [], "elev", own, 1, focal.slope_aspect(463.0), ["slope"]).withColumn("slope", F.round("slope", 6))
    return geometry.stack(v.px.select(*BY, "r", "c", "red"), BY, side, [(v.dem, [], "elev", own), (None, [], "thermal", own), (steep, [], "slope", own)])


@query(f"""WITH {_TILES}, {_ring()}, {_SLOPE}, cd AS (SELECT r, c FROM t0 WHERE slope > 0.5 AND aspect > 135 AND aspect < 315), o5(d) AS (VALUES (-2), (-1), (0), (1), (2)), ex AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM {{dem}}),
  ds AS (SELECT DISTINCT r + a.d AS r, c + b.d AS c FROM cd, o5 a, o5 b, ex WHERE a.d * a.d + b.d * b.d <= 4 AND r + a.d BETWEEN 0 AND h - 1 AND c + b.d BETWEEN 0 AND w - 1),
  gq AS (SELECT tr, unnest(range(0, side)) AS tc, side FROM (SELECT side, unnest(range(0, side)) AS tr FROM {{grid_side}}) x),
  lm AS (SELECT tr, tc FROM gq, ex JOIN ds ON ds.r = CAST(floor(tr * (CAST(h - 1 AS DOUBLE) / (side - 1)) + 0.5) AS BIGINT) AND ds.c = CAST(floor(tc * (CAST(w - 1 AS DOUBLE) / (side - 1)) + 0.5) AS BIGINT))
  SELECT r0, c0, count(*) AS n FROM lm JOIN t ON tr >= r0 AND tr < r0 + 16 AND tc >= c0 AND tc < c0 + 16 GROUP BY 1, 2 HAVING count(*) / 256.0 >= 0.001""".replace("  t AS (SELECT r, c, slope", "  t0 AS (SELECT r, c, slope"))
def workflow_labels(v):
    """Patches of the pixels' grid with foreground that slopes of the terrain suggest."""
    side = (v.side, v.side)
    mask = workflow.labels(v.dem, "elev", extent(v), 463.0, side, slope=0.5)
    return geometry.patches(mask, [], side, 16, 8).where("fraction >= 0.001").select("r0", "c0", "n")


_FLOW = f"""{_ring()}, {_SLOPE}, ex AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM {{dem}}), e8(k, a, b) AS (VALUES (0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, -1), (6, 0, -1), (7, -1, -1)),
  fl AS (SELECT r, c, r + a AS nr, c + b AS nc FROM t JOIN e8 ON k = CAST(floor(aspect / 45 + 0.5) AS BIGINT) % 8, ex WHERE r + a BETWEEN 0 AND h - 1 AND c + b BETWEEN 0 AND w - 1),
  sd AS (SELECT r, c FROM t WHERE slope > 0.5 AND aspect > 135 AND aspect < 315),
  dn(r, c, k) AS (SELECT r, c, 1 FROM sd UNION SELECT nr, nc, k + 1 FROM dn JOIN fl USING (r, c) WHERE k < 11)"""


@query(f"WITH {_FLOW} SELECT DISTINCT r, c FROM dn", recursive=True)
def channels(v):
    """What lies within eleven cells downstream of the steep cells that face south."""
    from gridloom.operators.flow import downstream, flow_next

    terrain = stored(focal.focal(v.dem, [], "elev", extent(v), 1, focal.slope_aspect(463.0), ["slope", "aspect"]), "terrain")
    return downstream(terrain.where("slope > 0.5 AND aspect > 135 AND aspect < 315"), flow_next(terrain, extent(v)), 11)


@query(f"""WITH {_FLOW}, o3(d) AS (VALUES (-1), (0), (1)), o5(d) AS (VALUES (-2), (-1), (0), (1), (2)),
  ds AS (SELECT r + a.d AS r, c + b.d AS c FROM sd, o5 a, o5 b, ex WHERE a.d * a.d + b.d * b.d <= 4 AND r + a.d BETWEEN 0 AND h - 1 AND c + b.d BETWEEN 0 AND w - 1
    UNION SELECT r + a.d, c + b.d FROM dn, o3 a, o3 b, ex WHERE r + a.d BETWEEN 0 AND h - 1 AND c + b.d BETWEEN 0 AND w - 1),
  gq AS (SELECT tr, unnest(range(0, side)) AS tc, side FROM (SELECT side, unnest(range(0, side)) AS tr FROM {{grid_side}}) x)
  SELECT tr AS r, tc AS c FROM gq, ex JOIN ds ON ds.r = CAST(floor(tr * (CAST(h - 1 AS DOUBLE) / (side - 1)) + 0.5) AS BIGINT) AND ds.c = CAST(floor(tc * (CAST(w - 1 AS DOUBLE) / (side - 1)) + 0.5) AS BIGINT)""", recursive=True)
def workflow_label_cells(v):
    """Discs and channels on the pixels' grid, cell by cell."""
    return workflow.labels(v.dem, "elev", extent(v), 463.0, (v.side, v.side), slope=0.5, length=11)


_H = "greatest((0.5 - 0.5 * cos(2 * pi() * (r - r0) / 15)) * (0.5 - 0.5 * cos(2 * pi() * (c - c0) / 15)), 1e-6)"
_BLENDED = f"""{_TILES}, tc AS (SELECT site, scene, r0, c0, r, c, prob AS z, avg(prob) OVER (PARTITION BY site, scene, r0, c0) AS m FROM {{px}} JOIN t ON r >= r0 AND r < r0 + 16 AND c >= c0 AND c < c0 + 16),
  bl AS (SELECT site, scene, r, c, round(sum({_H} / (1 + exp(-8 * (z - m)))) / sum({_H}), 6) AS prob FROM tc GROUP BY 1, 2, 3, 4)"""


def contrast(tile: np.ndarray) -> np.ndarray:
    """A cell's probability by its distance from the mean of its tile."""
    return 1 / (1 + np.exp(-8 * (tile - np.nanmean(tile))))


def blended(v):
    return workflow.score_scenes(v.px, BY, "prob", (v.side, v.side), 16, 8, contrast).withColumn("prob", F.round("prob", 6))


@query(f"WITH {_BLENDED} SELECT site, scene, r, c, prob FROM bl")
def workflow_score(v):
    return blended(v)


@query(f"""WITH {_BLENDED}, {_comp(cells='bl', least='0.9')}, bg AS (SELECT site, scene, r, c FROM cp JOIN (SELECT site, scene, comp FROM cp GROUP BY 1, 2, 3 HAVING count(*) >= 3) b USING (site, scene, comp)), o5(d) AS (VALUES (-2), (-1), (0), (1), (2)),
  di AS (SELECT DISTINCT site, scene, r + a.d AS r, c + b.d AS c FROM bg, o5 a, o5 b, {{grid_side}} WHERE r + a.d BETWEEN 0 AND side - 1 AND c + b.d BETWEEN 0 AND side - 1),
  cl AS (SELECT site, scene, r + a.d AS r, c + b.d AS c FROM di, o5 a, o5 b, {{grid_side}} WHERE r + a.d BETWEEN 0 AND side - 1 AND c + b.d BETWEEN 0 AND side - 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 25)
  SELECT site, scene, count(*) AS n_px, round(count(*) * CAST(0.0036 AS DOUBLE), 4) AS area_ha FROM cl GROUP BY 1, 2""", recursive=True)
def workflow_threshold(v):
    """Tiles scored and blended, cut at a threshold, without small components, closed, and summed."""
    masks = workflow.threshold(stored(blended(v), "blended"), BY, (v.side, v.side), [0.9], 3, tile=64)
    return masks.groupBy(*BY).agg(F.count("*").alias("n_px")).withColumn("area_ha", F.round(F.col("n_px") * 0.0036, 4))


@query("""WITH m AS (SELECT site, scene, r, c FROM {px} WHERE prob >= 0.7), s AS (SELECT DISTINCT site, scene FROM {px})
  SELECT 'masks' AS artefact, count(*) AS n FROM m UNION ALL SELECT 'probabilities', count(*) FROM {px} UNION ALL SELECT 'summary', count(*) FROM s UNION ALL SELECT 'metrics', count(*) FROM s
  UNION ALL SELECT 'overviews', sum(n) FROM (SELECT count(*) AS n FROM (SELECT DISTINCT site, scene, r // f, c // f, f FROM {px}, (VALUES (2), (4), (8), (16)) t(f)) a) b
  UNION ALL SELECT 'outlines', count(*) FROM (SELECT m.site, m.scene, m.r, m.c, d.dr, d.dc FROM m, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dr, dc) WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.site = m.site AND n.scene = m.scene AND n.r = m.r + d.dr AND n.c = m.c + d.dc)) e""")
def workflow_export(v):
    """What each artefact holds after it was written and read again."""
    masks = v.px.where("prob >= 0.7").select(*BY, "r", "c")
    edges = objects.polygon_edges(masks.withColumn("comp", F.lit(0)), BY)
    line = F.array(F.array("x0", "y0"), F.array("x1", "y1"))
    outlines = edges.select(R.feature("LineString", line, {"site": F.col("site"), "scene": F.col("scene")}).alias("feature"))
    summary = v.px.groupBy(*BY).agg(F.count(F.when(F.col("prob") >= 0.7, 1)).alias("n_px"), F.max("prob").alias("max_prob"))
    found = metrics(confusion(v.px, BY, "prob", "target", 0.7))
    back = workflow.export(f"{shared_dir(v.spark)}/export-{uuid.uuid4().hex}", BY, masks, v.px.select(*BY, "r", "c", "prob"), outlines, summary, found)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("artefact"), "n") for k, df in back.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_PLACES} SELECT site, scene, r0, c0 FROM tp")
def sql_tile_coords(v):
    """The table function as a user of SQL calls it, for the grid of every scene."""
    tables.register(v.spark)
    return v.spark.sql("SELECT site, scene, t.r0, t.c0 FROM (SELECT site, scene, max(r) + 1 AS h, max(c) + 1 AS w FROM {px} GROUP BY site, scene) g, LATERAL tile_coords(h, w, 16, 8) t", px=v.px)


@query("SELECT site, scene, dr, dc, count(*) AS n FROM {px}, (SELECT a.d AS dr, b.d AS dc FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d)) o, {grid_side} WHERE r + dr BETWEEN 0 AND side - 1 AND c + dc BETWEEN 0 AND side - 1 GROUP BY 1, 2, 3, 4")
def sql_shifts(v):
    """Cells that each shift leaves in the grid."""
    tables.register(v.spark)
    text = "SELECT site, scene, dr, dc, count(*) AS n FROM {px} p CROSS JOIN shifts(1) o WHERE r + dr BETWEEN 0 AND {side} - 1 AND c + dc BETWEEN 0 AND {side} - 1 GROUP BY site, scene, dr, dc"
    return v.spark.sql(text, px=v.px, side=v.side)
