"""Queries on objects: components, matching, tracks, outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import focal, pixels
from gridloom.operators import objects as O
from gridloom.registry import query

BY = ["site", "scene"]


def cells(v, eight: bool = True, threshold: float = 0.7):
    mask = v.px.where(F.col("prob") >= threshold).select("site", "scene", "r", "c")
    return O.components(mask, BY, v.side, eight, tile=64)


def _comp(near: str = "abs(n.r - w.r) <= 1 AND abs(n.c - w.c) <= 1", cells: str = "{px}", least: str = "0.7") -> str:
    return f"""m AS (SELECT site, scene, r, c, r * side + c AS id FROM {cells}, {{grid_side}} WHERE prob >= {least}),
      w AS (SELECT site, scene, r, c, id AS root FROM m UNION SELECT n.site, n.scene, n.r, n.c, w.root FROM w JOIN m n ON n.site = w.site AND n.scene = w.scene AND {near} AND n.id > w.root),
      cp AS (SELECT site, scene, r, c, min(root) AS comp FROM w GROUP BY 1, 2, 3, 4)"""


C8, C4 = _comp(), _comp("abs(n.r - w.r) + abs(n.c - w.c) = 1")


@query(f"WITH {C8} SELECT site, scene, r, c, comp FROM cp", recursive=True)
def components8(v):
    return cells(v)


@query(f"WITH {C4} SELECT site, scene, r, c, comp FROM cp", recursive=True)
def components4(v):
    return cells(v, eight=False)


_STATS = "st AS (SELECT site, scene, comp, count(*) AS area_px, avg(r) AS row, avg(c) AS col, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM cp GROUP BY 1, 2, 3)"


@query(f"WITH {C8}, {_STATS} SELECT site, scene, comp, area_px, round(row, 6) AS row, round(col, 6) AS col, r0, r1, c0, c1 FROM st", recursive=True)
def component_stats(v):
    return O.component_stats(cells(v), BY).withColumns({"row": F.round("row", 6), "col": F.round("col", 6)})


@query(f"WITH {C8}, {_STATS} SELECT cp.* FROM cp JOIN st USING (site, scene, comp) WHERE area_px >= 4", recursive=True)
def remove_small(v):
    return O.remove_small(cells(v), BY, 4)


@query(f"WITH {C8}, {_STATS} SELECT site, scene, comp, area_px FROM st WHERE area_px >= 6", recursive=True)
def min_size(v):
    return O.component_stats(cells(v), BY).where("area_px >= 6").select("site", "scene", "comp", "area_px")


@query(f"WITH {C8}, {_STATS} SELECT cp.* FROM cp JOIN st USING (site, scene, comp) WHERE area_px >= 5 AND greatest(r1 - r0 + 1, c1 - c0 + 1) / (least(r1 - r0 + 1, c1 - c0 + 1) + 1.0) >= 1.2", recursive=True)
def elongated(v):
    return O.elongated(cells(v), BY, 1.2, 5)


_MATCH = """s AS (SELECT DISTINCT site, scene FROM {px}), p AS (SELECT site, t0, t1 FROM (SELECT site, scene AS t0, lead(scene) OVER (PARTITION BY site ORDER BY scene) AS t1 FROM s) u WHERE t1 IS NOT NULL),
  i AS (SELECT p.site, p.t0, p.t1, a.comp, b.comp AS prev, count(*) AS n FROM p JOIN cp a ON a.site = p.site AND a.scene = p.t1 JOIN cp b ON b.site = p.site AND b.scene = p.t0 AND b.r = a.r AND b.c = a.c GROUP BY 1, 2, 3, 4, 5),
  u AS (SELECT i.*, n / CAST(x.area_px + y.area_px - n AS DOUBLE) AS iou FROM i JOIN st x ON x.site = i.site AND x.scene = t1 AND x.comp = i.comp JOIN st y ON y.site = i.site AND y.scene = t0 AND y.comp = prev),
  mt AS (SELECT site, t0, t1, comp, prev, iou FROM (SELECT *, row_number() OVER (PARTITION BY site, t1, comp ORDER BY iou DESC, prev) AS k FROM u) q WHERE k = 1 AND iou >= 0.3)"""
_TRACK = """tr AS (SELECT st.site, st.scene, st.comp, st.scene AS fs, st.comp AS fc FROM st LEFT JOIN mt ON mt.site = st.site AND mt.t1 = st.scene AND mt.comp = st.comp WHERE mt.site IS NULL
    UNION ALL SELECT mt.site, mt.t1, mt.comp, tr.fs, tr.fc FROM tr JOIN mt ON mt.site = tr.site AND mt.t0 = tr.scene AND mt.prev = tr.comp),
  tk AS (SELECT site, scene, comp, fs AS first_scene, fc AS first_comp, dense_rank() OVER (PARTITION BY site ORDER BY fs, fc) - 1 AS track FROM tr)"""


def matched(v, found):
    return O.match(found, pixels.scene_pairs(v.px.select("site", "scene").distinct(), ["site"], "scene"), ["site"], "scene", 0.3)


@query(f"WITH {C8}, {_STATS}, {_MATCH} SELECT site, t0, t1, comp, prev, round(iou, 6) AS iou FROM mt", recursive=True)
def match_iou(v):
    from gridloom.sources.scratch import stored

    return matched(v, stored(cells(v), "cells")).withColumn("iou", F.round("iou", 6))


def tracked(v):
    from gridloom.sources.scratch import stored

    found = stored(cells(v), "cells")
    stats = O.component_stats(found, BY)
    return O.tracks(stats, matched(v, found), ["site"], "scene"), stats


@query(f"WITH {C8}, {_STATS}, {_MATCH}, {_TRACK} SELECT site, scene, comp, first_scene, first_comp, track FROM tk", recursive=True)
def tracks(v):
    return tracked(v)[0]


@query(f"WITH {C4}, {_STATS} SELECT site, scene, comp, round(area_px * CAST(36 AS DOUBLE), 2) AS area_m2 FROM st WHERE area_px * 36 >= 72", recursive=True)
def polygon_area(v):
    out = O.component_stats(cells(v, eight=False), BY)
    return out.select("site", "scene", "comp", F.round(F.col("area_px") * 36.0, 2).alias("area_m2")).where("area_m2 >= 72")


@query(f"""WITH {C4}, sd(dr, dc, x0, y0, x1, y1) AS (VALUES (-1, 0, 0, 0, 1, 0), (0, 1, 1, 0, 1, 1), (1, 0, 1, 1, 0, 1), (0, -1, 0, 1, 0, 0))
  SELECT a.site, a.scene, a.comp, a.c + x0 AS x0, a.r + y0 AS y0, a.c + x1 AS x1, a.r + y1 AS y1 FROM cp a CROSS JOIN sd LEFT JOIN cp n ON n.site = a.site AND n.scene = a.scene AND n.comp = a.comp AND n.r = a.r + dr AND n.c = a.c + dc WHERE n.site IS NULL""", recursive=True)
def polygon_edges(v):
    return O.polygon_edges(cells(v, eight=False), BY)


#: Edges with the next one of each (to the right where there are two), walks from every edge over later ones, and those that come back: a ring's first edge.
_RINGS = f"""{C4}, sd(dr, dc, x0, y0, x1, y1) AS (VALUES (-1, 0, 0, 0, 1, 0), (0, 1, 1, 0, 1, 1), (1, 0, 1, 1, 0, 1), (0, -1, 0, 1, 0, 0)),
  e0 AS (SELECT a.site, a.scene, a.comp, a.c + sd.x0 AS x0, a.r + sd.y0 AS y0, a.c + sd.x1 AS x1, a.r + sd.y1 AS y1 FROM cp a CROSS JOIN sd LEFT JOIN cp n ON n.site = a.site AND n.scene = a.scene AND n.comp = a.comp AND n.r = a.r + dr AND n.c = a.c + dc WHERE n.site IS NULL),
  e AS (SELECT *, row_number() OVER (ORDER BY site, scene, comp, y0, x0, y1, x1) AS id FROM e0),
  nx AS (SELECT a.id, arg_min(b.id, CASE WHEN b.x1 - b.x0 = a.y0 - a.y1 AND b.y1 - b.y0 = a.x1 - a.x0 THEN 0 ELSE 1 END) AS nxt FROM e a JOIN e b ON b.site = a.site AND b.scene = a.scene AND b.comp = a.comp AND b.x0 = a.x1 AND b.y0 = a.y1 GROUP BY a.id),
  wk(start, here, place) AS (SELECT id, id, CAST(0 AS BIGINT) FROM nx UNION ALL SELECT start, nxt, place + 1 FROM wk JOIN nx ON nx.id = wk.here WHERE nxt > start),
  fs AS (SELECT DISTINCT start FROM wk JOIN nx ON nx.id = wk.here AND nxt = start),
  rg AS (SELECT site, scene, comp, id AS start, row_number() OVER (PARTITION BY site, scene, comp ORDER BY id) - 1 AS ring FROM e JOIN fs ON fs.start = e.id),
  rp AS (SELECT rg.site, rg.scene, rg.comp, ring, place, e.x0 AS x, e.y0 AS y FROM rg JOIN wk USING (start) JOIN e ON e.id = wk.here)"""


@query(f"WITH {_RINGS} SELECT site, scene, comp, ring, place, x, y FROM rp", recursive=True)
def ring_points(v):
    return O.ring_points(O.polygon_edges(cells(v, eight=False), BY), BY)


@query(f"WITH {_RINGS}, pt AS (SELECT site, scene, comp, ring, place, x, y FROM rp UNION ALL SELECT site, scene, comp, ring, (SELECT max(place) FROM rp) + 1, x, y FROM rp WHERE place = 0) SELECT site, scene, comp, ring, flatten(list([x, y] ORDER BY place)) AS points FROM pt GROUP BY 1, 2, 3, 4", recursive=True)
def polygon_rings(v):
    """A ring as x and y of its corners in turn, the first again at the end."""
    return O.polygon_rings(O.polygon_edges(cells(v, eight=False), BY), BY).withColumn("points", F.flatten("points"))


@query("""WITH m0 AS (SELECT site, scene, r, c FROM {px} WHERE prob >= 0.5), o3(d) AS (VALUES (-1), (0), (1)),
  er AS (SELECT site, scene, r + a.d AS r, c + b.d AS c FROM m0, o3 a, o3 b WHERE abs(a.d) + abs(b.d) <= 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 5),
  m AS (SELECT site, scene, r, c, r * side + c AS id FROM (SELECT DISTINCT site, scene, r + a.d AS r, c + b.d AS c FROM er, o3 a, o3 b) q, {grid_side} WHERE r BETWEEN 0 AND side - 1 AND c BETWEEN 0 AND side - 1),
  w AS (SELECT site, scene, r, c, id AS root FROM m UNION SELECT n.site, n.scene, n.r, n.c, w.root FROM w JOIN m n ON n.site = w.site AND n.scene = w.scene AND abs(n.r - w.r) <= 1 AND abs(n.c - w.c) <= 1 AND n.id > w.root),
  cp AS (SELECT site, scene, r, c, min(root) AS comp FROM w GROUP BY 1, 2, 3, 4), st AS (SELECT site, scene, comp, count(*) AS n, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS wd FROM cp GROUP BY 1, 2, 3)
  SELECT cp.* FROM cp JOIN st USING (site, scene, comp) WHERE n >= 10 AND greatest(h, wd) / (least(h, wd) + 1.0) >= 1.0""", recursive=True)
def reshape_channels(v):
    shape = (v.side, v.side)
    m = v.px.where("prob >= 0.5").select("site", "scene", "r", "c")
    m = focal.dilate(focal.erode(m, BY, shape, 1, cross=True), BY, shape, 1)
    return O.elongated(O.components(m, BY, v.side, True, 64), BY, 1.0, 10)
