"""Queries on neighbourhoods: terrain, texture, morphology, filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import focal as O
from gridloom.operators.boxes import box_deviation
from gridloom.operators.distance import class_distance, nearest_cell
from gridloom.registry import query

CELL = 463.0


def _ring(table: str = "{dem}", tag: str = "") -> str:
    """CTEs nb (r, c, dr, dc, z: neighbours, the edge repeated) and k (a column for each of nine) of a grid, names ending in ``tag``."""
    cells = ", ".join(f"max(CASE WHEN dr = {i} AND dc = {j} THEN z END) AS z{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1))
    at = "least(greatest(d.{x} + d{x}, 0), {n} - 1)"
    return f"""e{tag} AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM {table}), o{tag} AS (SELECT a.d AS dr, b.d AS dc FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d)),
      nb{tag} AS (SELECT d.r, d.c, dr, dc, n.elev AS z FROM {table} d CROSS JOIN o{tag} CROSS JOIN e{tag} JOIN {table} n ON n.r = {at.format(x='r', n='h')} AND n.c = {at.format(x='c', n='w')}),
      k{tag} AS (SELECT r, c, {cells} FROM nb{tag} GROUP BY r, c)"""


_SLOPE = f"""g AS (SELECT r, c, ((z02 + 2 * z12 + z22) - (z00 + 2 * z10 + z20)) / (8 * 463.0) AS dx, ((z20 + 2 * z21 + z22) - (z00 + 2 * z01 + z02)) / (8 * 463.0) AS dy FROM k),
  sa AS (SELECT r, c, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, 90 - degrees(atan2(-dy, dx)) AS a FROM g),
  t AS (SELECT r, c, slope, CASE WHEN a < 0 THEN a + 360 WHEN a >= 360 THEN a - 360 ELSE a END AS aspect FROM sa)"""


def extent(v) -> tuple[int, int]:
    x = v.dem.agg(F.max("r"), F.max("c")).first()
    return x[0] + 1, x[1] + 1


def _terrain(v, kernel, outputs, radius=1, mode="clamp"):
    return O.focal(v.dem, [], "elev", extent(v), radius, kernel, outputs, mode, tile=32)


@query(f"WITH {_ring()}, {_SLOPE} SELECT r, c, round(slope, 6) AS slope FROM t")
def slope(v):
    return _terrain(v, O.slope_aspect(CELL), ["slope"]).withColumn("slope", F.round("slope", 6))


@query(f"WITH {_ring()}, {_SLOPE} SELECT r, c, round(aspect, 6) AS aspect FROM t")
def aspect(v):
    return _terrain(v, O.slope_aspect(CELL), ["aspect"]).withColumn("aspect", F.round("aspect", 6))


@query(f"WITH {_ring()}, {_SLOPE} SELECT r, c FROM t WHERE slope > 0.5 AND aspect > 135 AND aspect < 315")
def slope_candidates(v):
    return _terrain(v, O.slope_aspect(CELL), ["slope", "aspect"]).where("slope > 0.5 AND aspect > 135 AND aspect < 315").select("r", "c")


_CURVE = """q AS (SELECT r, c, (z12 - 2 * z11 + z10) / (2 * 463.0 * 463.0) AS d, (z21 - 2 * z11 + z01) / (2 * 463.0 * 463.0) AS e1, (z22 - z20 - z02 + z00) / (4 * 463.0 * 463.0) AS f,
  (z12 - z10) / (2 * 463.0) AS g, (z21 - z01) / (2 * 463.0) AS h1 FROM k)"""
for _name, _top in (("plan", "d * h1 * h1 - f * g * h1 + e1 * g * g"), ("profile", "d * g * g + f * g * h1 + e1 * h1 * h1")):

    @query(f"WITH {_ring()}, {_CURVE} SELECT r, c, round(1e6 * CASE WHEN g * g + h1 * h1 > 1e-10 THEN -2 * ({_top}) / ((g * g + h1 * h1) * sqrt(g * g + h1 * h1 + 1)) ELSE 0 END, 4) AS {_name} FROM q", name=f"curvature_{_name}")
    def _curve(v, name=_name):
        return _terrain(v, O.curvature(CELL), [name]).withColumn(name, F.round(F.col(name) * 1e6, 4))


@query(f"WITH {_ring()}, s AS (SELECT r, c, avg(z) AS m, avg(z * z) AS m2 FROM nb GROUP BY r, c) SELECT r, c, round(sqrt(greatest(m2 - m * m, 0)), 4) AS roughness FROM s")
def roughness(v):
    return box_deviation(v.dem, [], "elev", extent(v), 3).withColumn("roughness", F.round("roughness", 4))


@query("""WITH e AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM {dem}), o AS (SELECT i AS d FROM range(-32, 33) a(i)),
  rr AS (SELECT r, c, elev, h, w FROM {dem}, e), hz AS (SELECT x.r, x.c, sum(n.elev) AS s, sum(n.elev * n.elev) AS q FROM rr x, o JOIN {dem} n ON n.r = x.r AND n.c = CASE WHEN ((x.c + d) % (2 * w) + 2 * w) % (2 * w) < w THEN ((x.c + d) % (2 * w) + 2 * w) % (2 * w) ELSE 2 * w - 1 - ((x.c + d) % (2 * w) + 2 * w) % (2 * w) END GROUP BY 1, 2),
  vt AS (SELECT x.r, x.c, sum(n.s) / 4225 AS m, sum(n.q) / 4225 AS m2 FROM rr x, o JOIN hz n ON n.c = x.c AND n.r = CASE WHEN ((x.r + d) % (2 * h) + 2 * h) % (2 * h) < h THEN ((x.r + d) % (2 * h) + 2 * h) % (2 * h) ELSE 2 * h - 1 - ((x.r + d) % (2 * h) + 2 * h) % (2 * h) END GROUP BY 1, 2)
  SELECT r, c, round(sqrt(greatest(m2 - m * m, 0)), 3) AS roughness FROM vt""")
def roughness_wide(v):
    """The deviation in windows of 65 cells a side, which cost what those of 3 cost."""
    return box_deviation(v.dem, [], "elev", extent(v), 65).withColumn("roughness", F.round("roughness", 3))


_TAPS = ", ".join(f"({k - 4}, CAST({float(w)!r} AS DOUBLE))" for k, w in enumerate(O.gaussian_taps(1.0)))


_GAUSS = f"""eg AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM {{table}}), tg(d, wt) AS (VALUES {_TAPS}),
  ag AS (SELECT x.r, x.c, sum(n.elev * wt) AS z FROM {{table}} x CROSS JOIN tg CROSS JOIN eg JOIN {{table}} n ON n.c = x.c AND n.r = CASE WHEN x.r + d < 0 THEN -1 - x.r - d WHEN x.r + d >= h THEN 2 * h - 1 - x.r - d ELSE x.r + d END GROUP BY 1, 2),
  sm AS (SELECT x.r, x.c, sum(n.z * wt) AS elev FROM ag x CROSS JOIN tg CROSS JOIN eg JOIN ag n ON n.r = x.r AND n.c = CASE WHEN x.c + d < 0 THEN -1 - x.c - d WHEN x.c + d >= w THEN 2 * w - 1 - x.c - d ELSE x.c + d END GROUP BY 1, 2)"""


@query(f"WITH {_GAUSS.format(table='{dem}')} SELECT r, c, round(elev, 5) AS smooth FROM sm")
def gaussian_smooth(v):
    return _terrain(v, O.gaussian(1.0), ["smooth"], 4, "reflect").withColumn("smooth", F.round("smooth", 5))


_FILLED = """hl AS (SELECT r AS hr, c AS hc FROM {dem} WHERE (r * 7 + c) % 11 = 0), gd AS (SELECT * FROM {dem} WHERE (r * 7 + c) % 11 <> 0),
  fd AS (SELECT hr AS r, hc AS c, elev FROM (SELECT hr, hc, elev, row_number() OVER (PARTITION BY hr, hc ORDER BY (r - hr) * (r - hr) + (c - hc) * (c - hc), r, c) AS n FROM hl JOIN gd ON abs(r - hr) <= 3 AND abs(c - hc) <= 3 AND (r - hr) * (r - hr) + (c - hc) * (c - hc) <= 9) q WHERE n = 1),
  al AS (SELECT r, c, elev FROM gd UNION ALL SELECT r, c, elev FROM fd)"""
_BENT = "round(1e6 * CASE WHEN g * g + h1 * h1 > 1e-10 THEN -2 * ({top}) / ((g * g + h1 * h1) * sqrt(g * g + h1 * h1 + 1)) ELSE 0 END, 4)"


@query(f"""WITH {_FILLED}, {_ring('al')}, {_SLOPE}, s AS (SELECT r, c, avg(z) AS m, avg(z * z) AS m2 FROM nb GROUP BY r, c), {_GAUSS.format(table='al')}, {_ring('sm', '2')}, {_CURVE.replace('FROM k)', 'FROM k2)')}
  SELECT r, c, round(slope, 6) AS slope, round(aspect, 6) AS aspect, {_BENT.format(top='d * h1 * h1 - f * g * h1 + e1 * g * g')} AS plan, {_BENT.format(top='d * g * g + f * g * h1 + e1 * h1 * h1')} AS profile, round(sqrt(greatest(m2 - m * m, 0)), 4) AS roughness FROM t JOIN s USING (r, c) JOIN q USING (r, c)""")
def morphometrics(v):
    """All features, after cells without a number were filled."""
    dem = v.dem.withColumn("elev", F.when((F.col("r") * 7 + F.col("c")) % 11 != 0, F.col("elev")))
    out = O.morphometrics(dem, [], "elev", extent(v), CELL, tile=32)
    return out.select("r", "c", *(F.round(x, 6).alias(x) for x in ("slope", "aspect")), *(F.round(F.col(x) * 1e6, 4).alias(x) for x in ("plan", "profile")), F.round("roughness", 4).alias("roughness"))


def mask(v, threshold: float = 0.7):
    return v.px.where(F.col("prob") >= threshold).select("site", "scene", "r", "c")


_M = "m AS (SELECT site, scene, r, c FROM {px} WHERE prob >= 0.7), o3(d) AS (VALUES (-1), (0), (1)), o5(d) AS (VALUES (-2), (-1), (0), (1), (2))"


@query(f"WITH {_M} SELECT DISTINCT site, scene, r + a.d AS r, c + b.d AS c FROM m, o3 a, o3 b, {{grid_side}} WHERE r + a.d BETWEEN 0 AND side - 1 AND c + b.d BETWEEN 0 AND side - 1")
def dilate(v):
    return O.dilate(mask(v), ["site", "scene"], (v.side, v.side))


@query(f"WITH {_M.replace('0.7', '0.3')} SELECT site, scene, r + a.d AS r, c + b.d AS c FROM m, o3 a, o3 b WHERE abs(a.d) + abs(b.d) <= 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 5")
def erode(v):
    return O.erode(mask(v, 0.3), ["site", "scene"], (v.side, v.side), cross=True)


@query(f"""WITH {_M}, di AS (SELECT DISTINCT site, scene, r + a.d AS r, c + b.d AS c FROM m, o5 a, o5 b, {{grid_side}} WHERE r + a.d BETWEEN 0 AND side - 1 AND c + b.d BETWEEN 0 AND side - 1)
  SELECT site, scene, r + a.d AS r, c + b.d AS c FROM di, o5 a, o5 b, {{grid_side}} WHERE r + a.d BETWEEN 0 AND side - 1 AND c + b.d BETWEEN 0 AND side - 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 25""")
def morph_close(v):
    return O.close(mask(v), ["site", "scene"], (v.side, v.side), 2)


def _windows(size: int, tag: str = "") -> str:
    """CTE tx: the texture of every window of that size at each fourth cell."""
    reach = ", ".join(f"({d})" for d in range(-(size // 2), size // 2 + 1))
    same = "x.site = y.site AND x.scene = y.scene AND x.wr = y.wr AND x.wc = y.wc AND x.dr = y.dr AND y.dc = x.dc + 1"
    return f"""ow{tag}(d) AS (VALUES {reach}), wn{tag} AS (SELECT site, scene, side AS n, CAST(i * 4 AS BIGINT) AS wr, CAST(j * 4 AS BIGINT) AS wc FROM (SELECT DISTINCT site, scene FROM {{px}}) s, {{grid_side}}, range(0, 100) a(i), range(0, 100) b(j) WHERE i * 4 < side AND j * 4 < side),
  f{tag} AS (SELECT site, scene, wr, wc, a.d AS dr, b.d AS dc, CASE WHEN wr + a.d < 0 THEN -(wr + a.d) WHEN wr + a.d >= n THEN 2 * n - 2 - wr - a.d ELSE wr + a.d END AS r, CASE WHEN wc + b.d < 0 THEN -(wc + b.d) WHEN wc + b.d >= n THEN 2 * n - 2 - wc - b.d ELSE wc + b.d END AS c FROM wn{tag}, ow{tag} a, ow{tag} b),
  z{tag} AS (SELECT f.site, f.scene, wr, wc, dr, dc, CAST(floor(coalesce(least(greatest(p.prob, 0), 1), 0) * 15) AS BIGINT) AS q FROM f{tag} f LEFT JOIN {{px}} p ON p.site = f.site AND p.scene = f.scene AND p.r = f.r AND p.c = f.c),
  pr{tag} AS (SELECT x.site, x.scene, x.wr, x.wc, x.q AS i, y.q AS j FROM z{tag} x JOIN z{tag} y ON {same}),
  g{tag} AS (SELECT site, scene, wr, wc, i, j, count(*) / CAST({2 * size * (size - 1)} AS DOUBLE) AS p FROM (SELECT * FROM pr{tag} UNION ALL SELECT site, scene, wr, wc, j, i FROM pr{tag}) u GROUP BY 1, 2, 3, 4, 5, 6),
  tx{tag} AS (SELECT site, scene, wr, wc, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sqrt(sum(p * p)) AS energy, -sum(p * log2(p + 1e-10)) AS entropy FROM g{tag} GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_windows(5)} SELECT site, scene, wr AS r, wc AS c, round(contrast, 5) AS contrast, round(dissimilarity, 5) AS dissimilarity, round(homogeneity, 5) AS homogeneity, round(energy, 5) AS energy, round(entropy, 5) AS entropy FROM tx JOIN {{px}} p USING (site, scene) WHERE p.r = wr AND p.c = wc")
def glcm_patch(v):
    names = ["contrast", "dissimilarity", "homogeneity", "energy", "entropy"]
    out = O.texture(v.px, ["site", "scene"], "prob", (v.side, v.side), 5, 16, 4, names)
    return out.where("r % 4 = 0 AND c % 4 = 0").select("site", "scene", "r", "c", *(F.round(n, 5).alias(n) for n in names))


_AT = "ON {t}.site = p.site AND {t}.scene = p.scene AND {t}.wr = p.r - p.r % 4 AND {t}.wc = p.c - p.c % 4"


@query(f"WITH {_windows(5)} SELECT p.site, p.scene, p.r, p.c, round(contrast, 5) AS contrast, round(entropy, 5) AS entropy FROM {{px}} p JOIN tx {_AT.format(t='tx')}")
def texture_map(v):
    out = O.texture(v.px, ["site", "scene"], "prob", (v.side, v.side), 5, 16, 4, ["contrast", "entropy"], tile=16)
    return out.select("site", "scene", "r", "c", F.round("contrast", 5).alias("contrast"), F.round("entropy", 5).alias("entropy"))


_SIZES = (3, 5, 7)


@query(f"WITH {', '.join(_windows(n, str(n)) for n in _SIZES)} SELECT p.site, p.scene, p.r, p.c, {', '.join(f'round(tx{n}.{x}, 5) AS {x}_w{n}' for n in _SIZES for x in ('entropy', 'contrast'))} FROM {{px}} p {' '.join(f'JOIN tx{n} ' + _AT.format(t=f'tx{n}') for n in _SIZES)}")
def texture_multiscale(v):
    out = O.multiscale_texture(v.px, ["site", "scene"], "prob", (v.side, v.side))
    return out.select("site", "scene", "r", "c", *(F.round(x, 5).alias(x) for x in out.columns[4:]))


@query("""WITH h AS (SELECT r AS hr, c AS hc FROM {dem} WHERE (r * 7 + c) % 11 = 0), g AS (SELECT * FROM {dem} WHERE (r * 7 + c) % 11 <> 0),
  d AS (SELECT hr, hc, elev, row_number() OVER (PARTITION BY hr, hc ORDER BY (r - hr) * (r - hr) + (c - hc) * (c - hc), r, c) AS n FROM h JOIN g ON abs(r - hr) <= 3 AND abs(c - hc) <= 3 AND (r - hr) * (r - hr) + (c - hc) * (c - hc) <= 9)
  SELECT hr AS r, hc AS c, round(elev, 6) AS elev FROM d WHERE n = 1""")
def fill_nearest(v):
    gone = (F.col("r") * 7 + F.col("c")) % 11 == 0
    return O.fill_nearest(v.dem.where(~gone), [], v.dem.where(gone).select("r", "c"), "elev", 3).withColumn("elev", F.round("elev", 6))


@query("""WITH ex AS (SELECT max(r) AS h, max(c) AS w FROM {dem}), x AS (SELECT d.*, (r * 7 + c) % 11 = 0 OR (4 * r BETWEEN h AND 3 * h AND 8 * c BETWEEN w AND 7 * w) AS gone FROM {dem} d, ex),
  n AS (SELECT a.r, a.c, b.r AS near_r, b.c AS near_c, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS d2, b.elev, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c), b.r, b.c) AS n FROM x a JOIN x b ON a.gone AND NOT b.gone)
  SELECT r, c, near_r, near_c, d2, round(elev, 6) AS elev FROM n WHERE n = 1""")
def fill_nearest_far(v):
    """The middle of the ground is gone: the nearest cell left, however far."""
    h, w = (x - 1 for x in extent(v))
    gone = ((F.col("r") * 7 + F.col("c")) % 11 == 0) | ((4 * F.col("r")).between(h, 3 * h) & (8 * F.col("c")).between(w, 7 * w))
    out = nearest_cell(v.dem.where(~gone), [], v.dem.where(gone).select("r", "c"), "elev")
    return out.select("r", "c", "near_r", "near_c", "d2", F.round("near_value", 6).alias("elev"))


@query("""WITH n AS (SELECT a.site, a.scene, a.r, a.c, a.target, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d2 FROM {px} a JOIN {px} b ON b.site = a.site AND b.scene = a.scene AND b.target <> a.target GROUP BY 1, 2, 3, 4, 5)
  SELECT site, scene, r, c, target, d2 FROM n""")
def boundary_distance(v):
    """The squared distance of every pixel from the nearest one of the other class."""
    return class_distance(v.px.select("site", "scene", "r", "c", "target"), ["site", "scene"], "target").select("site", "scene", "r", "c", "target", "d2")
