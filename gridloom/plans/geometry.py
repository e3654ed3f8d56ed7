"""Queries on grids in space."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import geometry as G
from gridloom.operators.pixels import scene_pairs
from gridloom.registry import query
from gridloom.sources.scratch import stored

PI = math.pi


@query("SELECT id, round(radians(lon0) * 3396190, 3) AS x, round(radians(lat0) * 3396190, 3) AS y FROM {footprint}")
def lonlat_m(v):
    return v.footprint.select("id", F.round(S.to_metres(F.col("lon0")), 3).alias("x"), F.round(S.to_metres(F.col("lat0")), 3).alias("y"))


@query("SELECT id, round(degrees(id * 1000.0 / 3396190), 9) AS lon FROM {footprint}")
def m_lonlat(v):
    return v.footprint.select("id", F.round(S.to_degrees(F.col("id") * 1000.0), 9).alias("lon"))


@query("SELECT id, round(CASE WHEN lon0 > 180 THEN lon0 - 360 ELSE lon0 END, 6) AS signed, round(lon1 - 360 * floor(lon1 / 360), 6) AS positive, round(360 - lon0, 6) AS east FROM {footprint}")
def lon_wrap(v):
    r = lambda c, n: F.round(c, 6).alias(n)
    return v.footprint.select("id", r(S.wrap_180(F.col("lon0")), "signed"), r(S.wrap_360(F.col("lon1")), "positive"), r(S.west_to_east(F.col("lon0")), "east"))


@query("SELECT site, scene, r, c, round(1000 + (c + 0.5) * 6, 3) AS x, round(5000 - (r + 0.5) * 6, 3) AS y FROM {px}")
def pixel_to_map(v):
    return v.px.select("site", "scene", "r", "c", F.round(S.pixel_to_map(F.lit(6.0), F.lit(1000.0), F.col("c")), 3).alias("x"), F.round(S.pixel_to_map(F.lit(-6.0), F.lit(5000.0), F.col("r")), 3).alias("y"))


@query("SELECT id, CAST(floor((lon0 - 0) / 0.5) AS BIGINT) AS col, CAST(floor((lat0 - 90) / -0.5) AS BIGINT) AS row FROM {footprint}")
def map_to_pixel(v):
    return v.footprint.select("id", S.map_to_pixel(F.lit(0.5), F.lit(0.0), F.col("lon0")).alias("col"), S.map_to_pixel(F.lit(-0.5), F.lit(90.0), F.col("lat0")).alias("row"))


@query("SELECT id, [[lon0, lat0], [lon1, lat0], [lon1, lat1], [lon0, lat1], [lon0, lat0]] AS ring FROM {footprint}")
def footprint(v):
    return v.footprint.select("id", S.ring(*map(F.col, ("lon0", "lat0", "lon1", "lat1"))).alias("ring"))


@query("SELECT avg((lon0 + lon1) / 2) AS lon, avg((lat0 + lat1) / 2) AS lat, min(lon0) AS west, min(lat0) AS south, max(lon1) AS east, max(lat1) AS north FROM {sites}")
def extent_union(v):
    return v.sites.agg(F.avg((F.col("lon0") + F.col("lon1")) / 2).alias("lon"), F.avg((F.col("lat0") + F.col("lat1")) / 2).alias("lat"), F.min("lon0").alias("west"), F.min("lat0").alias("south"), F.max("lon1").alias("east"), F.max("lat1").alias("north"))


_W = {
    "hanning": "greatest((0.5 - 0.5 * cos(2 * pi() * i / 7)) * (0.5 - 0.5 * cos(2 * pi() * j / 7)), 1e-6)",
    "linear": "greatest(1 - abs(i - 3.5) / 4, 1e-6) * greatest(1 - abs(j - 3.5) / 4, 1e-6)",
    "gaussian": "greatest(exp(-0.5 * (power((i - 3.5) / (0.35 * 8), 2) + power((j - 3.5) / (0.35 * 8), 2))), 1e-6)",
}
for _m, _sql in _W.items():

    @query(f"SELECT vec_id, k // 8 AS i, k % 8 AS j, round({_sql}, 6) AS w, round(p * ({_sql}), 6) AS weighted FROM (SELECT vec_id, CAST(p AS DOUBLE) AS p, k, k // 8 AS i, k % 8 AS j FROM (SELECT vec_id, unnest(embedding) AS p, unnest(range(0, 64)) AS k FROM embeddings) e) f", name=f"weights_{_m}")
    def _weights(v, m=_m):
        cells = v.embeddings.select("vec_id", F.posexplode("embedding").alias("k", "p")).select("vec_id", F.col("p").cast("double").alias("p"), F.floor(F.col("k") / 8).alias("i"), (F.col("k") % 8).cast("long").alias("j"))
        w = S.blend_weight(m, F.col("i"), F.col("j"), 8)
        return cells.select("vec_id", "i", "j", F.round(w, 6).alias("w"), F.round(F.col("p") * w, 6).alias("weighted"))


_TILES = "t AS (SELECT r0, c0 FROM (SELECT DISTINCT least(i * 8, side - 16) AS r0 FROM {grid_side}, range(0, 1000) a(i) WHERE i * 8 <= side) x, (SELECT DISTINCT least(i * 8, side - 16) AS c0 FROM {grid_side}, range(0, 1000) a(i) WHERE i * 8 <= side) y)"
_PLACES = """gr AS (SELECT site, scene, max(r) + 1 AS h, max(c) + 1 AS wd, greatest(max(r) - 15, 0) AS lr, greatest(max(c) - 15, 0) AS lc FROM {px} GROUP BY 1, 2),
  tp AS (SELECT DISTINCT site, scene, h, wd, least(i * 8, lr) AS r0, least(j * 8, lc) AS c0 FROM (SELECT *, unnest(range(0, lc // 8 + 2)) AS j FROM (SELECT *, unnest(range(0, lr // 8 + 2)) AS i FROM gr) a) b)"""


def places(v):
    grids = v.px.groupBy("site", "scene").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    return G.tile_places(grids, ["site", "scene"], 16, 8)


@query(f"WITH {_PLACES} SELECT site, scene, r0, c0 FROM tp")
def tile_coords(v):
    return places(v)


_EMB = "e AS (SELECT (vec_id // 25) * 4 AS r0, (vec_id % 25) * 4 AS c0, list_transform(embedding, lambda x: 1 / (1 + exp(-10 * CAST(x AS DOUBLE)))) AS d FROM embeddings), f AS (SELECT r0, c0, unnest(d) AS p, unnest(range(0, 64)) AS k FROM e), g AS (SELECT r0 + k // 8 AS r, c0 + k % 8 AS c, p, k // 8 AS i, k % 8 AS j FROM f)"


@query(f"WITH {_EMB} SELECT r, c, round(least(greatest(sum(p * {_W['hanning']}) / sum({_W['hanning']}), 0), 1), 6) AS prob FROM g GROUP BY r, c")
def blend_hanning(v):
    e = v.embeddings.select((F.floor(F.col("vec_id") / 25) * 4).alias("r0"), (F.col("vec_id") % 25 * 4).alias("c0"), F.transform("embedding", lambda x: S.sigmoid(x.cast("double") * 10)).alias("data"))
    return G.blend(e, [], 8).withColumn("prob", F.round("prob", 6))


_BIL = """a AS (SELECT tr, tc, y, x, CAST(floor(y) AS BIGINT) AS y0, CAST(floor(x) AS BIGINT) AS x0 FROM t), b AS (SELECT tr, tc, y0 + i AS r, x0 + j AS c, (CASE WHEN i = 1 THEN y - y0 ELSE 1 - y + y0 END) * (CASE WHEN j = 1 THEN x - x0 ELSE 1 - x + x0 END) AS w FROM a, (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j)),
  o AS (SELECT tr, tc, round(CASE WHEN count(*) = count(elev) THEN sum(w * elev) END, 4) AS elev FROM b LEFT JOIN {dem} d USING (r, c) WHERE w > 0 GROUP BY tr, tc)"""


def _dim(height: str = "h", width: str = "wd") -> str:
    return f"n AS (SELECT max(r) + 1 AS h, max(c) + 1 AS wd FROM {{dem}}), g0 AS (SELECT *, unnest(range(0, tw)) AS tc FROM (SELECT *, unnest(range(0, th)) AS tr FROM (SELECT h, wd, {height} AS th, {width} AS tw FROM n) a) b)"


_ZOOM = "t AS (SELECT tr, tc, tr * (CAST(h - 1 AS DOUBLE) / (th - 1)) AS y, tc * (CAST(wd - 1 AS DOUBLE) / (tw - 1)) AS x FROM g0)"


def extent(v):
    x = v.dem.agg(F.max("r"), F.max("c")).first()
    return x[0] + 1, x[1] + 1


def finer(v) -> tuple[tuple[int, int], tuple[int, int]]:
    """The raster's size and half as much again on each side."""
    h, w = extent(v)
    return (h, w), (h * 3 // 2, w * 3 // 2)


@query(f"WITH {_dim('h * 3 // 2', 'wd * 3 // 2')}, {_ZOOM}, {_BIL} SELECT * FROM o")
def resize_bilinear(v):
    return G.bilinear(v.dem, [], "elev", G.zoom_targets(v.spark, *finer(v))).withColumn("elev", F.round("elev", 4))


@query(f"WITH {_dim('h * 3 // 2', 'wd * 3 // 2')}, {_ZOOM} SELECT tr, tc, elev FROM t LEFT JOIN {{dem}} d ON d.r = floor(y + 0.5) AND d.c = floor(x + 0.5)")
def resize_nearest(v):
    return G.nearest(v.dem, [], "elev", G.zoom_targets(v.spark, *finer(v)))


@query(f"WITH {_dim('2 * h', '2 * wd')}, t AS (SELECT tr, tc, 0.5 * tr + 0.25 AS y, 0.5 * tc - 0.25 AS x FROM g0), {_BIL} SELECT * FROM o")
def reproject_bilinear(v):
    h, w = extent(v)
    at = G.affine_targets(G.grid(v.spark, 2 * h, 2 * w), 0.5, 0.0, -0.25, 0.0, 0.5, 0.25)
    return G.bilinear(v.dem, [], "elev", at).withColumn("elev", F.round("elev", 4))


_PAIRS = "p AS (SELECT * FROM (SELECT site, scene AS t0, lead(scene) OVER (PARTITION BY site ORDER BY scene) AS t1 FROM (SELECT DISTINCT site, scene FROM {px}) s) u WHERE t1 IS NOT NULL)"


def paired(v) -> tuple[DataFrame, DataFrame]:
    """The pixels of the earlier (t0) and of the later (t1) scene of every pair of scenes. Pixels are made once."""
    px = stored(v.px.select("site", "scene", "r", "c", "red"), "px")
    pairs = scene_pairs(px.select("site", "scene").distinct(), ["site"], "scene")
    before, after = (px.join(pairs.withColumn("scene", F.col(t)), ["site", "scene"]).select("site", "t0", "t1", "r", "c", "red") for t in ("t0", "t1"))
    return before, after


@query(f"WITH {_PAIRS} SELECT p.site, p.t0, p.t1, a.r, a.c, b.red FROM p JOIN {{px}} a ON a.site = p.site AND a.scene = t0 JOIN {{px}} b ON b.site = p.site AND b.scene = t1 AND b.r = a.r AND b.c = a.c")
def align_nearest(v):
    """Each later scene on the cells of the one before it."""
    keys = ["site", "t0", "t1"]
    before, after = paired(v)
    at = before.select(*keys, F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("r").cast("double").alias("y"), F.col("c").cast("double").alias("x"))
    out = G.nearest(after, keys, "red", at).where("red IS NOT NULL")
    return out.select(*keys, F.col("tr").alias("r"), F.col("tc").alias("c"), "red")


@query(f"WITH {_dim()} SELECT tr, tc, elev FROM g0 LEFT JOIN {{dem}} d ON d.r = tr + 2 AND d.c = tc + 3")
def warp_affine(v):
    return G.bilinear(v.dem, [], "elev", G.affine_targets(G.grid(v.spark, *extent(v)), 1.0, 0.0, 3.0, 0.0, 1.0, 2.0))


@query(f"WITH {_dim()}, t AS (SELECT tr, tc, cos(radians(15)) * tr - sin(radians(15)) * tc + 4 AS y, cos(radians(15)) * tc + sin(radians(15)) * tr + 1 AS x FROM g0), {_BIL} SELECT * FROM o")
def augment_affine(v):
    t = math.radians(15)
    at = G.affine_targets(G.grid(v.spark, *extent(v)), math.cos(t), math.sin(t), 1.0, -math.sin(t), math.cos(t), 4.0)
    return G.bilinear(v.dem, [], "elev", at).withColumn("elev", F.round("elev", 4))


@query("WITH n AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM {dem}), x AS (SELECT CAST(ceil(h / 16.0) * 16 AS BIGINT) AS ph, CAST(ceil(w / 16.0) * 16 AS BIGINT) AS pw, h, w FROM n) SELECT CAST(i AS BIGINT) AS r, CAST(j AS BIGINT) AS c, elev FROM x, range(0, 400) a(i), range(0, 400) b(j), {dem} d WHERE i < ph AND j < pw AND d.r = CASE WHEN i < h THEN i ELSE 2 * h - 2 - i END AND d.c = CASE WHEN j < w THEN j ELSE 2 * w - 2 - j END")
def pad_multiple(v):
    return G.pad(v.dem, [], extent(v), 16).select("r", "c", "elev")


_PATCH = "m AS (SELECT site, scene, r, c FROM {px} WHERE prob >= 0.7), t2 AS (SELECT r0, c0 FROM t WHERE r0 % 16 = 0 AND c0 % 16 = 0), fg AS (SELECT site, scene, r0, c0, count(*) AS n FROM m JOIN t ON r >= r0 AND r < r0 + 16 AND c >= c0 AND c < c0 + 16 GROUP BY 1, 2, 3, 4)"


def fg_patches(v):
    m = v.px.where("prob >= 0.7").select("site", "scene", "r", "c")
    return G.patches(m, ["site", "scene"], (v.side, v.side), 16, 8)


@query(f"WITH {_TILES}, {_PATCH} SELECT site, scene, CAST(r0 AS BIGINT) AS r0, CAST(c0 AS BIGINT) AS c0, n, n / CAST(256 AS DOUBLE) AS fraction FROM fg WHERE n / 256.0 >= 0.1")
def patch_fg(v):
    return fg_patches(v).where("fraction >= 0.1")


@query(f"WITH {_TILES}, {_PATCH}, f AS (SELECT * FROM fg WHERE n / 256.0 >= 0.1), w AS (SELECT site, scene, greatest(count(*) // 3, 1) AS k FROM f GROUP BY 1, 2), e AS (SELECT s.site, s.scene, t2.r0, t2.c0, row_number() OVER (PARTITION BY s.site, s.scene ORDER BY t2.r0, t2.c0) AS n FROM (SELECT DISTINCT site, scene FROM {{px}}) s CROSS JOIN t2 LEFT JOIN f ON f.site = s.site AND f.scene = s.scene AND f.r0 = t2.r0 AND f.c0 = t2.c0 WHERE f.site IS NULL) SELECT site, scene, CAST(r0 AS BIGINT) AS r0, CAST(c0 AS BIGINT) AS c0 FROM e JOIN w USING (site, scene) WHERE n <= k")
def patch_bg(v):
    fg = fg_patches(v).where("fraction >= 0.1")
    grids = v.px.select("site", "scene").distinct().withColumns({"height": F.lit(v.side), "width": F.lit(v.side)})
    return G.background(G.tile_places(grids, ["site", "scene"], 16, 8).where("r0 % 16 = 0 AND c0 % 16 = 0"), fg, ["site", "scene"])


def _unit(text: str) -> str:
    """The SQL of ``unit_hash`` for the text that is hashed."""
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / CAST({1 << 52} AS DOUBLE))"


@query(f"""WITH a AS (SELECT site, scene, CAST(floor({_unit("'1|' || site || '|' || scene || '|' || k")} * (side - 7)) AS BIGINT) AS r0, CAST(floor({_unit("'2|' || site || '|' || scene || '|' || k")} * (side - 7)) AS BIGINT) AS c0 FROM (SELECT DISTINCT site, scene FROM {{px}}) s, {{grid_side}}, range(0, 10) q(k))
  SELECT site, scene, r0, c0, count(*) AS count FROM a JOIN {{px}} p USING (site, scene) WHERE prob >= 0.5 AND r >= r0 AND r < r0 + 8 AND c >= c0 AND c < c0 + 8 GROUP BY 1, 2, 3, 4 HAVING count(*) BETWEEN 8 AND 56""")
def patch_random(v):
    at = v.px.select("site", "scene").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    at = at.select("site", "scene", *(F.floor(G.unit_hash(s, "site", "scene", "k") * (v.side - 7)).cast("long").alias(n) for s, n in ((1, "r0"), (2, "c0"))))
    m = v.px.where("prob >= 0.5").select("site", "scene", "r", "c")
    hit = m.join(at, ["site", "scene"]).where("r >= r0 AND r < r0 + 8 AND c >= c0 AND c < c0 + 8")
    return hit.groupBy("site", "scene", "r0", "c0").count().where(F.col("count").between(8, 56))


_DIH = " UNION ALL ".join(f"SELECT vec_id, CAST({k + 4 * f} AS BIGINT) AS variant, {a} AS r, {('7 - (' + b + ')') if f else b} AS c, p FROM g" for f in (0, 1) for k, (a, b) in enumerate([("i", "j"), ("7 - j", "i"), ("7 - i", "7 - j"), ("j", "7 - i")]))


@query(f"WITH f AS (SELECT vec_id, unnest(embedding) AS p, unnest(range(0, 64)) AS k FROM embeddings), g AS (SELECT vec_id, p, k // 8 AS i, k % 8 AS j FROM f), u AS ({_DIH}) SELECT vec_id, variant, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, p FROM u")
def augment_dihedral(v):
    x = v.embeddings.select("vec_id", F.posexplode("embedding").alias("k", "p")).select("vec_id", "p", F.floor(F.col("k") / 8).alias("r"), (F.col("k") % 8).alias("c"))
    return G.dihedral(x, 8)


@query(f"""SELECT site, scene, r, c, round(prob * (1 + ({_unit("'7|' || site || '-' || scene")} * 2 - 1) * 0.2) + ({_unit("'8|' || site || '-' || scene")} * 2 - 1) * 0.2, 6) AS prob FROM {{px}}""")
def augment_bc(v):
    out = G.jitter(v.px.withColumn("patch", F.concat_ws("-", "site", "scene")), "patch", "prob", 0.2, 7)
    return out.select("site", "scene", "r", "c", F.round("prob", 6).alias("prob"))


_NB = "greatest(side // 10, 1)"


@query(f"SELECT site, scene, r, c, least(r // 10, {_NB} - 1) * {_NB} + least(c // 10, {_NB} - 1) AS block_id, (least(r // 10, {_NB} - 1) * {_NB} + least(c // 10, {_NB} - 1)) % 5 AS fold FROM {{px}}, {{grid_side}}")
def fold_pixels(v):
    return v.px.select("site", "scene", "r", "c").withColumns(G.block_fold(F.col("r"), F.col("c"), (v.side, v.side), 10, 5))


@query(f"WITH {_PLACES} SELECT site, scene, r0, c0, CAST((least((r0 + 8) // 10, {_NB} - 1) * {_NB} + least((c0 + 8) // 10, {_NB} - 1)) % 5 AS BIGINT) AS fold FROM tp, {{grid_side}}")
def fold_patches(v):
    return places(v).withColumn("fold", G.block_fold(F.col("r0") + 8, F.col("c0") + 8, (v.side, v.side), 10, 5)["fold"])


@query("WITH p AS (SELECT site, scene, avg(CASE WHEN prob >= 0.7 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS f FROM {px} GROUP BY 1, 2), w AS (SELECT *, CASE WHEN f > 0.14 THEN CAST(1 AS DOUBLE) ELSE 0.3 END AS w FROM p) SELECT site, scene, round(w / sum(w) OVER (), 6) AS weight FROM w")
def weights_fg(v):
    p = v.px.groupBy("site", "scene").agg(F.avg(F.when(F.col("prob") >= 0.7, 1.0).otherwise(0.0)).alias("f")).withColumn("w", F.when(F.col("f") > 0.14, 1.0).otherwise(0.3))
    return p.crossJoin(p.agg(F.sum("w").alias("s"))).select("site", "scene", F.round(F.col("w") / F.col("s"), 6).alias("weight"))  # the sum is one row


@query(f"""WITH w AS (SELECT doc_id, CASE WHEN target > 0 THEN CAST(1 AS DOUBLE) ELSE 0.3 END AS w FROM {{scored}}), c AS (SELECT doc_id, (sum(w) OVER (ORDER BY doc_id) - w) / sum(w) OVER () AS low, sum(w) OVER (ORDER BY doc_id) / sum(w) OVER () AS high FROM w),
  d AS (SELECT k AS draw, {_unit("'11|' || k")} AS u FROM range(0, 500) q(k)) SELECT draw, doc_id FROM d JOIN c ON u >= low AND u < high""")
def weighted_sample(v):
    w = v.scored.select("doc_id", F.when(F.col("target") > 0, 1.0).otherwise(0.3).alias("w"))
    return G.weighted_draw(w, "doc_id", "w", 500, 11)


@query(f"""WITH u AS (SELECT doc_id, row_number() OVER (ORDER BY {_unit("'3|' || doc_id")}, doc_id) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT doc_id FROM {{scored}}) d) SELECT doc_id, CASE WHEN n <= greatest(1, floor(0.2 * total)) THEN 'val' ELSE 'train' END AS split FROM u""")
def split_random(v):
    return G.random_split(v.scored.select("doc_id"), "doc_id", 0.2, 3)


@query("SELECT site, scene, CASE WHEN scene BETWEEN 1992 AND 1995 THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT site, scene FROM {px}) s WHERE scene BETWEEN 1992 AND 1995 OR scene BETWEEN 1997 AND 1998")
def split_temporal(v):
    return G.temporal_split(v.px.select("site", "scene").distinct(), "scene", (1992, 1995), (1997, 1998))


@query("SELECT site, scene, CASE WHEN n <= floor(total * CAST(0.6 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM (SELECT site, scene, row_number() OVER (ORDER BY site, scene) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT site, scene FROM {px}) s) u")
def split_by_place(v):
    """No year is in either range: the first 60 % by place are for training."""
    return G.temporal_split(v.px.select("site", "scene").distinct(), "scene", (2005, 2010), (2015, 2020), ["site", "scene"])


@query(f"WITH {_PAIRS}, o AS (SELECT i AS d FROM range(-2, 3) a(i)), m AS (SELECT p.site, t0, t1, r + a.d AS r, c + b.d AS c, a.d AS dr, b.d AS dc, red AS m FROM p JOIN {{px}} x ON x.site = p.site AND x.scene = t1, o a, o b) SELECT m.site, t0, t1, dr, dc, round(CASE WHEN isnan(corr(red, m)) THEN NULL ELSE corr(red, m) END, 5) AS score FROM m JOIN {{px}} f ON f.site = m.site AND f.scene = t0 AND f.r = m.r AND f.c = m.c GROUP BY 1, 2, 3, 4, 5")
def register_shift(v):
    """Every later scene against the one before it."""
    out = G.register_shift(*paired(v), "red", 2, ["site", "t0", "t1"])
    return out.withColumn("score", F.round(F.nanvl("score", F.lit(None).cast("double")), 5))


@query(f"""WITH {_PAIRS}, o AS (SELECT i AS d FROM range(-3, 4) a(i)), n AS (SELECT i AS d FROM range(-1, 2) a(i)), h AS (SELECT site, scene, r // 2 AS r, c // 2 AS c, avg(red) AS red FROM {{px}} GROUP BY 1, 2, 3, 4),
  sh AS (SELECT p.site, t0, t1, a.d AS dr, b.d AS dc, corr(f.red, m.red) AS s FROM p, o a, o b JOIN h m ON m.site = p.site AND m.scene = t1 JOIN h f ON f.site = p.site AND f.scene = t0 AND f.r = m.r + a.d AND f.c = m.c + b.d GROUP BY 1, 2, 3, 4, 5),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, t0, t1 ORDER BY round(s, 6) DESC, dr * dr + dc * dc, dr, dc) AS n FROM sh WHERE s IS NOT NULL AND NOT isnan(s)) q WHERE n <= 3),
  cd AS (SELECT DISTINCT site, t0, t1, 2 * dr + a.d AS dr, 2 * dc + b.d AS dc FROM k, n a, n b WHERE abs(2 * dr + a.d) <= 6 AND abs(2 * dc + b.d) <= 6),
  sc AS (SELECT cd.site, t0, t1, dr, dc, corr(f.red, m.red) AS s FROM cd JOIN {{px}} m ON m.site = cd.site AND m.scene = t1 JOIN {{px}} f ON f.site = cd.site AND f.scene = t0 AND f.r = m.r + dr AND f.c = m.c + dc GROUP BY 1, 2, 3, 4, 5)
  SELECT site, t0, t1, dr, dc, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY site, t0, t1 ORDER BY round(s, 6) DESC, dr * dr + dc * dc, dr, dc) AS n FROM sc WHERE s IS NOT NULL AND NOT isnan(s)) q WHERE n = 1""")
def register_pyramid(v):
    """Every later scene against the one before it, by halves of the resolution first."""
    return G.register_pyramid(*paired(v), "red", 6, ["site", "t0", "t1"]).withColumn("score", F.round("score", 5))


@query(f"WITH {_PAIRS}, o AS (SELECT i AS d FROM range(-2, 3) a(i)), sc AS (SELECT p.site, t0, t1, a.d AS dr, b.d AS dc, corr(f.red, m.red) AS s FROM p, o a, o b JOIN {{px}} m ON m.site = p.site AND m.scene = t1 JOIN {{px}} f ON f.site = p.site AND f.scene = t0 AND f.r = m.r + a.d AND f.c = m.c + b.d GROUP BY 1, 2, 3, 4, 5) SELECT site, t0, t1, dr, dc FROM (SELECT *, row_number() OVER (PARTITION BY site, t0, t1 ORDER BY round(s, 6) DESC, dr * dr + dc * dc, dr, dc) AS n FROM sc WHERE s IS NOT NULL AND NOT isnan(s)) q WHERE n = 1")
def register_best(v):
    """The best of all shifts within two cells, as the pyramid finds it at that reach."""
    return G.register_pyramid(*paired(v), "red", 2, ["site", "t0", "t1"]).drop("score")


_SEED = "sd AS (SELECT p_partkey AS id, p_partkey % 30 AS r, p_partkey * 7 % 30 AS c, ((p_partkey % 3) - 1) * CAST(0.5 AS DOUBLE) + 0.25 AS dr, CAST(0.75 AS DOUBLE) AS dc, p_size % 8 AS length FROM part)"


def seeds(v):
    return v.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 30).alias("r"), (F.col("p_partkey") * 7 % 30).alias("c"), ((F.col("p_partkey") % 3 - 1) * 0.5 + 0.25).alias("dr"), F.lit(0.75).alias("dc"), (F.col("p_size") % 8).alias("length"))


@query(f"WITH {_SEED}, l AS (SELECT id, CAST(trunc(r + k * dr) AS BIGINT) AS r, CAST(trunc(c + k * dc) AS BIGINT) AS c FROM sd, range(0, 8) a(k) WHERE k < length), o(d) AS (VALUES (-2), (-1), (0), (1)) SELECT DISTINCT id, r + a.d AS r, c + b.d AS c FROM l, o a, o b WHERE r + a.d BETWEEN 0 AND 31 AND c + b.d BETWEEN 0 AND 31")
def draw_channels(v):
    return G.draw_channels(seeds(v), (32, 32), 3)


@query(f"WITH {_SEED}, o(d) AS (VALUES (-2), (-1), (0), (1), (2)) SELECT DISTINCT id, r + a.d AS r, c + b.d AS c FROM sd, o a, o b WHERE a.d * a.d + b.d * b.d <= 4 AND r + a.d BETWEEN 0 AND 31 AND c + b.d BETWEEN 0 AND 31")
def draw_discs(v):
    return G.draw_discs(seeds(v), (32, 32), 2)


@query("SELECT p.site, p.scene, p.r, p.c, p.red, p.prob, q.red AS red_before, d.elev FROM {px} p LEFT JOIN {px} q ON q.site = p.site AND q.scene = p.scene - 1 AND q.r = p.r AND q.c = p.c LEFT JOIN {dem} d ON d.r = p.r AND d.c = p.c")
def feature_stack(v):
    before = v.px.select("site", (F.col("scene") + 1).alias("scene"), "r", "c", F.col("red").alias("red_before"))
    return v.px.select("site", "scene", "r", "c", "red", "prob").join(before, ["site", "scene", "r", "c"], "left").join(v.dem, ["r", "c"], "left")


@query("SELECT a.vec_id FROM embeddings a JOIN (SELECT vec_id FROM embeddings WHERE label % 2 = 0) b USING (vec_id)")
def patch_match(v):
    return v.embeddings.select("vec_id").join(v.embeddings.where("label % 2 = 0").select("vec_id"), "vec_id")
