"""Queries on pixels: scans, indices, masks, change, composites and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import pixels as P
from gridloom.registry import query


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


@query("SELECT site, scene, r, c, round(CASE WHEN x IS NULL OR isnan(x) OR x = -1.0 / 0 THEN 0 WHEN x = 1.0 / 0 THEN 1 ELSE x END, 6) AS x FROM (SELECT *, CASE r % 4 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN NULL ELSE prob END AS x FROM {px}) u".replace("-1.0 / 0", "CAST('-inf' AS DOUBLE)").replace("1.0 / 0", "CAST('inf' AS DOUBLE)"))
def scan_scrub(v):
    x = F.when(F.col("r") % 4 == 0, float("nan")).when(F.col("r") % 4 == 1, float("inf")).when(F.col("r") % 4 == 2, None).otherwise(F.col("prob"))
    return v.px.select("site", "scene", "r", "c", F.round(S.scrub(x), 6).alias("x"))


@query("SELECT site, scene, r, c FROM {px} WHERE target > 0")
def mask_scan(v):
    return v.px.where("target > 0").select("site", "scene", "r", "c")


@query("SELECT site, scene, r - 4 AS r, c - 3 AS c, red FROM {px} WHERE r BETWEEN 4 AND 9 AND c BETWEEN 3 AND 8")
def bbox_window(v):
    return v.px.where(F.col("r").between(4, 9) & F.col("c").between(3, 8)).select("site", "scene", (F.col("r") - 4).alias("r"), (F.col("c") - 3).alias("c"), "red")


@query("SELECT site, scene, CAST(floor(r / 2.0) AS BIGINT) AS r, CAST(floor(c / 2.0) AS BIGINT) AS c, round(avg(red), 6) AS red FROM {px} GROUP BY 1, 2, 3, 4")
def downsample_avg(v):
    return P.block_average(v.px, ["site", "scene"], "red", 2).withColumn("red", F.round("red", 6))


@query("SELECT site, scene, r * o // side AS r, c * o // side AS c, round(avg(red), 6) AS red FROM {px}, (SELECT side, least(side, greatest(64, CAST(floor(side * (CAST(side * 2 // 3 AS DOUBLE) / side)) AS BIGINT))) AS o FROM {grid_side}) g GROUP BY 1, 2, 3, 4")
def downsample_longest(v):
    """At most two thirds of the cells a side, at least 64 where there are as many."""
    return P.downsample(v.px, ["site", "scene"], "red", v.side, v.side * 2 // 3).withColumn("red", F.round("red", 6))


_ORIGIN, _SPAN = (0.0, 5335046.0), 21344000.0
_CUT = "CAST(trunc({x}) AS BIGINT)"


@query(f"""WITH n AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM {{dem}}), m AS (SELECT site, h, w, CAST({_SPAN} AS DOUBLE) / w AS px, CAST({_SPAN} AS DOUBLE) / 2 / h AS py, radians(lon0) * 3396190.0 AS x0, radians(lon1) * 3396190.0 AS x1, radians(lat0) * 3396190.0 AS y0, radians(lat1) * 3396190.0 AS y1 FROM {{sites}}, n),
  a AS (SELECT *, greatest(0, least({_CUT.format(x='(5335046.0 - y1) / py')}, h - 1)) AS r0, {_CUT.format(x='(5335046.0 - y0) / py')} + 1 AS rr, greatest(0, least({_CUT.format(x='x0 / px')}, w - 1)) AS c0, {_CUT.format(x='x1 / px')} + 1 AS cc FROM m),
  b AS (SELECT *, greatest(r0 + 1, least(rr, h)) AS r1, greatest(c0 + 1, least(cc, w)) AS c1 FROM a)
  SELECT site, d.r - r0 AS r, d.c - c0 AS c, elev, round(c0 * px, 3) AS x0, round(5335046.0 - r0 * py, 3) AS y0 FROM b JOIN {{dem}} d ON d.r >= r0 AND d.r < r1 AND d.c >= c0 AND d.c < c1""")
def bbox_degrees(v):
    """The cells of the terrain in the box of degrees of every site, and where each window begins."""
    h, w = (x + 1 for x in v.dem.agg(F.max("r"), F.max("c")).first())
    box = P.degree_window([F.col(x) for x in ("lon0", "lat0", "lon1", "lat1")], _ORIGIN, (_SPAN / w, _SPAN / 2 / h), (h, w))
    windows = v.sites.select("site", *(c.alias(k) for k, c in box.items()))
    cells = P.read_windows(v.dem, windows, "site")
    return cells.join(windows.select("site", F.round("x0", 3).alias("x0"), F.round("y0", 3).alias("y0")), "site")


@query("SELECT site, scene, r, c, round((blue - red) / (blue + red + 1e-8), 6) AS ndsi, round((nir - red) / (nir + red + 1e-8), 6) AS dci FROM {px}")
def sensor_bands(v):
    """Indices of bands that a sensor names by their order; its blue band stands for green, too."""
    bands = v.px.select("site", "scene", "r", "c", F.col("red").alias("b0"), F.col("blue").alias("b1"), F.col("nir").alias("b2"))
    return S.INDICES.apply(S.name_bands(bands, "red_blue_infrared", ["b0", "b1", "b2"]), ["ndsi", "dci"]).select("site", "scene", "r", "c", r6("ndsi"), r6("dci"))


_INDEX = {
    "idx_rsi": ("rsi", "(red - blue) / (red + blue + 1e-8)"),
    "idx_dci": ("dci", "(nir - red) / (nir + red + 1e-8)"),
    "idx_ndsi": ("ndsi", "(blue - red) / (blue + red + 1e-8)"),
    "idx_swi": ("swi", "(nir - blue) / (nir + blue + 1e-8)"),
    "idx_redness": ("redness", "red / (blue + 1e-8)"),
}
for _key, (_name, _sql) in _INDEX.items():

    @query(f"SELECT site, scene, r, c, round({_sql}, 6) AS {_name} FROM {{px}}", name=_key)
    def _index(v, name=_name):
        px = v.px.withColumns({"green": F.col("blue"), "swir2400": F.col("nir"), "swir2300": F.col("blue")})
        return S.INDICES.apply(px, [name]).select("site", "scene", "r", "c", r6(name))


@query("SELECT site, scene, r, c, round(nir / (red + 1e-8), 6) AS ratio FROM {px}")
def band_ratio(v):
    return v.px.select("site", "scene", "r", "c", F.round(S.band_ratio(F.col("nir"), F.col("red")), 6).alias("ratio"))


@query("""SELECT site, scene, r, c, round((red - blue) / (red + blue + 1e-8), 6) AS rsi, round((nir - red) / (nir + red + 1e-8), 6) AS dci,
          round((blue - red) / (blue + red + 1e-8), 6) AS ndsi, round(red / (blue + 1e-8), 6) AS redness FROM {px}""")
def all_indices(v):
    have = S.INDICES.apply(v.px.withColumn("green", F.col("blue")))
    return have.select("site", "scene", "r", "c", *(r6(n) for n in S.INDICES.defs if n in have.columns))


@query("SELECT vec_id, list_slice(list_concat(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(range(80), lambda x: CAST(0 AS DOUBLE))), 1, 80) AS f FROM embeddings")
def fix_channels_zero(v):
    return v.embeddings.select("vec_id", S.fix_channels(F.col("embedding").cast("array<double>"), 80, "zero").alias("f"))


@query("SELECT vec_id, list_slice(list_concat(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(range(80), lambda x: CAST(embedding[len(embedding)] AS DOUBLE))), 1, 80) AS f FROM embeddings")
def fix_channels_repeat(v):
    return v.embeddings.select("vec_id", S.fix_channels(F.col("embedding").cast("array<double>"), 80, "repeat").alias("f"))


@query("SELECT site, scene, r, c, threshold, 'thr' || lpad(CAST(CAST(floor(threshold * 100 + 1e-9) AS BIGINT) AS VARCHAR), 2, '0') AS mask_name FROM {px}, (VALUES (CAST(0.3 AS DOUBLE)), (0.5), (0.7)) t(threshold) WHERE prob >= threshold")
def binarise_multi(v):
    return P.binarise(v.px, "prob", [0.3, 0.5, 0.7]).select("site", "scene", "r", "c", "threshold", "mask_name")


@query("SELECT site, scene, r, c, CAST(floor(least(greatest(prob, 0), 1) * 15) AS BIGINT) AS q FROM {px}")
def quantize(v):
    return v.px.select("site", "scene", "r", "c", S.quantize(F.col("prob"), 16).alias("q"))


@query("SELECT site, scene, r, c, round(1 / (1 + exp(-(prob * 8 - 4))), 6) AS p FROM {px}")
def sigmoid(v):
    return v.px.select("site", "scene", "r", "c", F.round(S.sigmoid(F.col("prob") * 8 - 4), 6).alias("p"))


@query("SELECT site, round(CASE WHEN site % 3 = 0 THEN abs((lon1 - lon0) / 1000 * (lat1 - lat0) / 1000) * power(3.141592653589793 / 180 * 3389500, 2) WHEN site % 3 = 1 THEN abs((lon1 - lon0) * (lat1 - lat0)) ELSE 1 END, 4) AS area FROM {sites}")
def pixel_area(v):
    site = F.col("site")
    w = F.when(site % 3 == 0, (F.col("lon1") - F.col("lon0")) / 1000).when(site % 3 == 1, F.col("lon1") - F.col("lon0"))
    h = F.when(site % 3 == 0, (F.col("lat1") - F.col("lat0")) / 1000).when(site % 3 == 1, F.col("lat1") - F.col("lat0"))
    return v.sites.select("site", F.round(S.pixel_area(w, h, site % 3 == 0), 4).alias("area"))


@query("SELECT site, scene, r, c, prob FROM {px} WHERE prob > 0 AND red >= 1000")
def valid_pixels(v):
    ok = F.col("prob").isNotNull() & ~F.isnan("prob") & (F.col("prob") > 0) & (F.col("red") >= 1000)
    return v.px.where(ok).select("site", "scene", "r", "c", "prob")


_MASK = "m AS (SELECT site, scene, r, c FROM {px} WHERE prob >= 0.5), s AS (SELECT DISTINCT site, scene FROM {px}), p AS (SELECT * FROM (SELECT site, scene AS t0, lead(scene) OVER (PARTITION BY site ORDER BY scene) AS t1 FROM s) u WHERE t1 IS NOT NULL), j AS (SELECT p.site, p.t0, p.t1, m.r, m.c, max(CASE WHEN m.scene = p.t0 THEN 1 ELSE 0 END) AS m0, max(CASE WHEN m.scene = p.t1 THEN 1 ELSE 0 END) AS m1 FROM p JOIN m ON m.site = p.site AND (m.scene = p.t0 OR m.scene = p.t1) GROUP BY 1, 2, 3, 4, 5)"


def changed(v):
    pairs = P.scene_pairs(v.px.select("site", "scene").distinct(), ["site"], "scene")
    return P.change(v.px.where("prob >= 0.5").select("site", "scene", "r", "c"), pairs, ["site"], "scene")


@query("WITH s AS (SELECT DISTINCT site, scene FROM {px}) SELECT * FROM (SELECT site, scene AS t0, lead(scene) OVER (PARTITION BY site ORDER BY scene) AS t1 FROM s) u WHERE t1 IS NOT NULL")
def scene_pairs(v):
    return P.scene_pairs(v.px.select("site", "scene").distinct(), ["site"], "scene")


@query(f"WITH {_MASK} SELECT site, t0, t1, r, c, CAST(m1 * (1 - m0) AS BIGINT) AS gain, CAST(m0 * (1 - m1) AS BIGINT) AS loss, CAST(m0 * m1 AS BIGINT) AS stable FROM j")
def change_pixels(v):
    return changed(v)


for _key, _cond in (("gain", "m1 = 1 AND m0 = 0"), ("loss", "m0 = 1 AND m1 = 0"), ("stable", "m0 = 1 AND m1 = 1")):

    @query(f"WITH {_MASK} SELECT site, t0, t1, r, c FROM j WHERE {_cond}", name=f"change_{_key}")
    def _part(v, kind=_key):
        return changed(v).where(F.col(kind) == 1).select("site", "t0", "t1", "r", "c")


PIXEL_HA = 36 / 1e4


@query(f"WITH {_MASK} SELECT site, t0, t1, CAST(sum(m1 * (1 - m0)) AS BIGINT) AS gain_px, CAST(sum(m0 * (1 - m1)) AS BIGINT) AS loss_px, CAST(sum(m0 * m1) AS BIGINT) AS stable_px, round(sum(m1 * (1 - m0)) * CAST(0.0036 AS DOUBLE), 4) AS gain_ha, round(sum(m0 * (1 - m1)) * CAST(0.0036 AS DOUBLE), 4) AS loss_ha, round(sum(m0 * m1) * CAST(0.0036 AS DOUBLE), 4) AS stable_ha, round(sum(m1 - m0) * CAST(0.0036 AS DOUBLE), 4) AS net_ha FROM j GROUP BY 1, 2, 3")
def change_summary(v):
    return P.change_summary(changed(v), ["site"], PIXEL_HA)


@query(f"WITH {_MASK} SELECT site, t0, t1, r, c, round(least(m0 * (1 - m1) + 0.8 * m0 * m1, 1), 6) AS red, round(least(m1 * (1 - m0) + 0.6 * m0 * m1, 1), 6) AS green, CAST(0 AS DOUBLE) AS blue FROM j".replace("0.8", "CAST(0.8 AS DOUBLE)").replace("0.6 ", "CAST(0.6 AS DOUBLE) "))
def change_rgb(v):
    top = lambda x: F.round(F.least(x, F.lit(1.0)), 6)
    return changed(v).select("site", "t0", "t1", "r", "c", top(F.col("loss") + 0.8 * F.col("stable")).alias("red"), top(F.col("gain") + 0.6 * F.col("stable")).alias("green"), F.lit(0.0).alias("blue"))


@query("SELECT site, scene, r, c, round(CASE WHEN red IS NULL THEN 0 WHEN hi - lo < 1e-9 THEN 0 ELSE (least(greatest(red, lo), hi) - lo) / (hi - lo) END, 6) AS red FROM {px} JOIN (SELECT site, scene, quantile_cont(red, 0.02) AS lo, quantile_cont(red, 0.98) AS hi FROM {px} GROUP BY 1, 2) q USING (site, scene)")
def rescale_p2p98(v):
    return P.rescale(v.px, ["site", "scene"], "red").select("site", "scene", "r", "c", r6("red"))


@query("WITH q AS (SELECT site, scene, quantile_cont(nir, 0.02) AS lo, quantile_cont(nir, 0.98) AS hi FROM {px} GROUP BY 1, 2), k AS (SELECT site, scene, r, c, least(greatest(nir, lo), hi) AS x FROM {px} JOIN q USING (site, scene)) SELECT site, scene, r, c, round(CASE WHEN max(x) OVER w - min(x) OVER w < 1e-9 THEN 0 ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END, 6) AS nir FROM k WINDOW w AS (PARTITION BY site, scene)")
def rescale_minmax(v):
    return P.minmax(P.rescale(v.px, ["site", "scene"], "nir"), ["site", "scene"], "nir").select("site", "scene", "r", "c", r6("nir"))


@query("SELECT site, scene, r, c, round(CASE WHEN prob > 0 THEN CASE WHEN hi - lo < 1e-9 THEN 0 ELSE least(greatest((least(greatest(prob, lo), hi) - lo) / (hi - lo + 1e-6), 0), 1) END END, 6) AS prob FROM {px} LEFT JOIN (SELECT site, scene, quantile_cont(prob, 0.001) AS lo, quantile_cont(prob, 0.999) AS hi FROM {px} WHERE prob > 0 GROUP BY 1, 2) q USING (site, scene)")
def stretch_pos(v):
    return P.rescale(v.px, ["site", "scene"], "prob", 0.001, 0.999, 1e-6, positive=True, on_null=None).select("site", "scene", "r", "c", r6("prob"))


@query("SELECT site, r, c, round(median(red), 6) AS red, round(median(nir), 6) AS nir FROM {px} GROUP BY 1, 2, 3")
def median_composite(v):
    return P.median_composite(v.px, ["site"], ["red", "nir"]).select("site", "r", "c", r6("red"), r6("nir"))


@query("SELECT site, scene, round(min(red), 4) AS low, round(max(red), 4) AS high, round(avg(red), 4) AS mean, round(stddev_pop(red), 4) AS std, round(quantile_cont(red, 0.02), 4) AS p2, round(quantile_cont(red, 0.98), 4) AS p98 FROM {px} GROUP BY 1, 2")
def band_stats(v):
    out = P.statistics(v.px, ["site", "scene"], "red")
    return out.select("site", "scene", *(F.round(x, 4).alias(x) for x in ("low", "high", "mean", "std", "p2", "p98")))


@query("SELECT CAST(least(floor(prob / CAST(0.01 AS DOUBLE)), 99) AS BIGINT) AS bin, count(*) AS n FROM {px} WHERE prob BETWEEN 0 AND 1 GROUP BY 1")
def histogram(v):
    return P.histogram(v.px, "prob", 0.0, 1.0, 100)


@query("SELECT site, scene, count(*) AS n_px, round(count(*) * CAST(0.0036 AS DOUBLE), 4) AS area_ha FROM {px} WHERE prob >= 0.5 GROUP BY 1, 2")
def mask_area(v):
    return v.px.where("prob >= 0.5").groupBy("site", "scene").agg(F.count("*").alias("n_px")).withColumn("area_ha", F.round(F.col("n_px") * PIXEL_HA, 4))


@query("SELECT site, scene, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS std, round(min(f), 6) AS low, round(max(f), 6) AS high FROM (SELECT site, scene, r // 8 AS br, c // 8 AS bc, avg(CAST(target AS DOUBLE)) AS f FROM {px} GROUP BY 1, 2, 3, 4) u GROUP BY 1, 2")
def class_balance(v):
    f = P.block_average(v.px.withColumn("f", F.col("target").cast("double")), ["site", "scene"], "f", 8)
    return f.groupBy("site", "scene").agg(*(F.round(g("f"), 6).alias(n) for g, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "low"), (F.max, "high"))))


@query("SELECT DISTINCT target AS id, site FROM {px}")
def distinct_ids(v):
    return v.px.select(F.col("target").alias("id"), "site").distinct()


@query("SELECT site, scene, r, c, round(least(greatest(red / max(red) OVER (PARTITION BY site, scene), 0), 1), 6) AS red FROM {px}")
def max_normalise(v):
    return P.max_normalise(v.px, ["site", "scene"], "red").select("site", "scene", "r", "c", r6("red"))


@query("SELECT site, scene, f AS factor, CAST(r // f AS BIGINT) AS r, CAST(c // f AS BIGINT) AS c, round(avg(red), 6) AS red FROM {px}, (VALUES (CAST(2 AS BIGINT)), (4), (8), (16)) t(f) GROUP BY 1, 2, 3, 4, 5")
def overviews(v):
    return P.overviews(v.px, ["site", "scene"], "red").withColumn("red", F.round("red", 6))
