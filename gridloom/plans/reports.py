"""Queries that join results into reports, and the composed pipelines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions.kalman import smooth_series
from gridloom.operators import objects, pixels
from gridloom.operators import reports as R
from gridloom.operators import series as SE
from gridloom.plans.objects import BY, C8, _MATCH, _STATS, _TRACK, cells, tracked
from gridloom.plans.pixels import _MASK, PIXEL_HA, changed
from gridloom.plans.series import TRACKER
from gridloom.plans.terrain import extent
from gridloom.registry import query
from gridloom.sources.scratch import shared_dir


@query("""WITH s AS (SELECT DISTINCT site, scene FROM {px}), m AS (SELECT site, scene, count(*) AS n_px FROM {px} WHERE prob >= 0.9 GROUP BY 1, 2), p AS (SELECT site, scene, avg(prob) AS mean_prob, max(prob) AS max_prob FROM {px} WHERE prob > 0 GROUP BY 1, 2)
  SELECT site, scene, coalesce(n_px, 0) AS n_px, round(coalesce(n_px, 0) * CAST(0.0036 AS DOUBLE), 4) AS area_ha, round(coalesce(mean_prob, 0), 6) AS mean_prob, round(coalesce(max_prob, 0), 6) AS max_prob FROM s LEFT JOIN m USING (site, scene) LEFT JOIN p USING (site, scene)""")
def site_summary(v):
    m = v.px.where("prob >= 0.9").groupBy(*BY).agg(F.count("*").alias("n_px"))
    p = v.px.where("prob > 0").groupBy(*BY).agg(F.avg("prob").alias("mean_prob"), F.max("prob").alias("max_prob"))
    out = R.site_summary(v.px.select(*BY).distinct(), [m, p], BY)
    return out.withColumns({"area_ha": F.round(F.col("n_px") * PIXEL_HA, 4), "mean_prob": F.round("mean_prob", 6), "max_prob": F.round("max_prob", 6)})


@query(f"WITH {_MASK} SELECT site, t0, t1, round(sum(m1 * (1 - m0)) * CAST(0.0036 AS DOUBLE), 4) AS gain_ha, round(-sum(m0 * (1 - m1)) * CAST(0.0036 AS DOUBLE), 4) AS loss_ha FROM j GROUP BY 1, 2, 3")
def plot_change_bars(v):
    return pixels.change_summary(changed(v), ["site"], PIXEL_HA).select("site", "t0", "t1", "gain_ha", F.round(-F.col("loss_ha"), 4).alias("loss_ha"))


@query(f"""WITH {_MASK}, n AS (SELECT site, t0, t1, CAST(sum(m1 - m0) AS BIGINT) AS net_px FROM j GROUP BY 1, 2, 3)
  SELECT site, t0, t1, net_px, greatest(sum(net_px) OVER (PARTITION BY site ORDER BY t1), 0)::BIGINT AS total_px FROM n""")
def change_report(v):
    n = pixels.change_summary(changed(v), ["site"], PIXEL_HA).select("site", "t0", "t1", (F.col("gain_px") - F.col("loss_px")).alias("net_px"))
    total = SE.cumulative_area(n.withColumn("net", F.col("net_px").cast("double")), ["site"], "t1", "net", lead_in=False)
    return n.join(total.select("site", F.col("t").cast("long").alias("t1"), F.col("area").cast("long").alias("total_px")), ["site", "t1"])


def observed(v):
    """Track observations with their smoothed areas; on one date the smaller component comes first."""
    links, stats = tracked(v)
    obs = links.join(stats, [*BY, "comp"]).select("site", "track", "scene", "comp", (F.col("area_px") * PIXEL_HA).alias("area"), "row", "col")
    return obs, smooth_series(obs, ["site", "track"], "scene", "area", update_first=False, order=["comp"])


@query(f"""WITH {C8}, {_STATS}, {_MATCH}, {_TRACK}, ob AS (SELECT tk.site, tk.track, tk.scene, st.area_px * CAST(0.0036 AS DOUBLE) AS a, row_number() OVER (PARTITION BY tk.site, tk.track ORDER BY tk.scene, tk.comp) AS n FROM tk JOIN st USING (site, scene, comp)),
  kf(site, track, n, t, a, x, v, p00, p01, p10, p11) AS (SELECT site, track, n, CAST(scene AS DOUBLE), a, a, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM ob WHERE n = 1
    UNION ALL SELECT site, track, n, t, a, xp + p0 / (p0 + CAST(0.1 AS DOUBLE)) * (a - xp), v + q10 / (p0 + CAST(0.1 AS DOUBLE)) * (a - xp), (1 - p0 / (p0 + CAST(0.1 AS DOUBLE))) * p0, (1 - p0 / (p0 + CAST(0.1 AS DOUBLE))) * q01, q10 - q10 / (p0 + CAST(0.1 AS DOUBLE)) * p0, q11 - q10 / (p0 + CAST(0.1 AS DOUBLE)) * q01
      FROM (SELECT o.site, o.track, o.n, CAST(o.scene AS DOUBLE) AS t, o.a, kf.x + dt * kf.v AS xp, kf.v, kf.p00 + dt * kf.p10 + dt * (kf.p01 + dt * kf.p11) + CAST(0.01 AS DOUBLE) AS p0, kf.p01 + dt * kf.p11 AS q01, kf.p10 + dt * kf.p11 AS q10, kf.p11 + CAST(0.005 AS DOUBLE) AS q11
        FROM kf JOIN (SELECT *, greatest(CAST(scene - lag(scene) OVER (PARTITION BY site, track ORDER BY n) AS DOUBLE), CAST(0.01 AS DOUBLE)) AS dt FROM ob) o ON o.site = kf.site AND o.track = kf.track AND o.n = kf.n + 1) u)
  SELECT site, track, t, round(a, 6) AS a, round(x, 6) AS smoothed, round(v, 6) AS velocity FROM kf""", recursive=True)
def track_obs(v):
    return observed(v)[1].select("site", "track", "t", F.round("a", 6).alias("a"), "smoothed", "velocity")


@query(f"WITH {C8}, {_STATS}, {_MATCH}, {_TRACK} SELECT site, track, min(scene) AS first_seen, max(scene) AS last_seen, count(*) AS n_obs FROM tk GROUP BY 1, 2", recursive=True)
def activity_report(v):
    return tracked(v)[0].groupBy("site", "track").agg(F.min("scene").alias("first_seen"), F.max("scene").alias("last_seen"), F.count("*").alias("n_obs"))


@query(f"WITH {C8}, {_STATS}, {_MATCH}, {_TRACK}, l AS (SELECT site, track, arg_max(comp, (scene, comp)) AS comp, max(scene) AS scene FROM tk GROUP BY 1, 2) SELECT l.site, l.track, round(1000 + (col + 0.5) * 6, 3) AS x, round(5000 - (row + 0.5) * 6, 3) AS y FROM l JOIN st USING (site, scene, comp)", recursive=True)
def track_points(v):
    links, stats = tracked(v)
    last = SE.latest(links, ["site", "track"], "scene", ["scene"]).join(links.groupBy("site", "track").agg(F.max_by("comp", F.struct("scene", "comp")).alias("comp")), ["site", "track"])
    at = last.join(stats, [*BY, "comp"])
    return at.select("site", "track", F.round(1000 + (F.col("col") + 0.5) * 6, 3).alias("x"), F.round(5000 - (F.col("row") + 0.5) * 6, 3).alias("y"))


@query(f"WITH {C8}, {_STATS} SELECT site, scene, comp, 'Feature' AS type, area_px FROM st", recursive=True)
def geojson_features(v):
    s = objects.component_stats(cells(v), BY)
    text = R.feature("Point", F.array("col", "row"), {"comp": F.col("comp"), "area_px": F.col("area_px")})
    return s.select(*BY, "comp", F.get_json_object(text, "$.type").alias("type"), F.get_json_object(text, "$.properties.area_px").cast("long").alias("area_px"))


@query("SELECT site || '-' || scene AS id, scene || '-07-01T00:00:00Z' AS datetime, CAST(2 AS BIGINT) AS n_assets, 'thumb/' || site || '-' || scene || '.png' AS thumb FROM (SELECT DISTINCT site, scene FROM {px}) s")
def stac_items(v):
    s = v.px.select(*BY).distinct().withColumn("id", F.concat_ws("-", "site", "scene"))
    kinds = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(x).alias("ext")) for r, x in (("data", ".parquet"), ("thumb", ".png")))))
    assets = s.select("id", kinds.alias("k")).select("id", "k.role", F.concat("k.role", F.lit("/"), "id", "k.ext").alias("href"))
    items = R.catalogue_items(s, assets, "id")
    return items.select("id", F.concat(F.col("scene").cast("string"), F.lit("-07-01T00:00:00Z")).alias("datetime"), F.size("assets").cast("long").alias("n_assets"), F.col("assets")["thumb"].alias("thumb"))


@query(f"WITH {TRACKER} SELECT k AS track_id, list(t ORDER BY t) AS dates, list(a ORDER BY t) AS areas_ha, list(smoothed ORDER BY t) AS smoothed_ha FROM sm GROUP BY k", recursive=True)
def read_tracks_json(v):
    """Track documents written as JSON and read with a fixed schema."""
    import uuid

    from gridloom.sources.rasters import read_tracks

    path = f"{shared_dir(v.spark)}/tracks-{uuid.uuid4().hex}"
    s = smooth_series(v.series, ["k"], update_first=False)
    doc = s.groupBy(F.col("k").alias("track_id")).agg(F.array_sort(F.collect_list(F.struct("t", "a", "smoothed"))).alias("p"))
    doc = doc.select("track_id", F.col("p.t").alias("dates"), F.col("p.a").alias("areas_ha"), F.col("p.smoothed").alias("smoothed_ha"))
    doc.write.json(path)
    return read_tracks(v.spark, path, whole_files=False)


@query("SELECT site, scene, r, c, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS hit FROM (SELECT site, scene, r, c, 1 / (1 + exp(-(0.5 * (red - blue) / (red + blue + 1e-8) + prob - 0.5))) AS p FROM {px}) q")
def pipeline_score(v):
    """Indices, a linear score and a threshold in one projection."""
    from gridloom.functions import scalar as S

    x = S.INDICES.apply(v.px, ["rsi"])
    p = S.sigmoid(0.5 * F.col("rsi") + F.col("prob") - 0.5)
    return x.select(*BY, "r", "c", F.when(p >= 0.5, 1).otherwise(0).alias("hit"))


@query("SELECT site, CAST(scene AS BIGINT) AS scene, r, c, red, prob FROM {px}, {grid_side} WHERE r BETWEEN side // 4 AND side // 2 AND c BETWEEN side // 3 AND side - 3")
def zorder_window(v):
    """A window of all scenes from pixels that were written in Z-order, twice: the second time replaces the first."""
    path = f"{shared_dir(v.spark)}/pixels-{uuid.uuid4().hex}"
    for _ in range(2):
        R.write_pixels(v.px.select(*BY, "r", "c", "red", "prob"), path, BY, 1 << 16)
    return R.read_pixels(v.spark, path, (v.side // 4, v.side // 2), (v.side // 3, v.side - 3)).select("site", F.col("scene").cast("long").alias("scene"), "r", "c", "red", "prob")


@query("SELECT 'dem' AS scene_id, r, c, floor(elev) AS z FROM {dem}")
def grid_roundtrip(v):
    """The ground as 16-bit grids in stripes of rows, read again."""
    from gridloom.sources.grids import registered, write_grids

    path = f"{shared_dir(v.spark)}/grids-{uuid.uuid4().hex}"
    write_grids(v.dem.select(F.lit("dem").alias("scene_id"), "r", "c", F.floor("elev").alias("z")), path, extent(v)[1], stripe=16)
    return registered(v.spark).read.format("grid16").option("path", path).load()
