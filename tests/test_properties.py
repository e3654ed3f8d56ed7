"""Golden vectors and properties of the raster operators."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.functions.kalman import smooth_series
from gridloom.operators import focal, geometry, objects, pixels, series
from gridloom.operators.evaluation import confusion, metrics
from gridloom.operators.focal import wrap

SERIES = [(2005.0, 1.0), (2008.0, 1.5), (2011.0, 2.0), (2014.0, 2.5), (2017.0, 3.0)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("first, want", [(True, [1, 1.494566, 1.997469, 2.498808, 2.999547]), (False, [1, 1.495054, 1.995786, 2.497859, 2.998994])])
def test_kalman_golden(spark, first, want):
    df = frame(spark, [("a", t, a) for t, a in SERIES], "k string, t double, area double")
    got = [r["smoothed"] for r in smooth_series(df, ["k"], update_first=first).orderBy("t").collect()]
    assert got == pytest.approx(want, abs=1e-6)


def test_stream_state_equals_fold(spark):
    from gridloom.streaming.series import advance

    df = frame(spark, [("a", t, a) for t, a in SERIES], "k string, t double, area double")
    want = [r["smoothed"] for r in smooth_series(df, ["k"], update_first=False).orderBy("t").collect()]
    state, got = None, []
    for t, a in SERIES:
        state = advance(state, t, a)
        got.append(round(state[1], 6))
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("h, w", [(9, 12), (16, 7)])
def test_closing_a_full_mask_loses_a_frame(spark, h, w):
    full = spark.range(h * w).select(F.lit("s").alias("s"), F.floor(F.col("id") / w).alias("r"), (F.col("id") % w).alias("c"))
    assert focal.close(full, ["s"], (h, w), 2).count() == (h - 4) * (w - 4)


def test_slope_of_planes(spark):
    east = frame(spark, [(r, c, 10.0 * c) for r in range(6) for c in range(6)], "r long, c long, z double")
    got = {(x.r, x.c): (x.slope, x.aspect) for x in focal.focal(east, [], "z", (6, 6), 1, focal.slope_aspect(10.0), ["slope", "aspect"], tile=4).collect()}
    assert got[2, 2] == pytest.approx((45, 90)) and got[2, 0][0] == pytest.approx(26.565, abs=1e-3)
    south = frame(spark, [(r, c, 10.0 * r) for r in range(6) for c in range(6)], "r long, c long, z double")
    assert focal.focal(south, [], "z", (6, 6), 1, focal.slope_aspect(10.0), ["aspect"], tile=3).where("r = 2 AND c = 2").first()["aspect"] == pytest.approx(180)


@pytest.mark.parametrize("mode", ["clamp", "reflect", "mirror"])
def test_tile_size_changes_nothing(spark, mode):
    rng = np.random.default_rng(1)
    df = frame(spark, [(r, c, float(rng.normal())) for r in range(11) for c in range(13)], "r long, c long, z double")
    runs = [{(x.r, x.c): round(x.smooth, 9) for x in focal.focal(df, [], "z", (11, 13), 4, focal.gaussian(1.0), ["smooth"], mode, tile=t).collect()} for t in (5, 64)]
    assert runs[0] == runs[1]


@given(st.integers(-40, 40), st.integers(1, 9), st.sampled_from(["clamp", "reflect", "mirror"]))
@settings(deadline=None)
def test_wrap_stays_inside(i, n, mode):
    assert 0 <= int(wrap(i, n, mode)) < n


def test_wrap_matches_numpy_padding():
    a = np.arange(5)
    for mode, name in (("clamp", "edge"), ("reflect", "symmetric"), ("mirror", "reflect")):
        assert (a[wrap(np.arange(-4, 9), 5, mode)] == np.pad(a, 4, mode=name)).all()


@pytest.mark.parametrize("tile", [3, 100])
def test_components_do_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(2)
    on = rng.random((14, 14)) < 0.45
    df = frame(spark, [("s", int(r), int(c)) for r, c in np.argwhere(on)], "s string, r long, c long")
    got = {(x.r, x.c): x.comp for x in objects.components(df, ["s"], 14, True, tile).collect()}
    want, todo = {}, {tuple(map(int, p)) for p in np.argwhere(on)}
    while todo:
        start = min(todo, key=lambda p: p[0] * 14 + p[1])
        stack, part = [start], set()
        while stack:
            p = stack.pop()
            if p in todo:
                todo.remove(p)
                part.add(p)
                stack += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        want |= dict.fromkeys(part, start[0] * 14 + start[1])
    assert got == want


def test_empty_masks(spark):
    empty = frame(spark, [], "s string, r long, c long")
    assert objects.components(empty, ["s"], 8).count() == 0
    assert focal.dilate(empty, ["s"], (8, 8)).count() == 0


def test_blend_of_a_constant_is_constant(spark):
    tiles = frame(spark, [(0, 0, [0.3] * 64), (4, 4, [0.3] * 64)], "r0 long, c0 long, data array<double>")
    for method in ("hanning", "linear", "gaussian"):
        assert {round(x.prob, 9) for x in geometry.blend(tiles, [], 8, method).collect()} == {0.3}
    with pytest.raises(ValueError):
        S.blend_weight("none", F.lit(0), F.lit(0), 8)


def test_change_counts_add_up(spark):
    rng = np.random.default_rng(3)
    rows = [("s", t, int(r), int(c)) for t in (1, 2) for r, c in np.argwhere(rng.random((10, 10)) < 0.4)]
    df = frame(spark, rows, "s string, scene long, r long, c long")
    got = pixels.change_summary(pixels.change(df, pixels.scene_pairs(df.select("s", "scene").distinct(), ["s"], "scene"), ["s"], "scene"), ["s"], 1.0).first()
    assert got.loss_px + got.stable_px == sum(r[1] == 1 for r in rows) and got.gain_px + got.stable_px == sum(r[1] == 2 for r in rows)


def test_rescale_constant_and_nodata(spark):
    df = frame(spark, [("s", 0, 0, 5.0), ("s", 0, 1, 5.0), ("s", 0, 2, float("nan")), ("s", 0, 3, None), ("s", 0, 4, 0.0)], "s string, r long, c long, z double")
    got = [r.z for r in pixels.rescale(df, ["s"], "z", nodata=0.0).orderBy("c").collect()]
    assert got == [0.0] * 5


def test_perfect_and_wrong_scores(spark):
    good = frame(spark, [(1.0, 1)] * 100, "prob double, target int")
    assert metrics(confusion(good, [], "prob", "target", 0.5)).first()["iou"] > 0.99
    wrong = frame(spark, [(0.0, 1)] * 100, "prob double, target int")
    assert metrics(confusion(wrong, [], "prob", "target", 0.5)).first()["iou"] < 0.01


def test_unknown_index_is_an_error(spark):
    df = frame(spark, [(1.0, 2.0)], "red double, blue double")
    table = S.IndexTable(S.INDICES.defs)
    table.register("twice", "red * 2", ["red"])
    assert {"rsi", "redness", "twice"} <= set(table.apply(df).columns) and "dci" not in table.apply(df).columns
    with pytest.raises(KeyError):
        table.apply(df, ["nothing"])


def test_early_stop(spark):
    df = frame(spark, [("a", i, s) for i, s in enumerate([0.1, 0.3, 0.2, 0.2, 0.4])], "run string, epoch long, iou double")
    assert [r.since for r in series.early_stop(df, ["run"], "epoch", "iou", 2).orderBy("epoch").collect()] == [0, 0, 1, 2, 0]


def test_grid_files(spark, tmp_path):
    from gridloom.sources.rasters import read_grids, tiles_to_pixels

    grid = np.arange(30, dtype=">i2").reshape(5, 6)
    grid[2, 3] = -32768
    (tmp_path / "a.img").write_bytes(grid.tobytes())
    got = {(x.r, x.c): x.z for x in tiles_to_pixels(read_grids(spark, str(tmp_path), 5, 6, tile=4), 4).collect()}
    assert len(got) == 29 and got[4, 5] == 29 and (2, 3) not in got


def test_discover(spark, tmp_path):
    from gridloom.sources.rasters import discover

    (tmp_path / "o1").mkdir()
    for n in ("a_RED.JP2", "a_COLOR.tif", "a_RED.tif"):
        (tmp_path / "o1" / n).write_bytes(b"x" * (1 if n.endswith("RED.tif") else 50))
    assert discover(spark, str(tmp_path), ["RED.tif", "RED.JP2", "COLOR.tif"], 10).first()["path"].endswith("a_RED.JP2")


def test_multiscale_texture_takes_all_scenes(spark):
    from gridloom import registry

    scenes = lambda name: {(r.site, r.scene) for r in registry.queries()[name](spark, "/root/testdata/sf0.001").select("site", "scene").distinct().collect()}
    assert scenes("texture_multiscale") == scenes("pixel_to_map") and len(scenes("pixel_to_map")) > 2
