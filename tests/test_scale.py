"""Operators that deal rows out by range or arrive in streams, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import tables
from gridloom.functions.kalman import advance, elements, smooth_long, smooth_series, state_after
from gridloom.operators import catalogue, focal, geometry, objects, ordering, pixels
from gridloom.streaming.series import ingest_masks, window_area


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [("a" if i % 3 else "b", rng.randint(0, 20)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(7)
    got = ordering.numbered(df, ["g"], ["x"]).collect()
    for g in "ab":
        mine = sorted((r.n, r.x) for r in got if r.g == g)
        assert [n for n, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for h, x in rows if h == g)
    assert {r.n_total for r in got if r.g == "b"} == {sum(g == "b" for g, _ in rows)}
    assert sorted(r.n for r in ordering.numbered(df, [], ["x"]).collect()) == list(range(400))
    assert ordering.numbered(df.limit(0), ["g"], ["x"]).count() == 0


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=333), "b": np.repeat([1.0, 2.0], [300, 3]), "c": np.array([5.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs] + [("a", None), ("d", None)], "g string, x double").repartition(5)
    shares = (0.0, 0.02, 0.5, 0.98, 1.0)
    got = {r.g: r.p for r in pixels.percentiles(df, ["g"], "x", shares).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, xs in values.items():
        assert got[g] == pytest.approx(np.quantile(xs, shares).tolist())


def test_draws_follow_the_weights(spark):
    rows = [(i, [0.0, 1.0, 3.0][i % 3]) for i in range(60)] + [(7, 1.0)]
    df = spark.createDataFrame(rows, "k long, w double")
    got = Counter(r.k for r in geometry.weighted_draw(df, "k", "w", 4000, 5).collect())
    assert sum(got.values()) == 4000 and not any(k % 3 == 0 for k in got)
    assert 2.5 < sum(n for k, n in got.items() if k % 3 == 2) / sum(n for k, n in got.items() if k % 3 == 1) < 3.2
    assert geometry.weighted_draw(df.where("w = 0"), "k", "w", 10, 5).count() == 0


def test_split_keeps_rows_and_keys_together(spark):
    df = spark.createDataFrame([(i % 50,) for i in range(200)] + [(None,)], "k long")
    out = geometry.random_split(df, "k", 0.2, 3).collect()
    assert len(out) == 201 and all(len({r.split for r in out if r.k == k}) == 1 for k in range(50))
    assert len({r.k for r in out if r.split == "val"}) == 10


def test_tiles_of_a_cell(spark):
    for n, size, stride in ((21, 8, 4), (16, 8, 8), (5, 8, 4), (30, 7, 3)):
        got = {r.x: sorted(r.s) for r in spark.range(n).select(F.col("id").alias("x"), geometry.starts_over(F.col("id"), n, size, stride).alias("s")).collect()}
        assert got == {x: [s for s in geometry.starts(n, size, stride) if s <= x < s + size] for x in range(n)}


def test_filling_widens(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 30, 2.0)], "r long, c long, z double")
    holes = spark.createDataFrame([(0, c) for c in range(1, 30)], "r long, c long")
    assert focal.fill_nearest(df, [], holes, "z", 3).count() == 6
    got = {r.c: r.z for r in focal.fill_nearest(df, [], holes, "z", 3, widen=30).collect()}
    assert got == {c: 1.0 if c <= 15 else 2.0 for c in range(1, 30)}
    assert focal.fill_nearest(df.limit(0), [], holes, "z", 3, widen=30).count() == 0


def test_names_contain_stems(spark):
    names = ["xx_alpha_1", "alpha", "beta_9", "zzz", "aaaa"]
    stems = ["alpha", "beta", "a", "none", ""]
    got = {r.stem: r.name for r in catalogue.first_containing(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(s,) for s in stems], "stem string"), "name", "stem").collect()}
    assert got == {s: min(n for n in names if s in n) for s in ("alpha", "beta", "a")}


def filtered_by_hand(points, update_first):
    """The textbook filter with matrices, point by point."""
    out, x, p, before = [], None, None, None
    for t, a in points:
        if x is None:
            x, p = np.array([a, 0.0]), np.eye(2)
            if update_first:
                p[0, 0] -= 1 / 1.1
        else:
            f = np.array([[1.0, max(t - before, 0.01)], [0.0, 1.0]])
            x, p = f @ x, f @ p @ f.T + np.diag([0.01, 0.005])
            k = p[:, 0] / (p[0, 0] + 0.1)
            x, p = x + k * (a - x[0]), p - np.outer(k, p[0])
        before = t
        out.append((t, a, *x))
    return out


@pytest.mark.parametrize("first", [True, False])
def test_series_over_many_ranges(spark, first):
    """One key holds nearly all rows; others, a null one too, lie between."""
    rng = np.random.default_rng(3)
    rows = [(k, float(t), float(a)) for k, n in ((1, 5000), (0, 40), (None, 30), (2, 1), (3, 2)) for t, a in zip(np.cumsum(rng.random(n) * 0.05), rng.normal(5, 1, n))]
    rows += [(4, 1.0, 2.0), (4, 1.0, 2.0), (4, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, t double, area double").repartition(6)
    want = {k: filtered_by_hand(sorted((t, a) for j, t, a in rows if j == k), first) for k in {r[0] for r in rows}}
    for f in (smooth_series, smooth_long):
        got = f(df, ["k"], update_first=first).collect()
        assert len(got) == len(rows)
        for k, points in want.items():
            assert np.allclose(sorted(tuple(r)[1:] for r in got if r["k"] == k), sorted(points), atol=2e-6)
    assert smooth_long(df.limit(0), ["k"]).count() == 0


def test_elements_are_associative():
    """A series cut anywhere gives the same states as the whole one."""
    rng = np.random.default_rng(5)
    t, a = np.cumsum(rng.random(40)), rng.normal(size=40)
    whole = state = None
    for x, y in zip(t, a):
        whole = advance(whole, x, y)
    for cut in (1, 7, 39):
        state = None
        for x, y in zip(t[:cut], a[:cut]):
            state = advance(state, x, y)
        state = advance(state, t[cut], a[cut])
        assert state_after(elements(t[cut:], a[cut:])[-1], state, t[-1]) == pytest.approx(whole, abs=1e-9)


def test_winding_components(spark):
    # A spiral is one component whose length is far more than its tile's side.
    side, cells, at, step = 21, set(), [0, -1], 0
    turns, run = [(0, 1), (1, 0), (0, -1), (-1, 0)], [side, side - 1]
    while run[step % 2] > 0:
        for _ in range(run[step % 2]):
            at = [at[0] + turns[step % 4][0], at[1] + turns[step % 4][1]]
            cells.add(tuple(at))
        run[step % 2] -= 2
        step += 1
    got = objects._label(np.array(sorted(cells)), np.array([r * side + c for r, c in sorted(cells)]), False)
    assert set(got.tolist()) == {0}


def test_table_functions(spark):
    tables.register(spark)
    for method in ("hanning", "linear", "gaussian"):
        got = {(r.i, r.j): r.w for r in spark.sql(f"SELECT * FROM blend_weights('{method}', 8)").collect()}
        want = {(r.i, r.j): r.w for r in geometry.weights(spark, method, 8).collect()}
        assert got == pytest.approx(want)
    assert spark.sql("SELECT * FROM tile_coords(21, 8, 8, 4)").count() == len(geometry.starts(21, 8, 4))


def test_tracking_survives_a_restart(spark, tmp_path):
    rng = np.random.default_rng(4)
    scenes = {t: np.argwhere(rng.random((12, 12)) < 0.5) for t in range(1, 5)}
    rows = [(s, t, int(r), int(c)) for t, cells in scenes.items() for r, c in cells for s in ("a", "b") if (r + c) % 3 or s == "a"]
    masks = spark.createDataFrame(rows, "site string, scene long, r long, c long")
    masks.write.partitionBy("scene").parquet(f"{tmp_path}/masks")
    schema = "site string, scene long"

    def arrive(t):
        spark.createDataFrame([("a", t), ("b", t)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/arrivals")

    def run():
        arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/arrivals")
        ingest_masks(arrivals, f"{tmp_path}/masks", f"{tmp_path}/out", ["site"], "scene", 12, 0.1, f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()

    for t in (1, 2):
        arrive(t)
    run()
    # A batch that had written its results but not its commit runs again and counts nothing twice.
    for f in (tmp_path / "log" / "commits").iterdir():
        if f.name.strip(".crc").lstrip(".") == "1":
            f.unlink()
    for t in (3, 4):
        arrive(t)
    run()
    got = Counter(map(tuple, spark.read.parquet(f"{tmp_path}/out/matches").select("site", "t0", "t1", "comp", "prev", F.round("iou", 9)).collect()))
    cells = objects.components(masks, ["site", "scene"], 12)
    pairs = pixels.scene_pairs(masks.select("site", "scene").distinct(), ["site"], "scene")
    want = Counter(map(tuple, objects.match(cells, pairs, ["site"], "scene", 0.1).select("site", "t0", "t1", "comp", "prev", F.round("iou", 9)).collect()))
    assert got == want and want
    assert sorted(f.name for f in (tmp_path / "out" / "manifest").iterdir()) == ["batch=2", "batch=3"]  # the last and the one before


def test_late_events_are_dropped(spark, tmp_path):
    def arrive(k, *rows):
        spark.createDataFrame(rows, "user_id long, ts string, value double").selectExpr("user_id", "timestamp(ts) AS ts", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        events = spark.readStream.schema("user_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        window_area(events).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    arrive(0, (1, "2024-01-01 10:00:00", 2.0), (1, "2024-01-01 11:00:00", 3.0))
    arrive(1, (1, "2024-01-05 10:00:00", 1.0))
    run()
    arrive(2, (1, "2024-01-01 12:00:00", 100.0), (1, "2024-01-05 12:00:00", 4.0))
    arrive(3, (1, "2024-01-09 10:00:00", 1.0))
    run()
    got = {str(r.start)[:10]: r.area for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"2024-01-01": 5.0, "2024-01-05": 5.0}


def test_classifier_learns(spark):
    from gridloom.operators.scoring import fit_classifier

    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), int(a + b > 1.4)) for a, b in rng.random((400, 2))]
    df = spark.createDataFrame(rows, "a double, b double, t int")
    out = fit_classifier(df, ["a", "b"], "t").transform(df)
    assert out.where("prediction = t").count() > 0.95 * len(rows)
