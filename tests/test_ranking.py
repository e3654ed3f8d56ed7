"""Running sums, list ranking and rings beside loops."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.operators import objects, ranking
from gridloom.operators.ordering import running


def lists(seed: int, scattered: bool, n: int = 240):
    rng = random.Random(seed)
    ids = list(range(-300, 3 * n - 300, 3))
    if scattered:
        rng.shuffle(ids)
    while ids:
        size = rng.choice([1, 2, 5, 40])
        part, ids = ids[:size], ids[size:]
        yield part, [rng.randint(0, 9) for _ in part]


@pytest.mark.parametrize("one_task, scattered", [(1 << 16, False), (5, False), (5, True)])
def test_sums_along_lists(spark, monkeypatch, one_task, scattered):
    monkeypatch.setattr(ranking, "ONE_TASK", one_task)
    rows, want = [], {}
    for part, w in lists(1, scattered):
        for i, x in enumerate(part):
            rows.append((x, part[i + 1] if i + 1 < len(part) else None, w[i], 1))
            want[x] = (sum(w[i:]), len(part) - i)
    df = spark.createDataFrame(rows, "id long, next long, w long, n long").repartition(5)
    assert {r["id"]: (r["w"], r["n"]) for r in ranking.suffix_sums(df, ["id"], ["next"], ["w", "n"]).collect()} == want
    split = df.selectExpr("floor(id / 10) AS a", "pmod(id, 10) AS b", "floor(next / 10) AS na", "pmod(next, 10) AS nb", "w")
    assert {10 * r["a"] + r["b"]: r["w"] for r in ranking.suffix_sums(split, ["a", "b"], ["na", "nb"], ["w"]).collect()} == {k: v[0] for k, v in want.items()}
    assert ranking.suffix_sums(df.limit(0), ["id"], ["next"], ["w"]).count() == 0


@pytest.mark.parametrize("one_task, scattered", [(1 << 16, True), (5, True), (5, False)])
def test_places_in_rings(spark, monkeypatch, one_task, scattered):
    monkeypatch.setattr(ranking, "ONE_TASK", one_task)
    rows, want = [], {}
    for part, _ in lists(2, scattered):
        first = part.index(min(part))
        ring = part[first:] + part[:first]
        for i, x in enumerate(ring):
            rows.append((x, ring[(i + 1) % len(ring)]))
            want[x] = (ring[0], len(ring) - i)
    got = ranking.ring_places(spark.createDataFrame(rows, "id long, next long").repartition(5))
    assert {r["id"]: (r["leader"], r["left"]) for r in got.collect()} == want


def test_a_ring_is_no_list(spark):
    with pytest.raises(Exception, match="does not end"):
        ranking.suffix_sums(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "id long, next long, w long"), ["id"], ["next"], ["w"]).collect()


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "c"]) if i % 3 else "a", i, rng.randint(0, 5)) for i in range(400)]
    total, count, want = Counter(), Counter(), {}
    for g, i, v in rows:
        total[g] += v
        count[g] += 1
        want[i] = (total[g], count[g])
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(7)
    assert {r["i"]: (r["s"], r["n"]) for r in running(df, ["g"], ["i"], {"s": F.col("v"), "n": F.lit(1)}).collect()} == want
    assert {r["i"]: r["n"] for r in running(df, [], ["i"], {"n": F.lit(1)}).collect()} == {i: i + 1 for i in range(400)}
    assert running(df.limit(0), ["g"], ["i"], {"s": F.col("v")}).count() == 0


def rings_by_hand(edges):
    """Rings of one component, walked edge by edge."""
    ways: dict = {}
    for x0, y0, x1, y1 in sorted(edges, reverse=True):
        ways.setdefault((x0, y0), []).append((x1, y1))
    rings = []
    for start in sorted(ways, key=lambda p: (p[1], p[0])):
        while ways[start]:
            path, at = [start], ways[start].pop()
            while at != start:
                before, outs = path[-1], ways[at]
                path.append(at)
                turn = (before[1] - at[1], at[0] - before[0])
                at = outs.pop(next((i for i, p in enumerate(outs) if (p[0] - at[0], p[1] - at[1]) == turn), len(outs) - 1))
            rings.append([list(p) for p in [*path, start]])
    return rings


@pytest.mark.parametrize("one_task", [1 << 16, 4])
def test_rings_of_ragged_masks(spark, monkeypatch, one_task):
    monkeypatch.setattr(ranking, "ONE_TASK", one_task)
    rng = random.Random(7)
    cells = [("s", r, c, r * 14 + c) for r in range(14) for c in range(14) if rng.random() < 0.62]
    mask = spark.createDataFrame(cells, "s string, r long, c long, id long").drop("id")
    edges = objects.polygon_edges(objects.components(mask, ["s"], 14, False, tile=5), ["s"])
    want = {}
    for comp in {e["comp"] for e in edges.collect()}:
        for k, ring in enumerate(rings_by_hand([(e["x0"], e["y0"], e["x1"], e["y1"]) for e in edges.where(F.col("comp") == comp).collect()])):
            want[comp, k] = ring
    got = {(r["comp"], r["ring"]): r["points"] for r in objects.polygon_rings(edges, ["s"]).collect()}
    assert got == want and len(want) > 5
    assert objects.ring_points(edges.limit(0), ["s"]).count() == 0


def test_one_ring_over_many_tasks(spark):
    """A comb of 200 teeth is one ring; no range holds it and no row is the whole of it."""
    cells = [("s", 0, c) for c in range(399)] + [("s", r, c) for c in range(0, 399, 2) for r in range(1, 40)]
    mask = spark.createDataFrame(cells, "s string, r long, c long")
    edges = objects.polygon_edges(mask.withColumn("comp", F.lit(0).cast("long")), ["s"])
    got = objects.ring_points(edges, ["s"]).orderBy("place").collect()
    n = edges.count()
    assert [r["place"] for r in got] == list(range(n)) and {r["ring"] for r in got} == {0}
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(got, got[1:] + got[:1]))
