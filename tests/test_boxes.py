"""Boxes that meet in a quadtree, beside all pairs."""

from __future__ import annotations

import random

import pytest

from gridloom.operators.catalogue import _in_cells, _pieces, bbox_search


def boxes(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, lon0 double, lat0 double, lon1 double, lat1 double")


@pytest.mark.parametrize("crowd", [3, 40, 10_000])
@pytest.mark.parametrize("around", [None, 360.0])
def test_all_pairs(spark, crowd, around):
    rng = random.Random(crowd)

    def box(k):
        x, y = (rng.choice([10.0, 64.0, 0.0, 359.0]), 0.0) if k % 3 == 0 else (rng.uniform(-180, 360), rng.uniform(-90, 85))
        w, h = rng.choice([(0.0, 0.0), (1.0, 1.0), (54.0, 3.0), (2.5, 80.0)])
        return (k, x, y, x + w, min(90.0, y + h))

    items, sites = [box(k) for k in range(150)], [box(k) for k in range(40)]
    if around:
        items.append((999, 350.0, 0.0, 10.0, 5.0))  # across the end by a smaller lon1
        sites.append((998, -500.0, -5.0, 500.0, 5.0))  # all round
    want = set()
    for i, a0, b0, a1, b1 in items:
        a1 = a1 + 360 if a1 < a0 else a1
        for s, c0, d0, c1, d1 in sites:
            turns = [0] if around is None else [360 * k for k in range(-3, 4)]
            if b0 <= d1 and b1 >= d0 and any(a0 + t <= c1 and a1 + t >= c0 for t in turns):
                want.add((s, i))
    got = [tuple(r) for r in bbox_search(boxes(spark, items, "id"), boxes(spark, sites, "site"), around, crowd, depth=6).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_crowded_cell_is_split(spark):
    """A third of all boxes in one degree: no leaf and no part holds more than a few times the bound."""
    rng = random.Random(1)
    rows = [(k, *(lambda x, y: (x, y, x + 0.001, y + 0.001))(*((rng.uniform(20, 21), rng.uniform(5, 6)) if k % 3 == 0 else (rng.uniform(0, 350), rng.uniform(-80, 80))))) for k in range(3000)]
    items = boxes(spark, rows, "id")
    import gridloom.operators.catalogue as c

    seen = {}
    original = c._in_cells
    c._in_cells = lambda df, splits, levels: seen.setdefault(df.columns[0], original(df, splits, levels))
    try:
        assert bbox_search(items, boxes(spark, [(1, 20.0, 5.0, 21.0, 6.0)], "site"), crowd=50).count() == sum(20 <= r[3] and r[1] <= 21 and 5 <= r[4] and r[2] <= 6 for r in rows)
    finally:
        c._in_cells = original
    assert seen["id"].groupBy("k", "x", "y").count().agg({"count": "max"}).first()[0] <= 150
    assert _pieces(items, "id", None).count() == 3000 and _in_cells is original
