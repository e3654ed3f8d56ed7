"""The distance transform beside all pairs."""

from __future__ import annotations

import time

import numpy as np
import pytest

from gridloom.operators.distance import class_distance, envelope, nearest_cell, nearest_in_row


@pytest.mark.parametrize("strip", [1, 60, 1 << 21])
def test_nearest_of_all(spark, strip):
    rng = np.random.default_rng(1)
    shape, rows, asked, want = (23, 31), [], [], {}
    for g, share in (("a", 0.02), ("b", 0.3), (None, 0.004), ("none", 0.0)):
        on = rng.random(shape) < share
        cells = [tuple(map(int, p)) for p in np.argwhere(on)]
        rows += [(g, r, c, float(100 * r + c)) for r, c in cells]
        for r, c in map(tuple, np.argwhere(~on)):
            asked.append((g, int(r), int(c)))
            if cells:
                d2, nr, nc = min(((r - x) ** 2 + (c - y) ** 2, x, y) for x, y in cells)
                want[g, int(r), int(c)] = (nr, nc, int(d2), float(100 * nr + nc))
    cells = spark.createDataFrame(rows, "g string, r long, c long, z double").repartition(5)
    out = nearest_cell(cells, ["g"], spark.createDataFrame(asked, "g string, r long, c long"), "z", strip)
    assert {(x["g"], x["r"], x["c"]): (x["near_r"], x["near_c"], x["d2"], x["near_value"]) for x in out.collect()} == want
    assert nearest_cell(cells.limit(0), ["g"], cells.select("g", "r", "c"), "z").count() == 0
    assert nearest_cell(cells, ["g"], cells.select("g", "r", "c").limit(0)).count() == 0


def test_ties_go_to_the_smaller():
    assert nearest_in_row(np.array([0, 4, 5]), np.arange(7)).tolist() == [0, 0, 0, 1, 1, 2, 2]
    on, until, count = envelope(np.array([0, 4]), np.zeros((2, 1), np.int64))
    assert (on[:2, 0].tolist(), until[0, 0], count[0]) == ([0, 1], 2, 2)


def test_distance_from_the_other_class(spark):
    rows = [("s", r, c, int(c >= 3)) for r in range(4) for c in range(6)] + [("t", 0, 0, 1)]
    got = class_distance(spark.createDataFrame(rows, "s string, r long, c long, label int"), ["s"], "label").collect()
    assert {(x["r"], x["c"], x["label"]): x["d2"] for x in got} == {(r, c, int(c >= 3)): (3 - c if c < 3 else c - 2) ** 2 for _, r, c, _ in rows[:-1]}


def test_the_gap_costs_nothing():
    """Envelopes over 4000 rows take alike whether the cells are near or far."""
    rng, took = np.random.default_rng(2), []
    for near in (3, 3000):
        height = rng.integers(0, near, (4000, 64)) ** 2
        began = time.perf_counter()
        envelope(np.arange(4000), height)
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.5
