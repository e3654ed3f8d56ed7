"""Windows of any size, and flow over terrain, beside loops."""

from __future__ import annotations

import time

import numpy as np
import pytest

from gridloom.operators.boxes import box_deviation, sliding
from gridloom.operators.flow import EIGHT, downstream, flow_next
from gridloom.operators.focal import wrap


@pytest.mark.parametrize("window, mode, strip", [(3, "reflect", 1 << 21), (5, "mirror", 40), (29, "reflect", 40), (4, "clamp", 1)])
def test_deviation_of_windows(spark, window, mode, strip):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g in ("a", None):
        z = rng.normal(1e6, 1, size=(13, 17))
        z[4, 5] = np.nan
        padded = z[np.ix_(*(wrap(np.arange(-(window // 2), n + window - window // 2 - 1), n, mode) for n in z.shape))]
        for r in range(13):
            for c in range(17):
                if (r, c) != (9, 2):
                    rows.append((g, r, c, float(z[r, c])))
        hole = np.argwhere(padded == z[9, 2])
        padded[tuple(hole.T)] = np.nan
        for r in range(13):
            for c in range(17):
                if (r, c) != (9, 2):
                    want[g, r, c] = padded[r : r + window, c : c + window].std()
    df = spark.createDataFrame(rows, "g string, r long, c long, z double").repartition(4)
    got = {(x["g"], x["r"], x["c"]): x["roughness"] for x in box_deviation(df, ["g"], "z", (13, 17), window, mode=mode, strip=strip).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-6, nan_ok=True) for k, v in want.items())


def test_wide_windows_cost_the_same():
    x, took = np.random.default_rng(2).normal(size=(400, 2000)), []
    sliding(x, 3, "reflect")
    for window in (3, 501):
        began = time.perf_counter()
        sliding(x, window, "reflect")
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.2


@pytest.mark.parametrize("length", [1, 2, 3, 8, 13, 100])
def test_downstream(spark, length):
    rng = np.random.default_rng(3)
    aspect = rng.uniform(0, 360, (9, 11))
    aspect[2, 2] = np.nan
    seeds = [(0, 0), (4, 4), (8, 10), (2, 2), (4, 4)]
    terrain = spark.createDataFrame([(r, c, float(aspect[r, c])) for r in range(9) for c in range(11)], "r long, c long, aspect double")
    got = {(x["r"], x["c"]) for x in downstream(spark.createDataFrame(seeds, "r long, c long"), flow_next(terrain, (9, 11)), length).collect()}
    want = set()
    for r, c in seeds:
        for _ in range(length):
            want.add((r, c))
            if np.isnan(aspect[r, c]):
                break
            dr, dc = EIGHT[int(np.floor(aspect[r, c] / 45 + 0.5)) % 8]
            r, c = r + dr, c + dc
            if not (0 <= r < 9 and 0 <= c < 11):
                break
    assert got == want
