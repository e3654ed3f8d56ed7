"""Percentiles by counting beside sorting, and sketches that merge."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gridloom.operators import pixels

SHARES = (0.0, 0.02, 0.37, 0.5, 0.98, 1.0)


@pytest.mark.parametrize("steps, few", [(4096, 4096), (3, 2), (16, 0)])
def test_exact_whatever_the_steps(spark, monkeypatch, steps, few):
    monkeypatch.setattr(pixels, "STEPS", steps)
    monkeypatch.setattr(pixels, "FEW", few)
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=500),
        "ties": np.repeat([1.0, 2.0, 2.0 + 1e-15, 5e300], [200, 3, 50, 1]),
        "one": np.array([5.0]),
        "huge": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0]),
        "skewed": np.exp(rng.normal(size=300) * 20),
        None: np.arange(101.0),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None), ("void", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r["p"] for r in pixels.percentiles(df, ["g"], "x", SHARES).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        ranked = np.sort(xs)
        for s, p in zip(SHARES, got[g], strict=True):
            at = s * (len(xs) - 1)
            low, high = ranked[math.floor(at)], ranked[math.ceil(at)]
            assert p == pytest.approx(low * (1 - at % 1) + (high * (at % 1) if at % 1 else 0), rel=1e-12)


def test_endless_values_are_at_the_ends(spark):
    inf, nan = float("inf"), float("nan")
    xs = [-inf, -inf, 1.0, 2.0, 3.0, inf, nan]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = pixels.percentiles(df, [], "x", [k / 6 for k in range(7)]).first()["p"]
    assert got[:6] == xs[:6] and math.isnan(got[6])


def test_sketches_merge(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=20_000)
    df = spark.createDataFrame([(k % 2, k % 7, float(x)) for k, x in enumerate(values)], "g long, part long, x double")
    kept = pixels.sketches(df, ["g", "part"], "x", 800)
    assert kept.count() == 14
    got = {r["g"]: r["p"] for r in pixels.quantiles(pixels.merged(kept, ["g"], 800), ["g"], [0.02, 0.5, 0.98]).collect()}
    for g in (0, 1):
        own = np.sort(values[g::2])
        for s, x in zip((0.02, 0.5, 0.98), got[g], strict=True):
            assert abs(np.searchsorted(own, x) / len(own) - s) < 0.01
    near = {r["g"]: r["p"] for r in pixels.percentiles(df, ["g"], "x", [0.5], exact=False).collect()}
    assert abs(near[0][0] - np.median(values[::2])) < 0.02
