"""Scores of shifts put together from tiles."""

from __future__ import annotations

import numpy as np
import pytest

from gridloom.operators import geometry


def test_scores_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(geometry, "TILE", 8)
    rng = np.random.default_rng(2)
    scenes = {k: {(r, c): float(rng.normal(1e4, 1)) for r in range(-5, 20) for c in range(22) if rng.random() < 0.9} for k in range(3)}
    scenes[2] = dict.fromkeys(scenes[2], 0.1)  # level: no score
    scenes[1][(3, 3)] = None
    fixed = spark.createDataFrame([("s", r, c, z) for (r, c), z in scenes[0].items()], "s string, r long, c long, z double")
    moving = spark.createDataFrame([("s", k, r, c, z) for k in (1, 2) for (r, c), z in scenes[k].items()], "s string, k long, r long, c long, z double")
    out = geometry.register_shift(fixed, moving, "z", 3, ["s"], ["k"])
    got = {(x.k, x.dr, x.dc): x.score for x in out.collect()}
    assert len(got) == 2 * 49
    for (k, dr, dc), score in got.items():
        pairs = [(scenes[0][(r + dr, c + dc)], z) for (r, c), z in scenes[k].items() if (r + dr, c + dc) in scenes[0] and z is not None]
        assert score is None if k == 2 else score == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1], abs=1e-9)
    assert "Join" not in out.drop("score")._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
