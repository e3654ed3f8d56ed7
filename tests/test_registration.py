"""Coarse-to-fine registration finds far shifts that were planted."""

from __future__ import annotations

import numpy as np
import pytest

from gridloom.operators import geometry


@pytest.mark.parametrize("shift", [(40, -23), (0, 0), (-7, 38)])
def test_planted_shift(spark, shift):
    rng = np.random.default_rng(1)
    field = np.zeros((160, 160))
    for size in (80, 40, 20, 10, 5, 2):
        field += np.kron(rng.normal(size=(160 // size, 160 // size)), np.ones((size, size)))
    cells = [(r, c) for r in range(100) for c in range(100)]
    fixed = spark.createDataFrame([("s", r, c, float(field[30 + r, 30 + c])) for r, c in cells], "s string, r long, c long, z double")
    moving = spark.createDataFrame([("s", k, r, c, float(field[30 + r + k * shift[0], 30 + c + k * shift[1]]) if 0 <= 30 + r + k * shift[0] < 160 and 0 <= 30 + c + k * shift[1] < 160 else None) for k in (0, 1) for r, c in cells], "s string, k long, r long, c long, z double")
    got = {x["k"]: (x["dr"], x["dc"]) for x in geometry.register_pyramid(fixed, moving.where("z IS NOT NULL"), "z", 40, ["s"], ["k"]).collect()}
    assert got == {0: (0, 0), 1: shift}


def test_no_overlap_has_no_row(spark):
    one = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "r long, c long, z double")
    far = spark.createDataFrame([(90, 90, 1.0), (90, 91, 2.0)], "r long, c long, z double")
    assert geometry.register_pyramid(one, far, "z", 8).count() == 0
    assert geometry.register_pyramid(one.limit(0), far, "z", 8).count() == 0
