"""Cells drawn round seeds, in tasks of a bounded number of seeds."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.operators import geometry


@pytest.mark.parametrize("name", ["discs", "channels"])
def test_shared_ids_and_small_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(geometry, "SEEDS", 100, raising=False)
    rows = [(k, k % 37, k * 7 % 31, 0.25 - k % 3, 0.75, k % 6) for k in range(1000)]
    rows += [(5, 3, 3, 1.0, 0.0, 4), (5, 3, 4, 1.0, 0.0, 4), (None, 1, 1, 0.0, 1.0, 3), (None, 1, 2, 0.0, 1.0, 3)]
    seeds = spark.createDataFrame(rows, "id long, r long, c long, dr double, dc double, length long")
    want = set()
    for i, r, c, dr, dc, n in rows:
        if name == "discs":
            want |= {(i, r + a, c + b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4}
        else:
            want |= {(i, int(r + k * dr) + a, int(c + k * dc) + b) for k in range(n) for a in (-2, -1, 0, 1) for b in (-2, -1, 0, 1)}
    out = geometry.draw_discs(seeds, (32, 32), 2) if name == "discs" else geometry.draw_channels(seeds, (32, 32), 3)
    got = Counter((x.id, x.r, x.c) for x in out.collect())
    assert max(got.values()) == 1 and set(got) == {x for x in want if 0 <= x[1] < 32 and 0 <= x[2] < 32}
    seeds_of_task = out.groupBy(F.spark_partition_id()).agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0]
    assert seeds_of_task < 250
