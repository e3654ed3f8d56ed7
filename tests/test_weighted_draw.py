"""Draws by one ordered pass over the pieces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import geometry
from gridloom.operators.ordering import running_share


def test_one_pass_and_the_right_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7 / 10).alias("w"))
    out = geometry.weighted_draw(df, "k", "w", 300, 5)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()  # such a frame is read again for each row
    high = np.cumsum([k % 7 / 10 for k in range(5000)])
    at = [(r.draw, r.at) for r in spark.range(300).select(F.col("id").alias("draw"), geometry.unit_hash(5, "id").alias("at")).collect()]
    want = {d: int(np.searchsorted(high / high[-1], u, side="right")) for d, u in at}
    assert {r.draw: r.k for r in out.collect()} == want


def test_pieces_leave_no_gap(spark):
    pieces, begin = running_share(spark.range(3000).select("id", (F.col("id") % 5 / 7).alias("w")).repartition(3), "id", "w")
    rows = sorted((r.part, r.id, r.low, r.high) for r in pieces.collect())
    edges = dict(begin)
    for a, b in zip(rows, rows[1:], strict=False):
        assert b[2] == (a[3] if a[0] == b[0] else edges[b[0]])
