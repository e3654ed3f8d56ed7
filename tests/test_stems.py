"""Stems meet names by a shuffle, whatever their number looks like."""

from __future__ import annotations

from gridloom.operators import catalogue


def test_stems_are_not_broadcast(spark):
    names = spark.createDataFrame([("ab_1",), ("ab_0",), ("xabc",)], "name string")
    stems = spark.createDataFrame([("ab",), ("abc",), ("q",), ("",)], "stem string")
    out = catalogue.first_containing(names, stems, "name", "stem")
    assert {r.stem: r.name for r in out.collect()} == {"ab": "ab_0", "abc": "xabc"}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
