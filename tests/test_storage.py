"""Layouts on disk: Z-order and binary grids."""

from __future__ import annotations

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.functions.scalar import interleaved
from gridloom.operators.reports import read_pixels, write_pixels
from gridloom.sources.grids import registered, write_grids


def test_bits_are_interleaved(spark):
    cells = [(0, 0), (1, 0), (0, 1), (5, 9), (2**31 - 1, 2**31 - 1), (123456, 654321)]
    got = spark.createDataFrame(cells, "r long, c long").select("r", "c", interleaved(F.col("r"), F.col("c")).alias("z")).collect()
    for x in got:
        assert x["z"] == sum((x["r"] >> k & 1) << (2 * k + 1) | (x["c"] >> k & 1) << (2 * k) for k in range(31))


def scanned(df) -> int:
    """Rows that the scan of a query without exchanges gave to its filters."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_a_window_reads_few_rows(spark, tmp_path):
    side, path = 256, f"{tmp_path}/px"
    px = spark.range(side * side).select(F.lit("s").alias("site"), (F.col("id") % 2).alias("scene"), F.floor(F.col("id") / side).alias("r"), (F.col("id") % side).alias("c"), F.rand(1).alias("z"))
    write_pixels(px, path, rows_per_file=1024)
    window = read_pixels(spark, path, (40, 55), (100, 115))
    assert window.count() == 256
    assert scanned(window) <= side * side / 8
    touched = [f for f in glob.glob(f"{path}/*/*/*.parquet") if (t := pq.read_table(f, columns=["r", "c"]).to_pandas()) is not None and ((t.r.max() >= 40) & (t.r.min() <= 55) & (t.c.max() >= 100) & (t.c.min() <= 115))]
    assert len(touched) <= len(glob.glob(f"{path}/*/*/*.parquet")) / 6


def test_written_scenes_replace_theirs(spark, tmp_path):
    path, rows = f"{tmp_path}/px", [("s", t, r, r, 1.0) for t in (1, 2) for r in range(9)]
    px = spark.createDataFrame(rows, "site string, scene long, r long, c long, z double")
    write_pixels(px, path)
    write_pixels(px.where("scene = 2 AND r < 4"), path)
    got = spark.read.parquet(path).groupBy("scene").count().collect()
    assert {x["scene"]: x["count"] for x in got} == {1: 9, 2: 4}


def test_grids_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    cells = [(n, r, c, int(rng.integers(-32767, 32768))) for n in ("a/b", "ü__1") for r in range(37) for c in range(11) if rng.random() < 0.7]
    df = spark.createDataFrame([(*x[:3], float(x[3])) for x in cells] + [("a/b", 36, 10, None), ("a/b", 80, 0, 7.0)], "scene_id string, r long, c long, z double").dropDuplicates(["scene_id", "r", "c"]).repartition(5)
    want = {tuple(x) for x in df.where("z IS NOT NULL").collect()}
    for _ in range(2):  # the second time replaces the first
        write_grids(df, f"{tmp_path}/g", 11, stripe=8)
        back = registered(spark).read.format("grid16").option("path", f"{tmp_path}/g").load()
        assert {tuple(x) for x in back.collect()} == want
    assert {tuple(x) for x in back.where("r >= 9 AND r < 20 AND scene_id = 'a/b'").collect()} == {x for x in want if x[0] == "a/b" and 9 <= x[1] < 20}


def test_filters_leave_out_files(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    from gridloom.sources.grids import GridReader

    df = spark.range(64).select(F.lit("s").alias("scene_id"), "id", F.lit(0).alias("c"), F.lit(1.0).alias("z")).withColumnRenamed("id", "r")
    write_grids(df, f"{tmp_path}/g", 1, stripe=8)
    reader = GridReader({"path": f"{tmp_path}/g", "tile": "4"})
    assert len(reader.partitions()) == 16
    list(reader.pushFilters([GreaterThanOrEqual(("r",), 17), LessThan(("r",), 22)]))
    assert sorted(p.first for p in reader.partitions()) == [16, 20]
    list(reader.pushFilters([EqualTo(("scene_id",), "other")]))
    assert reader.partitions() == []


def test_a_file_of_another_size(spark, tmp_path):
    (tmp_path / "a.img").write_bytes(b"x" * 10)
    with pytest.raises(Exception, match="has 10 bytes"):
        registered(spark).read.format("grid16").option("path", str(tmp_path)).option("rows", 5).option("cols", 6).load().collect()
