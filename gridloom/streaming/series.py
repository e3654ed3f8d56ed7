"""Streaming forms: Kalman state for each key, tracks by arriving dates, windowed areas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.functions.kalman import advance
from gridloom.operators import objects
from gridloom.operators.pixels import scene_pairs

STATE = "t double, x double, v double, p double, q double, r double"
OUT = "k long, t double, a double, smoothed double, velocity double"


def stream_kalman(series: DataFrame) -> DataFrame:
    """One row for each observation (k, t, area) of a stream, smoothed with its key's state.

    Rows of a micro-batch are taken in order of time; one that is older than the state counts as 0.01 later.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["t", "area"])
        out = []
        for t, a in zip(rows["t"], rows["area"], strict=True):
            now = advance(now, float(t), float(a))
            out.append((key[0], float(t), float(a), round(now[1], 6), round(now[2], 6)))
        state.update(now)
        yield pd.DataFrame(out, columns=["k", "t", "a", "smoothed", "velocity"])

    return series.groupBy("k").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def window_area(events: DataFrame, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """Areas of keys summed in tumbling windows; rows later than the watermark are left out of a stream."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return x.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.round(F.sum("value"), 4).alias("area")).select("user_id", F.col("w.start").alias("start"), "area")


def ingest_masks(arrivals: DataFrame, masks: str, path: str, by: list[str], order: str, width: int, threshold: float, checkpoint: str):
    """Track components of dates as they arrive: ``arrivals`` is a stream of dates (by, order), whose masks lie in the table at ``masks``.

    A micro-batch takes whole dates, later ones than all before. It writes its components and
    its matches under its own number, and a manifest: the last date of each group and the
    number of the batch that holds its components, carried on from the manifest before. So a
    batch reads one manifest and the components of its groups' last dates, however many batches
    there were; manifests older than the one before are removed. A batch that runs again finds what was
    there when it ran first, and overwrites what it wrote, so nothing is counted twice.
    """
    keys = [*by, order]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dates = batch.select(*keys).distinct()
        dates.write.mode("overwrite").parquet(f"{path}/dates/batch={number}")
        dates = spark.read.parquet(f"{path}/dates/batch={number}")
        cells = objects.components(spark.read.parquet(masks).join(dates, keys, "left_semi"), keys, width)
        cells.write.mode("overwrite").parquet(f"{path}/cells/batch={number}")
        cells = spark.read.parquet(f"{path}/cells/batch={number}").select(*keys, "r", "c", "comp")

        groups = dates.select(*by).distinct()
        kept = sorted(n for n in _batches(spark, f"{path}/manifest") if n < number)
        now = dates.groupBy(*by).agg(F.max(order).alias(order)).withColumn("held_by", F.lit(number).cast("long"))
        manifest = known = None
        if kept:
            manifest = spark.read.schema(now.schema).parquet(f"{path}/manifest/batch={kept[-1]}")
            last = manifest.join(groups, by, "left_semi")
            held = [r["held_by"] for r in last.select("held_by").distinct().collect()]  # one number a group of this batch at most
            if held:
                before = spark.read.option("basePath", f"{path}/cells").parquet(*(f"{path}/cells/batch={n}" for n in held))
                known = before.withColumnRenamed("batch", "held_by").join(last, ["held_by", *keys], "left_semi").select(*keys, "r", "c", "comp")
        shown = dates if known is None else dates.union(last.select(*keys))
        pairs = scene_pairs(shown, by, order).join(dates.withColumnRenamed(order, "t1"), [*by, "t1"], "left_semi")
        both = cells if known is None else known.union(cells)
        objects.match(both, pairs, by, order, threshold).write.mode("overwrite").parquet(f"{path}/matches/batch={number}")
        if manifest is not None:
            now = manifest.join(groups, by, "left_anti").unionByName(now)
        now.write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")
        for n in kept[:-1]:
            _removed(spark, f"{path}/manifest/batch={n}")

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _batches(spark: SparkSession, path: str) -> list[int]:
    fs, place = _place(spark, path)
    return [int(n.removeprefix("batch=")) for s in (fs.listStatus(place) if fs.exists(place) else []) if (n := s.getPath().getName()).startswith("batch=")]


def _removed(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)
