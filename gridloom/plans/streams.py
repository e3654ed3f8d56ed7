"""Queries that run as streams over the tables until all rows are read, and return what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.plans.objects import C8, _MATCH, _STATS
from gridloom.plans.series import TRACKER
from gridloom.registry import query
from gridloom.sources.scratch import shared_dir
from gridloom.streaming import series as S


def _written(stream, v, label: str):
    path = f"{shared_dir(v.spark)}/{label}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{path}/out")


def _stored(df, v, label: str) -> str:
    path = f"{shared_dir(v.spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


@query(f"WITH {TRACKER} SELECT k, t, a, smoothed, velocity FROM sm", recursive=True)
def stream_kalman(v):
    source = v.spark.readStream.schema(v.series.schema).parquet(_stored(v.series, v, "series"))
    return _written(S.stream_kalman(source), v, "kalman")


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS start, round(sum(value), 4) AS area FROM events GROUP BY 1, 2")
def window_area(v):
    return S.window_area(v.events)


@query(f"WITH {C8}, {_STATS}, {_MATCH} SELECT site, t0, t1, comp, prev, round(iou, 6) AS iou FROM mt", recursive=True)
def stream_tracks(v):
    """Dates arrive one after another, each a micro-batch; their masks lie in a table."""
    path = f"{shared_dir(v.spark)}/tracks-{uuid.uuid4().hex}"
    v.px.where("prob >= 0.7").select("site", "scene", "r", "c").repartition("site", "scene").write.partitionBy("scene").parquet(f"{path}/masks")
    dates = v.px.select("site", "scene").distinct().cache()
    for scene in sorted(r["scene"] for r in dates.select("scene").distinct().collect()):  # one file a date, in the order of arrival
        dates.where(F.col("scene") == scene).coalesce(1).write.mode("append").parquet(f"{path}/arrivals")
    arrivals = v.spark.readStream.schema(dates.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/arrivals")
    S.ingest_masks(arrivals, f"{path}/masks", path, ["site"], "scene", v.side, 0.3, f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    dates.unpersist()
    return v.spark.read.parquet(f"{path}/matches").select("site", "t0", "t1", "comp", "prev", F.round("iou", 6).alias("iou"))
