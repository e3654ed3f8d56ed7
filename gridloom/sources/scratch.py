"""Intermediate tables on the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; a local folder only where that is unset and Spark runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.gridloom.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.gridloom.scratch", folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and rows are computed once."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
