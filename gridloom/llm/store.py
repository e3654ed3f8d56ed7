"""Tables and intermediate results of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; a local folder is made only
    where that is unset and Spark runs on this machine alone, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = spark.conf.get("spark.gridloom.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.gridloom.scratch", folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage like a reliable checkpoint, but computes the rows once
    and keeps only the columns asked for. A lost executor loses no part of it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame) -> DataFrame:
    """doc_id, text and, as one struct ``row``, all columns but ``text``: no name of a user's column can meet one that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def restored(rows: DataFrame, columns: list[str], **replaced) -> DataFrame:
    """``rows`` that went aside with their ``columns`` again; those in ``replaced`` and ``text`` have the new values."""
    replaced = {"text": F.col("text")} | replaced
    return rows.select(*((replaced[c] if c in replaced else F.col(f"row.`{c}`")).alias(c) for c in columns))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, where=None) -> DataFrame:
    """Up to ``bound`` labelled documents: doc_id, text, label.

    ``bound`` is the documented limit on rows that a classifier is fitted on. The
    rows are those with the smallest hash of doc_id, so the choice is the same on
    every run and does not depend on partitioning. Because of the limit their ids
    (16 bytes each) may be broadcast. An id with several labels has the smallest one; of
    several texts under one id the one with the smallest hash is taken.
    """
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    if where is not None:
        chosen = chosen.where(where)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("label").alias("label"))
