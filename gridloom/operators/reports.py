"""Joined summaries and documents for export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import interleaved


def site_summary(scenes: DataFrame, parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Scenes with the columns of every part, 0 where a part has no row."""
    out = scenes
    for p in parts:
        out = out.join(p, list(by), "left")
    return out.fillna(0)


def feature(geometry_type: str, coordinates: Column, properties: Mapping[str, Column]) -> Column:
    """A GeoJSON feature as text."""
    geometry = F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*(c.alias(k) for k, c in properties.items())).alias("properties")))


def catalogue_items(scenes: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """One item a scene: id, bbox, datetime and a map of its assets (role, href), which stays small for each scene."""
    m = assets.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "href")))).alias("assets"))
    return scenes.join(m, key, "left")


def write_pixels(df: DataFrame, path: str, by: Sequence[str] = ("site", "scene"), rows_per_file: int = 1 << 20) -> None:
    """Pixels in folders of their scenes, in Z-order: cells near each other lie in the same files and row groups, which Parquet skips by their least and greatest r and c.

    Scenes that are written replace what their folders held; other scenes stay.
    """
    placed = df.withColumn("__z", interleaved(F.col("r"), F.col("c")))
    ranged = placed.repartitionByRange(*by, "__z").sortWithinPartitions(*by, "__z").drop("__z")
    ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).option("parquet.block.size", 1 << 22).partitionBy(*by).parquet(path)


def read_pixels(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The cells of a window (first and last row and column, both included) of all scenes at ``path``; files and row groups elsewhere are skipped."""
    return spark.read.parquet(path).where(F.col("r").between(*rows) & F.col("c").between(*cols))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; nulls are left out."""
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One document a line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
