"""Raster sources: binary grids, folders of files, JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.grids import registered

def read_grids(spark: SparkSession, path: str, rows: int, cols: int, nodata: int = -32768, tile: int = 256) -> DataFrame:
    """Big-endian 16-bit grids as tiles (scene_id, tr, tc, h, w, data); nodata is NaN. A file of another size is an error. A task reads the rows of one row of tiles."""
    source = registered(spark).read.format("grid16").option("path", path).option("layout", "tiles")
    return source.option("rows", rows).option("cols", cols).option("nodata", nodata).option("tile", tile).load()


def tiles_to_pixels(tiles: DataFrame, tile: int = 256) -> DataFrame:
    """scene_id, r, c, z of the cells that have a value."""
    flat = tiles.select("scene_id", "tr", "tc", "w", F.posexplode("data").alias("k", "z")).where(~F.isnan("z"))
    return flat.select("scene_id", (F.col("tr") * tile + F.floor(F.col("k") / F.col("w"))).cast("long").alias("r"), (F.col("tc") * tile + F.col("k") % F.col("w")).cast("long").alias("c"), F.col("z").cast("double").alias("z"))


def discover(spark: SparkSession, path: str, priorities: Sequence[str], least_bytes: int = 0) -> DataFrame:
    """folder, path: of each folder the first file by the priority of its ending, among those large enough."""
    from gridloom.operators.catalogue import pick_priority

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where(F.col("length") >= least_bytes)
    rank = F.coalesce(*(F.when(F.endswith("path", F.lit(p)), F.lit(i)) for i, p in enumerate(priorities)))
    return pick_priority(files.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]+$", 1)), ["folder"], rank, ["path"]).select("folder", "path")


TRACK_SCHEMA = "track_id long, dates array<double>, areas_ha array<double>, smoothed_ha array<double>"


def read_tracks(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Track documents with a fixed schema, one array a file or one document a line: fields that a document lacks are null."""
    return spark.read.schema(TRACK_SCHEMA).option("multiLine", whole_files).json(path)
