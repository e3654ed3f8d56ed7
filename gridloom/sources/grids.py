"""Binary grids of big-endian 16-bit numbers as a Spark data source: reads ranges of rows, writes stripes.

``spark.read.format("grid16")`` takes the options ``path`` (a folder or file of any file system that Arrow opens),
``nodata`` (-32768), ``layout`` (``cells``: scene_id, r, c, z of cells with a value; ``tiles``: scene_id, tr, tc, h, w, data),
``tile`` (256, rows a partition reads of a file), and ``rows`` and ``cols`` for files that are a whole scene each.
Without the last two, files are stripes as the writer names them: scene__firstrow_rowsxcols.i2.
Filters on scene_id and r leave out files and rows before they are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

LAYOUTS = {"cells": "scene_id string, r long, c long, z double", "tiles": "scene_id string, tr int, tc int, h int, w int, data array<float>"}
NODATA = -32768
_STRIPE = re.compile(r"(?P<scene>.*)__(?P<first>\d+)_(?P<rows>\d+)x(?P<cols>\d+)\.i2$")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Rows(InputPartition):
    """Some rows of a file: ``skip`` of its rows come before, ``first`` is the number of the first in the scene."""

    path: str
    scene: str
    first: int
    skip: int
    count: int
    cols: int


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class GridReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.layout = options["path"], options.get("layout", "cells")
        self.nodata, self.tile = int(options.get("nodata", NODATA)), int(options.get("tile", 256))
        self.shape = (int(options["rows"]), int(options["cols"])) if "rows" in options else None
        self.scene, self.low, self.high = None, 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("scene_id",) and isinstance(f, EqualTo):
                self.scene = f.value
            elif at == ("r",) and self.layout == "cells" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, int(f.value))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, int(f.value) + 1)
            yield f  # rows are only narrowed; Spark still filters

    def partitions(self) -> list[Rows]:
        fs, root = _opened(self.path)
        found = fs.get_file_info(root)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        out = []
        for info in files:
            if info.type != pafs.FileType.File or info.base_name.startswith(("_", ".")):
                continue
            if self.shape:
                scene, first, (rows, cols) = info.base_name, 0, self.shape
            elif m := _STRIPE.match(info.base_name):
                scene, first, rows, cols = unquote(m["scene"]), int(m["first"]), int(m["rows"]), int(m["cols"])
            else:
                continue
            if info.size != 2 * rows * cols:
                raise ValueError(f"{info.path} has {info.size} bytes, not {2 * rows * cols}")
            if self.scene not in (None, scene):
                continue
            for skip in range(0, rows, self.tile):
                count = min(self.tile, rows - skip)
                if first + skip < self.high and first + skip + count > self.low:
                    out.append(Rows(info.path, scene, first + skip, skip, count, cols))
        return out

    def read(self, p: Rows) -> Iterator[pa.RecordBatch]:
        if p is None:
            return
        fs, _ = _opened(self.path)
        with fs.open_input_file(p.path) as f:
            f.seek(2 * p.cols * p.skip)
            grid = np.frombuffer(f.read(2 * p.cols * p.count), ">i2").reshape(p.count, p.cols)
        if self.layout == "cells":
            for low in range(0, p.count, max(1, (1 << 16) // p.cols)):
                part = grid[low : low + max(1, (1 << 16) // p.cols)]
                r, c = np.nonzero(part != self.nodata)
                z = part[r, c].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.repeat(p.scene, len(r)), pa.array(r + p.first + low), pa.array(c), pa.array(z)], ["scene_id", "r", "c", "z"])
            return
        values = grid.astype(np.float32)
        values[grid == self.nodata] = np.nan
        for c in range(0, p.cols, self.tile):
            part = values[:, c : c + self.tile]
            sizes = [pa.array([n], pa.int32()) for n in (p.first // self.tile, c // self.tile, *part.shape)]
            yield pa.RecordBatch.from_arrays([pa.array([p.scene]), *sizes, pa.array([part.ravel()], pa.list_(pa.float32()))], ["scene_id", "tr", "tc", "h", "w", "data"])


class GridWriter(DataSourceArrowWriter):
    """Rows (scene_id, r, c, z) sorted by scene and row, a stripe at a time; files get their names when all are written."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.cols, self.stripe, self.overwrite = options["path"], int(options["cols"]), int(options.get("stripe", 256)), overwrite
        self.nodata = int(options.get("nodata", NODATA))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        own, grid, names = None, None, []

        def close() -> None:
            if own is None:
                return
            used = int(np.flatnonzero((grid != self.nodata).any(axis=1)).max(initial=0)) + 1
            name = f"{quote(own[0], safe='')}__{own[1] * self.stripe}_{used}x{self.cols}.i2"
            hidden = f"_{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{root}/{hidden}") as f:
                f.write(grid[:used].tobytes())
            names.append((hidden, name))

        for b in batches:
            scenes = np.array(b.column("scene_id").to_pylist(), object)
            r, c, z = (b.column(k).to_numpy(zero_copy_only=False) for k in ("r", "c", "z"))
            if not len(r):
                continue
            at = r // self.stripe
            new = np.concatenate([[0], np.flatnonzero((scenes[1:] != scenes[:-1]) | (at[1:] != at[:-1])) + 1, [len(r)]])
            for low, high in zip(new[:-1], new[1:]):
                if own != (scenes[low], int(at[low])):
                    close()
                    own, grid = (scenes[low], int(at[low])), np.full((self.stripe, self.cols), self.nodata, ">i2")
                grid[r[low:high] % self.stripe, c[low:high]] = np.nan_to_num(z[low:high], nan=self.nodata)
        close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        new = [n for m in messages if m is not None for n in m.names]
        if self.overwrite:
            kept = {name for _, name in new}
            for info in fs.get_file_info(pafs.FileSelector(root)):
                if _STRIPE.match(info.base_name) and info.base_name not in kept:
                    fs.delete_file(info.path)
        for hidden, name in new:
            fs.move(f"{root}/{hidden}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        for m in messages:
            for hidden, _ in m.names if m is not None else ():
                fs.delete_file(f"{root}/{hidden}")


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grid16"

    def schema(self) -> str:
        return LAYOUTS[self.options.get("layout", "cells")]

    def reader(self, schema: StructType) -> GridReader:
        return GridReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> GridWriter:
        return GridWriter(dict(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """``spark`` with the source ``grid16``, whose filters are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
    return spark


def write_grids(df: DataFrame, path: str, cols: int, stripe: int = 256) -> None:
    """scene_id, r, c, z as files of ``stripe`` rows each; cells without a row, null and NaN are nodata, fractions are cut. Other stripes in the folder go."""
    registered(df.sparkSession)
    rows = df.select(F.col("scene_id").cast("string").alias("scene_id"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.coalesce(F.col("z").cast("double"), F.lit(float("nan"))).alias("z"))
    rows = rows.repartition("scene_id", F.floor(F.col("r") / stripe)).sortWithinPartitions("scene_id", "r")
    rows.write.format("grid16").mode("overwrite").option("path", path).option("cols", cols).option("stripe", stripe).save()
