"""Grids in space: tiles, patches, resampling, warping, blending, registration, splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.scalar import blend_weight, clip
from gridloom.operators.ordering import numbered, running_share
from gridloom.sources.scratch import stored


def starts(n: int, size: int, stride: int) -> list[int]:
    """Where tiles begin on an axis of ``n`` cells, the last one flush with the edge."""
    return sorted({*range(0, max(1, n - size + 1), stride), max(0, n - size)})


def axis_starts(n: Column, size: int, stride: int) -> Column:
    """The starts of tiles on an axis of ``n`` cells, the last one flush with the edge."""
    last = F.greatest(n - size, F.lit(0)).cast("long")
    return F.array_union(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last))


def starts_over(x: Column, n: int, size: int, stride: int) -> Column:
    """The starts of the tiles that hold cell ``x`` of an axis of ``n`` cells, from the stride alone."""
    last = max(0, n - size)
    low, high = F.greatest(F.ceil((x - size + 1) / stride), F.lit(0)), F.least(F.floor(x / stride), F.lit(last // stride))
    even = F.transform(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")), lambda k: k * stride)
    flush = F.array(F.lit(last).cast("long")) if last % stride else F.array().cast("array<bigint>")
    return F.concat(even, F.when(x >= last, flush).otherwise(F.array().cast("array<bigint>")))


def tile_places(grids: DataFrame, by: Sequence[str], size: int, stride: int) -> DataFrame:
    """by, r0, c0 of every tile of each grid (by, height, width)."""
    rows = grids.select(*by, "width", F.explode(axis_starts(F.col("height"), size, stride)).alias("r0"))
    return rows.select(*by, "r0", F.explode(axis_starts(F.col("width"), size, stride)).alias("c0"))


def tile_coords(spark: SparkSession, height: int, width: int, size: int, stride: int) -> DataFrame:
    """r0, c0 of every tile."""
    return tile_places(spark.range(1).select(F.lit(height).alias("height"), F.lit(width).alias("width")), [], size, stride)


def weights(spark: SparkSession, method: str, size: int) -> DataFrame:
    """i, j, w: a blend weight for each cell of a tile."""
    return spark.range(size).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(size - 1)).cast("array<bigint>")).alias("j")).withColumn("w", blend_weight(method, F.col("i"), F.col("j"), size))


def blend(tiles: DataFrame, by: Sequence[str], size: int, method: str = "hanning", data: str = "data") -> DataFrame:
    """by, r, c, prob: overlapping tiles (r0, c0, row-major ``data``) averaged with weights."""
    flat = tiles.select(*by, "r0", "c0", F.posexplode(data).alias("k", "p")).select(*by, "r0", "c0", F.floor(F.col("k") / size).alias("i"), (F.col("k") % size).cast("long").alias("j"), F.col("p").cast("double").alias("p"))
    w = blend_weight(method, F.col("i"), F.col("j"), size)
    cells = flat.select(*by, (F.col("r0") + F.col("i")).alias("r"), (F.col("c0") + F.col("j")).alias("c"), w.alias("w"), (F.col("p") * w).alias("pw"))
    return cells.groupBy(*by, "r", "c").agg(clip(F.sum("pw") / F.sum("w")).alias("prob"))


def bilinear(df: DataFrame, by: Sequence[str], col: str, targets: DataFrame) -> DataFrame:
    """by, tr, tc, col: values at fractional places of a grid.

    ``targets`` has by, tr, tc and the place (y, x) in the source. The four cells round a
    place are looked up by equal keys; places outside, or beside a hole, are null.
    """
    y0, x0 = F.floor("y"), F.floor("x")
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    asked = targets.select(*by, "tr", "tc", "y", "x", y0.alias("y0"), x0.alias("x0"), corner.alias("o"))
    fy, fx = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    w = F.when(F.col("o.i") == 1, fy).otherwise(1 - fy) * F.when(F.col("o.j") == 1, fx).otherwise(1 - fx)
    asked = asked.select(*by, "tr", "tc", (F.col("y0") + F.col("o.i")).alias("r"), (F.col("x0") + F.col("o.j")).alias("c"), w.alias("w")).where("w > 0")
    found = asked.join(df.select(*by, "r", "c", F.col(col).alias("z")), [*by, "r", "c"], "left")
    out = found.groupBy(*by, "tr", "tc").agg(F.sum(F.col("w") * F.col("z")).alias(col), F.count_if(F.col("z").isNull()).alias("gone"))
    return out.select(*by, "tr", "tc", F.when(F.col("gone") == 0, F.col(col)).alias(col))


def nearest(df: DataFrame, by: Sequence[str], col: str, targets: DataFrame) -> DataFrame:
    """by, tr, tc, col: the cell that each target falls into."""
    asked = targets.select(*by, "tr", "tc", F.floor(F.col("y") + 0.5).alias("r"), F.floor(F.col("x") + 0.5).alias("c"))
    return asked.join(df.select(*by, "r", "c", col), [*by, "r", "c"], "left").select(*by, "tr", "tc", col)


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """tr, tc of all cells of a grid."""
    return spark.range(height).select(F.col("id").alias("tr"), F.explode(F.sequence(F.lit(0), F.lit(width - 1)).cast("array<bigint>")).alias("tc"))


def zoom_targets(spark: SparkSession, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """A grid of another size over the same corners."""
    at = lambda x, n, m: F.col(x) * F.lit((n - 1) / max(1, m - 1))
    return grid(spark, *target).withColumns({"y": at("tr", source[0], target[0]), "x": at("tc", source[1], target[1])})


def affine_targets(cells: DataFrame, a: float, b: float, c: float, d: float, e: float, f: float) -> DataFrame:
    """For each (tr, tc): x = a tc + b tr + c, y = d tc + e tr + f in the source."""
    return cells.withColumns({"x": a * F.col("tc") + b * F.col("tr") + c, "y": d * F.col("tc") + e * F.col("tr") + f})


def pad(df: DataFrame, by: Sequence[str], shape: tuple[int, int], multiple: int, mode: str = "mirror") -> DataFrame:
    """``df`` with rows and columns repeated beyond its edge up to a multiple: mirror (c b | a b c) or edge."""
    h, w = (-(-n // multiple) * multiple for n in shape)

    def copies(x: str, n: int, m: int) -> Column:
        col = F.col(x).cast("long")
        if mode == "edge":
            return F.when(col == n - 1, F.sequence(F.lit(n - 1).cast("long"), F.lit(m - 1).cast("long"))).otherwise(F.array(col))
        other = F.lit(2 * n - 2) - col
        return F.when((other > n - 1) & (other <= m - 1), F.array(col, other.cast("long"))).otherwise(F.array(col))

    return df.withColumn("r", F.explode(copies("r", shape[0], h))).withColumn("c", F.explode(copies("c", shape[1], w)))


def patches(mask: DataFrame, by: Sequence[str], shape: tuple[int, int], size: int, stride: int) -> DataFrame:
    """by, r0, c0, n, fraction: the foreground of every tile that has any.

    Each cell names the few tiles that hold it from the stride; nothing is joined.
    """
    hit = mask.select(*by, F.explode(starts_over(F.col("r"), shape[0], size, stride)).alias("r0"), "c").select(*by, "r0", F.explode(starts_over(F.col("c"), shape[1], size, stride)).alias("c0"))
    return hit.groupBy(*by, "r0", "c0").agg(F.count("*").alias("n")).withColumn("fraction", F.col("n") / F.lit(float(size * size)))


def background(tiles: DataFrame, fg: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tiles (by, r0, c0) without foreground, at most a third as many as have some and at least one in each group, in reading order."""
    wanted = fg.groupBy(*by).agg(F.greatest(F.floor(F.count("*") / 3), F.lit(1)).alias("k"))
    empty = tiles.join(fg.select(*by, "r0", "c0"), [*by, "r0", "c0"], "left_anti")
    w = Window.partitionBy(*by).orderBy("r0", "c0")
    return empty.withColumn("n", F.row_number().over(w)).join(wanted, list(by)).where("n <= k").select(*by, "r0", "c0")


def dihedral(df: DataFrame, size: int) -> DataFrame:
    """The eight turns and flips of square patches, one set of rows for each variant."""
    n = F.lit(size - 1)
    r, c = F.col("r"), F.col("c")
    turned = [(r, c), (n - c, r), (n - r, n - c), (c, n - r)]
    options = [F.struct(F.lit(k + 4 * f).cast("long").alias("variant"), a.cast("long").alias("r"), (n - b if f else b).cast("long").alias("c")) for f in (0, 1) for k, (a, b) in enumerate(turned)]
    rest = [x for x in df.columns if x not in ("r", "c")]
    return df.select(*rest, F.explode(F.array(*options)).alias("o")).select(*rest, "o.variant", "o.r", "o.c")


def unit_hash(seed: int, *cols: str) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of the MD5 of the seed and the columns, joined by |: any engine can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def jitter(df: DataFrame, key: str, col: str, amount: float, seed: int) -> DataFrame:
    """Contrast and brightness changed by up to ``amount``, alike for all cells of a patch."""
    c = (unit_hash(seed, key) * 2 - 1) * amount
    b = (unit_hash(seed + 1, key) * 2 - 1) * amount
    return df.withColumn(col, F.col(col) * (1 + c) + b)


def block_fold(r: Column, c: Column, shape: tuple[int, int], block: int, folds: int) -> dict[str, Column]:
    """block_id and fold of a cell; cells beyond the last full block belong to it."""
    rows, cols = (max(1, n // block) for n in shape)
    br, bc = (F.least(F.floor(x / block), F.lit(n - 1)) for x, n in ((r, rows), (c, cols)))
    block_id = (br * cols + bc).cast("long")
    return {"block_id": block_id, "fold": block_id % folds}


def random_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``df`` with split: a ``share`` of the keys, at least one, is for validation: those with the smallest hashes, ties to the smaller key.

    Rows that share a key stay together, so nothing validated was trained on. Rows without a key are for training.
    """
    keys = numbered(df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__u", unit_hash(seed, key)), [], ["__u", key], "__n")
    n_val = F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("__n_total")))
    held = keys.where(F.col("__n") < n_val).select(key, F.lit("val").alias("split"))
    return df.join(held, key, "left").select(*df.columns, F.coalesce("split", F.lit("train")).alias("split"))


def temporal_split(df: DataFrame, year: str, train: tuple[int, int], test: tuple[int, int], order: Sequence[str] = (), fallback: float = 0.6) -> DataFrame:
    """``df`` with split: years in either range; a year between them is dropped, an unknown one is for training.

    If no row has a year in either range, the first ``fallback`` of all rows in ``order``
    are for training and the rest for testing.
    """
    y = F.col(year)
    if df.where(y.between(*train) | y.between(*test)).limit(1).count():
        split = F.when(y.isNull(), "train").when(y.between(*train), "train").when(y.between(*test), "test")
        return df.withColumn("split", split).where(F.col("split").isNotNull())
    rows = numbered(df, [], list(order) or df.columns, "__n")
    return rows.withColumn("split", F.when(F.col("__n") < F.floor(F.col("__n_total") * F.lit(fallback)), "train").otherwise("test")).drop("__n", "__n_total")


def weighted_draw(df: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """draw, key: ``n`` draws with replacement in proportion to weight (rows of weight 0 or less are never drawn).

    Rows take pieces of [0, 1) in order of key. A draw goes to the part that its number
    falls in, and meets its row there by one sort: the last piece that begins before it.
    """
    pieces, begin = running_share(df, key, weight)
    if not begin:
        return df.sparkSession.createDataFrame([], f"draw long, {key} {df.schema[key].dataType.simpleString()}")
    edges, names = (F.array(*(F.lit(x[i]) for x in begin)) for i in (1, 0))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), unit_hash(seed, "id").alias("at"))
    draws = draws.withColumn("part", F.element_at(names, F.size(F.filter(edges, lambda e: e <= F.col("at")))))
    both = pieces.select("part", F.col("low").alias("at"), F.lit(None).cast("long").alias("draw"), key).unionByName(draws.withColumn(key, F.lit(None).cast(df.schema[key].dataType)))
    w = Window.partitionBy("part").orderBy("at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(key, F.last(key, ignorenulls=True).over(w)).where("draw IS NOT NULL").select("draw", key)


#: Cells a side of the tiles of scenes that are compared.
TILE = 256


def _steps(reach: int) -> Column:
    """All shifts within ``reach``."""
    return F.array(*(F.struct(F.lit(i).cast("long").alias("dr"), F.lit(j).cast("long").alias("dc")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))


def _shift_scores(fixed: DataFrame, moving: DataFrame, col: str, reach: int, by: Sequence[str], each: Sequence[str], steps: DataFrame | None = None) -> DataFrame:
    """by, each, dr, dc, score: the correlation over shared cells for every shift that overlaps; of those in ``steps`` (by, each, steps), or all within ``reach``.

    A tile of a scene meets the same tile of the fixed one and a border of ``reach`` cells. It gives a count, means and
    moments for each shift, and these are added up: cells move once, not once for each shift.
    """
    keys = [*by, *each]
    z = F.col(col).cast("double").alias("z")
    tile = lambda x: F.floor(x / F.lit(TILE))
    loose = moving.select(*keys, tile(F.col("r")).alias("__tr"), tile(F.col("c")).alias("__tc"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), z, F.lit(None).cast("array<struct<dr: bigint, dc: bigint>>").alias("steps"))
    asked = loose.select(*keys, "__tr", "__tc").distinct()
    if steps is None:
        asked = asked.withColumn("steps", _steps(reach))
    else:
        asked = asked.join(steps, keys) if keys else asked.crossJoin(steps)
    loose = loose.unionByName(asked.withColumns({"r": F.lit(None).cast("long"), "c": F.lit(None).cast("long"), "z": F.lit(None).cast("double")}))
    if each:
        scenes = moving.select(*keys).distinct()
        fixed = fixed.join(scenes, list(by)) if by else fixed.crossJoin(scenes)
    over = lambda x: F.explode(F.sequence(tile(F.col(x) - reach), tile(F.col(x) + reach)))
    still = fixed.select(*(F.col(k).alias(k) for k in keys), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), z).withColumn("__tr", over("r")).withColumn("__tc", over("c"))
    numbers = ["n", "mf", "mm", "sf", "sm", "sc"]
    schema = T.StructType([*(T.StructField(k, moving.schema[k].dataType) for k in keys), *(T.StructField(x, T.LongType()) for x in ("dr", "dc")), *(T.StructField(x, T.DoubleType()) for x in numbers)])

    def grid_of(part: pa.Table, r0: int, c0: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, which cells are there, and which have a value."""
        r, c = part.column("r").to_numpy() - r0, part.column("c").to_numpy() - c0
        fine = (r >= 0) & (r < shape[0]) & (c >= 0) & (c < shape[1])
        at = r[fine], c[fine]
        value, there, valid = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        value[at], there[at], valid[at] = part.column("z").to_numpy()[fine], True, part.column("z").is_valid().to_numpy()[fine]
        return value, there, valid

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        tried = right.column("steps").drop_null().to_pylist()
        right = right.filter(right.column("steps").is_null())
        if left.num_rows and right.num_rows and tried:
            r, c = right.column("r").to_numpy(), right.column("c").to_numpy()
            r0, c0, h, w = int(r.min()), int(c.min()), int(np.ptp(r)) + 1, int(np.ptp(c)) + 1
            y, y_there, y_valid = grid_of(right, r0, c0, (h, w))
            x, x_there, x_valid = grid_of(left, r0 - reach, c0 - reach, (h + 2 * reach, w + 2 * reach))
            for step in tried[0]:
                cut = (slice(reach + step["dr"], reach + step["dr"] + h), slice(reach + step["dc"], reach + step["dc"] + w))
                if not (x_there[cut] & y_there).any():
                    continue
                both = x_valid[cut] & y_valid
                f, m = x[cut][both], y[both]
                row = [0.0] * len(numbers)
                if len(f):
                    with np.errstate(invalid="ignore", over="ignore"):
                        mf, mm = f[0] + (f - f[0]).mean(), m[0] + (m - m[0]).mean()
                        f, m = f - mf, m - mm
                        row = [float(len(f)), mf, mm, f @ f, m @ m, f @ m]
                out.append((step["dr"], step["dc"], *row))
        own = [pa.array([k.as_py()] * len(out), k.type) for k in key[: len(keys)]]
        rest = [pa.array([o[i] for o in out], pa.int64() if i < 2 else pa.float64()) for i in range(2 + len(numbers))]
        return pa.Table.from_arrays([*own, *rest], names=schema.names)

    at = [*keys, "__tr", "__tc"]
    parts = loose.groupBy(*at).cogroup(still.groupBy(*at))
    parts = parts.applyInArrow(lambda key, right, left: run(key, left, right), schema)
    w = Window.partitionBy(*keys, "dr", "dc")
    some = F.when(F.col("n") > 0, 1.0)
    middle = {}
    for k in ("mf", "mm"):
        low = F.min(some * F.col(k)).over(w)
        middle[f"d{k}"] = F.col(k) - (low + F.sum(F.col("n") * (F.col(k) - low)).over(w) / F.nullif(F.sum("n").over(w), F.lit(0.0)))
    sums = {k: F.sum(F.when(F.col("n") > 0, F.col(k) + F.col("n") * a * b)) for k, a, b in (("sf", F.col("dmf"), F.col("dmf")), ("sm", F.col("dmm"), F.col("dmm")), ("sc", F.col("dmf"), F.col("dmm")))}
    total = parts.withColumns(middle).groupBy(*keys, "dr", "dc").agg(*(e.alias(k) for k, e in sums.items()))
    return total.select(*keys, "dr", "dc", F.when((F.col("sf") > 0) & (F.col("sm") > 0), F.col("sc") / F.sqrt(F.col("sf") * F.col("sm"))).alias("score"))


def register_shift(fixed: DataFrame, moving: DataFrame, col: str, reach: int, by: Sequence[str] = (), each: Sequence[str] = ()) -> DataFrame:
    """by, each, dr, dc, score for every shift of ``moving`` within ``reach`` that overlaps: the correlation over shared cells, null where one side is level. ``each`` names the scenes of ``moving`` that share one fixed scene; a scene has a cell once."""
    return _shift_scores(fixed, moving, col, reach, by, each)


def best_shift(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, dr, dc: the shift of the best score, ties (in six digits) to the shortest, then the smaller one; scores that aren't numbers take no part."""
    fine = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    rank = F.struct(-F.round("score", 6), F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc"), F.col("dr"), F.col("dc"))
    return fine.groupBy(*by).agg(F.min_by(F.struct("dr", "dc"), rank).alias("b")).select(*by, "b.dr", "b.dc")


def _reduced(df: DataFrame, keys: Sequence[str], col: str, factor: int) -> DataFrame:
    if factor == 1:
        return df.select(*keys, "r", "c", col)
    return df.groupBy(*keys, F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg(col).alias(col))


def register_pyramid(fixed: DataFrame, moving: DataFrame, col: str, reach: int, by: Sequence[str] = (), each: Sequence[str] = (), kept: int = 3, least: int = 4) -> DataFrame:
    """by, each, dr, dc, score: the shift of ``moving`` that correlates best, searched from coarse cells to fine ones.

    Cells are averaged by powers of two until ``reach`` is at most ``least`` of them; there every
    shift is tried. Each finer level tries the cells round twice the ``kept`` best shifts of the one before. So some
    12 * ``kept`` shifts are tried whatever the reach, not all (2 reach + 1)**2; a pixel moves once a level; with a reach of ``least`` or less it is the exhaustive search. Ties are as in
    ``best_shift``; scenes without a score have no row.
    """
    keys = [*by, *each]
    levels = max(0, math.ceil(math.log2(max(1, reach) / least)))
    fixed, moving = stored(fixed.select(*by, "r", "c", col), "fixed"), stored(moving.select(*keys, "r", "c", col), "moving")
    found = None
    for level in range(levels, -1, -1):
        factor = 1 << level
        still, loose = _reduced(fixed, by, col, factor), _reduced(moving, keys, col, factor)
        if found is None:
            scores = register_shift(still, loose, col, math.ceil(reach / factor), by, each)
        else:
            near = F.explode(F.array(*(F.struct((2 * F.col("dr") + i).alias("dr"), (2 * F.col("dc") + j).alias("dc")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
            shifts = found.select(*keys, near.alias("__o")).select(*keys, "__o.dr", "__o.dc").where((F.abs("dr") <= math.ceil(reach / factor)) & (F.abs("dc") <= math.ceil(reach / factor))).distinct()
            steps = shifts.groupBy(*keys).agg(F.collect_list(F.struct("dr", "dc")).alias("steps"))  # a row for each scene, of 9 * kept at most
            scores = _shift_scores(still, loose, col, math.ceil(reach / factor), by, each, steps)
        fine = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
        rank = F.struct((-F.round("score", 6)).alias("a"), (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("b"), "dr", "dc", "score")
        best = F.slice(F.array_sort(F.collect_list(rank)), 1, kept if level else 1)
        found = stored(fine.groupBy(*keys).agg(best.alias("best")).select(*keys, F.explode("best").alias("__s")).select(*keys, "__s.dr", "__s.dc", "__s.score"), "shifts")
    return found


def stack(base: DataFrame, by: Sequence[str], shape: tuple[int, int], layers: Sequence[tuple[DataFrame | None, Sequence[str], str, tuple[int, int]]]) -> DataFrame:
    """``base`` (by, r, c, ...) with the columns of other layers, cell by cell.

    A layer is (table, its own keys, column, its grid's shape): one on another grid gives
    each cell the nearest of its own, one without a table is left out. Cells that a layer
    lacks are null. Each layer is met by equal cells; nothing of ``base`` is copied.
    """
    out = base
    for table, keys, col, own in layers:
        if table is None:
            continue
        at = lambda x, n, m: F.floor(F.col(x) * F.lit((m - 1) / max(1, n - 1)) + 0.5).cast("long")
        placed = out.withColumns({"__lr": at("r", shape[0], own[0]), "__lc": at("c", shape[1], own[1])})
        part = table.select(*keys, F.col("r").alias("__lr"), F.col("c").alias("__lc"), col)
        out = placed.join(part, [*keys, "__lr", "__lc"], "left").drop("__lr", "__lc")
    return out.select(*base.columns, *(c for t, _, c, _ in layers if t is not None))


#: Seeds that a task draws, about.
SEEDS = 1 << 18


def _drawn(seeds: DataFrame, cells: Column, shape: tuple[int, int]) -> DataFrame:
    """id, r, c: the ``cells`` (an array of r, c) of each seed that are inside, once for each id.

    Cells of a seed are told apart in its own row; only those of ids with several seeds meet in a shuffle.
    """
    seeds = stored(seeds, "seeds")
    parts = max(1, math.ceil(seeds.count() / SEEDS))
    counted = seeds.repartition(parts, "id").withColumn("__n", F.count("*").over(Window.partitionBy("id")))
    inside = F.array_distinct(F.filter(cells, lambda x: x["r"].between(0, shape[0] - 1) & x["c"].between(0, shape[1] - 1)))
    draw = lambda df: df.select("id", F.explode(inside).alias("__o")).select("id", "__o.r", "__o.c")
    return draw(counted.where("__n = 1")).unionByName(draw(counted.where("__n > 1")).distinct())


def draw_channels(seeds: DataFrame, shape: tuple[int, int], width: int = 3) -> DataFrame:
    """Cells of straight channels: seeds have id, r, c, dr, dc (steps of the direction) and length."""
    trunc = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")
    at = lambda k: F.struct(trunc(F.col("r") + k * F.col("dr")).alias("r"), trunc(F.col("c") + k * F.col("dc")).alias("c"))
    line = F.filter(F.transform(F.sequence(F.lit(0), F.col("length").cast("int") - 1), at), lambda p: p["r"].between(-width, shape[0] + width) & p["c"].between(-width, shape[1] + width))
    span = range((-width) // 2, width // 2 + 1)
    wide = F.transform(line, lambda p: F.array(*(F.struct((p["r"] + i).alias("r"), (p["c"] + j).alias("c")) for i in span for j in span)))
    return _drawn(seeds.where("length > 0").select("id", "r", "c", "dr", "dc", "length"), F.flatten(wide), shape)


def draw_discs(seeds: DataFrame, shape: tuple[int, int], radius: int) -> DataFrame:
    """Cells within ``radius`` of each seed (id, r, c)."""
    near = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    return _drawn(seeds.select("id", "r", "c"), F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i, j in near)), shape)
