"""Product catalogues and ledgers: parsing, lookup, search, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.scratch import stored


def parse_index(lines: DataFrame, line: str = "line", number: str = "line_no") -> DataFrame:
    """product_id, volume, path from lines of volume, path, ...: of a repeated product the last line wins."""
    part = F.split(F.translate(line, '"', ""), ",")
    out = lines.select(F.trim(part[0]).alias("volume"), F.trim(part[1]).alias("path"), F.col(number).alias("n"))
    out = out.withColumn("product_id", F.regexp_replace(F.upper(F.element_at(F.split("path", "/"), -1)), "\\.IMG$", ""))
    return out.groupBy("product_id").agg(F.max_by("volume", "n").alias("volume"), F.max_by("path", "n").alias("path"))


def flatten_catalogue(df: DataFrame, doc: str, keep: Sequence[str], item_schema: str, path: str) -> DataFrame:
    """One row for each item at a JSON path that may hold an object, an array, or nothing."""
    raw = F.get_json_object(doc, path)
    one, many = F.from_json(raw, item_schema), F.from_json(raw, f"array<{item_schema}>")
    items = F.when(F.substring(raw, 1, 1) == "[", many).when(raw.isNotNull(), F.array(one)).otherwise(F.array().cast(f"array<{item_schema}>"))
    return df.select(*keep, F.explode(items).alias("item")).select(*keep, "item.*")


def pick_priority(df: DataFrame, by: Sequence[str], rank: Column, ties: Sequence[str]) -> DataFrame:
    """The row of each group with the smallest rank; null ranks take no part."""
    w = Window.partitionBy(*by).orderBy("__rank", *ties)
    return df.withColumn("__rank", rank).where("__rank IS NOT NULL").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__rank", "__n")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def first_containing(names: DataFrame, stems: DataFrame, name: str, stem: str) -> DataFrame:
    """Each stem with the first name, by order, that contains it; stems that no name contains, and empty ones, have no row.

    A name is spread over its parts of the lengths that stems have (a few numbers, at
    most as many as the longest name has letters), and both meet by equal text: any stem
    is found, and no common key brings all together.
    """
    stems = stems.select(stem).where(F.length(stem) > 0).distinct()
    lengths = sorted(r["n"] for r in stems.select(F.length(stem).alias("n")).distinct().collect())
    if not lengths:
        return stems.withColumn(name, F.lit(None).cast("string")).limit(0)
    size = F.length(name)

    def parts(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substr(F.col(name), i, F.lit(n)))
        return F.when(size >= n, found).otherwise(F.array().cast("array<string>"))

    spread = names.select(name, F.explode(F.array_distinct(F.concat(*map(parts, lengths)))).alias(stem))
    # Texts shrink so much in a shuffle that Spark would take millions of stems for a small table, and broadcast them.
    return spread.join(stems.hint("merge"), stem).groupBy(stem).agg(F.min(name).alias(name))


def resolve(keys: DataFrame, key: str, sources: Sequence[DataFrame], value: str) -> DataFrame:
    """keys with the first value that a list of lookup tables has, and the number of that table."""
    out = keys
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col(value).alias(f"__v{i}")), key, "left")
    found = [F.col(f"__v{i}") for i in range(len(sources))]
    which = F.coalesce(*(F.when(v.isNotNull(), F.lit(i)) for i, v in enumerate(found)))
    return out.select(*keys.columns, F.coalesce(*found).alias(value), which.cast("long").alias("source_no"))


#: Degrees of the coarsest cells; a cell of level k has the 2**k-th part. Powers of two, so that cells of all levels fit into each other exactly.
ROOT = 64.0
_BOX = ("lon0", "lat0", "lon1", "lat1")


def _cell(x, level) -> Column:
    return F.floor(x * F.pow(F.lit(2.0), level) / ROOT).cast("long")


def _pieces(boxes: DataFrame, key: str, around: float | None) -> DataFrame:
    """key and box, its longitudes between 0 and ``around``: a box that goes across the end is two."""
    x = boxes.select(key, *(F.col(k).cast("double").alias(k) for k in _BOX))
    if around is None:
        return x
    width = F.when(F.col("lon1") >= F.col("lon0"), F.col("lon1") - F.col("lon0")).otherwise(F.col("lon1") + around - F.col("lon0"))
    low = F.when(width >= around, 0.0).otherwise(F.pmod("lon0", F.lit(around)))
    high = low + F.least(width, F.lit(around))
    part = lambda a, b: F.struct(a.alias("lon0"), "lat0", b.alias("lon1"), "lat1")
    parts = F.when(high >= around, F.array(part(low, F.lit(around)), part(F.lit(0.0), high - around))).otherwise(F.array(part(low, high)))
    return x.select(key, F.explode(parts).alias("__p")).select(key, "__p.*")


def _in_cells(boxes: DataFrame, splits: DataFrame, levels: Sequence[int]) -> DataFrame:
    """``boxes`` in the cells (k, x, y) of the quadtree that they touch: a cell that is split hands them to its quarters.

    A box with a level of its own stays in the cells of that level, split or not, so it is in four cells or so. One without
    is in every cell on its way to the leaves.
    """

    def spread(df: DataFrame, level: int, x: tuple[Column, Column], y: tuple[Column, Column]) -> DataFrame:
        reach = lambda axis, own: F.explode(F.sequence(F.greatest(own[0], _cell(F.col(f"{axis}0"), F.lit(level))), F.least(own[1], _cell(F.col(f"{axis}1"), F.lit(level)))))
        return df.withColumn("__nx", reach("lon", x)).withColumn("__ny", reach("lat", y)).drop("x", "y").withColumnsRenamed({"__nx": "x", "__ny": "y"})

    least, most = F.lit(-(1 << 60)), F.lit(1 << 60)
    open_, leaves = spread(boxes, 0, (least, most), (least, most)), None
    for level in levels:
        at = splits.where(F.col("k") == level).select("x", "y")
        met = open_.join(at.withColumn("split", F.lit(True)), ["x", "y"], "left")
        done = met.withColumn("k", F.lit(level)).where("split IS NULL OR own IS NULL OR own <= k").drop("split")
        leaves = done if leaves is None else leaves.unionByName(done)
        x, y = F.col("x"), F.col("y")
        open_ = stored(spread(met.where(F.col("split") & (F.col("own").isNull() | (F.col("own") > level))).drop("split"), level + 1, (2 * x, 2 * x + 1), (2 * y, 2 * y + 1)), "boxes")
    open_ = open_.withColumn("k", F.lit(len(levels)))
    return open_ if leaves is None else leaves.unionByName(open_)


def bbox_search(items: DataFrame, sites: DataFrame, around: float | None = None, crowd: int = 10_000, depth: int = 16) -> DataFrame:
    """site, id for boxes that overlap or touch: both sides meet in the cells of a quadtree that is fine where items are dense.

    An item goes down to cells of about its own size at most, so that it is copied some four times however dense items are;
    sites are met on all levels. A cell with more than ``crowd`` items that go further down is split, ``depth`` times at most; in one that is still crowded,
    as where boxes are alike, items are dealt over parts and the sites' boxes copied to each. A pair that shares
    several cells is given by the one with their larger lower corners. With ``around`` (360) longitudes are
    a circle: boxes may cross its end, or have a smaller lon1 than lon0.
    """
    side = F.greatest(F.col("lon1") - F.col("lon0"), F.col("lat1") - F.col("lat0"), F.lit(ROOT / (1 << depth)))
    a = _pieces(items, "id", around).withColumn("own", F.greatest(F.floor(F.log2(F.lit(ROOT) / side)), F.lit(0)).cast("int"))
    b = _pieces(sites, "site", around).withColumn("own", F.lit(None).cast("int"))
    fine = a.where("own > 0").groupBy(_cell(F.col("lon0"), F.lit(depth)).alias("fx"), _cell(F.col("lat0"), F.lit(depth)).alias("fy"), "own").agg(F.count("*").alias("n"))
    up = F.explode(F.sequence(F.lit(0), F.col("own") - 1))
    above = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), depth - F.col("k"))).cast("long")
    cells = fine.withColumn("k", up).groupBy("k", above("fx").alias("x"), above("fy").alias("y")).agg(F.sum("n").alias("n"))
    splits = stored(cells.where(F.col("n") > crowd).select("k", "x", "y"), "splits")
    levels = sorted(r["k"] for r in splits.select("k").distinct().collect())  # ``depth`` numbers at most
    placed = _in_cells(a, splits, levels)
    if levels:
        placed = stored(placed, "placed")
    loads = placed.groupBy("k", "x", "y").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("k", "x", "y", F.ceil(F.col("n") / crowd).alias("parts"))
    loads = stored(loads, "loads")
    one = F.coalesce("parts", F.lit(1))
    left = placed.drop("own").join(loads, ["k", "x", "y"], "left").withColumn("part", F.pmod(F.xxhash64("id", *_BOX), one)).drop("parts")
    right = _in_cells(b, splits, levels).drop("own").join(loads, ["k", "x", "y"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("parts")
    both = left.join(right.withColumnsRenamed({k: f"s{k}" for k in _BOX}), ["k", "x", "y", "part"]).where("lon0 <= slon1 AND lon1 >= slon0 AND lat0 <= slat1 AND lat1 >= slat0")
    home = (_cell(F.greatest("lon0", "slon0"), F.col("k")) == F.col("x")) & (_cell(F.greatest("lat0", "slat0"), F.col("k")) == F.col("y"))
    out = both.where(home).select("site", "id")
    return out.distinct() if around is not None else out


def ledger_state(ledger: DataFrame) -> DataFrame:
    """step, key and the status written last; a key whose last row is a tombstone is gone."""
    last = F.max_by("status", F.struct("ts", "seq"))
    return ledger.groupBy("step", "key").agg(last.alias("status")).where("status <> 'cleared'")


def pending(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """Keys of a step that aren't done."""
    return keys.join(ledger_state(ledger).where("status = 'done'").select("step", "key"), ["step", "key"], "left_anti")


def record(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger with more rows: nothing is overwritten."""
    return ledger.unionByName(rows)
