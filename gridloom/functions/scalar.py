"""Column functions: band indices, quantising, map geometry, ids and dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8
#: Radii of the sphere, in metres: of the map projection, and of pixel areas.
MAP_RADIUS, AREA_RADIUS = 3_396_190.0, 3_389_500.0


def difference_ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), kept finite."""
    return (a - b) / (a + b + F.lit(EPS))


def band_ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(EPS))


class IndexTable:
    """Named band indices as SQL expressions with the bands they need; users add their own."""

    def __init__(self, defs: Mapping[str, tuple[str, Sequence[str]]]):
        self.defs = dict(defs)

    def register(self, name: str, expr: str, requires: Sequence[str]) -> None:
        self.defs[name] = (expr, tuple(requires))

    def apply(self, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """``df`` with a column for each index whose bands it has; an unknown name is an error."""
        for n in names or ():
            if n not in self.defs:
                raise KeyError(f"no index is named {n}")
        have = set(df.columns)
        return df.withColumns({n: F.expr(e) for n, (e, need) in self.defs.items() if (not names or n in names) and set(need) <= have})


INDICES = IndexTable(
    {
        "rsi": ("(red - blue) / (red + blue + 1e-8D)", ("red", "blue")),
        "dci": ("(nir - red) / (nir + red + 1e-8D)", ("nir", "red")),
        "ndsi": ("(green - red) / (green + red + 1e-8D)", ("green", "red")),
        "swi": ("(swir2400 - swir2300) / (swir2400 + swir2300 + 1e-8D)", ("swir2400", "swir2300")),
        "redness": ("red / (blue + 1e-8D)", ("red", "blue")),
    }
)


# The bands of a sensor in order; a band may have a second name.
SENSOR_BANDS = {"red_blue_infrared": (("red",), ("blue", "green"), ("nir",)), "generic": (("red",), ("green",), ("blue",), ("nir",))}


def name_bands(df: DataFrame, sensor: str, bands: Sequence[str]) -> DataFrame:
    """``df`` with the columns ``bands`` (in the sensor's order, as many as there are) under their names; an unknown sensor is ``generic``."""
    names = SENSOR_BANDS.get(sensor, SENSOR_BANDS["generic"])
    return df.withColumns({n: F.col(b) for b, own in zip(bands, names, strict=False) for n in own}).drop(*(b for b in bands if not any(b in own for own in names)))


def affine_from_position(lat: Column, lon: Column, width: Column, height: Column, cell: float = 6.0) -> dict[str, Column]:
    """The corner x0, y0 and the steps a, e of a raster whose middle is at a place in degrees."""
    return {"x0": to_metres(lon) - width / 2 * cell, "y0": to_metres(lat) + height / 2 * cell, "a": F.lit(cell), "e": F.lit(-cell)}


def affine_from_bounds(west: Column, south: Column, east: Column, north: Column, width: Column, height: Column) -> dict[str, Column]:
    """The corner x0, y0 and the steps a, e of a raster between bounds in degrees."""
    x0, x1, y0, y1 = to_metres(west), to_metres(east), to_metres(south), to_metres(north)
    return {"x0": x0, "y0": y1, "a": (x1 - x0) / width, "e": (y0 - y1) / height}


def scrub(x: Column) -> Column:
    """NaN and null to 0, +inf to 1, -inf to 0."""
    return F.when(x.isNull() | F.isnan(x) | (x == F.lit(float("-inf"))), 0.0).when(x == F.lit(float("inf")), 1.0).otherwise(x)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def quantize(x: Column, levels: int) -> Column:
    """Levels 0 .. levels - 1 of a value between 0 and 1."""
    return F.floor(clip(x) * F.lit(float(levels - 1))).cast("long")


def fix_channels(f: Column, n: int, fill: str = "zero") -> Column:
    """An array of exactly ``n`` values: cut, or filled with zeros or with the last value."""
    if fill not in ("zero", "repeat"):
        raise ValueError("fill is zero or repeat")
    more = F.lit(0.0) if fill == "zero" else F.element_at(f, -1)
    return F.slice(F.concat(f, F.array_repeat(more, n)), 1, n)


def pixel_area(width: Column, height: Column, geographic: Column) -> Column:
    """Square metres of a pixel: |a e|, degrees measured on the sphere; 1 without a transform."""
    degree = F.lit(3.141592653589793 / 180 * AREA_RADIUS)
    metres = F.abs(width * height)
    return F.coalesce(F.when(geographic, F.abs(width) * degree * F.abs(height) * degree).otherwise(metres), F.lit(1.0))


def to_metres(degrees: Column) -> Column:
    return F.radians(degrees) * F.lit(MAP_RADIUS)


def to_degrees(metres: Column) -> Column:
    return F.degrees(metres / F.lit(MAP_RADIUS))


def wrap_180(lon: Column) -> Column:
    """Longitude in (-180, 180]."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def wrap_360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def west_to_east(lon: Column) -> Column:
    return F.lit(360.0) - lon


def pixel_to_map(a: Column, x0: Column, n: Column) -> Column:
    """The map coordinate of a pixel's centre along one axis."""
    return x0 + (n.cast("double") + 0.5) * a


def map_to_pixel(a: Column, x0: Column, x: Column) -> Column:
    return F.floor((x - x0) / a).cast("long")


def ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring of five points."""
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def sort_key(path: Column) -> Column:
    """The orbit of a scene: six digits after a phase name, any six digits, a year of this century, or the place of a named site."""
    named = F.when(path.contains("primary"), "000000").when(path.contains("secondary"), "000001").when(path.contains("tertiary"), "000002").otherwise("000000")
    return F.coalesce(_found(path, "[EP]SP_([0-9]{6})"), _found(path, "([0-9]{6})"), _found(path, "(20[0-9]{2})"), named)


def parse_year(path: Column) -> Column:
    return _found(path, "(200[0-9]|201[0-9]|202[0-9])").cast("long")


def mid_year(path: Column) -> Column:
    return F.make_date(_found(path, "([0-9]{4})").cast("int"), F.lit(7), F.lit(1))


def orbit_block(obs: Column) -> Column:
    """ORB_lo_hi, the hundred orbits that hold an observation."""
    low = (F.floor(F.split(obs, "_")[1].cast("long") / 100) * 100).cast("long")
    return F.concat_ws("_", F.lit("ORB"), F.lpad(low.cast("string"), 6, "0"), F.lpad((low + 99).cast("string"), 6, "0"))


def short_name(name: Column) -> Column:
    return F.lower(F.split(name, " ")[0])


def signed_position(pid: Column) -> tuple[Column, Column]:
    """Latitude and east longitude written in a product id, as in 41S257W."""
    pattern = "([0-9]+)([NS])([0-9]+)([EW])"
    lat = F.regexp_extract(pid, pattern, 1).cast("double") * F.when(F.regexp_extract(pid, pattern, 2) == "S", -1.0).otherwise(1.0)
    lon = F.regexp_extract(pid, pattern, 3).cast("double")
    return lat, F.when(F.regexp_extract(pid, pattern, 4) == "W", 360.0 - lon).otherwise(lon)


def blend_weight(method: str, i: Column, j: Column, size: int) -> Column:
    """The weight of cell (i, j) of a tile of ``size`` cells a side, at least 1e-6."""
    pi = 3.141592653589793
    if method == "hanning":
        one = lambda k: F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * pi) * k.cast("double") / F.lit(float(size - 1)))
        return F.greatest(one(i) * one(j), F.lit(1e-6))
    middle = (size - 1) / 2
    if method == "linear":
        one = lambda k: F.greatest(F.lit(1.0) - F.abs(k.cast("double") - middle) / F.lit(size / 2), F.lit(1e-6))
        return one(i) * one(j)
    if method == "gaussian":
        one = lambda k: (k.cast("double") - middle) / F.lit(0.35 * size)
        return F.greatest(F.exp(F.lit(-0.5) * (one(i) * one(i) + one(j) * one(j))), F.lit(1e-6))
    raise ValueError(f"no blend weight is named {method}")


def interleaved(r: Column, c: Column) -> Column:
    """The Z-order of a cell: the bits of its row and column (from 0, under 2**31) in turn."""

    def spread(x: Column) -> Column:
        x = x.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return F.shiftleft(spread(r), 1).bitwiseOR(spread(c))
