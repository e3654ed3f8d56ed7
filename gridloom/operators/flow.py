"""Flow over terrain: the cell that each one drains to, and what lies downstream of some."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.scratch import stored

#: Row and column steps of the eight directions, clockwise from north.
EIGHT = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def flow_next(terrain: DataFrame, shape: tuple[int, int], aspect: str = "aspect") -> DataFrame:
    """r, c, nr, nc: the neighbour in the direction nearest to the azimuth; cells that drain out of the grid, and those without an azimuth, have no row."""
    k = F.pmod(F.floor(F.col(aspect) / 45 + 0.5), F.lit(8)).cast("int")
    step = lambda i: F.get(F.array(*(F.lit(d[i]) for d in EIGHT)), k)
    out = terrain.where(F.col(aspect).isNotNull() & ~F.isnan(aspect)).select("r", "c", (F.col("r") + step(0)).alias("nr"), (F.col("c") + step(1)).alias("nc"))
    return out.where(F.col("nr").between(0, shape[0] - 1) & F.col("nc").between(0, shape[1] - 1))


def downstream(seeds: DataFrame, flow: DataFrame, length: int) -> DataFrame:
    """r, c: the cells within ``length`` cells of flow from the seeds (r, c), which count as the first.

    Ways are doubled, so the rounds follow the logarithm of the length; a cell keeps
    the longest way that is left to go from it. Seeds and cells may repeat; ways may meet, end or go round.
    """
    reached = stored(seeds.select("r", "c").distinct().withColumn("left", F.lit(length - 1)), "reached")
    jump, size = stored(flow.select("r", "c", "nr", "nc"), "jump"), 1
    while size < length:
        further = reached.where(F.col("left") >= size).join(jump, ["r", "c"]).select(F.col("nr").alias("r"), F.col("nc").alias("c"), (F.col("left") - size).alias("left"))
        reached = stored(reached.union(further).groupBy("r", "c").agg(F.max("left").alias("left")), "reached")
        size *= 2
        if size < length:
            beyond = jump.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("nr").alias("fr"), F.col("nc").alias("fc"))
            jump = stored(jump.join(beyond, ["nr", "nc"]).select("r", "c", F.col("fr").alias("nr"), F.col("fc").alias("nc")), "jump")
    return reached.where("left >= 0").select("r", "c")
