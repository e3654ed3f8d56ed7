"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import stored


def stars(links: DataFrame) -> bool:
    """Whether every larger end of links (a < b, or a node with itself) has one smaller end, which is no larger end itself."""
    real = links.where("a < b")
    ends = real.select(F.col("b").alias("node"), F.col("a").alias("up")).union(real.select("a", F.lit(None).cast("long")))
    seen = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.count("up").alias("ups"), F.count("*").alias("ends"))
    return not seen.where("low < high OR (ups > 0 AND ends > ups)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """node, root: for each end of a link the smallest node of its component.

    Each round joins every node to the smallest node it knows of (large-star, then
    small-star), which at least halves the longest chains; the loop ends when all
    components are stars round their smallest node. Links are (a, b) longs; a node linked
    to itself alone is its own root. A round's links are written once to the shared
    folder, so nothing grows with the number of rounds and no round is computed twice. So
    are the minima, for the join with them then has exchanges of its own, which Spark can
    split where a node is hot. Groups are only ever reduced to their minimum, with map-side
    aggregation: a node with many links is no hot task.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while not stars(links):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y"))
        large = large.union(low.select(F.col("a").alias("x"), F.col("m").alias("y")))
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y")))
        links = stored(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    nodes = links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select("a", "a"))
    return nodes.groupBy("node").agg(F.min("root").alias("root"))
