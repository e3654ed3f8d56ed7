"""List ranking: sums along linked lists and places in closed rings, for lists that no task can hold.

Items lie sorted by key in ranges. Each range follows the links inside it at once and is
left with segments; the segments are a shorter list of the same kind, which is solved the
same way, and every item adds what lies beyond its segment. Where links lead out of the
ranges so often that nothing gets shorter, links are doubled by joins instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources.scratch import stored

#: Segments that one task solves.
ONE_TASK = 1 << 16


def follow(after: np.ndarray, sums: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each item its list's last item, and whether it lies in a closed ring; ``sums`` and ``least`` become those from the item on.

    ``after`` holds places in the array, or -1. In a ring ``least`` is that of the whole ring, its last item and sums mean nothing.
    """
    n = len(after)
    last, at = np.arange(n), after.copy()
    for _ in range(max(1, math.ceil(math.log2(max(n, 2)))) + 1):
        own = np.flatnonzero(at >= 0)
        if not len(own):
            break
        to = at[own]
        sums[own] = sums[own] + sums[to]
        if least is not None:
            least[own] = np.minimum(least[own], least[to])
        last[own], at[own] = last[to], at[to]
    return last, at >= 0


def _places(keys: list[np.ndarray], after: list[np.ndarray], open_end: np.ndarray) -> np.ndarray:
    """Where the keys of the next items are among the keys here, or -1."""
    if not len(open_end):
        return np.zeros(0, np.int64)
    if len(keys) == 1:
        order = np.argsort(keys[0], kind="stable")
        at = np.minimum(np.searchsorted(keys[0], after[0], sorter=order), len(order) - 1)
        found = np.where(keys[0][order[at]] == after[0], order[at], -1)
    else:
        found = pd.MultiIndex.from_arrays(keys).get_indexer(pd.MultiIndex.from_arrays(after))
    return np.where(open_end, -1, found)


def _segments(items: DataFrame, key: list[str], after: list[str], weights: list[str], parts: int | None, least: str | None = None) -> DataFrame:
    """key, seg, head, ring, and from the item to its segment's end: weights, ``least``, and the keys after it (__after, __end)."""
    dealt = items.select(*key, *(F.coalesce(a, F.lit(0)).alias(f"__n_{a}") for a in after), F.col(after[0]).isNull().alias("__open"), *weights)
    dealt = (dealt.repartitionByRange(parts, *key) if parts else dealt.repartitionByRange(*key)).withColumn("__part", F.spark_partition_id())
    nexts, low = [f"__n_{a}" for a in after], ["__least"] if least else []
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in (*key, *nexts, *weights, *low, "seg")), *(T.StructField(n, T.BooleanType()) for n in ("head", "ring", "__end"))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        x = pd.concat(got, ignore_index=True)
        open_end = x["__open"].to_numpy()
        at = _places([x[k].to_numpy() for k in key], [x[n].to_numpy() for n in nexts], open_end)
        sums = x[weights].to_numpy(np.int64)
        lows = x[least].to_numpy(np.int64).copy() if least else None
        last, ring = follow(at, sums, lows)
        head = np.ones(len(x), bool)
        head[at[at >= 0]] = False
        out = {k: x[k] for k in key} | {n: x[n].to_numpy()[last] for n in nexts} | {w: sums[:, k] for k, w in enumerate(weights)}
        if least:
            out["__least"] = lows
        number = last + (int(x["__part"].iloc[0]) << 36)
        yield pd.DataFrame(out | {"seg": number, "head": head, "ring": ring, "__end": open_end[last]})

    return stored(dealt.mapInPandas(run, schema), "segments")


def _linked(local: DataFrame, key: list[str], after: list[str], weights: list[str]) -> DataFrame:
    """seg, next_seg, weights: the list of segments, from the items that head them."""
    heads = local.where("head AND NOT ring")
    to = heads.select(F.col("seg").alias("next_seg"), *(F.col(k).alias(f"__k_{k}") for k in key), F.lit(False).alias("__closed"))
    met = ~heads["__end"] & ~to["__closed"]
    for k, a in zip(key, after, strict=True):
        met = met & (heads[f"__n_{a}"] == to[f"__k_{k}"])
    return stored(heads.join(to, met, "left").select("seg", "next_seg", *weights), "links")


def suffix_sums(items: DataFrame, key: Sequence[str], after: Sequence[str], weights: Sequence[str], parts: int | None = None) -> DataFrame:
    """key and, for each weight, its sum from the item to the end of its list.

    ``items`` are unique by ``key`` (longs); ``after`` names the next item, null at the end of a
    list. Lists must end. Other columns are left out; an empty table gives an empty one.
    """
    key, after, weights = list(key), list(after), list(weights)
    local = _segments(items, key, after, weights, parts)
    if local.where("ring").limit(1).count():
        raise ValueError("a list does not end")
    beyond = _beyond(_linked(local, key, after, weights), weights, local.count())
    out = local.select(*key, "seg", *weights).join(beyond, "seg", "left")
    return out.select(*key, *((F.col(w) + F.coalesce(f"__b_{w}", F.lit(0))).alias(w) for w in weights))


def _beyond(links: DataFrame, weights: list[str], items: int) -> DataFrame:
    """seg and, for each weight, __b_{weight}: its sum from the next segment to the end of the list."""
    n = links.count()
    if n <= ONE_TASK:
        schema = T.StructType([T.StructField(c, T.LongType()) for c in ("seg", *(f"__b_{w}" for w in weights))])

        def run(x: pd.DataFrame) -> pd.DataFrame:
            own = x[weights].to_numpy(np.int64)
            sums = own.copy()
            _, ring = follow(_places([x["seg"].to_numpy()], [x["next"].to_numpy()], x["open"].to_numpy()), sums)
            if ring.any():
                raise ValueError("a list does not end")
            return pd.DataFrame({"seg": x["seg"]} | {f"__b_{w}": sums[:, k] - own[:, k] for k, w in enumerate(weights)})

        few = links.select("seg", F.coalesce("next_seg", F.lit(0)).alias("next"), F.isnull("next_seg").alias("open"), *weights)
        return few.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(run, schema)
    if 2 * n <= items:
        solved = suffix_sums(links.withColumnsRenamed({"seg": "item", "next_seg": "next_item"}), ["item"], ["next_item"], weights, math.ceil(n / ONE_TASK)).withColumnRenamed("item", "seg")
    else:
        solved = _doubled(links, weights, n)
    own = links.select("seg", *(F.col(w).alias(f"__w_{w}") for w in weights))
    return solved.join(own, "seg").select("seg", *((F.col(w) - F.col(f"__w_{w}")).alias(f"__b_{w}") for w in weights))


def _doubled(links: DataFrame, weights: list[str], n: int) -> DataFrame:
    """seg and the sums to the end, by links that reach twice as far each round."""
    for _ in range(math.ceil(math.log2(n)) + 2):
        if not links.where("next_seg IS NOT NULL").limit(1).count():
            return links.select("seg", *weights)
        to = links.select(F.col("seg").alias("__to"), F.col("next_seg").alias("__further"), *(F.col(w).alias(f"__w_{w}") for w in weights))
        step = links.join(to, links["next_seg"] == to["__to"], "left")
        links = stored(step.select("seg", F.col("__further").alias("next_seg"), *((F.col(w) + F.coalesce(f"__w_{w}", F.lit(0))).alias(w) for w in weights)), "doubled")
    raise ValueError("a list does not end")


def ring_places(items: DataFrame) -> DataFrame:
    """id, leader (the ring's smallest id), left (items from this one to the one before the leader): ``items`` are (id, next) of closed rings.

    Leaders are the minima over links that reach twice as far each round, until nothing
    changes; there the rings are cut, and the places come from ``suffix_sums``.
    """
    local = _segments(items.withColumn("__w", F.lit(1)).withColumn("__id", F.col("id")), ["id"], ["next"], ["__w", "__id"], None, "__id")
    heads = local.where("head AND NOT ring")
    to = heads.select(F.col("id").alias("__k"), F.col("seg").alias("next_seg"))
    links = stored(heads.join(to, heads["__n_next"] == to["__k"]).select("seg", "next_seg", F.col("__least").alias("leader")), "rings")
    n = links.count()
    if n <= ONE_TASK:

        def run(x: pd.DataFrame) -> pd.DataFrame:
            least = x["leader"].to_numpy(np.int64).copy()
            at = _places([x["seg"].to_numpy()], [x["next_seg"].to_numpy()], np.zeros(len(x), bool))
            follow(at, np.zeros(len(x), np.int64), least)
            return pd.DataFrame({"seg": x["seg"], "leader": least})

        leaders = links.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(run, "seg long, leader long")
    else:
        moved = True
        while moved:
            to = links.select(F.col("seg").alias("__to"), F.col("next_seg").alias("__further"), F.col("leader").alias("__their"))
            step = links.join(to, links["next_seg"] == to["__to"])
            links = stored(step.select("seg", F.col("__further").alias("next_seg"), F.least("leader", "__their").alias("leader"), (F.col("__their") < F.col("leader")).alias("moved")), "rings")
            moved = bool(links.where("moved").limit(1).count())
        leaders = links.select("seg", "leader")
    named = local.where("NOT ring").select("id", "seg").join(leaders, "seg").select("id", "leader").union(local.where("ring").select("id", "__least"))
    named = stored(named, "leaders")
    cut = items.join(named, "id").select("id", F.when(F.col("next") != F.col("leader"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("left"))
    return suffix_sums(cut, ["id"], ["next"], ["left"]).join(named, "id").select("id", "leader", "left")
