"""Importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Two generative models of hashed words and word pairs are counted, one over all
documents, one over those labelled as good. A document's importance is the ratio of the
probabilities that the models give it. Drawing without replacement in proportion to
importance is the same as keeping the largest sums of log-importance and Gumbel noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import labelled_sample, stored
from gridloom.llm.text import Texts, owners, slices, window_hashes, word_hashes


def buckets(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word and word pair, and its document."""
    hashes, first = word_hashes(t)
    pairs, begin = window_hashes(hashes, first, 2)
    found = np.concatenate([hashes, pairs]) % np.uint64(size)
    return found.astype(np.int64), np.concatenate([owners(first), owners(begin)])


def bucket_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How often each of ``size`` buckets occurs in all texts: each task counts its rows, Spark adds the counts up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for t in slices(batches):
            total += np.bincount(buckets(t, size)[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.float64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), smoothed by pseudo-counts that follow the raw model."""
    prior = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    pseudo = 0.01 * max(1.0, target.sum())
    p = (target + pseudo * prior) / (target.sum() + pseudo)
    return np.log(p) - np.log(prior)


def gumbel(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise that depends on the id and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11)
    return -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))))


def score(docs: DataFrame, ratio: np.ndarray, temperature: float) -> DataFrame:
    """doc_id, n_grams and log_weight: the mean log-ratio of a document's n-grams over ``temperature``.

    The mean makes the weight of a document independent of its length. A text without
    words has no n-gram and the weight of text like the raw model's (0).
    """
    size = len(ratio)
    kept = docs.select("doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(ratio)
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_grams long, log_weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = table.value
        for t in slices(batches):
            at, who = buckets(t, size)
            n = np.bincount(who, minlength=len(t))
            mean = np.bincount(who, values[at], minlength=len(t)) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([t.batch.column("doc_id"), pa.array(n), pa.array(mean / temperature)], ["doc_id", "n_grams", "log_weight"])

    return kept.mapInArrow(run, schema)


def kth(rows: DataFrame, column: str, k: int, bins: int = 4096) -> tuple[float | int, int]:
    """The ``k``-th smallest value of a column without nulls (k from 1, at most the number of rows), and how many rows are below it.

    Rows are counted in ``bins`` equal steps between the bounds that are left, which are
    then those of the step with the k-th row. Steps never go down where values go up,
    so no rounding can put a row on the wrong side. Only counts reach the driver.
    """
    x = F.col(column)
    low, high = rows.agg(F.min(x), F.max(x)).first()
    below = 0
    while low < high:
        width = (float(high) - float(low)) / bins
        step = F.least(F.floor((x.cast("double") - F.lit(float(low))) / F.lit(width)), F.lit(bins - 1)) if width > 0 else (x > F.lit(low)).cast("long")
        counted = rows.where(x.between(F.lit(low), F.lit(high))).groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for r in sorted(counted.collect()):
            if below + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            below += r["n"]
    return low, below


def top_k(scored: DataFrame, k: int, key: str = "key", bins: int = 4096) -> DataFrame:
    """``scored`` with ``kept``: true for exactly ``k`` rows (all, if fewer have a key), those of largest ``key``.

    Ties go to the smaller doc_id, null first, then to any of the rows that share key and
    id. The three bounds are found by counting (see ``kth``), so no task ranks all rows.
    Every row comes back once with its columns; a column named ``kept`` is replaced.
    """
    columns = [c for c in scored.columns if c != "kept"]
    place = F.coalesce(F.col("doc_id").try_cast("long"), F.lit(-(1 << 63)))
    rows = stored(scored.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), (-F.col(key)).alias("key"), place.alias("id"), F.monotonically_increasing_id().alias("n")), "ranked")
    ties = rows.where("key IS NOT NULL")
    left = min(k, ties.count())
    if left <= 0:
        return rows.select("row.*", F.lit(False).alias("kept"))
    bound = []
    for column in ("key", "id", "n"):
        value, below = kth(ties, column, left, bins)
        bound.append(F.lit(value))
        left -= below
        ties = ties.where(F.col(column) == F.lit(value))
    v, i, n = bound
    inside = (F.col("key") < v) | ((F.col("key") == v) & ((F.col("id") < i) | ((F.col("id") == i) & (F.col("n") <= n))))
    return rows.withColumn("in", F.coalesce(inside, F.lit(False))).select("row.*", F.col("in").alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, size: int = 1 << 17, bound: int = 20_000, temperature: float = 0.05, seed: int = 17) -> DataFrame:
    """Every document with its importance and whether it is drawn: doc_id, n_grams, log_weight, key, kept.

    The raw model counts all documents. The target model counts at most ``bound``
    documents with quality 1. ``share`` of all rows is drawn; by default the share of
    good ones among all labels. Null texts are scored as empty ones. Repeated rows
    with one id get one key, and any of them are drawn where the limit falls between them;
    every row of ``docs`` comes back once. Without labels all rows are drawn; an empty table stays empty.
    """
    target = labelled_sample(docs, labels.where("quality = 1"), "quality", bound)
    ratio = log_ratio(bucket_counts(target, size), bucket_counts(docs, size))
    scored = score(docs, ratio, temperature).withColumn("key", F.col("log_weight") + gumbel("doc_id", seed))
    if share is None:
        share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    n = docs.count()
    k = min(n, math.ceil(n * (1.0 if share is None else share)))
    return top_k(scored, k)
