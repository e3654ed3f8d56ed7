"""Approximate nearest neighbours by additive quantisation.

A vector, scaled to length one, is approximated by a sum of codewords, one from each of
several codebooks of full dimension. Encoding keeps the best few partial sums while it
goes through the codebooks (beam search); the length of the sum is stored beside the
codes, and so is how far the vector is from the sum. A query is scored against a code by adding up one table entry
for each codebook and dividing by the stored length. The angle between query and vector is at least the one between
query and sum less the one between vector and sum: vectors that this bound puts behind the best seen so far are left
out, all others are compared themselves, so that none of the nearest is missed, however the vectors lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.store import stored


@dataclass(frozen=True)
class Codebooks:
    """Codewords: (books, words, dimension)."""

    words: np.ndarray
    beam: int = 4

    def encode(self, x: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (n, books), the lengths of the sums they stand for, and the parts (n, 2) of each vector along its sum and across it."""
        codes, near = np.empty((len(x), len(self.words)), np.uint8), x.astype(np.float32)
        for at in range(0, len(x), block):
            codes[at : at + block] = self._search(near[at : at + block])
        total = self.decode(codes).astype(np.float64)
        lengths = np.maximum(np.linalg.norm(total, axis=1), 1e-6)
        total /= lengths[:, None]
        along = (x * total).sum(axis=1)
        across = np.linalg.norm(x - along[:, None] * total, axis=1)
        return codes, lengths.astype(np.float32), np.stack([along, across], axis=1).astype(np.float32)

    def slack(self, lengths: np.ndarray) -> np.ndarray:
        """How far scores in single precision may be off."""
        return np.float32(1e-6) * (1 + np.sqrt((self.words * self.words).sum(axis=2)).max(axis=1).sum() / lengths)

    def _search(self, x: np.ndarray) -> np.ndarray:
        n, k = len(x), self.words.shape[1]
        rest, error = x[:, None, :], np.zeros((n, 1), np.float32)
        path = np.zeros((n, 1, 0), np.uint8)
        rows = np.arange(n)[:, None]
        for book in self.words:
            cost = error[:, :, None] + (book * book).sum(axis=1) - 2 * (rest @ book.T)
            flat = cost.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            beam, word = best // k, best % k
            error = flat[rows, best]
            rest = rest[rows, beam] - book[word]
            path = np.concatenate([path[rows, beam], word[:, :, None].astype(np.uint8)], axis=2)
        return path[np.arange(n), error.argmin(axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.words))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query with every codeword: (books, words, queries)."""
        return np.ascontiguousarray(self.words @ queries.T)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Codewords for residuals by k-means; an empty one takes a random row."""
    book = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (-2 * x @ book.T + (book * book).sum(axis=1)).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        some = count > 0
        book[some] = np.add.reduceat(x[order], begin[some], axis=0) / count[some, None]
        book[~some] = x[rng.integers(len(x), size=int((~some).sum()))]
    return book


def learn(x: np.ndarray, books: int = 16, words: int = 256, beam: int = 4, passes: int = 2, seed: int = 3) -> Codebooks:
    """Codebooks for the rows of ``x``: residual k-means, then passes of beam encoding and least squares over all codewords at once."""
    rng = np.random.default_rng(seed)
    words = min(words, max(1, len(x)))
    rest, found = x.copy(), []
    for _ in range(books):
        book = _means(rest, words, rng, 6)
        rest = rest - book[(-2 * rest @ book.T + (book * book).sum(axis=1)).argmin(axis=1)]
        found.append(book)
    out = Codebooks(np.stack(found).astype(np.float32), beam)
    for _ in range(passes):
        codes = out.encode(x)[0]
        at = codes.astype(np.int64) + np.arange(books) * words
        gram = np.zeros((books * words, books * words))
        for m in range(books):
            for other in range(books):
                np.add.at(gram, (at[:, m], at[:, other]), 1)
        side = np.zeros((books * words, x.shape[1]))
        for m in range(books):
            np.add.at(side, at[:, m], x)
        # A small pull towards the present codewords keeps unused ones in place.
        now = out.words.reshape(-1, x.shape[1]).astype(np.float64)
        pull = 1e-2 * len(x) / words
        gram.flat[:: len(gram) + 1] += pull
        solved = np.linalg.solve(gram, side + pull * now)
        out = Codebooks(solved.reshape(out.words.shape).astype(np.float32), beam)
    return out


def valid(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length, scaled to length one."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; components are summed in order."""
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Components of the vectors in a group, and queries that meet it together, at most (the mean; both are dealt by hash).
GROUP, QUERIES = 1 << 23, 1 << 14


class Best:
    """The best vectors of some queries (rows of ``asked``) over the blocks of a group: place of the query, id and cosine, best first, ties to the smaller id."""

    def __init__(self, asked: np.ndarray, keep: int):
        self.asked, self.keep = asked, keep
        self.at, self.rep, self.near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _least(self) -> np.ndarray:
        """The last cosine that is kept, of queries that have all they keep."""
        out = np.full(len(self.asked), -np.inf)
        count = np.bincount(self.at, minlength=len(out))
        full = count == self.keep
        out[full] = self.near[np.cumsum(count)[full] - 1]
        return out

    def _cosines(self, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(row) * 8 > len(x) * len(self.asked):
            return (x @ self.asked.T)[row, at]
        step = max(1, (1 << 21) // x.shape[1])
        return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[row[i : i + step]], self.asked[at[i : i + step]]) for i in range(0, len(row), step))])

    def add(self, ids: np.ndarray, score: np.ndarray, parts: np.ndarray, slack: np.ndarray, x: np.ndarray) -> None:
        """Scores (vectors, queries) of the sums of a block, and its vectors ``x``: those that may be among the best are compared."""
        least = self._least()
        if np.isneginf(least).any() and len(ids) >= self.keep:
            first = np.argpartition(-score, self.keep - 1, axis=0)[: self.keep].ravel()
            own = self._cosines(x, first, np.tile(np.arange(len(self.asked)), self.keep)).reshape(self.keep, -1)
            least = np.maximum(least, own.min(axis=0) - 1e-12)
        low = np.clip(least, -1, 1)
        low, side = low.astype(np.float32), np.sqrt(1 - low * low).astype(np.float32)
        bound = np.outer(parts[:, 0], low) - np.outer(parts[:, 1], side) - (slack[:, None] + np.float32(1e-6))
        row, at = np.nonzero((score >= bound) | (parts[:, :1] <= -low))
        near = self._cosines(x, row, at)
        kept = near >= least[at]
        at, rep, near = np.concatenate([self.at, at[kept]]), np.concatenate([self.rep, ids[row[kept]]]), np.concatenate([self.near, near[kept]])
        order = np.lexsort((rep, -near, at))
        at = at[order]
        fine = np.arange(len(at)) - np.searchsorted(at, at) < self.keep
        self.at, self.rep, self.near = at[fine], rep[order][fine], near[order][fine]


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, candidates: int = 300, sample: int = 16_000, books: int = 16, block: int = 4096, query_block: int = 256) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: its ``k`` nearest others by cosine.

    query_id, rank (from 1), vec_id, score. The codebooks are learned from at most
    ``sample`` different vectors (those with the smallest hash), and every vector is
    encoded. Groups of codes, with their vectors, meet parts of the queries; a group keeps each query's best over
    all its blocks, twice as many as can have a place. Of all groups' best, at most ``candidates`` a query
    are compared once more, in the order of their components. The bound on
    codes only saves work: the more coarsely they stand for the vectors, the more vectors are compared.

    Equal vectors are one code, so a frequent vector takes one place among the
    candidates; its k + 1 smallest ids stand for it, which is all that ``k`` places can
    show. Ties go to the smaller vec_id. Vectors null, zero or with a null or non-finite
    component, and those with another number of components than most, take no part;
    neither do null ids. Repeated rows count once. Fewer others than ``k`` give fewer
    rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & valid(F.col("v")) & (F.size("v") > 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], out_schema)
    rows = stored(rows.where(F.size("v") == common["d"]).distinct(), "vectors")

    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1).drop("n")
    few = stored(few.withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))), "few")
    reps = few.where("vec_id = rep").select("rep", "v")
    members = few.select("rep", "vec_id")

    learned = learn(_matrix(reps.orderBy(F.xxhash64("v"), "rep").limit(sample).select("v").toArrow().column("v").combine_chunks()).astype(np.float32), books)
    books_sent = spark.sparkContext.broadcast(learned)
    total = reps.count()
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * common["d"] / GROUP))
    keep = 2 * (k + 1)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                x = _matrix(part.column("v"))
                codes, lengths, sides = books_sent.value.encode(x)
                ids = part.column("rep").to_numpy()
                yield pa.RecordBatch.from_pydict({"grp": pa.array([int(ids[0] % groups)], pa.int32()), "ids": [ids.tobytes()], "codes": [np.ascontiguousarray(codes.T).tobytes()], "lengths": [lengths.tobytes()], "parts": [sides.tobytes()], "x": [x.tobytes()]})

    codes = stored(reps.mapInArrow(encoded, "grp int, ids binary, codes binary, lengths binary, parts binary, x binary"), "codes")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"), "v").distinct()

    parts = max(1, math.ceil(queries.count() / QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    questions = queries.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")).withColumn("grp", each(groups))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        model, schema = books_sent.value, pa.schema([("qid", pa.int64()), ("rep", pa.int64()), ("near", pa.float64())])
        out = [schema.empty_table()]
        for at in range(0, right.num_rows if left.num_rows else 0, query_block):
            part = right.slice(at, query_block).combine_chunks()
            qids, asked = part.column("qid").to_numpy(), _matrix(part.column("v").combine_chunks())
            tables, best = model.tables(asked.astype(np.float32)), Best(asked, keep)
            for r in range(left.num_rows):
                read = lambda name, kind, r=r: np.frombuffer(left.column(name)[r].as_buffer(), kind)
                ids, lengths = read("ids", np.int64), read("lengths", np.float32)
                code = read("codes", np.uint8).reshape(-1, len(ids))
                score = tables[0][code[0]]
                for m in range(1, len(code)):
                    score += tables[m][code[m]]
                score /= lengths[:, None]
                best.add(ids, score, read("parts", np.float32).reshape(-1, 2), model.slack(lengths), read("x", np.float64).reshape(len(ids), -1))
            out.append(pa.table({"qid": qids[best.at], "rep": best.rep, "near": best.near}, schema))
        return pa.concat_tables(out)

    spread = codes.withColumn("part", each(parts)).groupBy("grp", "part").cogroup(questions.groupBy("grp", "part"))
    scanned = stored(spread.applyInArrow(scan, "qid long, rep long, near double"), "scanned")
    foremost = Window.partitionBy("qid").orderBy(F.desc("near"), F.asc("rep"))
    found = scanned.withColumn("n", F.row_number().over(foremost)).where(F.col("n") <= max(candidates, keep)).select("qid", "rep")
    exact = found.join(queries.withColumnRenamed("v", "qv"), "qid").join(reps, "rep").select("qid", "rep", cosine(F.col("qv"), F.col("v")).alias("score"))
    front = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("rep"))
    exact = exact.withColumn("n", F.row_number().over(front)).where(F.col("n") <= k + 1).drop("n")
    named = exact.join(members, "rep").where(F.col("vec_id") != F.col("qid"))
    last = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("vec_id"))
    return named.withColumn("rank", F.row_number().over(last).cast("int")).where(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) / (q.norm * c.norm) AS score
      FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
