"""Documents scored by masked pseudo-likelihood.

A small network predicts a token from the two tokens on either side: their position
embeddings are summed, squashed, and read out by a softmax in two levels. It is trained
in NumPy where the data is: in each round every task trains on its documents of that
round, starting from the same weights, and Spark averages what the tasks have learned.
The sum of the log-probabilities of the words of a document, seen from both sides, is
the document's score. The network gives that of a frequent word or of a bucket of all
others; a word's share of its bucket comes from the counts of all words, which stay a
Spark table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import stored
from gridloom.llm.text import mix, owners, slices, word_hashes

SIDES = (-2, -1, 1, 2)
#: Weights are summed as whole numbers of this size, so that their order doesn't matter.
_UNIT = 2.0**-24
#: Words that a task counts together.
_COUNTED = 1 << 21


@dataclass(frozen=True)
class Shape:
    """``frequent`` tokens have numbers of their own, all others share ``buckets`` by their hash; one more stands beyond the text."""

    frequent: int = 768
    buckets: int = 256
    width: int = 24
    branch: int = 32

    @classmethod
    def grown(cls, words: int) -> Shape:
        """The shape for a corpus of so many words: its numbered tokens grow with their cube root."""
        frequent = max(cls.frequent, round(3 * words ** (1 / 3)))
        buckets = frequent // 3
        return cls(frequent, buckets, branch=int(np.ceil(np.sqrt(frequent + buckets))))

    @property
    def size(self) -> int:
        return self.frequent + self.buckets

    def parts(self) -> dict[str, tuple[int, ...]]:
        leaves = -(-self.size // self.branch)
        return {"embed": (len(SIDES), self.size + 1, self.width), "bias": (self.width,), "up": (self.width, self.branch), "up0": (self.branch,), "low": (self.branch, self.width, leaves), "low0": (self.branch, leaves)}


def fresh(shape: Shape, share: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights, with offsets that give each token its share of all words."""
    rng = np.random.default_rng(seed)
    out = {k: (rng.normal(0, 0.1, s) if k in ("embed", "up", "low") else np.zeros(s)).astype(np.float32) for k, s in shape.parts().items()}
    tokens = np.arange(shape.size)
    table = np.full(shape.parts()["low0"], 1e-9)
    table[tokens % shape.branch, tokens // shape.branch] = share
    out["up0"] = np.log(table.sum(axis=1)).astype(np.float32)
    out["low0"] = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    return out


def packed(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights.values()])


def unpacked(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shape.parts().items():
        n = int(np.prod(s))
        out[k], at = flat[at : at + n].reshape(s).astype(np.float32), at + n
    return out


class Vocabulary:
    """Numbers for word hashes: the place among the frequent ones, or a bucket."""

    def __init__(self, frequent: np.ndarray, shape: Shape):
        self.order = np.argsort(frequent)
        self.sorted, self.shape = frequent[self.order], shape

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = (self.shape.frequent + (hashes % np.uint64(self.shape.buckets)).astype(np.int64)).astype(np.int32)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            known = self.sorted[at] == hashes
            out[known] = self.order[at[known]]
        return out


def contexts(tokens: np.ndarray, first: np.ndarray, beyond: int) -> np.ndarray:
    """For each token those at SIDES in its document, or ``beyond``: (tokens, sides)."""
    n = len(tokens)
    place = np.arange(n)
    begin, end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    out = np.full((n, len(SIDES)), beyond, np.int32)
    for k, side in enumerate(SIDES):
        at = place + side
        fine = (at >= begin) & (at < end)
        out[fine, k] = tokens[at[fine]]
    return out


def _by_value(x: np.ndarray) -> np.ndarray:
    """A stable order of small whole numbers."""
    return np.argsort(x.astype(np.int16) if len(x) and int(x.max()) < 1 << 15 else x, kind="stable")


def _by_branch(around: np.ndarray, tokens: np.ndarray, branch: int) -> tuple[np.ndarray, ...]:
    """Rows in the order of their branches, so that those of one are a slice: that order, contexts, branches, leaves, and where each branch begins."""
    order = _by_value(tokens % branch)
    sorted_tokens = np.take(tokens, order)
    top = sorted_tokens % branch
    return order, np.take(around, order, axis=0), top, sorted_tokens // branch, np.searchsorted(top, np.arange(branch + 1))


def _hidden(embed: np.ndarray, bias: np.ndarray, around: np.ndarray) -> np.ndarray:
    """What the network makes of the contexts, a column each: (width, tokens)."""
    out = np.take(embed[0], around[:, 0], axis=0)
    for k in range(1, around.shape[1]):
        out += np.take(embed[k], around[:, k], axis=0)
    out += bias
    return np.ascontiguousarray(np.tanh(out, out=out).T)


def _logits(weights: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Outcomes by tokens, less each token's largest. NumPy sums and compares whole rows at once, so the tokens are columns."""
    x = weights.T @ h
    x += offsets[:, None]
    x -= x.max(axis=0)
    return x


def _softmax(x: np.ndarray) -> np.ndarray:
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def log_probabilities(weights: dict[str, np.ndarray], around: np.ndarray, tokens: np.ndarray, branch: int, block: int = 1 << 15) -> np.ndarray:
    """log p(token | both sides) of every token."""
    out = np.empty(len(tokens), np.float32)
    place = np.arange(min(block, len(tokens)))
    for at in range(0, len(tokens), block):
        order, x, top, leaf, cut = _by_branch(around[at : at + block], tokens[at : at + block], branch)
        h = _hidden(weights["embed"], weights["bias"], x)
        z = _logits(weights["up"], weights["up0"], h)
        p = z[top, place[: len(top)]]
        total = np.exp(z, out=z).sum(axis=0)
        for c in np.flatnonzero(np.diff(cut)):
            rows = slice(cut[c], cut[c + 1])
            z = _logits(weights["low"][c], weights["low0"][c], h[:, rows])
            p[rows] += z[leaf[rows], place[: z.shape[1]]]
            total[rows] *= np.exp(z, out=z).sum(axis=0)
        out[at + order] = p - np.log(total)
    return out


class Trainer:
    """Adagrad on the negative log-probability of the tokens."""

    def __init__(self, weights: dict[str, np.ndarray], branch: int, rate: float):
        self.w, self.branch, self.rate, self.seen = weights, branch, rate, 0
        self.squares = {k: np.full(v.shape, 1e-2, np.float32) for k, v in weights.items()}

    def _move(self, name: str, at, grad: np.ndarray) -> None:
        squares = self.squares[name][at] + grad * grad
        self.squares[name][at] = squares
        self.w[name][at] -= self.rate * grad / np.sqrt(squares)

    def step(self, around: np.ndarray, tokens: np.ndarray) -> None:
        w, n = self.w, len(tokens)
        _, around, top, leaf, cut = _by_branch(around, tokens, self.branch)
        place = np.arange(n)
        h = _hidden(w["embed"], w["bias"], around)
        d = _softmax(_logits(w["up"], w["up0"], h))
        d[top, place] -= 1
        dh = w["up"] @ d
        low, low0 = np.zeros_like(w["low"]), np.zeros_like(w["low0"])
        for c in np.flatnonzero(np.diff(cut)):
            rows = slice(cut[c], cut[c + 1])
            hr = h[:, rows]
            e = _softmax(_logits(w["low"][c], w["low0"][c], hr))
            e[leaf[rows], place[: e.shape[1]]] -= 1
            dh[:, rows] += w["low"][c] @ e
            np.matmul(hr, e.T, out=low[c])
            e.sum(axis=1, out=low0[c])
        self._move("low", ..., low / n)
        self._move("low0", ..., low0 / n)
        self._move("up", ..., h @ d.T / n)
        self._move("up0", ..., d.sum(axis=1) / n)
        dz = (dh * (1 - h * h)).astype(np.float64) / n
        self._move("bias", ..., dz.sum(axis=1).astype(h.dtype))
        for k in range(around.shape[1]):
            met = np.bincount(around[:, k]) > 0
            ids = (np.cumsum(met) - 1)[around[:, k]]
            grad = np.array([np.bincount(ids, row) for row in dz], h.dtype)
            self._move("embed", (k, np.flatnonzero(met)), grad.T)
        self.seen += n


@dataclass(frozen=True)
class Model:
    """``inside`` (word, gain in whole units) has every counted word of the buckets: what it adds to ``unseen``, the log-share of the words of its bucket that were never counted. The commonest of them also stand in ``known``, sorted, and ``gains``. ``seen`` counts the targets it was trained on."""

    frequent: np.ndarray
    weights: np.ndarray
    shape: Shape
    inside: DataFrame
    unseen: np.ndarray
    known: np.ndarray
    gains: np.ndarray
    seen: int


def word_counts(docs: DataFrame) -> DataFrame:
    """word (its hash) and n of all words of all documents, written once."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        times = pa.array(np.concatenate(held).view(np.int64)).value_counts()
        return pa.RecordBatch.from_arrays([times.field("values"), times.field("counts")], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in slices(batches):
            held.append(word_hashes(t)[0])
            size += len(held[-1])
            if size >= _COUNTED:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return stored(docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def frequent_words(counts: DataFrame, shape: Shape, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words, ties to the smaller hash, and the share of all words of each token."""
    rows = counts.orderBy(F.desc("n"), F.asc("word")).limit(shape.frequent).collect()
    share = np.ones(shape.size)
    share[: len(rows)] += [r["n"] for r in rows]
    share[shape.frequent :] += max(0, total - sum(r["n"] for r in rows)) / shape.buckets
    return np.array([r["word"] for r in rows], np.int64).view(np.uint64), share / share.sum()


def within_buckets(counts: DataFrame, frequent: np.ndarray, shape: Shape, known: int = 128) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A word's share of its bucket: the ``inside``, ``unseen``, ``known`` and ``gains`` of a model.

    Of n words in a bucket, t different ones, a word that came c times has the share
    c / (n + t), and all words that never came have t / (n + t) together. Known are the
    words from some count on, at most ``known`` times as many as the frequent ones: tasks
    look them up, and only the others are joined.
    """
    sent = counts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(sent.value, shape)
        for batch in batches:
            bucket = vocabulary(batch.column("word").to_numpy(zero_copy_only=False).view(np.uint64)) - shape.frequent
            whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], ["word", "n", "bucket"])
            yield whole.filter(pa.array(bucket >= 0))

    held = counts.select("word", "n").mapInArrow(run, "word long, n long, bucket int")
    sums = held.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("t")).toPandas()
    n, t = np.zeros(shape.buckets), np.zeros(shape.buckets)
    n[sums["bucket"]], t[sums["bucket"]] = sums["n"], sums["t"]
    kinds = F.broadcast(counts.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(t)], "bucket int, t double"))
    gain = F.round(F.log(F.col("n") / F.col("t")) / F.lit(_UNIT)).cast("long")
    unseen = np.log(np.where(t > 0, t / np.maximum(n + t, 1), 1))
    step = F.floor(F.log2("n") * 8).cast("int")
    inside = stored(held.join(kinds, "bucket").select("word", gain.alias("gain"), step.alias("step")), "inside")
    steps = sorted(((r["step"], r["count"]) for r in inside.groupBy("step").count().collect()), reverse=True)
    few = np.cumsum([n for _, n in steps]) <= known * shape.frequent
    least = min((k for (k, _), fits in zip(steps, few, strict=True) if fits), default=None)
    common = inside.where(F.lit(False) if least is None else F.col("step") >= least).select("word", "gain").toArrow()
    words, gains = common["word"].to_numpy().view(np.uint64), common["gain"].to_numpy()
    order = np.argsort(words)
    return inside.select("word", "gain"), unseen, words[order], gains[order]


def trained(docs: DataFrame, shape: Shape | None = None, rounds: int = 3, masked: float = 1.0, rate: float = 0.2, batch: int = 8192, seed: int = 5) -> Model:
    """A network trained on all documents.

    A document's hash says in which of the ``rounds`` it is trained on. All its tokens are
    predicted once, in the order of a hash, or a share of ``masked`` below 1 of them, chosen
    by word and place in the document. What reaches the driver after a
    round is the average of the tasks' weights, weighted by the tokens they saw. Without
    a ``shape`` it grows with the corpus.
    """
    counts = word_counts(docs)
    words = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    shape = shape or Shape.grown(words)
    frequent, share = frequent_words(counts, shape, words)
    flat = packed(fresh(shape, share, seed)).astype(np.float64)
    context, seen = docs.sparkSession.sparkContext, 0
    for r in range(rounds):
        start = context.broadcast((frequent, flat.astype(np.float32)))
        lesson_rate = rate / (1 + r)

        def lesson(batches: Iterator[pa.RecordBatch], start=start, r=r, lesson_rate=lesson_rate) -> Iterator[pa.RecordBatch]:
            numbered, begin = start.value
            vocabulary = Vocabulary(numbered, shape)
            trainer = Trainer(unpacked(begin.copy(), shape), shape.branch, lesson_rate)
            for t in slices(batches):
                hashes, first = word_hashes(t)
                tokens = vocabulary(hashes)
                around = contexts(tokens, first, shape.size)
                place = (np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
                with np.errstate(over="ignore"):
                    draw = mix(hashes + place * np.uint64(0xD1342543DE82EF95), 60 + r)
                chosen = np.flatnonzero(draw < np.uint64(int(masked * 2**64))) if masked < 1 else np.arange(len(draw))
                chosen = chosen[np.argsort(draw[chosen], kind="stable")]
                for at in range(0, len(chosen), batch):
                    rows = chosen[at : at + batch]
                    trainer.step(np.take(around, rows, axis=0), np.take(tokens, rows))
            if trainer.seen:
                learned = np.rint((packed(trainer.w).astype(np.float64) - begin) / _UNIT) * trainer.seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(learned) + 1, dtype=np.int32)), pa.array(np.append(learned, trainer.seen).astype(np.int64))], ["at", "sum"])

        turn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r).select("text")
        moved = turn.mapInArrow(lesson, "at int, sum long").groupBy("at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).cast("double").alias("sum")).toPandas()
        start.unpersist()
        if not len(moved):
            continue
        total = np.zeros(len(flat) + 1)
        total[moved["at"].to_numpy()] = moved["sum"].to_numpy()
        seen += int(total[-1])
        flat = flat + total[:-1] / total[-1] * _UNIT
    return Model(frequent, flat.astype(np.float32), shape, *within_buckets(counts, frequent, shape), seen)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all tokens) and score (its mean) of every whole text.

    A word outside the frequent ones has the probability of its bucket times its own share
    of it, or times that of all uncounted words together. Null, empty and wordless texts
    have 0 tokens, likelihood 0 and a null mean. Rows are scored one by one; repeated rows score alike, other columns are left out.
    """
    kept = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    shape = model.shape
    sent = docs.sparkSession.sparkContext.broadcast((model.frequent, model.weights, model.unseen, model.known, model.gains))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, n_tokens long, total double, others array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, flat, unseen, known, gains = sent.value
        vocabulary, weights = Vocabulary(frequent, shape), unpacked(flat, shape)
        beside = np.concatenate([np.zeros(shape.frequent), unseen])
        for t in slices(batches):
            hashes, first = word_hashes(t)
            tokens, owner = vocabulary(hashes), owners(first)
            each = log_probabilities(weights, contexts(tokens, first, shape.size), tokens, shape.branch) + beside[tokens]
            rare = np.flatnonzero(tokens >= shape.frequent)
            hashes, holder = hashes[rare], owner[rare]
            at = np.searchsorted(known, hashes)
            met = np.take(known, at, mode="clip") == hashes if len(known) else np.zeros(len(at), bool)
            gain = np.bincount(holder[met], gains[at[met]], minlength=len(t))
            total = np.bincount(owner, each, minlength=len(t)) + gain * _UNIT
            cut = np.searchsorted(holder[~met], np.arange(len(t) + 1))
            others = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(hashes[~met].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(t.batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(np.diff(first)), pa.array(total), others], ["doc_id", "k1", "k2", "n_tokens", "total", "others"])

    facts = stored(kept.mapInArrow(run, schema), "facts")
    pieces = facts.select("k1", "k2", F.explode("others").alias("word")).join(model.inside, "word")
    # Equal texts have one sum between them, and count how many share it.
    sums = pieces.select("k1", "k2", "gain", F.lit(0).alias("copies")).union(facts.select("k1", "k2", F.lit(0).cast("long"), F.lit(1)))
    sums = stored(sums.groupBy("k1", "k2").agg((F.sum("gain") / F.sum("copies") * F.lit(_UNIT)).alias("gain")), "gains")
    total = F.col("total") + F.col("gain")
    return facts.join(sums, ["k1", "k2"]).select("doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("score"))


def scored(docs: DataFrame) -> DataFrame:
    """Every document scored by a network trained on all of them; see ``trained`` and ``score``. An empty table gives an empty one."""
    return score(docs, trained(docs))
