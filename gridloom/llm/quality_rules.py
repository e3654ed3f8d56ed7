"""Quality rules: text statistics, and decision lists learned from labelled statistics.

The list is grown by sequential covering: a rule is a conjunction of thresholds on
statistics that low-quality documents meet. Conditions are added greedily on a growing
part of the labelled rows and pruned on the rest; documents that a rule covers are
taken away before the next one is grown. The result is an ordered conditional
expression of Spark columns, which can be read and printed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.store import labelled_sample
from gridloom.llm.text import Texts, mix, owners, prefix_hash, slices, spaces, span_hash, window_hashes, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words")
#: What rules may test: a name and its value in Spark columns.
FEATURES = {
    "words": "cast(n_words AS double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_word_share": "n_distinct_words / greatest(n_words, 1)",
}


def _members(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in chars]] = 1
    return table


SYMBOLS = _members("#*$%&|<>")
UPPER = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGITS = _members("0123456789")
MARKS = _members("!?;:")


def _total(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the flags of each document's bytes."""
    run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return run[offsets[1:]] - run[offsets[:-1]]


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each document has."""
    with np.errstate(over="ignore"):
        at = np.unique(mix(keys + mix(owner.astype(np.uint64))), return_index=True)[1]
    return np.bincount(owner[at], minlength=n)


def measure(t: Texts) -> dict[str, np.ndarray]:
    """The counts named in COUNTS for each document."""
    data, n = t.data, len(t)
    space = spaces(data)
    starts, ends, first = words(t, space)
    prefix = prefix_hash(data)
    owner = owners(first)
    hashes = span_hash(prefix, starts, ends)
    out = {"n_words": np.diff(first)}
    out["word_chars"] = _total(((data & 0xC0) != 0x80) & ~space, t.offsets)
    for name, table in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_digits", DIGITS), ("n_marks", MARKS)):
        out[name] = _total(table[data], t.offsets)
    out["n_distinct_words"] = _distinct(hashes, owner, n)

    filled = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([t.offsets[:-1], breaks + 1]), kind="stable")
    line_owner = np.searchsorted(t.offsets, line_start, "right") - 1
    # A break at the end of a document begins an empty line, which has no word; empty documents share their place with the next one.
    line_end = np.minimum(np.concatenate([line_start[1:], [len(data)]]), len(data))
    cut = (line_end > line_start) & (line_end > 0)
    cut[cut] = data[line_end[cut] - 1] == 10
    line_end = line_end - cut
    worded = filled[np.maximum(line_end, line_start)] > filled[np.minimum(line_start, len(data))]
    ls, le, lo = line_start[worded], line_end[worded], line_owner[worded]
    out["n_lines"] = np.bincount(lo, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(span_hash(prefix, ls, le, 3), lo, n)

    windows, begin = window_hashes(hashes, first, 3)
    who = owners(begin)
    covered = np.zeros(len(hashes) + 3, np.int64)
    if len(windows):
        with np.errstate(over="ignore"):
            _, inverse, times = np.unique(mix(windows + mix(who.astype(np.uint64))), return_inverse=True, return_counts=True)
        at = (np.arange(len(windows)) + (first[:-1] - begin[:-1])[who])[times[inverse] > 1]
        for k in range(3):
            covered[at + k] = 1
    run = np.concatenate([[0], np.cumsum(covered[: len(hashes)])])
    out["n_repeat_words"] = run[first[1:]] - run[first[:-1]]
    return out


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of COUNTS (long) of each whole text; columns of those names are replaced.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have zero counts; rows are
    taken one by one, so ties, repeated rows and null ids change nothing.
    """
    docs = docs.drop(*COUNTS)
    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches, text_col):
            m = measure(t)
            columns = [*t.batch.columns, *(pa.array(np.asarray(m[c], np.int64)) for c in COUNTS)]
            yield pa.RecordBatch.from_arrays(columns, [*t.batch.schema.names, *COUNTS])

    return docs.mapInArrow(run, schema)


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x >= self.threshold if self.at_least else x <= self.threshold

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x >= F.lit(self.threshold) if self.at_least else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a document that meets one is rejected, any other is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def column(self) -> Column:
        """True where the document is kept."""
        if not self.rules:
            return F.lit(True)
        tests = [reduce(lambda a, b: a & b, (c.column() for c in rule)) for rule in self.rules]
        chain = F.when(tests[0], F.lit(False))
        for t in tests[1:]:
            chain = chain.when(t, F.lit(False))
        return chain.otherwise(F.lit(True))

    def keeps(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(table.values()))), bool)
        for rule in self.rules:
            out &= ~_covers(rule, table)
        return out

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, rule))}" for rule in self.rules) or "keep all"


def _covers(rule, table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _best_condition(table: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the largest information gain over what the rule covers so far."""
    p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
    before = np.log2(max(p0, 1e-9) / max(p0 + n0, 1e-9))
    best, found = 1e-6, None
    for name, x in table.items():
        x = x[inside]
        order = np.argsort(x, kind="stable")
        xs, ys = x[order], bad[inside][order]
        last = np.flatnonzero(np.concatenate([xs[1:] > xs[:-1], [False]]))
        if not len(last):
            continue
        p, m = np.cumsum(ys)[last], last + 1
        middle = (xs[last] + xs[last + 1]) / 2
        for at_least, pos, count in ((False, p, m), (True, p0 - p, len(xs) - m)):
            gain = pos * (np.log2(np.maximum(pos, 1e-9) / np.maximum(count, 1)) - before)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Condition(name, at_least, float(middle[k]))
    return best, found


def learn(table: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.95, min_covered: int = 5, max_conditions: int = 4, max_rules: int = 12) -> DecisionList:
    """A decision list that rejects ``bad`` rows.

    A rule is accepted when, on the rows it was not grown on and on all that are left,
    at least ``min_precision`` of what it covers is bad (the first with one error
    forgiven) and it covers ``min_covered`` bad rows or more. With rows of one class
    only, or no rows, the list is empty and keeps everything.
    """
    bad = np.asarray(bad, bool)
    n = len(bad)
    if not n or not bad.any() or bad.all():
        return DecisionList(())
    grow = np.arange(n) % 3 != 2
    left, rules = np.ones(n, bool), []
    while len(rules) < max_rules and (bad & left).sum() >= min_covered:
        part = {k: v[left & grow] for k, v in table.items()}
        y = bad[left & grow]
        rule: list[Condition] = []
        inside = np.ones(len(y), bool)
        while len(rule) < max_conditions and (~y & inside).any() and (y & inside).any():
            _, c = _best_condition(part, y, inside)
            if c is None:
                break
            rule.append(c)
            inside &= c.holds(part)
        if not rule:
            break
        rest = left & ~grow

        def worth(k: int) -> float:
            hit = _covers(rule[:k], table) & rest
            p, m = (bad & hit).sum(), (~bad & hit).sum()
            return (p - m) / (p + m) if p + m else -1.0

        keep = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        rule = rule[:keep]
        hit = _covers(rule, table) & left
        p, m = (bad & hit).sum(), (~bad & hit).sum()
        q, r = (bad & hit & rest).sum(), (~bad & hit & rest).sum()
        if p < min_covered or p < min_precision * (p + m) or q < min_precision * (q + r - 1):
            break
        rules.append(tuple(rule))
        left &= ~hit
    return DecisionList(tuple(rules))


def features(rows: list) -> dict[str, np.ndarray]:
    return {name: np.array([r[name] for r in rows], float) for name in FEATURES}


def fit_rules(docs: DataFrame, labels: DataFrame, bound: int = 12_000, **options) -> DecisionList:
    """A list learned from at most ``bound`` labelled documents (quality 0 is bad), chosen by a hash of their id.

    Documents that fail the base rules teach nothing and are left out.
    """
    sample = with_statistics(labelled_sample(docs, labels, "quality", bound)).where(~base_failed())
    rows = sample.select("doc_id", "label", *(F.expr(e).alias(k) for k, e in FEATURES.items())).orderBy("doc_id").collect()
    return learn(features(rows), np.array([r["label"] == 0 for r in rows], bool), **options)


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``; every other column stays."""
    return with_statistics(docs.drop("base_failed", "kept")).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column())


def report(docs: DataFrame, labels: DataFrame, bound: int = 12_000) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row.

    Null and empty texts have zero counts and fail the base rules. Rows are judged one by
    one: repeated ones alike, null ids like any other. Ties of a threshold count as met.
    Other columns are left out; an empty table gives an empty one; without labels of both
    classes the base rules alone decide.
    """
    rules = fit_rules(docs, labels, bound)
    return apply_rules(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
