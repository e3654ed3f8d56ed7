"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes the usual disguises: letters of other scripts that look Latin, full
width forms, accents of Latin letters that stand for plain ones, and digits or signs
written for letters. The lexicon is learned from labelled documents: word beginnings
and whole words that toxic documents use and others do not, each weighted by its
smoothed log-odds. Phrases in which an entry is harmless are exceptions: a few given
ones, and those that only clean labelled documents use. A document's
score is a calibrated function of the weight it gathers for each hundred words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import labelled_sample
from gridloom.llm.text import slices

# Look-alike letters and the Latin letters they stand for.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ı": "i", "ℓ": "l", "ƅ": "b", "ⅼ": "l", "ⅰ": "i",
}
# Digits and signs written for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Phrases in which an English entry is harmless; more are learned with the entries.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "moron test")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:?!\"'()[]{}<>#*%&-_/\\…«»“”‘’¡¿"
_WIDE = {0xFF01 + k: chr(0x21 + k) for k in range(94)}
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_LOOK = {ord(k): v for k, v in LOOKALIKES.items()} | _WIDE | _INVISIBLE
_LEET = str.maketrans(LEET)


def fold_word(word: str) -> str:
    """A word as the matcher sees it; words of digits and signs only stay as they are."""
    word = word.lower().translate(_LOOK).lower().strip(EDGES)
    if word.isalpha() or not any(c.isalpha() for c in word):
        return word
    return word.translate(_LEET)


class Folder(dict):
    """Folds words and texts, keeping the words seen lately (at most ``size`` of them)."""

    def __init__(self, size: int = 200_000):
        self.size = size

    def __missing__(self, word: str) -> str:
        folded = fold_word(word)
        if len(word) <= 40:
            if len(self) >= self.size:
                self.clear()
            self[word] = folded
        return folded

    def __call__(self, text: str) -> str:
        """The folded words of the text with a blank before, between and after them."""
        return " ".join(["", *filter(None, map(self.__getitem__, WORD.findall(text))), ""])


class Suspects(dict):
    """Whether the lexicon has an entry for a word, for the words seen lately."""

    def __init__(self, lexicon: Lexicon, size: int = 400_000):
        self.lexicon, self.size = lexicon, size

    def __missing__(self, word: str) -> bool:
        folded = fold_word(word)
        found = bool(folded) and bool(self.lexicon.weights) and any(w is not None for _, (_, w) in self.lexicon.machine.iter(f" {folded} "))
        if len(word) <= 40:
            if len(self) >= self.size:
                self.clear()
            self[word] = found
        return found


@dataclass
class Lexicon:
    """Entries (with the blanks that anchor them), exceptions, and the calibration of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 4.0
    offset: float = -4.0
    _machine: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_machine": None}

    @property
    def machine(self):
        if self._machine is None:
            a = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                a.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, None))
            a.make_automaton()
            self._machine = a
        return self._machine

    def density(self, folded: str) -> float:
        """The weight of matched words for each hundred words: a word counts once, with its heaviest entry."""
        if not self.weights:
            return 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self.machine.iter(folded):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        if spared:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
        return 100.0 * sum(best.values()) / max(1, folded.count(" ") - 1)

    def score(self, folded: str) -> float:
        """Between 0 and 1, higher for text that is likelier toxic; 0 or nearly so with no entry found."""
        x = self.slope * np.log1p(self.density(folded)) + self.offset
        return float(1.0 / (1.0 + np.exp(-np.clip(x, -30, 30))))


def beginnings(folded: str, shortest: int = 4, longest: int = 7) -> set[str]:
    """What may become an entry: every word, and every beginning of a word that is long enough."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(shortest, min(longest, len(w)) + 1))
    return out


def choose_entries(toxic: Iterable[set[str]], other: Iterable[set[str]], min_docs: int, min_odds: float) -> dict[str, float]:
    """Entries with smoothed log-odds of at least ``min_odds``, the shortest precise beginning of a word standing for its longer forms.

    An entry is used by at least one in 33 toxic documents, or else by at least
    ``min_docs`` of those that no other entry covers: words that are typical only of
    a family of copies don't become entries.
    """
    toxic = list(toxic)
    bad, good, ng = Counter(), Counter(), 1.0
    for x in toxic:
        bad.update(x)
    nb = len(toxic) + 1.0
    bad = Counter({e: n for e, n in bad.items() if n >= min_docs})
    toxic = [x & bad.keys() for x in toxic]
    for x in other:
        good.update(x & bad.keys())
        ng += 1
    odds = {e: float(np.log((n + 0.5) / nb) - np.log((good[e] + 0.5) / ng)) for e, n in bad.items()}
    precise = sorted((e for e, o in odds.items() if o >= min_odds and good[e] <= 0.02 * bad[e]), key=lambda e: (len(e.strip()), e))
    chosen: dict[str, float] = {}

    def new(e: str) -> bool:
        return not any(e[:k] in chosen for k in range(4, len(e)))

    for e in precise:
        if bad[e] >= max(min_docs, 0.03 * len(toxic)) and new(e):
            chosen[e] = odds[e]
    bare = [x for x in toxic if not any(e in x for e in chosen)]
    while bare:
        use = Counter(e for x in bare for e in x & odds.keys() if odds[e] >= min_odds and good[e] <= 0.02 * bad[e])
        e = min(use, key=lambda e: (-use[e], len(e), e), default=None)
        if e is None or use[e] < min_docs:
            break
        if new(e):
            chosen[e] = odds[e]
        bare = [x for x in bare if e not in x]
    return chosen


def choose_exceptions(lexicon: Lexicon, toxic: Iterable[str], other: Iterable[str], min_docs: int) -> tuple[str, ...]:
    """Two-word phrases of at least ``min_docs`` clean documents, and of no toxic one, in which an entry would match."""
    suspect = Suspects(lexicon).__getitem__

    def phrases(folded: str) -> set[str]:
        words = folded.split()
        return {f"{a} {b}" for a, b in zip(words, words[1:]) if suspect(a) or suspect(b)}

    clean = Counter(p for t in other for p in phrases(t))
    found = {p for p, n in clean.items() if n >= min_docs}
    for t in toxic:
        found -= phrases(t)
    return tuple(sorted(found))


def fit(rows: list[tuple[str, int]], min_docs: int = 3, min_odds: float = 2.5, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from (text, label) pairs; none toxic or all toxic gives an empty one."""
    fold = Folder()
    folded = [(fold(text or ""), int(label)) for text, label in rows]
    toxic, other = (beginnings(t) for t, y in folded if y), (beginnings(t) for t, y in folded if not y)
    lexicon = Lexicon(choose_entries(toxic, other, min_docs, min_odds), exceptions)
    learned = choose_exceptions(lexicon, (t for t, y in folded if y), (t for t, y in folded if not y), min_docs)
    lexicon = Lexicon(lexicon.weights, tuple(dict.fromkeys((*exceptions, *learned))))
    x = np.log1p(np.array([lexicon.density(t) for t, _ in folded]))
    y = np.array([label for _, label in folded], float)
    if len(y) and 0 < y.sum() < len(y):
        lexicon.slope, lexicon.offset = _logistic(x, y)
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a lightly penalised logistic fit by Newton's method."""
    a, b = 1.0, -1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * x).sum() + penalty * a, (p - y).sum() + penalty * b])
        h = np.array([[(w * x * x).sum() + penalty, (w * x).sum()], [(w * x).sum(), w.sum() + penalty]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def fit_lexicon(docs: DataFrame, labels: DataFrame, bound: int = 4_000, where=None, max_bytes: int = 1 << 15, **options) -> Lexicon:
    """The lexicon learned from at most ``bound`` labelled documents, chosen by a hash of their id.

    Only texts of up to ``max_bytes`` teach, so what the driver takes is bounded in rows and
    bytes. ``where`` limits the labelled rows to learn from. With no labelled document, or
    one class only, the lexicon has no entry. Null texts are empty; an id teaches once.
    """
    rows = labelled_sample(docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes), labels, "toxic", bound, where).orderBy("doc_id").collect()
    return fit([(r["text"], r["label"]) for r in rows], **options)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``.

    Every whole text is read. Null and empty texts hold no entry and get the score of
    text without any; repeated rows get equal scores; other columns are left out.
    """
    kept = docs.select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, lex = Folder(), model.value
        suspect = Suspects(lex).__getitem__
        clean = lex.score("")

        def score(text: str) -> float:
            return lex.score(fold(text)) if any(map(suspect, WORD.findall(text))) else clean

        for t in slices(batches):
            scores = [score(t.text(i)) for i in range(len(t))]
            yield pa.RecordBatch.from_arrays([t.batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = kept.mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


#: The rows that labels may be learned from in the registered query.
TRAIN = "crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"


def held_out_report(docs: DataFrame, labels: DataFrame, bound: int = 4_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, by a lexicon learned only from rows whose crc32(doc_id) mod 3 is not 1.

    A row without an id is not held out. Repeated rows score alike, null and empty texts like
    text without any entry; other columns are left out; an empty table gives an empty one.
    """
    lexicon = fit_lexicon(docs, labels, bound, where=TRAIN)
    out = score_toxicity(docs, lexicon, threshold)
    return out.select("doc_id", F.coalesce(F.expr(f"NOT ({TRAIN})"), F.lit(False)).alias("held_out"), "score", "predicted")
