"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that can end its encoding: the
one that, following the last token of the prefix before it, no merge would have joined
otherwise. A suffix automaton of the vocabulary finds all tokens that end at each place.
A pair test decides which of them fits; following the stored tokens back from the end of
the word gives the ids, in time linear in the word for a vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.characters import EVERY, Classes
from gridloom.llm.suffix_automaton import SuffixAutomaton
from gridloom.llm.text import slices

CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: Added to the character of a byte that ends a word.
_LAST = 0xE000
_NEVER = 1 << 60


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it can be seen, else the next free one from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 0x100
    for b in range(256):
        if b in seen:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


def lower(text: str) -> str:
    """Lower case, each character by itself (no final sigma)."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def library_tables() -> tuple[Classes, dict[str, str]]:
    """Character classes as the tokenizers library finds them, and the characters that it puts in lower case otherwise than Python."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    def members(name: str) -> str:
        return "".join(x for x, _ in pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(EVERY))

    single = EVERY.replace("\n", "")
    lowered = normalizers.Lowercase().normalize_str("\n".join(single)).split("\n")
    return Classes.asked(members), {c: x for c, x in zip(single, lowered, strict=True) if c.lower() != x}


def composed(text: str) -> str:
    """NFC; of characters that Python's tables don't have, as the tokenizers library does it."""
    if "Cn" not in map(unicodedata.category, text):
        return unicodedata.normalize("NFC", text)
    from tokenizers import normalizers

    return normalizers.NFC().normalize_str(text)


@dataclass
class Tokenizer:
    """A BPE model with an end-of-word mark, read from a tokenizers file."""

    tokens: dict[str, int]
    merges: list[tuple[str, str]]
    suffix: str
    pattern: str
    specials: dict[str, int]
    classes: Classes
    lowers: dict[str, str]
    _ready: bool = field(default=False, repr=False)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, model["end_of_word_suffix"], split["pattern"]["Regex"], {t["content"]: t["id"] for t in spec["added_tokens"]}, *library_tables())

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("tokens", "merges", "suffix", "pattern", "specials", "classes", "lowers")} | {"_ready": False}

    def packed(self, token: str) -> str:
        """A token with one character for each byte; a final byte's character carries the end of the word."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(_LAST + ord(body[-1]))
        return token

    def prepare(self) -> None:
        if self._ready:
            return
        self.size = max(self.tokens.values()) + 1
        self.names = {i: t for t, i in self.tokens.items()} | {i: t for t, i in self.specials.items()}
        self.joined: dict[int, int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(self.merges):
            whole = (a + b) if not a.endswith(self.suffix) else None
            x, y, z = self.tokens.get(a), self.tokens.get(b), self.tokens.get(whole)
            if x is None or y is None or z is None:
                continue
            self.joined.setdefault(x * self.size + y, rank)
            made.setdefault(z, (rank, x, y))
        # The tokens met at an edge while a token is built, with the rank of the merge that ends each.
        self.left_edge: dict[int, tuple[tuple[int, int], ...]] = {}
        self.right_edge: dict[int, tuple[tuple[int, int], ...]] = {}
        for t in self.tokens.values():
            for edges, side in ((self.left_edge, 1), (self.right_edge, 2)):
                chain, until, at = [], _NEVER, t
                while True:
                    chain.append((at, until))
                    if at not in made:
                        break
                    until, at = made[at][0], made[at][side]
                edges[t] = tuple(reversed(chain))
        self.machine = SuffixAutomaton({self.packed(token): i for token, i in self.tokens.items()})
        self.chars = dict(enumerate(byte_characters()))
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.made = made
        self.splitter, self.exact = self.classes.usual(self.pattern), self.classes.exact(self.pattern)
        self.lower_first = str.maketrans(self.lowers)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self._ready = True

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens ``a`` and ``b`` as they are when they stand side by side.

        Both grow by their own merges; of the two merges that end the present edges the
        earlier comes first, the left one at equal rank. The pair fails if a merge
        across the border would come before that.
        """
        left, right, joined, size = self.right_edge[a], self.left_edge[b], self.joined, self.size
        i = j = 0
        while True:
            x, x_until = left[i]
            y, y_until = right[j]
            rank = joined.get(x * size + y)
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if x_until <= y_until:
                if x_until == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def stands(self, token: int) -> bool:
        """Whether BPE makes this one token of its own text."""
        known = self.whole.get(token)
        if known is None:
            made = self.made.get(token)
            known = made is None or (self.stands(made[1]) and self.stands(made[2]) and self._grows(token))
            self.whole[token] = known
        return known

    def _grows(self, token: int) -> bool:
        """Whether no merge across the two parts comes before the one that joins the whole parts."""
        rank, a, b = self.made[token]
        left, right = self.right_edge[a], self.left_edge[b]
        i = j = 0
        while i < len(left) - 1 or j < len(right) - 1:
            x, x_until = left[i]
            y, y_until = right[j]
            r = self.joined.get(x * self.size + y)
            if r is not None and r < x_until and r <= y_until:
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        return True

    def word(self, piece: str) -> list[int]:
        """The ids of one pre-tokenised piece of text."""
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.chars)
        if not text:
            return []
        text = text[:-1] + chr(_LAST + ord(text[-1]))
        n = len(text)
        last = [-1] * (n + 1)
        length = [0] * (n + 1)
        known, whole, size = self.pairs.get, self.whole.get, self.size
        machine = self.machine
        nxt, link, span, words = machine.next, machine.link, machine.length, machine.words
        state = run = end = 0
        for c in text:  # as ``machine.endings`` goes through a text
            end += 1
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                run = span[state]
                to = nxt[state].get(c)
            if to is None:
                run = 0
                continue
            state = to
            run += 1
            for k, token in words[state]:
                if k > run:
                    continue
                if k == end:
                    good = whole(token)
                    if good is None:
                        good = self.stands(token)
                else:
                    ahead = last[end - k]
                    if ahead < 0:
                        continue
                    good = known(ahead * size + token)
                    if good is None:
                        good = self.may_follow(ahead, token)
                if good:
                    last[end], length[end] = token, k
                    break
        out, at = [], n
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"no token ends at {at} of {piece!r}")
            out.append(last[at])
            at -= length[at]
        out.reverse()
        return out

    def may_follow(self, ahead: int, token: int) -> bool:
        """``fits``, remembered under ahead * size + token."""
        if len(self.pairs) >= 600_000:
            self.pairs.clear()
        good = self.pairs[ahead * self.size + token] = self.fits(ahead, token)
        return good

    def pieces(self, chunk: str) -> list[str | int]:
        """The parts of text without white space that are encoded by themselves; specials as ids."""
        if chunk.isascii() and "<" not in chunk:
            part = chunk.lower()
            return [part] if part.isalpha() else self.splitter.findall(part)
        out: list[str | int] = []
        for k, part in enumerate(self.special.split(chunk) if self.special and "<" in chunk else [chunk]):
            if k % 2:
                out.append(self.specials[part])
            elif part:
                if not part.isascii():
                    part = composed(part).translate(self.lower_first)
                part = lower(part)
                if not self.classes.plain(part):
                    out += self.exact.findall(part)
                elif part.isalpha():
                    out.append(part)
                else:
                    out += self.splitter.findall(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' own strings with a blank between them: the file names no decoder."""
        return " ".join(self.names[i] for i in ids if i in self.names)


class Kept(dict):
    """Things seen lately: when it is full, those that were not met again since the last time are forgotten."""

    def __init__(self, size: int):
        self.size, self.earlier = size, {}

    def put(self, key: str, value) -> None:
        if len(self) >= self.size:
            self.earlier = dict(self)
            self.clear()
        self[key] = value


class Encoder(Kept):
    """Encodings of chunks, keeping those seen lately: number of ids, ids and decoded text as strings."""

    def __init__(self, tokenizer: Tokenizer, size: int = 300_000):
        super().__init__(size)
        tokenizer.prepare()
        self.tokenizer, self.words = tokenizer, Kept(size)

    def piece(self, piece: str | int) -> tuple[int, str, str]:
        """The encoding of one piece, kept for other chunks that hold it."""
        found = self.words.get(piece)
        if found is None:
            found = self.words.earlier.get(piece)
            if found is None:
                ids = [piece] if isinstance(piece, int) else self.tokenizer.word(piece)
                found = (len(ids), " ".join(map(str, ids)), self.tokenizer.decode(ids))
            if isinstance(piece, int) or len(piece) <= 40:
                if len(self.words) < self.size:
                    self.words[piece] = found
                else:
                    self.words.put(piece, found)
        return found

    def __missing__(self, chunk: str) -> tuple[int, str, str] | None:
        found = self.earlier.get(chunk, self)
        if found is self:
            parts = [self.piece(p) for p in self.tokenizer.pieces(chunk)]
            if len(parts) > 1:
                counts, ids, decoded = zip(*parts)
                found = (sum(counts), " ".join(ids), " ".join(decoded))
            else:
                found = parts[0] if parts else None
        if len(chunk) <= 40:
            if len(self) < self.size:
                self[chunk] = found
            else:
                self.put(chunk, found)
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for found in map(self.__getitem__, CHUNK.findall(text)) if found for i in found[1].split()]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text."""
        found = list(filter(None, map(self.__getitem__, CHUNK.findall(text))))
        ids, decoded = " ".join(map(itemgetter(1), found)), " ".join(map(itemgetter(2), found))
        return sum(map(itemgetter(0), found)), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


_encoders: dict[int, Encoder] = {}


def _encoder(broadcast) -> Encoder:
    """One encoder a Python worker, so that what it has seen serves the worker's later tasks too."""
    if broadcast.value is not _encoders.get("of"):
        _encoders.clear()
        _encoders["of"], _encoders["is"] = broadcast.value, Encoder(broadcast.value)
    return _encoders["is"]


@lru_cache(1)
def _loaded(path: str) -> Tokenizer:
    return Tokenizer.load(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of every whole text.

    Null and empty texts have no ids; rows are encoded one by one, so repeated rows and null
    ids change nothing; other columns are left out; an empty table gives an empty one.
    """
    return _mapped(docs, path, id_col, text_col, "ids array<int>", lambda e, x: (e.encode(x),), [pa.list_(pa.int32())])


def encoded_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null and empty texts have no ids and the digests of the empty string; rows are
    encoded one by one, so repeated rows and null ids change nothing, and other columns
    are left out.
    """
    return _mapped(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda e, x: e.digest(x), [pa.int64(), pa.string(), pa.string()])


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, fields: str, of, types: list[pa.DataType]) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(_loaded(path))
    kept = docs.select(id_col, text_col)
    names = [id_col, *(x.split()[0] for x in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for t in slices(batches, text_col):
            columns = list(zip(*(of(encoder, t.text(i)) for i in range(len(t))), strict=True))
            yield pa.RecordBatch.from_arrays([t.batch.column(id_col), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], names)

    return kept.mapInArrow(run, f"{id_col} {kept.schema[id_col].dataType.simpleString()}, {fields}")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of a column of ids, specials included; null ids give null text, unknown ids nothing."""
    model = encoded.sparkSession.sparkContext.broadcast(_loaded(path))
    kept = encoded.select(id_col, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = model.value
        tokenizer.prepare()
        for b in batches:
            texts = [None if x is None else tokenizer.decode(x) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(texts, pa.string())], [id_col, "decoded"])

    return kept.mapInArrow(run, f"{id_col} {kept.schema[id_col].dataType.simpleString()}, decoded string")
