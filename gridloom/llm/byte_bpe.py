"""Exact byte-level BPE by backtracking over longest matches, and decoding.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton of the (reversed) tokens
finds the longest token that starts at each byte of a piece in one pass. Encoding takes the
longest one; if it may not stand beside the token before it, the next shorter token that
begins alike is taken, and if none is left, the last token is given up and its end marked, so
that no place is left twice. Whether two tokens may stand side by side depends on them
alone and is remembered. The result is what merging by rank gives, in time linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.characters import EVERY, Classes
from gridloom.llm.text import slices

_NEVER = 1 << 60
#: Characters of a text that are split at a time, pieces kept by a worker, and the longest that is kept.
SPAN, KEPT, KEPT_CHARS = 1 << 20, 200_000, 64


def library_classes() -> Classes:
    """Letters, numbers and white space as the tiktoken library finds them."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}

    def members(name: str) -> str:
        found = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        return found.decode_bytes(found.encode_ordinary(EVERY)).decode()

    return Classes.asked(members)


@dataclass
class Ranks:
    """A byte-level BPE vocabulary: ``tokens[i]`` are the bytes of rank i, which is also the id."""

    tokens: dict[int, bytes]
    pattern: str
    classes: Classes
    _ready: bool = field(default=False, repr=False)

    @classmethod
    def load(cls, path: str, pattern: str) -> Ranks:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        return cls({int(rank): base64.b64decode(token) for token, rank in pairs}, pattern, library_classes())

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "pattern": self.pattern, "classes": self.classes, "_ready": False}

    def prepare(self) -> None:
        if self._ready:
            return
        self.ranks = {t: i for i, t in self.tokens.items()}
        self.machine = ahocorasick.Automaton()
        for i, t in self.tokens.items():
            self.machine.add_word(t[::-1].decode("latin-1"), i)
        self.machine.make_automaton()
        self.usual, self.exact = self.classes.usual(self.pattern), self.classes.exact(self.pattern)
        self.size = max(self.tokens, default=0) + 1
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        #: The longest token that each token begins with, other than itself, or -1.
        self.shorter = {i: next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), -1) for i, t in self.tokens.items()}
        self.lengths = {i: len(t) for i, t in self.tokens.items()}
        self._ready = True

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merging its own bytes joins last; null for a byte, and for one that merging never makes."""
        if token not in self.made:
            found = [self.ranks[bytes([b])] for b in self.tokens[token]]
            while len(found) > 2:
                rank, at = min((self.ranks.get(self.tokens[x] + self.tokens[y], _NEVER), k) for k, (x, y) in enumerate(zip(found, found[1:])))
                if rank >= token:
                    break
                found[at : at + 2] = [rank]
            self.made[token] = (found[0], found[1]) if len(found) == 2 else None
        return self.made[token]

    def stands(self, token: int) -> bool:
        """Whether merging makes this one token of its own bytes."""
        return len(self.tokens[token]) == 1 or self.parts(token) is not None

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens met at an edge (0: left, 1: right) while a token is built, each with the rank of the merge that ends it."""
        chain = self.edges[side].get(token)
        if chain is None:
            chain, until, at = [], _NEVER, token
            while True:
                chain.append((at, until))
                made = self.parts(at)
                if made is None:
                    break
                until, at = at, made[side]
            chain.reverse()
            self.edges[side][token] = chain
        return chain

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves tokens ``a`` and ``b`` as they are when they stand side by side."""
        left, right = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.ranks.get(self.tokens[x] + self.tokens[y], _NEVER)
            if rank < x_until and rank <= y_until and rank < _NEVER:
                return False
            if x_until <= y_until:
                if x_until == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def may_follow(self, before: int, token: int) -> bool:
        """Whether a token may stand behind another one, or with -1 at the beginning; remembered under before * size + token."""
        if len(self.pairs) >= 600_000:
            self.pairs.clear()
        good = self.pairs[before * self.size + token] = self.stands(token) and (before < 0 or self.fits(before, token))
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest, at = array("i", bytes(4 * n)), -1
        for end, token in self.machine.iter(piece[::-1].decode("latin-1")):
            if end != at:  # the first match that ends here is the longest
                longest[n - 1 - end], at = token, end
        shorter, lengths, known, size = self.shorter, self.lengths, self.pairs.get, self.size
        out, dead = array("i"), bytearray(n + 1)
        pos, token, before = 0, longest[0], -1
        while pos < n:
            while token >= 0:
                end = pos + lengths[token]
                if not dead[end]:
                    good = known(before * size + token)
                    if good is None:
                        good = self.may_follow(before, token)
                    if good:
                        break
                token = shorter[token]
            else:
                dead[pos] = 1
                if not out:
                    raise ValueError(f"no tokens for {piece[:40]!r}")
                last = out.pop()
                pos -= lengths[last]
                token, before = shorter[last], out[-1] if out else -1
                continue
            out.append(token)
            pos, before = end, token
            token = longest[pos] if pos < n else -1
        return out.tolist()


class Encoder(dict):
    """Pieces seen lately: their ids as a string with a blank before each, their decoded bytes, and the number of ids."""

    def __init__(self, ranks: Ranks):
        ranks.prepare()
        self.ranks = ranks
        self.names = {i: f" {i}" for i in ranks.tokens}
        self.earlier: dict[str, tuple[str, bytes, int]] = {}

    def __missing__(self, piece: str) -> tuple[str, bytes, int]:
        found = self.earlier.get(piece)
        if found is None:
            names, tokens = self.names, self.ranks.tokens
            ids = self.ranks.encode_piece(piece.encode("utf-8", "surrogatepass"))
            found = "".join([names[i] for i in ids]), b"".join([tokens[i] for i in ids]), len(ids)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:  # those not met again since the last time are forgotten
                self.earlier = dict(self)
                self.clear()
            self[piece] = found
        return found

    def split(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, some at a time: no match goes on where white space follows something else."""
        find = (self.ranks.usual if self.ranks.classes.plain(text) else self.ranks.exact).findall
        at = 0
        while len(text) - at > SPAN:
            end = at + SPAN
            while end < len(text) and (text[end] not in " \n\t" or text[end - 1].isspace()):
                end += 1
            yield find(text[at:end])
            at = end
        yield find(text[at:] if at else text)

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.split(text) for piece in part for i in self[piece][0].split()]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded bytes."""
        n, ids, decoded, begun = 0, hashlib.sha256(), hashlib.sha256(), False
        for part in self.split(text):
            found = list(map(self.__getitem__, part))
            n += sum(map(itemgetter(2), found))
            line = "".join(map(itemgetter(0), found)).encode()
            ids.update(line if begun else line[1:])
            begun = begun or bool(line)
            decoded.update(b"".join(map(itemgetter(1), found)))
        return n, ids.hexdigest(), decoded.hexdigest()


@lru_cache(1)
def _loaded(path: str, pattern: str) -> Ranks:
    return Ranks.load(path, pattern)


_encoders: dict[str, object] = {}


def _encoder(ranks: Ranks) -> Encoder:
    """One encoder a Python worker, so that what it has seen serves the worker's later tasks too."""
    if _encoders.get("of") is not ranks:
        _encoders.update({"of": ranks, "is": Encoder(ranks)})
    return _encoders["is"]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and the ids of every whole text, each match of ``pattern`` encoded by itself; what no match covers is left out.

    Null and empty texts have no ids; rows are encoded one by one, so repeated rows, equal texts and
    null ids change nothing; other columns are left out, and an empty table gives an empty one.
    """
    return _mapped(docs, path, pattern, id_col, text_col, "ids array<int>", lambda e, x: (e.encode(x),), [pa.list_(pa.int32())])


def encoded_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, n_tokens, ids_sha256 and decoded_sha256 of every whole text; odd rows as in ``encode``.

    Null and empty texts have no ids and the digests of the empty string.
    """
    return _mapped(docs, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda e, x: e.digest(x), [pa.int64(), pa.string(), pa.string()])


def _mapped(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, fields: str, of, types: list[pa.DataType]) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(_loaded(path, pattern))
    kept = docs.select(id_col, text_col)
    names = [id_col, *(x.split()[0] for x in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for t in slices(batches, text_col):
            columns = list(zip(*(of(encoder, t.text(i)) for i in range(len(t))), strict=True))
            yield pa.RecordBatch.from_arrays([t.batch.column(id_col), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], names)

    return kept.mapInArrow(run, f"{id_col} {kept.schema[id_col].dataType.simpleString()}, {fields}")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and the decoded bytes of a column of ids; null ids give null, unknown ids nothing."""
    model = encoded.sparkSession.sparkContext.broadcast(_loaded(path, pattern))
    kept = encoded.select(id_col, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = model.value.tokens
        for b in batches:
            found = [None if x is None else b"".join([tokens.get(i, b"") for i in x]) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(found, pa.binary())], [id_col, "decoded"])

    return kept.mapInArrow(run, f"{id_col} {kept.schema[id_col].dataType.simpleString()}, decoded binary")
