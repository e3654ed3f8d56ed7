"""Byte-level BPE beside the tiktoken library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, queries
from gridloom.llm.byte_bpe import Encoder, Ranks
from gridloom.llm.characters import EVERY
from gridloom.llm.store import table

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ours():
    return Encoder(Ranks.load(PATH, PATTERN))


@pytest.fixture(scope="module")
def library(ours):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in ours.ranks.tokens.items()}, special_tokens={})


def texts():
    rng = random.Random(5)
    yield from ["", " ", "\n\n", "\x1c\x85  x", "can't we'LL", "x" * 100_000, " " * 70_000 + "y", "-=" * 30_000, "é" * 9999]
    for k in range(4000):
        if k % 4 == 0:
            yield "".join(rng.choice("ab ") for _ in range(rng.randint(0, 40)))
        elif k % 4 == 1:
            yield "".join(rng.choice("aeiourstnl' \n\t") for _ in range(rng.randint(0, 60)))
        elif k % 4 == 2:
            yield "".join(rng.choice(EVERY) for _ in range(rng.randint(0, 20)))
        else:
            yield rng.choice("ax-=1 \né") * rng.randint(1, 300) + rng.choice("ax ")


def test_is_the_library(ours, library):
    for text in texts():
        assert ours.encode(text) == library.encode_ordinary(text), text[:80]
        assert b"".join(ours.ranks.tokens[i] for i in ours.encode(text)) == text.encode()


def test_every_code_point(ours, library):
    wrong = [hex(ord(c)) for c in EVERY if ours.encode(t := f"a{c}b {c}") != library.encode_ordinary(t)]
    assert wrong == []


def test_every_token_is_one_token(ours, library):
    assert all(ours.ranks.encode_piece(t) == [i] and ours.ranks.stands(i) for i, t in ours.ranks.tokens.items())


def test_pairs_are_what_merging_leaves(ours, library):
    """Two tokens fit exactly if the library's merging of their joined bytes gives them back."""
    rng, known = random.Random(2), list(ours.ranks.tokens)
    whole = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=dict(library._mergeable_ranks), special_tokens={})
    for _ in range(20_000):
        a, b = rng.choice(known[: rng.choice([300, 5000, 50000])]), rng.choice(known[: rng.choice([300, 5000, 50000])])
        both = ours.ranks.tokens[a] + ours.ranks.tokens[b]
        if both in ours.ranks.ranks:
            continue
        assert ours.ranks.fits(a, b) == (whole._encode_bytes(both) == [a, b]), (a, b)


def test_spans_are_cut_where_no_match_goes_on(ours, library, monkeypatch):
    text = "some words,  and \n\n more's  of\tthem 12345 " * 50
    for span in (1, 2, 7, 50):
        monkeypatch.setattr(byte_bpe, "SPAN", span)
        assert ours.encode(text) == library.encode_ordinary(text)
        assert ours.digest(text) == (len(ids := library.encode_ordinary(text)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_query(spark, library):
    want = {}
    for r in table(spark, SF, "documents").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = queries.QUERIES["op11_byte_bpe"](spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_odd_rows_and_round_trip(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Eine  Zeile\nund ’ne 二", "c"), (3, "Eine  Zeile\nund ’ne 二", "c"), (None, "x", "d"), (4, "long " * 30_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("n_tokens", F.lit("mine"))
    ids = byte_bpe.encode(docs, PATH, PATTERN)
    back = byte_bpe.decode(ids, PATH, PATTERN).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    digests = byte_bpe.encoded_digest(docs, PATH, PATTERN).collect()
    assert len(digests) == len(rows) and {r["n_tokens"] for r in digests if r["doc_id"] in (1, 2)} == {0}
    assert byte_bpe.encoded_digest(docs.limit(0), PATH, PATTERN).count() == 0
    missing = spark.createDataFrame([(1, None), (2, [15, 10**6])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(missing, PATH, PATTERN).collect()} == {1: None, 2: bytearray(b"0")}
