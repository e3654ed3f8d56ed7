"""Near-duplicates of very long texts, and words of every plane beside the tokenizers library."""

from __future__ import annotations

import random
import tracemalloc
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import near_dedup
from gridloom.llm.bpe import Encoder, Tokenizer
from gridloom.llm.characters import EVERY

PATH = public_tokenizers.path("word_bpe_49k.json")


def common_in_band(a, b, band):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + 1 if x == y and abs(i - j) <= band else 0)
    return table[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=20), st.lists(st.integers(0, 5), min_size=1, max_size=20), st.integers(0, 20))
def test_rows_of_the_band(a, b, band):
    assert near_dedup._banded(np.array(a, np.uint64), np.array(b, np.uint64), band) == common_in_band(a, b, band)


@pytest.mark.parametrize("listed", [0, 16])
def test_both_ways_align_alike(monkeypatch, listed):
    monkeypatch.setattr(near_dedup, "MATCHES", listed)
    rng = np.random.default_rng(listed)
    for kinds in (2, 6, 50):
        for _ in range(60):
            a = rng.integers(0, kinds, 30).astype(np.uint64)
            b = a[rng.random(30) < 0.85]
            assert near_dedup.aligned(a, b, 0, 40) == common_in_band(a.tolist(), b.tolist(), 40)


@pytest.mark.parametrize("kinds, n", [(1 << 60, 250_000), (40, 20_000)])
def test_memory_of_an_alignment(kinds, n):
    a = np.random.default_rng(3).integers(0, kinds, n).astype(np.uint64)
    b = np.delete(a, np.arange(1000, n, 50))
    a[10], b[-10] = 1 << 61, 1 << 62
    least = near_dedup.least_common(len(a), len(b))
    tracemalloc.start()
    found = near_dedup.aligned(a, b, least, len(a) + len(b) - 2 * least)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert len(b) - 50 < found < len(b)


def test_a_group_of_long_texts_is_cut_by_shingles(spark, monkeypatch):
    """Blocks of few shingles give the same classes."""
    rng = random.Random(4)
    base = [str(rng.randrange(1000)) for _ in range(300)]
    texts = [" ".join(base[: 290 + i % 11]) for i in range(12)] + [" ".join(base[:150] + [f"{k}x{i}" for i in range(150)]) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, near_dedup.near_duplicates(docs).collect()))
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 500)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect())) == want


@pytest.fixture(scope="module")
def both():
    library = tokenizers.Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    return Encoder(Tokenizer.load(PATH)), library


def test_every_code_point(both):
    ours, library = both
    texts = [f"a{c}b {c}" for c in EVERY]
    wrong = [hex(ord(c)) for k in range(0, len(texts), 50_000) for c, x, e in zip(EVERY[k:], texts[k : k + 50_000], library.encode_batch(texts[k : k + 50_000], add_special_tokens=False)) if ours.encode(x) != e.ids]
    assert wrong == []


def test_new_characters_are_composed_and_ordered(both):
    ours, library = both
    rng = random.Random(1)
    new = [c for c in EVERY if unicodedata.category(c) == "Cn" and library.normalizer.normalize_str(c) != c]
    pool = [chr(c) for r in ((0x300, 0x370), (0x105C0, 0x10600), (0x11380, 0x113E3), (0x1C80, 0x1C90), (0xA7C0, 0xA7E0), (0x16D60, 0x16D6F), (0x41, 0x5B), (0x390, 0x3D0), (0x1100, 0x1120)) for c in range(*r)] + new + [" ", "\x85", "\xa0", "\x1c"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(30_000)]
    assert [x for x, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)) if ours.encode(x) != e.ids] == []
