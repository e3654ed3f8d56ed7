"""The corpus operators against brute force, and their defined results for odd rows."""

from __future__ import annotations

import dataclasses
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import additive_ann, bpe, components, lexicon, line_dedup, masked_lm, near_dedup, packing, quality_rules, queries, resample, suffix_array, suffix_dedup
from tests.oracle import database, differences

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "\n", "a", "one two\nONE two\none two", "x" * 5000, "é " * 700, "\n\n\n", "a\tb\x0bc\x0cd\re", None, ""]


#: Names that operators use themselves, as columns of a user's table.
NAMES = """row k1 k2 h2 n_bytes n_removed n_spans whole part kept kept_text n_lines n_dropped n_words word_chars n_symbols n_dup_lines n_repeat_words
base_failed lines pos key id rep class_id grp piece words score a b __a __b __id __null __rep __kept __lines __pos __row""".split()


def clashing(df):
    """``df`` with a column under every one of those names."""
    return df.withColumns({n: F.lit(f"my {n}") for n in NAMES if n not in df.columns})


def assert_untouched(rows):
    assert all(r[n] == f"my {n}" for r in rows for n in NAMES)


# Line dedup
def lines_by_hand(texts, least):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in texts]
    held = Counter(k for ls in split for k in {key(x) for x in ls} if k)
    out = []
    for ls in split:
        kept = [x for x in ls if not key(x) or held[key(x)] < least]
        out.append((len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines_by_hand(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choices(["Common ", " common", "rare%d" % i, "", "Ärger", "  x\t"], k=rng.randint(0, 6))) for i in range(60)] + ODD
    for least in (2, 10):
        got = [tuple(r)[1:] for r in line_dedup.digest(docs(spark, texts), least).orderBy("doc_id").collect()]
        assert got == lines_by_hand(texts, least)


def test_lines_keep_other_columns(spark):
    df = clashing(docs(spark, ["a\nb"])).withColumn("count", F.lit(3))
    out = line_dedup.drop_common_lines(df).first()
    assert out["count"] == 3 and out["n_lines"] == 2 and out["kept_text"] == "a\nb"
    assert all(out[n] == f"my {n}" for n in NAMES if n not in line_dedup.NEW)
    assert line_dedup.digest(docs(spark, [])).count() == 0


def test_lines_of_repeated_and_nameless_rows(spark):
    # Ten copies under one id are one document; ten ids are ten; rows without an id are told apart by their text.
    rows = [(1, "often\nalone")] * 10 + [(i, "shared\nx%d" % i) for i in range(2, 10)] + [(1, "shared\nmore"), (None, "shared"), (None, "shared"), (None, None), (None, "")]
    got = Counter(tuple(r) for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect())
    want = Counter({(1, 2, 0, "often\nalone"): 10, (1, 2, 1, "more"): 1, (None, 1, 1, ""): 2, (None, 1, 0, ""): 2} | {(i, 2, 1, f"x{i}"): 1 for i in range(2, 10)})
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), database(SF), queries.ORACLES[name]) == ""


# Quality rules
def stats_by_hand(text):
    t = text or ""
    w = WORD.findall(t)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #|é\n\t\x0b\U0001f600A", max_size=40)), max_size=8))
@settings(deadline=None, max_examples=150)
def test_statistics_by_hand(texts):
    import pyarrow as pa

    from gridloom.llm.text import slices

    b = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    got = []
    for limit in (3, 1 << 20):
        rows = []
        for t in slices([b], limit=limit):
            m = quality_rules.measure(t)
            rows += list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
        got.append(rows)
    assert got[0] == got[1] == [stats_by_hand(t) for t in texts]


def test_rules_learn_and_emit(spark):
    rng = np.random.default_rng(4)
    n = 900
    table = {k: rng.random(n) for k in quality_rules.FEATURES}
    bad = (table["symbols_a_word"] > 0.7) & (table["upper_share"] < 0.5)
    rules = quality_rules.learn(table, bad)
    assert rules.rules and (rules.keeps(table) == ~bad).mean() > 0.97
    assert quality_rules.learn(table, np.zeros(n, bool)).rules == () and quality_rules.learn({k: v[:0] for k, v in table.items()}, bad[:0]).rules == ()
    out = quality_rules.apply_rules(docs(spark, [*ODD, "word " * 20 + "&& " * 60]).withColumn("kept", F.lit("old")), rules)
    assert all(r.base_failed for r in out.where("doc_id < 6").collect()) and dict(out.dtypes)["kept"] == "boolean"


def test_quality_query(spark):
    out = queries.op3_quality_rules(spark, SF)
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in out.collect():
        want = stats_by_hand(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


# Resampling
def test_top_k_is_exact(spark):
    for keys, k in (([1.0] * 50, 7), ([float(i % 5) for i in range(100)], 33), ([0.5], 1), ([1.0, 2.0], 0), ([float(i) for i in range(3000)], 1234)):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(keys)], "doc_id long, key double")
        got = {r.doc_id for r in resample.top_k(df, k, bins=8).where("kept").collect()}
        assert got == set(sorted(range(len(keys)), key=lambda i: (-keys[i], i))[:k])


def test_top_k_of_repeated_rows(spark):
    rows = [(1, 0.5), (1, 0.5), (2, 0.5), (3, 0.1), (None, 0.5), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, key double").withColumns({"row": F.lit("my row"), "id": F.lit(1), "n": F.lit(2)})
    for k in range(8):
        out = resample.top_k(df, k, bins=4).collect()
        assert Counter((r.doc_id, r.key) for r in out) == Counter(rows) and sum(r.kept for r in out) == min(k, 5)
        assert [r.doc_id for r in out if r.kept] .count(None) == min(k, 1) and all(r.row == "my row" and r.id == 1 and r.n == 2 for r in out)
    wide = spark.createDataFrame([(i, x) for i, x in enumerate([1e300, -1e300, 1e-300, 0.0, -0.0, 5e-324, float(2**60), 1.0, 1.0 + 2**-52])], "doc_id long, key double")
    for k in range(1, 9):
        got = {r.doc_id for r in resample.top_k(wide, k, bins=4).where("kept").collect()}
        assert got == set(sorted(range(9), key=lambda i: (-wide.collect()[i].key, i))[:k])


def model_by_hand(texts, size):
    """How often each bucket of words and word pairs occurs, one text at a time."""
    import pyarrow as pa

    from gridloom.llm.text import _BASE, mix, slices, word_hashes

    counts, own = Counter(), []
    for t in texts:
        hashes = next(slices([pa.RecordBatch.from_pydict({"text": pa.array([t], pa.string())})]))
        one = [int(h) for h in word_hashes(hashes)[0]]
        pair = []
        for a, b in zip(one, one[1:]):
            with np.errstate(over="ignore"):
                x = mix(np.array([a], np.uint64))
                pair.append(int(mix(x * _BASE + np.uint64(b))[0]))
        own.append([h % size for h in one + pair])
        counts.update(own[-1])
    return counts, own


def test_importance_by_hand(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 12))) for _ in range(40)] + [None, "", "  "]
    size = 64
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "doc_id long, good boolean").selectExpr("doc_id", "int(good) AS quality")
    raw, own = model_by_hand(texts, size)
    target, _ = model_by_hand([texts[i] for i in range(0, 30, 3)], size)
    total, wanted = sum(raw.values()), sum(target.values())
    prior = [(raw[b] + 1) / (total + size) for b in range(size)]
    pseudo = 0.01 * max(1.0, wanted)
    ratio = [np.log((target[b] + pseudo * prior[b]) / (wanted + pseudo) / prior[b]) for b in range(size)]
    for r in resample.resample(docs(spark, texts), labels, size=size).collect():
        assert r.n_grams == len(own[r.doc_id])
        assert r.log_weight == pytest.approx(sum(ratio[b] for b in own[r.doc_id]) / max(1, len(own[r.doc_id])) / 0.05, abs=1e-9)


def test_resampling_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert resample.resample(docs(spark, []), none, size=64).count() == 0
    rows = [(1, "a b")] * 3 + [(None, "c"), (None, None), (2, "")]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = resample.resample(clashing(spark.createDataFrame(rows, DOCS)), labels, size=64)
    assert out.columns == ["doc_id", "n_grams", "log_weight", "key", "kept"]
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in rows) and out.where("kept").count() == 5


def test_resampling_prefers_the_target(spark):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(0, 60)], "doc_id long, quality int")
    texts = ["good calm words here again" if i % 2 == 0 else "junk!!! noise$$$ %%% zzz" for i in range(120)]
    out = resample.resample(docs(spark, [*texts, None, ""]), labels, size=1 << 12).collect()
    assert len(out) == 122 and sum(r.kept for r in out) == 61
    assert np.mean([r.kept for r in out if r.doc_id < 120 and r.doc_id % 2 == 0]) > 0.9
    assert next(r for r in out if r.doc_id == 120).log_weight == 0


def test_no_labels_keeps_all(spark):
    out = resample.resample(docs(spark, ["a b", "c"]), spark.createDataFrame([], "doc_id long, quality int"), size=64)
    assert [r.kept for r in out.collect()] == [True, True]


# Suffix sorting and removal
@given(st.lists(st.integers(0, 3), max_size=40))
@settings(deadline=None, max_examples=400)
def test_suffix_array(text):
    assert suffix_array.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def removed_by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    starts = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if starts[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [4000, 2])
def test_removal_by_hand(spark, crowd):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 7)))
    make = lambda n: " ".join(word() for _ in range(n))
    shared = [make(60), make(40), make(90)]
    texts = [*ODD, make(80), "z" * 900, "zy" * 300]
    for _ in range(40):
        parts = [rng.choice([make(rng.randint(1, 30)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 40) :]]) for _ in range(rng.randint(1, 4))]
        texts.append(" ".join(parts))
    texts += [texts[-1], texts[-1], texts[20]]
    got = [tuple(r)[1:] for r in suffix_dedup.digest(docs(spark, texts), 150, crowd).orderBy("doc_id").collect()]
    assert got == removed_by_hand(texts, 150)


@pytest.mark.parametrize("crowd", [4000, 2])
def test_short_passages_are_counted_beside_the_removed(spark, crowd):
    """Passages between the two lengths are counted and stay; the removed strings are those of brute force."""
    rng = random.Random(11)
    make = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(n))
    short, long = [make(32), make(45)], [make(90), make(120)]
    assert all(150 < len(t.encode()) < 300 for t in short) and all(len(t.encode()) > 400 for t in long)
    texts = [*ODD, make(80), "z" * 250, "z" * 900]
    for _ in range(40):
        texts.append(" ".join(rng.choice([make(rng.randint(1, 30)), rng.choice(short), rng.choice(long)[rng.randint(0, 200) :]]) for _ in range(rng.randint(1, 4))))
    texts += [texts[-1], texts[-1], short[0] + "x", short[0] + "x"]
    got = [tuple(r)[1:] for r in suffix_dedup.digest(docs(spark, texts), 300, crowd, passage=150).orderBy("doc_id").collect()]
    assert [r[:4] for r in got] == removed_by_hand(texts, 300)
    assert [r[4] for r in got] == [r[1] for r in removed_by_hand(texts, 150)]
    assert any(r[1] == 0 and r[4] for r in got) and any(0 < r[1] < r[4] for r in got)


def test_the_query_shows_passages_of_over_fifty_words(spark, tmp_path):
    passage = " ".join(f"w{i:03d}" for i in range(55))
    assert len(passage) < suffix_dedup.LENGTH
    docs(spark, ["head " + passage, passage + " tail", "alone " * 20]).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op4_suffix_dedup"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans, r.n_passage_bytes) for r in got] == [(0, 0, 274), (0, 0, 274), (0, 0, 0)]


def test_removal_odd_tables(spark):
    assert suffix_dedup.digest(docs(spark, []), 150).count() == 0
    long = " ".join(f"w{i}" for i in range(200))
    same = spark.createDataFrame([(1, long), (1, long), (None, long + "x")], DOCS)
    assert sorted((r.n_bytes - r.n_removed) for r in suffix_dedup.digest(same, 150).collect()) == [0, 0, 1]
    out = suffix_dedup.remove_repeats(clashing(docs(spark, [long, long, "short"])), 150).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["", "", "short"]
    assert_untouched(out)


def test_removal_keeps_whole_characters(spark):
    # The repeated bytes begin inside one character and end inside another.
    same = "x" * 160
    texts = ["é" + same + "à", "è" + same + "á", "tail"]
    out = suffix_dedup.remove_repeats(docs(spark, texts), 150).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["é", "è", "tail"]
    data = np.frombuffer("aéb".encode(), np.uint8)
    start, end = suffix_dedup.whole_characters(data, np.array([2]), np.array([3]))
    assert (start.tolist(), end.tolist()) == ([1], [3])


def test_anchors_do_not_depend_on_blocks():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 10, 10, 900, 4200, 5000])
    whole = suffix_dedup.anchors(data, offsets, 150, 1 << 16)
    for block in (1, 97, 1000):
        for a, b in zip(whole, suffix_dedup.anchors(data, offsets, 150, block), strict=True):
            assert a.tolist() == b.tolist()


def test_spans_are_hashed_piece_by_piece():
    from gridloom.llm.text import prefix_hash, span_hash, spans_hash

    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    start = rng.integers(0, 2900, 200)
    end = start + rng.integers(0, 100, 200)
    assert (spans_hash(data, start, end, 4, limit=150) == span_hash(prefix_hash(data), start, end, 4)).all()


# BPE
@pytest.fixture(scope="module")
def tokenizers_file():
    return queries.tokenizer_path()


def test_bpe_is_the_library(tokenizers_file):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizers_file)
    own = bpe.Encoder(bpe.Tokenizer.load(tokenizers_file), size=50)
    rng = random.Random(3)
    pool = ["a", "é", "é", "Σ", "İ", "ß", "\x85", " ", "\x1c", "​", " ", "\n", "'s", "'LL", "½", "😀", "你", "<|endoftext|>", "<|", "!!", "aaaa", "́", "　", "ﬁ", "don't", "th", "ing", "가"]
    for _ in range(4000):
        s = "".join(rng.choices(pool, k=rng.randint(0, 12)))
        want = lib.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == want
        assert own.digest(s) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest())


@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=6), min_size=1, max_size=12), st.text(alphabet="abcd", max_size=30))
@settings(deadline=None, max_examples=400)
def test_suffix_automaton_finds_all_words(words, text):
    from gridloom.llm.suffix_automaton import SuffixAutomaton

    words = {w: i for i, w in enumerate(sorted(words))}
    got = [(end, k, v) for end, longest, found in SuffixAutomaton(words).endings(text) for k, v in found if k <= longest]
    want = [(end, len(w), i) for end in range(1, len(text) + 1) for w, i in sorted(words.items(), key=lambda x: -len(x[0])) if text[:end].endswith(w)]
    assert got == want


def test_bpe_tables(spark, tokenizers_file):
    df = docs(spark, ODD).withColumn("ids", F.lit("clash"))
    out = bpe.encoded_digest(df, tokenizers_file).orderBy("doc_id").collect()
    assert len(out) == len(ODD) and out[0].n_tokens == 0 and out[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    back = bpe.decode(bpe.encode(docs(spark, ["Hello wörld"]), tokenizers_file), tokenizers_file).first()
    assert back.decoded.startswith("hello</w> ")


# Packing
@given(st.lists(st.integers(1, 64), max_size=60))
@settings(deadline=None, max_examples=200)
def test_packing_holds_everything(lengths):
    lengths = sorted(lengths, reverse=True)
    where, place, final = packing.pack(lengths, (16, 32, 64))
    used = Counter()
    for n, w, p in zip(lengths, where, place, strict=True):
        assert p == used[w]
        used[w] += n
    assert all(used[b] <= s and s == min(x for x in (16, 32, 64) if x >= used[b]) for b, s in enumerate(final))


@given(st.lists(st.integers(1, 64), max_size=30))
@settings(deadline=None, max_examples=100)
def test_packing_is_best_fit_decreasing(lengths):
    lengths = sorted(lengths, reverse=True)
    for sizes in ((64,), (16, 32, 64)):
        room, where, rest = [], [], sum(lengths)
        for n in lengths:
            rest -= n
            fits = [b for b in range(len(room)) if room[b] >= n]
            if fits:
                least = min(room[b] for b in fits)
                where.append([b for b in fits if room[b] == least])
            else:
                room.append(packing.cheapest(n, rest, sizes))
                where.append([len(room) - 1])
            got = packing.pack(lengths, sizes)[0][len(where) - 1]
            assert got in where[-1]
            room[got] -= n


@given(st.lists(st.integers(1, 64), min_size=1, max_size=6))
@settings(deadline=None, max_examples=100)
def test_packing_is_near_the_optimum(lengths):
    sizes = (16, 32, 64)
    lengths = sorted(lengths, reverse=True)

    def cost(used):
        return sum(packing.bin_cost(next(s for s in sizes if s >= u)) for u in used)

    def best(k, used):
        if k == len(lengths):
            return cost(used)
        n, tries = lengths[k], [best(k + 1, [*used, lengths[k]])]
        tries += [best(k + 1, [*used[:b], u + n, *used[b + 1 :]]) for b, u in enumerate(used) if u + n <= sizes[-1]]
        return min(tries)

    one = sum(map(packing.bin_cost, packing.pack(lengths, sizes)[2]))
    joint = sum(map(packing.bin_cost, packing.pack_jointly(lengths, sizes)[2]))
    optimum = best(0, [])
    assert optimum - 1e-9 <= joint <= one and joint <= 1.35 * optimum


def test_packing_of_odd_rows(spark):
    rows = [(1, "a b c")] * 40 + [(None, "d e")] * 40 + [(None, None), (2, "")]
    df = clashing(spark.createDataFrame(rows, DOCS))
    out = packing.best_fit(df, sizes=(4, 8), group_pieces=10)
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and sum(r.bin_id is None for r in got) == 2
    assert out.where("bin_id IS NOT NULL").groupBy(F.substring_index("bin_id", "-", 1)).count().agg(F.max("count")).first()[0] < 40
    assert packing.bins(out).where("n_tokens > bin_size").count() == 0


def test_best_fit_is_best(spark):
    b = packing.OpenBins()
    for room, number in ((5, 0), (3, 1), (9, 2), (3, 3)):
        b.put(room, number)
    assert b.best(4) == (5, 0) and b.best(3) == (3, 3) and b.best(10) is None


def test_packing_tables(spark):
    texts = [*ODD, "w " * 5000, *["a b c " * (i % 90) for i in range(300)]]
    out = packing.best_fit(docs(spark, texts), group_pieces=50)
    rows = out.collect()
    total = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert all(got[i] == n for i, n in total.items()) and {r.doc_id for r in rows} == set(total)
    assert all((r.bin_id is None) == (r.n_tokens == 0) for r in rows)
    assert packing.bins(out).where("n_tokens > bin_size").count() == 0
    assert packing.best_fit(docs(spark, [])).count() == 0


# Toxicity
def test_folding():
    assert lexicon.fold_word("1D10T!") == "idiot" and lexicon.fold_word("іdіоt") == "idiot" and lexicon.fold_word("2024") == "2024"


def test_exceptions_spare():
    lex = lexicon.Lexicon({" tras": 5.0}, ("trash can",), 4.0, -2.0)
    fold = lexicon.Folder()
    assert lex.density(fold("the trash can is full")) == 0 and lex.density(fold("what trash this is")) > 0


def test_exceptions_are_learned():
    rows = [(f"you utter idiot number{i}", 1) for i in range(200)] + [(f"the idiot board of page{i}", 0) for i in range(3)] + [(f"calm words here{i}", 0) for i in range(400)]
    lex = lexicon.fit(rows, min_docs=3, min_odds=1.0)
    fold = lexicon.Folder()
    assert {"idiot board", "the idiot"} <= set(lex.exceptions) and "utter idiot" not in lex.exceptions
    assert lex.density(fold("see the idiot board now")) == 0 and lex.density(fold("you utter idiot")) > 0


def test_toxicity_held_out(spark):
    rows = queries.op7_toxicity(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    tested = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in tested) / len(tested) > 0.95


@given(st.text(alphabet="tras hcnid ot", max_size=60))
@settings(deadline=None, max_examples=200)
def test_density_by_hand(text):
    lex = lexicon.Lexicon({" tras": 3.0, " trash ": 5.0, " idiot ": 2.0}, ("trash can",))
    folded = lexicon.Folder()(text)
    total = 0.0
    for i in range(len(folded)):
        spared = any(folded.startswith(" trash can ", k) and k <= i < k + len(" trash can ") - 0 for k in range(max(0, i - 10), i + 1))
        hit = [w for e, w in lex.weights.items() if folded.startswith(e, i)]
        total += 0 if spared or not hit else max(hit)
    assert lex.density(folded) == pytest.approx(100 * total / max(1, len(folded.split())))


def test_toxicity_of_odd_rows(spark):
    rows = [(1, "you idiot"), (1, "you idiot"), (2, "fine"), (None, "you idiot"), (None, None), (3, ""), (4, "idiot " * 20000), (5, "day")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    out = lexicon.held_out_report(clashing(spark.createDataFrame(rows, DOCS)), labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert lexicon.held_out_report(docs(spark, []), labels).count() == 0


def test_toxicity_odd(spark):
    lex = lexicon.fit([("you idiot", 1), ("fine day", 0)] * 5)
    out = lexicon.score_toxicity(docs(spark, ODD), lex).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert lexicon.fit([]).weights == {} and lexicon.fit([("a", 0)]).weights == {}


# Near duplicates
def classes_by_hand(texts):
    seqs = [WORD.findall(t or "") for t in texts]
    shingles = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in seqs]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
        return row[-1]

    for i in range(len(texts)):
        for j in range(i):
            if seqs[i] and (seqs[i] == seqs[j] or (a := shingles[i]) and (b := shingles[j]) and (c := lcs(a, b)) and c / (len(a) + len(b) - c) >= 0.8 - 1e-12):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def test_near_by_hand(spark):
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    texts = [*ODD, "a b c", "a b c", "a b c d e f g h", "a b c d e f g h i", "p q r s t u v", "p q r s t u v w"]
    for n in (12, 40, 90):
        base = make(n)
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [f"x{rng.randint(0, 999)}"], [w[k], "new"]])
            texts.append(" ".join(w))
    texts += [" ".join(make(60) + ["hello"] * 10) for _ in range(10)]
    got = [r.class_id for r in near_dedup.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == classes_by_hand(texts)


def test_large_component_meets_the_others_only(spark):
    """Forty linked copies and three strangers in one group: the strangers' links are found, copies among themselves aren't compared."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:50], f"x{i}", *base[50:]]) for i in range(40)] + [" ".join([*base[:40], "new", *base[40:]]), " ".join(base), "another text of more than five words here"]
    members = spark.createDataFrame([(1, 0, i) for i in range(43)], "key long, pivot long, rep long")
    roots = spark.createDataFrame([(i, 0) for i in range(40)], "node long, root long")
    links = near_dedup.within_groups(members, roots, docs(spark, texts), 0.8, block=8).collect()
    assert {x for r in links for x in (r.a, r.b) if x >= 40} == {40, 41} and all(max(r.a, r.b) >= 40 for r in links)


def test_blocks_split_a_group(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[: i % 50], f"x{i}", *base[i % 50 :]]) for i in range(40)]
    d = docs(spark, texts)
    members = spark.createDataFrame([(1, 0, i) for i in range(40)], "key long, pivot long, rep long")
    roots = spark.createDataFrame([(i, i) for i in range(40)], "node long, root long")
    links = near_dedup.within_groups(members, roots, d, 0.8, block=7)
    assert components.components(links).select("root").distinct().count() == 1 and links.count() < 40 * 12


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
@settings(deadline=None, max_examples=300)
def test_banded_alignment(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    want, least = best[-1][-1], near_dedup.least_common(len(a), len(b))
    got = near_dedup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), least, len(a) + len(b) - 2 * least)
    assert (got >= least) == (want >= least) and got <= want


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    root = {x: x for p in links for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_copy_of_repeated_rows_stays(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{k}{i}" for i in range(150)) for k in "abcd")
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b + " "), (4, c), (4, d), (None, d), (None, a), (None, b + "\n"), (None, c + " end"), (None, c + " end"), (5, a), (5, "five"), (None, ""), (None, None), (6, ""), (6, ""), (7, None)]
    df = spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    out = near_dedup.one_of_each(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, (r.text or "").strip()) for r in out.collect())
    assert got == Counter({(1, a): 1, (3, b): 1, (4, c): 1, (4, d): 1, (None, c + " end"): 1, (5, "five"): 1, (None, ""): 2, (6, ""): 1, (7, ""): 1})
    assert near_dedup.one_of_each(df.limit(0)).count() == 0
    few = df.where("doc_id IN (1, 2, 3)")
    left = corpus_pipeline.suffix_stage(spark, corpus_pipeline.near_stage(spark, few, SF), SF)
    assert sorted((r.text or "").strip() for r in left.collect()) == [a, b]


# Language model
def test_pseudo_likelihood_learns(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["red blue", "up down", "left right"], k=80)) for _ in range(80)]
    shape = masked_lm.Shape(frequent=16, buckets=16, width=8, branch=8)
    model = masked_lm.trained(docs(spark, texts), shape, rounds=2, masked=0.5, batch=128, rate=0.3)
    good, bad, *rest = masked_lm.score(docs(spark, ["red blue up down left right", "blue right red down down up", *ODD]), model).orderBy("doc_id").collect()
    assert good.score > bad.score and rest[0].n_tokens == 0 and rest[0].score is None
    assert good.log_likelihood == pytest.approx(good.score * good.n_tokens)


def test_log_probabilities_sum_to_one():
    shape = masked_lm.Shape(8, 8, 4, 4)
    w = masked_lm.fresh(shape, np.full(16, 1 / 16))
    around = np.array([[3, 1, 2, 16]] * 16, np.int32)
    p = np.exp(masked_lm.log_probabilities(w, around, np.arange(16), shape.branch))
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_words_of_a_bucket_are_told_apart(spark):
    texts = ["the cat the dog the cat", "the cat the bird"] * 3 + ["the dog"]
    shape = masked_lm.Shape(frequent=1, buckets=1, width=4, branch=2)
    model = masked_lm.trained(docs(spark, texts), shape, rounds=1)
    d = docs(spark, ["cat", "bird", "never", "cat", None, "bird cat bird"]).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    got = {r.doc_id: r for r in masked_lm.score(d, model).collect()}
    weights = masked_lm.unpacked(model.weights, shape)
    bucket = float(masked_lm.log_probabilities(weights, np.full((1, 4), shape.size, np.int32), np.array([1]), shape.branch)[0])
    # Beside "the" came 9 cats, 7 dogs and birds: 16 words, 3 different ones.
    share = {0: 9 / 19, 1: 3 / 19, 2: 3 / 19, None: 9 / 19}
    for k, x in share.items():
        assert got[k].log_likelihood == pytest.approx(bucket + np.log(x), abs=1e-5)
    assert got[4].log_likelihood == 0 and got[4].score is None and got[5].n_tokens == 3


def test_vocabulary_grows_with_the_corpus():
    small, large = masked_lm.Shape.grown(10_000_000), masked_lm.Shape.grown(5_000_000_000)
    assert small.frequent == 768 and large.frequent > 5 * small.frequent and large.buckets > 5 * small.buckets


def test_every_token_is_a_target_once(spark):
    texts = [" ".join(f"w{(i * k) % 37}" for k in range(1 + i)) for i in range(60)] + ODD
    model = masked_lm.trained(docs(spark, texts), masked_lm.Shape(8, 8, 4, 4))
    assert model.seen == sum(len(WORD.findall(t or "")) for t in texts)


def test_pseudo_likelihood_by_hand(spark):
    """Every conditional probability from one full softmax, one token at a time."""
    texts = ["a b a c", "c b a a b", "b", None, "", "a b a c"]
    shape = masked_lm.Shape(frequent=3, buckets=2, width=3, branch=2)
    model = masked_lm.trained(docs(spark, texts), shape, rounds=2, batch=4)
    w = masked_lm.unpacked(model.weights, shape)
    import pyarrow as pa

    from gridloom.llm.text import slices, word_hashes

    number = {}
    for x in "abc":
        h = word_hashes(next(slices([pa.RecordBatch.from_pydict({"text": [x]})])))[0]
        number[x] = int(masked_lm.Vocabulary(model.frequent, shape)(h)[0])
    assert set(number.values()) == {0, 1, 2}

    def p(around, token):
        h = np.tanh(sum(w["embed"][k][x].astype(float) for k, x in enumerate(around)) + w["bias"])
        softmax = lambda z: np.exp(z) / np.exp(z).sum()
        top = softmax(h @ w["up"] + w["up0"])
        return top[token % 2] * softmax(h @ w["low"][token % 2] + w["low0"][token % 2])[token // 2]

    for r in masked_lm.score(docs(spark, texts), model).collect():
        tokens = [number[x] for x in (texts[r.doc_id] or "").split()]
        at = lambda i: tokens[i] if 0 <= i < len(tokens) else shape.size
        want = sum(np.log(p([at(i + s) for s in masked_lm.SIDES], x)) for i, x in enumerate(tokens))
        assert r.log_likelihood == pytest.approx(want, abs=1e-4)


def test_steps_follow_the_gradient():
    """One step against differences of the summed loss: every weight moves by the rate times its gradient over the root of its square."""
    shape = masked_lm.Shape(3, 3, 3, 2)
    rng = np.random.default_rng(1)
    around, tokens = rng.integers(0, 7, (12, 4)).astype(np.int32), rng.integers(0, 6, 12)
    w = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in masked_lm.fresh(shape, np.full(6, 1 / 6)).items()}

    def loss(weights):
        return -masked_lm.log_probabilities(weights, around, tokens, shape.branch).astype(np.float64).mean()

    trainer = masked_lm.Trainer({k: v.copy() for k, v in w.items()}, shape.branch, 0.1)
    trainer.step(around, tokens)
    for name, old in w.items():
        for at in np.ndindex(old.shape):
            e = 1e-3
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += e
            down[name][at] -= e
            g = (loss(up) - loss(down)) / (2 * e)
            assert trainer.w[name][at] - old[at] == pytest.approx(-0.1 * g / np.sqrt(0.01 + g * g), abs=2e-3)


def test_common_words_are_looked_up_and_the_others_joined(spark):
    """Scores don't depend on how many of the words inside buckets are known; those are the commonest, and never more than asked for."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (1 + i) for i in range(60)], k=rng.randint(1, 40))) for _ in range(50)] + ODD
    d = docs(spark, [*texts, texts[0], "never seen " + texts[1]])
    shape = masked_lm.Shape(frequent=3, buckets=4, width=3, branch=3)
    model = masked_lm.trained(docs(spark, texts), shape)
    counts = masked_lm.word_counts(docs(spark, texts))
    times = {np.uint64(r.word % 2**64): r.n for r in counts.collect()}
    scores = []
    for known in (128, 5, 0):
        inside, unseen, held, gains = masked_lm.within_buckets(counts, model.frequent, shape, known)
        every = {np.uint64(r.word % 2**64): r.gain for r in inside.collect()}
        assert {w: every[w] for w in held} == dict(zip(held, gains, strict=True)) and (np.diff(held.astype(object)) > 0).all()
        assert len(held) == len(every) if known == 128 else len(held) <= known * shape.frequent
        assert known == 0 or min(times[w] for w in held) >= max([times[w] for w in every.keys() - set(held)], default=0)
        assert known != 5 or 0 < len(held) < len(every)
        part = dataclasses.replace(model, inside=inside, unseen=unseen, known=held, gains=gains)
        scores.append([r.log_likelihood for r in masked_lm.score(d, part).orderBy("doc_id").collect()])
    assert scores[1] == pytest.approx(scores[0], abs=1e-6) and scores[2] == pytest.approx(scores[0], abs=1e-6)


def test_texts_are_read_once_for_scoring(spark):
    """Words and likelihoods come from one pass over the texts, whose rows are written once."""
    texts = ["a b a c", "c b a a b", "b"]
    model = masked_lm.trained(docs(spark, texts), masked_lm.Shape(1, 2, 3, 2), rounds=1)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(text):
        seen.add(1)
        return text

    d = docs(spark, texts)
    masked_lm.score(d.withColumn("text", passed.asNondeterministic()("text")), model).collect()
    assert seen.value == len(texts)


def test_language_model_of_odd_rows(spark):
    rows = [(1, "a b c")] * 3 + [(None, "a b c"), (None, None), (2, ""), (1, "other words")]
    out = masked_lm.scored(clashing(spark.createDataFrame(rows, DOCS))).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter({(1, 3): 3, (None, 3): 1, (None, 0): 1, (2, 0): 1, (1, 2): 1})
    assert len({round(r.log_likelihood, 4) for r in out if r.n_tokens == 3}) == 1
    assert masked_lm.scored(docs(spark, [])).count() == 0


def test_training_on_nothing(spark):
    model = masked_lm.trained(docs(spark, []), masked_lm.Shape(4, 4, 4, 4), rounds=1)
    assert masked_lm.score(docs(spark, ["a b"]), model).first().n_tokens == 2


# Nearest neighbours
def test_neighbours_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2050, [0.0] * 8), (2100, [1.0] * 7 + [float("nan")]), (2150, [1.0] * 7 + [None]), (2200, [1.0]), (None, rows[0][1]), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = {}
    for r in additive_ann.nearest(df, books=6, candidates=60).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    fine = {i: np.array(np.float32(v), float) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    assert set(got) == {i for i in fine if i % 50 == 0}
    hit = total = 0
    for q, found in got.items():
        cos = {i: float(v @ fine[q] / np.linalg.norm(v) / np.linalg.norm(fine[q])) for i, v in fine.items() if i != q}
        want = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        assert sorted(found) == [1, 2, 3, 4, 5] and all(s == pytest.approx(cos[i]) for i, s in found.values())
        hit += len({i for i, _ in found.values()} & set(want))
        total += 5
    assert hit / total >= 0.9


def test_crowded_block_loses_no_candidate(spark):
    """All neighbours of a query in one block, more than its share: they are found all the same."""
    rng = np.random.default_rng(3)
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = [(i * groups * 1000, (np.eye(1, 6, 0)[0] + rng.normal(0, 0.01, 6)).tolist()) for i in range(30)]
    far = [(50 * i + 1, rng.normal(size=6).tolist()) for i in range(2000)]
    df = spark.createDataFrame(near + far, "vec_id long, embedding array<float>")
    got = {r.rank: r.vec_id for r in additive_ann.nearest(df, books=4, candidates=20).where("query_id = 0").collect()}
    v = {i: np.float32(x).astype(float) for i, x in near + far}
    cos = {i: x @ v[0] / np.linalg.norm(x) / np.linalg.norm(v[0]) for i, x in v.items() if i}
    best = sorted(cos, key=lambda i: -cos[i])[:20]
    assert len(got) == 5 and set(got.values()) <= set(best) | {i for i, _ in near}


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in additive_ann.nearest(df).collect()] == [(0, 1, 1)]
    assert additive_ann.nearest(df.where("vec_id > 5")).count() == 0


# Pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, near_dedup.stored(stage(spark, d, SF), "stage")
        names.append(name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.columns == before.columns and 0 < d.count() <= before.count()
            assert d.where("n_chars <> char_length(text)").count() == 0
    assert names == ["quality_rules", "line_dedup", "near_dedup", "suffix_dedup", "best_fit_packing"]
    assert d.count() > 0


ROWS = [(1, "a b c d e f\nshared line"), (1, "a b c d e f\nshared line"), (1, "other"), (None, "a b c d e f\nshared line"), (None, None), (None, ""), (2, None), (3, "w " * 30000), (4, "x" * 40000)]


def test_stages_on_odd_rows(spark):
    """No stage loses a column, changes a user's column or fails on nulls, repeats, long texts and clashing names."""
    import corpus_pipeline

    rows = clashing(spark.createDataFrame(ROWS, DOCS))
    kept = {"quality_rules": 0, "line_dedup": 9, "suffix_dedup": 9}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (rows, rows.limit(0)):
            out = stage(spark, df, SF)
            assert out.columns == df.columns
            got = out.collect()
            assert_untouched(got)
            assert len(got) <= df.count()
        assert name not in kept or stage(spark, rows, SF).count() == kept[name]
    assert corpus_pipeline.packing_stage(spark, rows, SF).select("doc_id").distinct().count() == 5
    assert corpus_pipeline.packing_stage(spark, rows.limit(0), SF).count() == 0


def test_pipeline_by_hand(spark):
    """Every stage but the first and last against brute force, each on what the one before kept."""
    import corpus_pipeline

    rng = random.Random(13)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    make = lambda n: " ".join(rng.choices(words, k=n))
    passage, common = make(60), make(6)
    texts = []
    for i in range(30):
        lines = [make(rng.randint(20, 40)) for _ in range(3)]
        if i % 2:
            lines.insert(1, common)
        if i % 5 == 0:
            lines[0] += " " + passage
        texts.append("\n".join(lines))
    texts += [texts[3], texts[4] + " more", texts[7].replace(" ", "  "), "short"]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")

    lined = corpus_pipeline.line_stage(spark, df, SF)
    keys = Counter(k for t in texts for k in set(t.split("\n")))
    want = {i: "\n".join(x for x in t.split("\n") if keys[x] < 10) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in lined.collect()} == want and lined.where("n_chars <> char_length(text)").count() == 0

    near = corpus_pipeline.near_stage(spark, lined, SF)
    classes = classes_by_hand([want[i] for i in range(len(texts))])
    want = {i: want[i] for i in range(len(texts)) if classes[i] == i}
    assert {r.doc_id: r.text for r in near.collect()} == want

    cut = corpus_pipeline.suffix_stage(spark, near, SF)
    starts = Counter(t[k : k + 200] for t in want.values() for k in range(len(t) - 199))
    for r in cut.collect():
        t = want[r.doc_id]
        gone = set()
        for k in range(len(t) - 199):
            if starts[t[k : k + 200]] > 1:
                gone |= set(range(k, k + 200))
        assert r.text == "".join(c for k, c in enumerate(t) if k not in gone)
    assert not any(passage[:150] in r.text for r in cut.collect())


def test_rules_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    out = quality_rules.report(clashing(spark.createDataFrame(ROWS, DOCS)), labels)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in ROWS)
    for r in out.where("doc_id = 3").collect():
        assert r.n_words == 30000 and r.base_failed and not r.kept
    assert quality_rules.report(docs(spark, []), labels).count() == 0


def test_bpe_of_odd_rows(spark, tokenizers_file):
    out = bpe.encoded_digest(clashing(spark.createDataFrame(ROWS, DOCS)), tokenizers_file).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in ROWS) and sum(r.n_tokens == 0 for r in out) == 3
    assert bpe.encoded_digest(docs(spark, []), tokenizers_file).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    out = near_dedup.near_duplicates(clashing(spark.createDataFrame(ROWS, DOCS))).collect()
    assert Counter((r.doc_id, r.class_id) for r in out) == Counter({(1, 1): 3, (None, 1): 1, (None, None): 2, (2, 2): 1, (3, 3): 1, (4, 4): 1})
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_a_very_long_text(spark):
    """Three million bytes in one row: removed spans are those of brute force on its only repeat."""
    rng = np.random.default_rng(5)
    long = "".join(map(chr, rng.integers(97, 123, 3_000_000)))
    texts = [long[:1_500_000] + "\n" + long[1_500_000:], "q" * 50 + long[2_000_000:2_000_700] + "q" * 50]
    got = {r.doc_id: r for r in suffix_dedup.digest(docs(spark, texts), 400).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (0, 1)] == [(700, 1), (700, 1)]
    assert got[0].kept_sha256 == hashlib.sha256(texts[0].replace(long[2_000_000:2_000_700], "").encode()).hexdigest()


def test_no_local_folder_on_a_cluster():
    from gridloom.llm import store

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        store.shared_dir(Session)
