"""The trie of conversations' beginnings beside brute force and SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import digests, prefix_trie, queries
from gridloom.operators import ranking
from tests.oracle import database, differences

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    """All nodes, from whole lists of turns."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + v[h:] for c, v in own.items()}
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += p not in children
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, ROWS)).collect()), key=str)


def conversations(seed, n=60, turns=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randint(1, turns)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hello", "héé", "", "x" * 50])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, one_task, piece", [(1, 1 << 16, 1 << 16), (2, 3, 2)])
def test_by_hand(spark, monkeypatch, seed, one_task, piece):
    monkeypatch.setattr(ranking, "ONE_TASK", one_task)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = conversations(seed)
    assert found(spark, rows) == by_hand(rows)


def test_shapes(spark):
    """A chain, a star, many equal conversations, one that is absent at its base, and conversations that lose all turns."""
    rows = [(0, t, "user", f"deep {t}") for t in range(300)]
    rows += [(5 * c, 0, "user", f"star {c}") for c in range(1, 60)]
    rows += [(1001 + 5 * c, t, "user", "same") for c in range(60) for t in range(2)]  # their bases are absent
    assert found(spark, rows) == by_hand(rows)


def test_odd_rows(spark):
    rows = [(3, None, None, None), (3, 0, "user", ""), (3, 0, "user", ""), (None, 0, "user", "x"), (8, 7, "user", "long " * 40_000), (8, None, "user", "a"), (5, 2, "b", "z"), (5, 2, "a", "y"), (0, 0, "user", "one"), (4, 9, "user", "two")]
    assert found(spark, rows) == by_hand(rows)
    wide = spark.createDataFrame(rows, ROWS).withColumns({n: F.lit("mine") for n in ("k", "d", "depth", "h", "n", "t1", "n_bytes", "length", "parent_conv_id", "seg", "a", "b")})
    assert sorted((tuple(r) for r in prefix_trie.trie(wide).collect()), key=str) == by_hand(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_pieces_are_hashed_in_order(spark):
    rows = [(k, i, None if i == 3 else f"é{k}{i}") for k in (1, 2, None) for i in range(7)]
    random.Random(1).shuffle(rows)
    got = {r["k"]: r["sha256"] for r in digests.pieces_sha256(spark.createDataFrame(rows, "k long, i long, x string"), ["k"], "i", "x", "\n").collect()}
    assert got == {k: hashlib.sha256("\n".join(f"é{k}{i}" for i in range(7) if i != 3).encode()).hexdigest() for k in (1, 2, None)}


def test_query(spark):
    name = "op12_prefix_trie"
    assert differences(queries.QUERIES[name](spark, SF), database(SF), queries.ORACLES[name]) == ""
