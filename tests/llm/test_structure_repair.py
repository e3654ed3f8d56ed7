"""Repair of conversations beside brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from heapq import heappop, heappush

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import queries, structure_repair
from gridloom.llm.store import table
from gridloom.llm.structure_repair import best, edits, joined, parsed

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(kinds):
    """The least (cost, audit), by trying edits in order of cost over all states (rows taken, last role)."""
    waiting, done = [(0, "", 0, "")], set()
    while waiting:
        cost, audit, i, last = heappop(waiting)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(kinds) and last in ("", "a"):
            return cost, audit
        go = lambda c, a, j, r: heappush(waiting, (cost + c, audit + a, j, r))
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        go(2, "I", i, after)
        if i < len(kinds):
            k, more = kinds[i], int(kinds[i].isupper())
            go(3, "D", i + 1, last)
            if k != "-":
                go(2 + more, "R", i + 1, after)
                if k.lower() == after or (k.lower() == "s" and last == ""):
                    go(more, "K", i + 1, k.lower())
    raise AssertionError


def by_hand(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c]
        r, x = (" " if v is None else v for v in (r, x))
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code == 0:
            continue
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        own[c] += [(t, "user" if code == 4 else r, x)] * (2 if code == 3 else 1)
    out = []
    for c, v in own.items():
        v.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1]))
        turns, seen, kinds, counts = {t for t, _, _ in v if t is not None}, set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, r, x in v:
            solid, initial = SOLID.findall(x), r[:1] if r[:1] in ("s", "u", "a") else "x"
            fault = "blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((r, x))
            if fault:
                counts[fault] += 1
            kinds += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = cheapest(kinds)
        lines, at, last = [], 0, ""
        for op in audit:
            role = "assistant" if last == "u" else "user"
            if op == "I":
                lines.append(f"{role}:")
            else:
                role = v[at][1] if op == "K" else role
                if op != "D":
                    lines.append(f"{role}:{v[at][2]}")
                at += 1
            last = last if op == "D" else role[0]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in structure_repair.repair(df).collect()), key=str)


@settings(max_examples=1500, deadline=None)
@given(st.text("suaxSUAX-", max_size=14))
def test_least_edits(kinds):
    assert best(parsed(kinds)) == cheapest(kinds)


@settings(max_examples=300, deadline=None)
@given(st.text("suaxSUAX-", max_size=12), st.integers(0, 12))
def test_every_split_gives_the_same_cell(kinds, at):
    left, right = kinds[:at], kinds[at:]
    if left and right:
        assert joined(parsed(left), parsed(right)) == parsed(kinds)


@settings(max_examples=300, deadline=None)
@given(st.text("suaxSUAX-", min_size=1, max_size=10))
def test_edits_make_a_legal_conversation(kinds):
    _, audit = best(parsed(kinds))
    roles = []
    initials = kinds.replace("-", "x").lower()
    for (before, role, after), own in zip(edits(audit, initials), initials, strict=True):
        roles += [x[0] for x in (before or "").split()] + ([] if role is None else [own if role == "" else role[0]]) + [x[0] for x in (after or "").split()]
    assert re.fullmatch("(s?(ua)+)?", "".join(roles))


def conversations(seed, n=40, turns=12):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool"]), rng.choice(["Well.", "what", "", " \t", "Yes! ", "one. two", "same.", f"{c}{t}?"])) for c in range(n) for t in rng.sample(range(turns + 3), rng.randint(1, turns))]


@pytest.mark.parametrize("seed, rows, size", [(1, 1024, 1 << 20), (2, 3, 1 << 20), (3, 1024, 20)])
def test_by_hand(spark, monkeypatch, seed, rows, size):
    monkeypatch.setattr(structure_repair, "BLOCK_ROWS", rows)
    monkeypatch.setattr(structure_repair, "BLOCK_BYTES", size)
    x = conversations(seed)
    random.Random(seed).shuffle(x)
    assert found(spark.createDataFrame(x, ROWS)) == by_hand(x)


def test_odd_rows(spark):
    x = [(1, None, None, None), (1, 0, "", "x."), (2, 3, "user", "a."), (2, 3, "user", "a."), (None, 1, "user", "b."), (None, None, "assistant", "c"), (3, 1, "user", "long. " * 50_000 + "."), (3, 2, "assistant", "é" * 70_000), (4, -(2**63), "user", "q."), (4, 2**63 - 1, "assistant", "q.")]
    x += [(50 + c, t, "user" if t % 2 else "assistant", f"{t}.") for c in range(3) for t in range(200 * c)]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    x.append((dropped, 0, "user", "gone"))
    got, want = found(spark.createDataFrame(x, ROWS)), by_hand([r for r in x if r[0] != 4])
    assert [r for r in got if r[0] != 4] == want
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    wide = spark.createDataFrame(x, ROWS).withColumns({n: F.lit("mine") for n in ("conv", "code", "copy", "pos", "block", "h1", "initial", "fault", "seen", "piece", "cost", "sha256")})
    assert found(wide) == got
    assert found(spark.createDataFrame([], ROWS)) == []


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_structure_repair"](spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows)
