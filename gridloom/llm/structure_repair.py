"""Repair of conversations by weighted CYK parsing of their rows.

The grammar is in Chomsky normal form. A non-terminal is what a span of rows becomes: nothing
(E), or an alternating sequence named by its first and last role (``ua``: user to assistant,
``ss``: one system turn, ``sa``: system to assistant), so that X -> Y Z where the last role of
Y may stand before the first of Z. A row becomes a terminal by Keep or Rerole and E by Delete;
inserted turns are terminals of an empty span, and a cell is closed under putting them at
either end. A cell holds the cheapest edits of each non-terminal and, at equal cost, the
ASCII-least letters of the edits; as edits of one span differ before one can end, least
parts make least wholes.

These non-terminals name every piece that a derivation can be cut into, so all splits of a
span give the same cell and one is tried: spans of one row are joined to spans of two, four
and so on. Blocks of a conversation's rows are parsed where they are, and only cells meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.digests import pieces_sha256
from gridloom.llm.store import stored
from gridloom.operators.ordering import running

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Roles that may follow each other, and what a whole conversation may be: ``(s?(ua)+)?``.
FOLLOWS = frozenset({"su", "ua", "au"})
WHOLE = ("E", "ua", "sa")
#: Rows in a block, bytes from which a block ends, and spans that a worker remembers.
BLOCK_ROWS, BLOCK_BYTES, REMEMBERED = 1024, 1 << 20, 100_000
SPACES = " \t\n\x0b\x0c\r"

Cell = dict[str, tuple[int, str]]


def concatenated(x: str, y: str) -> str | None:
    """The non-terminal of two spans side by side."""
    if x == "E" or y == "E":
        return y if x == "E" else x
    return x[0] + y[1] if x[1] + y[0] in FOLLOWS else None


_NAMES = ("E", "uu", "ua", "au", "aa", "ss", "su", "sa")
_RULES = {x: [(y, z) for y in _NAMES if (z := concatenated(x, y))] for x in _NAMES}


def closed(cell: Cell) -> Cell:
    """A cell with inserted turns at either end, as long as they make something cheaper."""
    waiting = list(cell)
    while waiting:
        x = waiting.pop()
        cost, audit = cell[x]
        for one in ("uu", "aa"):
            for z, new in ((concatenated(x, one), (cost + INSERT, audit + "I")), (concatenated(one, x), (cost + INSERT, "I" + audit))):
                if z and (z not in cell or new < cell[z]):
                    cell[z] = new
                    waiting.append(z)
    return cell


def leaf(kind: str) -> Cell:
    """The cell of one row: the initial of its role (x: another one), upper case if truncated, or - if it has to go."""
    cell: Cell = {"E": (DELETE, "D")}
    if kind != "-":
        role, more = kind.lower(), TRUNCATED if kind.isupper() else 0
        cell |= {2 * r: (REROLE + more, "R") for r in "ua"}
        if role in "sua":
            cell[2 * role] = (more, "K")
    return closed(cell)


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans side by side; closed if both are."""
    out: Cell = {}
    for x, (cost, audit) in left.items():
        for y, z in _RULES[x]:
            if y in right:
                c, a = right[y]
                best = out.get(z)
                if best is None or cost + c <= best[0]:
                    new = (cost + c, audit + a)
                    if best is None or new < best:
                        out[z] = new
    return out


_LEAVES = {k: leaf(k) for k in "suaxSUAX-"}
_spans: dict[str, Cell] = {}


def parsed(kinds: str) -> Cell:
    """The cell of rows, spans of growing length at a time; short spans are remembered."""
    cells = [(k, _LEAVES[k]) for k in kinds]
    while len(cells) > 1:
        pairs = []
        for i in range(0, len(cells) - 1, 2):
            text = cells[i][0] + cells[i + 1][0]
            cell = _spans.get(text)
            if cell is None:
                cell = joined(cells[i][1], cells[i + 1][1])
                if len(text) <= 64:
                    if len(_spans) >= REMEMBERED:
                        _spans.clear()
                    _spans[text] = cell
            pairs.append((text, cell))
        cells = pairs + cells[2 * len(pairs) :]
    return cells[0][1] if cells else {"E": (0, "")}


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[x] for x in WHOLE if x in cell)


def edits(audit: str, initials: str) -> list[tuple[str | None, str | None, str | None]]:
    """For each row the lines inserted before it, its role (null: deleted, empty: kept) and the lines inserted after the last."""
    out, before, last = [], [], None
    rows = iter(initials)
    for op in audit:
        role = "assistant" if last == "u" else "user"
        if op == "I":
            before.append(f"{role}:")
            last = role[0]
            continue
        own = next(rows)
        out.append(("\n".join(before) if before else None, {"D": None, "K": "", "R": role}[op], None))
        before = []
        if op != "D":
            last = own if op == "K" else role[0]
    if before and out:
        out[-1] = (*out[-1][:2], "\n".join(before))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text after the damage that the CRC-32 of ``conv_id:turn`` modulo 20 names, and ``copy`` (1: a repetition).

    0 drops the row, 1 empties the text, 2 takes its ``[.!?]`` away, 3 repeats the row and 4 makes
    the role user. Nulls are one space, also in ``conv``, the decimal conv_id.
    """
    conv, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "role", "text"))
    code = F.crc32(F.concat(conv, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    hit = conversations.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), code.alias("code")).where("code > 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with pos (from 1, by turn, nulls first; ties by role, then hash of the text), block, h1 and h2 (hashes of role and text)."""
    size = F.octet_length("role") + F.octet_length("text")
    hashed = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(31), "text", "role")})
    out = running(hashed, ["conv"], ["turn", "role", "h1", "h2", "copy"], {"pos": F.lit(1), "ends": size})
    return out.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK_ROWS) + F.floor((F.col("ends") - size) / BLOCK_BYTES)).drop("ends", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """conv, block, pos, turn, initial, fault (blank, duplicate, truncated or null) of placed rows; the first that holds counts."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    seen = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.left("role", F.lit(1))
    short = stored(rows.select("conv", "block", "pos", "turn", "h1", "h2", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), seen.alias("seen")), "faults")
    firsts = short.groupBy("conv", "h1", "h2").agg(F.min("pos").alias("first"))
    fault = F.when((F.col("first") < F.col("pos")) & F.coalesce(F.col("seen") != "blank", F.lit(True)), "duplicate").otherwise(F.col("seen"))
    return short.join(firsts, ["conv", "h1", "h2"]).select("conv", "block", "pos", "turn", "initial", fault.alias("fault"))


def _blocks(rows: DataFrame) -> DataFrame:
    """conv, block, initials, kinds: a letter for each row of a block."""
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    own = F.array_sort(F.collect_list(F.struct("pos", "initial", kind.alias("kind"))))
    line = lambda x: F.array_join(F.col(f"own.{x}"), "")
    return rows.groupBy("conv", "block").agg(own.alias("own")).select("conv", "block", line("initial").alias("initials"), line("kind").alias("kinds"))


_CELLS = "cells array<struct<name: string, cost: long, audit: string>>"


def _parsed_blocks(blocks: DataFrame) -> DataFrame:
    arrow = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("initials", pa.string()), ("cells", pa.list_(pa.struct([("name", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [[{"name": x, "cost": c, "audit": a} for x, (c, a) in parsed(k).items()] for k in b.column("kinds").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "block", "initials")), pa.array(cells, arrow.field("cells").type)], schema=arrow)

    return blocks.mapInArrow(run, f"conv string, block long, initials string, {_CELLS}")


def _solved(blocks: DataFrame) -> DataFrame:
    """conv, block, edits (of the block's rows in order) and, on a conversation's first block, cost, audit and illegal."""
    edit = pa.struct([("before", pa.string()), ("role", pa.string()), ("after", pa.string())])
    arrow = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("edits", pa.list_(edit)), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, parts in zip(b.column("conv").to_pylist(), b.column("parts").to_pylist(), strict=True):
                cells = [{c["name"]: (c["cost"], c["audit"]) for c in p["cells"]} for p in parts]
                while len(cells) > 1:
                    cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
                cost, audit = best(cells[0])
                initials = "".join(p["initials"] for p in parts)
                illegal = sum(x + y not in FOLLOWS for x, y in zip(initials, initials[1:]))
                done, at = edits(audit, initials), 0
                for k, p in enumerate(parts):
                    own = [dict(zip(("before", "role", "after"), e, strict=True)) for e in done[at : at + len(p["initials"])]]
                    at += len(own)
                    out.append({"conv": conv, "block": p["block"], "edits": own} | ({"cost": cost, "audit": audit, "illegal": illegal} if k == 0 else {}))
            yield pa.RecordBatch.from_pylist(out, arrow)

    whole = blocks.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "initials", "cells"))).alias("parts"))
    return whole.mapInArrow(run, "conv string, block long, edits array<struct<before: string, role: string, after: string>>, cost long, audit string, illegal long")


def _rendered(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """conv, block, piece: the repaired lines of a block, null if none is left."""
    own = rows.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("own"))

    def line(row, edit):
        kept = F.concat(F.when(edit["role"] == "", row["role"]).otherwise(edit["role"]), F.lit(":"), row["text"])
        return F.filter(F.array(edit["before"], kept, edit["after"]), lambda x: x.isNotNull())

    lines = F.flatten(F.zip_with("own", "edits", line))
    return own.join(solved.select("conv", "block", "edits"), ["conv", "block"]).select("conv", "block", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("piece"))


def repair(conversations: DataFrame) -> DataFrame:
    """Damage and repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id.

    Null conv_ids are one conversation. Rows of equal turn are taken by role, then by hash of the
    text; equal rows are duplicates of the first. A role without an initial, or with one other
    than s, u and a, can't be kept. Conversations without rows have zeros, an empty audit and
    the digest of the empty string; an empty table gives an empty one. A row holds a
    conversation's whole audit, one letter for an edit; texts move block by block.
    """
    ids = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    rows = placed(damaged(conversations))
    found = stored(faults(rows), "found")
    solved = stored(_solved(_parsed_blocks(_blocks(found))), "solved")
    digests = pieces_sha256(_rendered(rows, solved), ["conv"], "block", "piece", "\n")
    kinds = ("blank", "duplicate", "truncated")
    counts = found.groupBy("conv").agg(*(F.count_if(F.col("fault") == k).alias(k) for k in kinds))
    turns = found.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count("turn").alias("turns"))
    gaps = turns.select("conv", F.try_subtract(F.try_add(F.try_subtract("high", "low"), F.lit(1)), F.col("turns")).alias("gaps"))
    out = ids.join(gaps, "conv", "left").join(counts, "conv", "left").join(solved.where("audit IS NOT NULL").select("conv", "cost", "audit", "illegal"), "conv", "left").join(digests, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    name = F.when(F.col("conv") != " ", F.col("conv")).cast(conversations.schema["conv_id"].dataType).alias("conv_id")
    return out.select(name, *(zero(c) for c in ("gaps", *kinds, "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
