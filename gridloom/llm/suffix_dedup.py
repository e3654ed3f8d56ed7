"""Removal of long byte strings that occur more than once in the corpus.

A string of ``length`` bytes that starts anywhere else, in the same or another document,
is removed wherever it starts. The corpus is never one text in one place:

1.  Every window of ``length`` bytes is represented by an anchor in it, the (about a third
    as many) bytes with the smallest hash. Equal windows have equal anchors at equal places, so
    only anchors that occur twice can stand for repeated windows. Windows that share an
    anchor in one document are one context.
2.  Contexts of one anchor meet by a shuffle. Their texts after the anchor are parsed
    into phrases cut by content, and the suffixes of all phrases are sorted in linear time
    by Lyndon-prefix groups. Neighbours in that order tell how far contexts agree to the
    right of the anchor; hashes of the bytes before it tell the same to the left. Windows
    that agree with another on both sides are repeated.
3.  Anchors with more contexts than one task should hold are split: half of what a window
    has beside the anchor, on the side where it has more, joins the anchor's bytes, three
    times over, equal contexts are counted, and only different ones that still agree
    meet. If those are too many again,
    their windows are hashed one by one and counted by Spark.

Exact copies of a whole document are found by a hash of the text; one of them takes part.

Shorter strings can be counted beside the removed ones. A string that starts elsewhere has
only parts that do, so the longer ones are then sought in documents that share shorter ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import aside, restored, stored
from gridloom.llm.suffix_array import suffix_array
from gridloom.llm.text import mix, prefix_hash, slices, span_hash, spans_hash

LENGTH = 400
#: Bytes from which a repeated string counts as a passage in the query: under 4 for each word of a passage of over 50 words.
PASSAGE = 200
#: Contexts of one anchor, whole copies of documents aside, that one task takes together; anchors with more are split.
CROWD = 500
#: Bytes of contexts that are sorted together.
BATCH = 1 << 19
#: Windows whose anchors are found together (about 20 arrays of 8 bytes each), also inside one long document.
BLOCK = 1 << 17


def anchor_size(length: int) -> int:
    """Bytes of the anchor of windows of ``length`` bytes."""
    return length * 8 // 25


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    pad = -len(values) % width
    padded = np.concatenate([values, np.full(pad, values.max(), values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of all documents: document, hash of the anchor, its place, first window, number of windows.

    Places are counted from the beginning of ``data``. Documents of fewer than ``length`` bytes have none.
    Windows are taken ``block`` at a time; the result does not depend on that.
    """
    size = anchor_size(length)
    bits = np.uint64((block + length).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    docs, hashes, places, firsts = ([np.zeros(0, t)] for t in (np.int64, np.uint64, np.int64, np.int64))
    counts = [np.zeros(0, np.int64)]
    for begin in range(0, len(data) - length + 1, block):
        end = min(begin + block, len(data) - length + 1)
        piece = data[begin : end + length - 1]
        at = np.arange(len(piece) - size + 1)
        each = span_hash(prefix_hash(piece), at, at + size, 40)
        ranked = ((each >> bits) << bits) | at.astype(np.uint64)
        chosen = (sliding_least(ranked, length - size + 1) & low).astype(np.int64)
        window = np.arange(begin, end)
        doc = np.searchsorted(offsets, window, "right") - 1
        fine = window + length <= offsets[np.minimum(doc + 1, len(offsets) - 1)]
        window, doc, chosen = window[fine], doc[fine], chosen[fine]
        if not len(window):
            continue
        new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])]))
        docs.append(doc[new])
        hashes.append(each[chosen[new]])
        places.append(chosen[new] + begin)
        firsts.append(window[new])
        counts.append(np.diff(np.append(new, len(window))))
    doc, ahash, place, first, count = (np.concatenate(x) for x in (docs, hashes, places, firsts, counts))
    if not len(doc):
        return doc, ahash, place, first, count
    # A context that two blocks share is one.
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[new], ahash[new], place[new], first[new], np.add.reduceat(count, new)


def keyed(docs: DataFrame) -> DataFrame:
    """Two hashes of text and id name a row; rows that share both are equal in these."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(7), text, "doc_id"), "n_bytes": F.octet_length(text).cast("long"), "h2": F.xxhash64(F.lit(9), text)})


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """k1, k2, ahash, pos, first, wins: every context of every document, places counted in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches):
            doc, ahash, pos, first, wins = anchors(t.data, t.offsets, length)
            at = pa.array(doc)
            begin = t.offsets[doc]
            ints = [pa.array((x).astype(np.int32)) for x in (pos - begin, first - begin, wins)]
            yield pa.RecordBatch.from_arrays([t.batch.column("k1").take(at), t.batch.column("k2").take(at), pa.array(ahash.view(np.int64)), *ints], ["k1", "k2", "ahash", "pos", "first", "wins"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, ahash long, pos int, first int, wins int")


def halvings(length: int = LENGTH, levels: int = 3) -> np.ndarray:
    """Runs of window offsets (bytes before the anchor) that grow the anchor alike: lowest, highest, bytes added on the left, on the right.

    Equal windows have equal offsets, so they are in one run and agree in the grown anchor.
    """
    rows: list[list[int]] = []
    anchor = anchor_size(length)
    for o in range(length - anchor + 1):
        left = right = 0
        for _ in range(levels):
            half = -(-(length - anchor - left - right) // 2)
            if length - anchor - o - right >= half:
                right += half
            else:
                left += half
        if rows and rows[-1][2:] == [left, right]:
            rows[-1][1] = o
        else:
            rows.append([o, o, left, right])
    return np.array(rows)


def split_contexts(data: np.ndarray, begin: np.ndarray, pos: np.ndarray, first: np.ndarray, wins: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Contexts cut by the runs of their windows' offsets: the context each is from, hash of the grown anchor, first window, windows."""
    runs = halvings(length)
    high = np.minimum((pos - first)[:, None], runs[None, :, 1])
    low = np.maximum((pos - first - wins + 1)[:, None], runs[None, :, 0])
    of, run = np.nonzero(low <= high)
    at = begin[of] + pos[of]
    grown = spans_hash(data, at - runs[run, 2], at + anchor_size(length) + runs[run, 3], 47)
    with np.errstate(over="ignore"):
        grown = mix(grown + runs[run, 0].astype(np.uint64), 48)
    return of, grown, pos[of] - high[of, run], (high - low + 1)[of, run]


def repeated_windows(parts: list[bytes], group: np.ndarray, pos: np.ndarray, wins: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For contexts sorted by group: which of each one's windows equal a window of another context of its group.

    A context's bytes begin at its first window; ``pos`` is the anchor's place in them.
    """
    n, anchor = len(parts), anchor_size(length)
    out = [np.zeros(w, bool) for w in wins.tolist()]
    # Contexts that are equal throughout stand for each other.
    seen: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(group.tolist(), pos.tolist(), parts, strict=True)):
        seen.setdefault(key, []).append(i)
    copies = list(seen.values())
    for own in copies:
        if len(own) > 1:
            for i in own:
                out[i][:] = True
    heads = np.array([own[0] for own in copies])
    of_group = group[heads]
    alone = np.ones(len(heads), bool)
    if len(heads) > 1:
        same = of_group[1:] == of_group[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
    heads, copies = heads[~alone], [own for own, a in zip(copies, alone.tolist(), strict=True) if not a]
    if not len(heads):
        return out

    # Phrases after the anchor: the anchor, then pieces that end where the last bytes' hash says so.
    data = np.frombuffer(b"".join(parts[i] for i in heads), np.uint8)
    ends = np.cumsum([len(parts[i]) for i in heads])
    begin = ends - np.array([len(parts[i]) for i in heads])
    place = begin + pos[heads]
    prefix = prefix_hash(data)
    spot = np.arange(8, len(data) + 1)
    cuts = spot[(span_hash(prefix, spot - 8, spot, 41) & np.uint64(31)) == 0]
    lo, hi = np.searchsorted(cuts, place + anchor, "right"), np.searchsorted(cuts, ends, "left")
    raw = data.tobytes()
    phrases: list[bytes] = []
    bounds = [0]
    for a, e, x, y in zip(place.tolist(), ends.tolist(), lo.tolist(), hi.tolist(), strict=True):
        last = a
        for c in (a + anchor, *cuts[x:y].tolist(), e):
            if c > last:
                phrases.append(raw[last:c])
                last = c
        bounds.append(len(phrases))
    rank = {p: k for k, p in enumerate(sorted(set(phrases)))}
    m = len(heads)
    symbols: list[int] = []
    whole = []
    for k in range(m):
        whole.append(len(symbols))
        symbols.extend(rank[p] + m for p in phrases[bounds[k] : bounds[k + 1]])
        symbols.append(k)
    owner = {s: k for k, s in enumerate(whole)}
    order = np.array([owner[s] for s in suffix_array(symbols) if s in owner])
    # By group first: two groups can only mix if their anchors have one text and two hashes, or the reverse.
    order = order[np.argsort(group[heads[order]], kind="stable")]

    # How far neighbours in the sorted order agree after the anchor.
    reach = min(length, int((ends - place).max()))
    cols = np.minimum(place[order][:, None] + np.arange(reach)[None, :], len(data) - 1)
    body = data[cols].astype(np.int16)
    body[np.arange(reach)[None, :] >= (ends - place)[order][:, None]] = -1
    agree = (body[1:] == body[:-1]) & (body[1:] >= 0)
    common = np.where(agree.all(axis=1), reach, np.argmin(agree, axis=1)) if m > 1 else np.zeros(0, np.int64)
    common[group[heads[order]][1:] != group[heads[order]][:-1]] = -1
    back = pos[heads][order]  # the first window begins that many bytes before the anchor, the last one wins - 1 fewer
    win = wins[heads][order]
    row = np.repeat(np.arange(m), win)
    left = np.repeat(back, win) - (np.arange(len(row)) - np.repeat(np.cumsum(win) - win, win))
    # The run of neighbours that agree for the window's whole part after the anchor.
    lefts, where = np.unique(left, return_inverse=True)
    breaks = np.zeros((m, len(lefts)), np.int32)
    breaks[1:] = np.cumsum(common[:, None] < (length - lefts)[None, :], axis=0)
    run = breaks[row, where]
    a = place[order][row]
    before = span_hash(prefix, a - left, a, 42)
    with np.errstate(over="ignore"):
        key = mix(before + mix(run.astype(np.uint64) * np.uint64(1 << 20) + left.astype(np.uint64), 43), 44)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    stop = np.cumsum(win)
    for r, k in enumerate(order.tolist()):
        hit = again[stop[r] - win[r] : stop[r]]
        for i in copies[k]:
            out[i] |= hit
    return out


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of true values begins and ends."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def resolve(batches: Iterator[pa.RecordBatch], length: int, batch: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans (k1, k2, s, e) of the contexts of a partition sorted by anchor; no anchor is split over two calls."""
    rows: list[tuple] = []
    held = 0

    def flush(part: list[tuple]) -> pa.RecordBatch:
        group = np.array([r[0] for r in part], np.int64)
        pos, wins = np.array([r[4] for r in part]), np.array([r[5] for r in part])
        k1, k2, s, e = [], [], [], []
        for r, hit in zip(part, repeated_windows([r[6] for r in part], group, pos, wins, length), strict=True):
            if hit.any():
                for x, y in zip(*(v.tolist() for v in _runs(hit)), strict=True):
                    k1.append(r[1])
                    k2.append(r[2])
                    s.append(r[3] + x)
                    e.append(r[3] + y - 1 + length)
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["k1", "k2", "s", "e"])

    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("ahash", "k1", "k2", "first", "pos", "wins", "body")), strict=True):
            if held >= batch and rows and rows[-1][0] != r[0]:
                yield flush(rows)
                rows, held = [], 0
            rows.append(r)
            held += len(r[6])
    if rows:
        yield flush(rows)


def whole_copies(named: DataFrame, length: int) -> DataFrame:
    """k1, k2, n_bytes, rep of rows whose text of at least ``length`` bytes occurs again; ``rep`` marks the first of each text."""
    if length < 100:
        raise ValueError("length must be at least 100 bytes")
    long = named.where(F.col("n_bytes") >= length)
    twice = stored(long.groupBy("k1", "h2").agg(F.count("*").alias("n"), F.min("k2").alias("rep")).where("n > 1").select("k1", "h2", "rep"), "twice")
    return stored(long.select("k1", "k2", "h2", "n_bytes").join(twice, ["k1", "h2"]).select("k1", "k2", "n_bytes", (F.col("k2") == F.col("rep")).alias("rep")).distinct(), "copies")


def repeated_spans(long: DataFrame, length: int, crowd: int, spare: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (k1, k2, text) that share an anchor with another, and the repeated spans (k1, k2, spans) among them.

    The rows in ``spare`` take no part.
    """
    # Copies beyond the first take no part; a document is equal to its first copy in every window.
    found = stored(contexts(long, length), "contexts")
    often = stored(found.groupBy("ahash").agg(F.count("*").alias("n")).where("n > 1").select("ahash"), "often")
    mine = found.join(often, "ahash")
    mine = stored(mine if spare is None else mine.join(spare, ["k1", "k2"], "left_anti"), "mine")

    def per_document(rows: DataFrame) -> DataFrame:
        """The contexts of each document whose anchor others have too, with whether it is crowded."""
        groups = stored(rows.groupBy("ahash").agg(F.count("*").alias("n")).where("n > 1"), "groups")
        both = rows.join(groups, "ahash").select("k1", "k2", F.struct("ahash", "pos", "first", "wins", (F.col("n") > crowd).alias("hot")).alias("c"))
        return both.groupBy("k1", "k2").agg(F.collect_list("c").alias("cs"))

    work = stored(long.select("k1", "k2", "text").join(stored(per_document(mine), "perdoc"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]), "work")

    def parts(t, hot: bool):
        lists = t.batch.column("cs")
        flat = lists.flatten()
        doc = np.repeat(np.arange(len(t)), pc.list_value_length(lists).to_numpy())
        found = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("ahash", "pos", "first", "wins", "hot")]
        use = np.flatnonzero(found[-1] == hot)
        return doc[use], *(x[use].astype(np.int64) for x in found[:-1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches):
            doc, ahash, pos, first, wins = parts(t, False)
            who, raw = pa.array(doc), memoryview(t.data)
            body = [bytes(raw[x : x + w - 1 + length]) for x, w in zip((t.offsets[doc] + first).tolist(), wins.tolist(), strict=True)]
            ints = [pa.array(x.astype(np.int32)) for x in (first, pos - first, wins)]
            yield pa.RecordBatch.from_arrays([pa.array(ahash), t.batch.column("k1").take(who), t.batch.column("k2").take(who), *ints, pa.array(body, pa.binary())], ["ahash", "k1", "k2", "first", "pos", "wins", "body"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches):
            doc, _, pos, first, wins = parts(t, True)
            of, grown, start, count = split_contexts(t.data, t.offsets[doc], pos, first, wins, length)
            who, s = pa.array(doc[of]), t.offsets[doc[of]] + start
            with np.errstate(over="ignore"):
                whole = mix(spans_hash(t.data, s, s + count - 1 + length, 49) + (pos[of] - start).astype(np.uint64), 50)
            yield pa.RecordBatch.from_arrays([t.batch.column("k1").take(who), t.batch.column("k2").take(who), pa.array(grown.view(np.int64)), pa.array(whole.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (pos[of], start, count))], ["k1", "k2", "ahash", "whole", "pos", "first", "wins"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches):
            doc, _, _, first, wins = parts(t, True)
            row = np.repeat(np.arange(len(doc)), wins)
            start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(wins) - wins, wins)
            s, who = t.offsets[doc[row]] + start, pa.array(doc[row])
            hashes = [pa.array(spans_hash(t.data, s, s + length, seed).view(np.int64)) for seed in (45, 46)]
            yield pa.RecordBatch.from_arrays([t.batch.column("k1").take(who), t.batch.column("k2").take(who), *hashes, pa.array(start.astype(np.int32))], ["k1", "k2", "w1", "w2", "s"])

    # Crowded anchors meet again by the bytes round them.
    crowded = work.where(F.exists("cs", lambda c: c["hot"])).select("k1", "k2", "text", F.filter("cs", lambda c: c["hot"]).alias("cs"))
    again = stored(crowded.mapInArrow(grow, "k1 long, k2 long, ahash long, whole long, pos int, first int, wins int"), "grown")
    # Of contexts that are equal throughout one goes on; all their windows are repeated.
    name = F.xxhash64("k1", "k2", "first")
    twins = stored(again.groupBy("ahash", "whole").agg(F.count("*").alias("n"), F.min(name).alias("one")).where("n > 1").select("ahash", "whole", "one"), "twins")
    paired = again.join(twins, ["ahash", "whole"], "left")
    equal = paired.where("one IS NOT NULL").select("k1", "k2", F.col("first").alias("s"), (F.col("first") + F.col("wins") - 1 + F.lit(length)).alias("e"))
    more = stored(per_document(paired.where(F.col("one").isNull() | (F.col("one") == name)).drop("whole", "one")), "perdoc")
    close = stored(crowded.select("k1", "k2", "text").join(more, ["k1", "k2"]), "close")

    shape = "ahash long, k1 long, k2 long, first int, pos int, wins int, body binary"
    met = work.mapInArrow(cut, shape).union(close.mapInArrow(cut, shape)).repartition("ahash").sortWithinPartitions("ahash", "k1", "k2", "first")
    spans = met.mapInArrow(lambda b: resolve(b, length, BATCH), "k1 long, k2 long, s int, e int")
    each = stored(close.where(F.exists("cs", lambda c: c["hot"])).mapInArrow(single, "k1 long, k2 long, w1 long, w2 long, s int"), "windows")
    # A whole copy that stayed out is one more place where its windows start.
    double = stored(each.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2"), "double")
    lone = each.join(double, ["w1", "w2"], "left_semi").select("k1", "k2", "s", (F.col("s") + F.lit(length)).alias("e"))
    spans = spans.union(lone).union(equal).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return work.select("k1", "k2", "text"), stored(spans, "spans")


def repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the corpus repeats: the named rows, the keys of whole copies, and (k1, k2, text, spans) of other documents with repeats."""
    named = keyed(docs)
    copies = whole_copies(named, length)
    work, spans = repeated_spans(named.where(F.col("n_bytes") >= length), length, crowd, copies.where("NOT rep").select("k1", "k2"))
    rest = work.join(spans, ["k1", "k2"]).join(copies.select("k1", "k2"), ["k1", "k2"], "left_anti")
    return named, copies, rest


def nested_repeats(docs: DataFrame, length: int, passage: int, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``repeats`` gives for ``length``, and (k1, k2, n_passage_bytes) of rows with repeated strings of the shorter ``passage`` bytes."""
    if passage > length:
        raise ValueError("passage must not be longer than length")
    named = keyed(docs)
    copies = whole_copies(named, passage)
    work, spans = repeated_spans(named.where(F.col("n_bytes") >= passage), passage, crowd, copies.where("NOT rep").select("k1", "k2"))
    own = covered(spans).join(copies.select("k1", "k2"), ["k1", "k2"], "left_anti")
    # Every part of a repeated string is repeated, so all documents with one of length bytes are among those with shared anchors.
    work, spans = repeated_spans(work.where(F.octet_length("text") >= length), length, crowd)
    copies_long = copies.where(F.col("n_bytes") >= length)
    rest = work.join(spans, ["k1", "k2"]).join(copies_long.select("k1", "k2"), ["k1", "k2"], "left_anti")
    return named, copies_long, rest, own.union(copies.select("k1", "k2", F.col("n_bytes").alias("n_passage_bytes")))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that overlapping or touching spans cover."""
    order = np.argsort(start, kind="stable")
    start, far = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > far[:-1]]))
    return start[new], far[np.append(new[1:] - 1, len(far) - 1)]


def covered(spans: DataFrame) -> DataFrame:
    """k1, k2, n_passage_bytes: bytes that a document's spans cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = []
            lists = b.column("spans")
            cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            s, e = (lists.flatten().field(c).to_numpy().astype(np.int64) for c in ("s", "e"))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                start, end = merged(s[x:y], e[x:y])
                n.append(int((end - start).sum()))
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(n, pa.int64())], ["k1", "k2", "n_passage_bytes"])

    return spans.mapInArrow(run, "k1 long, k2 long, n_passage_bytes long")


def whole_characters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs widened to all bytes of the UTF-8 characters that they touch."""
    start, end = start.copy(), end.copy()
    for _ in range(3):
        start -= (start > 0) & ((data[np.minimum(start, len(data) - 1)] & 0xC0) == 0x80)
        end += (end < len(data)) & ((data[np.minimum(end, len(data) - 1)] & 0xC0) == 0x80)
    return merged(start, end)


def cleaned(rest: DataFrame, characters: bool = False) -> DataFrame:
    """k1, k2, n_removed, n_spans, kept (bytes) of documents with their repeated spans; with ``characters`` those that are only partly left go, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches):
            removed, runs, kept = [], [], []
            lists = t.batch.column("spans")
            cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            s, e = (lists.flatten().field(c).to_numpy().astype(np.int64) for c in ("s", "e"))
            for i in range(len(t)):
                start, end = merged(s[cuts[i] : cuts[i + 1]], e[cuts[i] : cuts[i + 1]])
                removed.append(int((end - start).sum()))
                runs.append(len(start))
                data = t.data[t.offsets[i] : t.offsets[i + 1]]
                if characters:
                    start, end = whole_characters(data, start, end)
                kept.append(b"".join(data[x:y].tobytes() for x, y in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([t.batch.column("k1"), t.batch.column("k2"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["k1", "k2", "n_removed", "n_spans", "kept"])

    return rest.mapInArrow(run, "k1 long, k2 long, n_removed long, n_spans long, kept binary")


def _joined(named: DataFrame, copies: DataFrame, parts: DataFrame) -> DataFrame:
    whole = copies.select("k1", "k2", F.lit(True).alias("whole"))
    out = named.join(parts, ["k1", "k2"], "left").join(whole, ["k1", "k2"], "left")
    gone = F.coalesce("whole", F.lit(False))
    return out.withColumns({"n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long"), "n_spans": F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long"), "whole": gone})


def digest(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with ``passage`` n_passage_bytes.

    A byte is removed if a string of ``length`` bytes that covers it also starts
    elsewhere; strings are judged on the input and don't cross documents. Null and empty
    texts have no bytes; documents under ``length`` bytes keep all of theirs. Repeated
    rows repeat each other's text and lose it all from ``length`` bytes on. Null ids
    are ids like any other. Other columns are left out.

    ``n_passage_bytes`` counts the bytes covered by strings of ``passage`` bytes that also
    start elsewhere. They are only counted, and change none of the other columns.
    """
    docs = docs.select("doc_id", "text")
    if passage is None:
        named, copies, rest = repeats(docs, length, crowd)
    else:
        named, copies, rest, short = nested_repeats(docs, length, passage, crowd)
    parts = cleaned(rest).select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("part_sha"))
    if passage is not None:
        parts = short.join(stored(parts, "parts"), ["k1", "k2"], "left")
    base = named.select("doc_id", "k1", "k2", "n_bytes", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("all_sha"))
    out = _joined(base, copies, stored(parts, "parts"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    more = [] if passage is None else [F.coalesce("n_passage_bytes", F.lit(0)).cast("long").alias("n_passage_bytes")]
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.when(F.col("whole"), empty).otherwise(F.coalesce("part_sha", "all_sha")).alias("kept_sha256"), *more)


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """``docs`` with ``text`` less its repeated bytes, every other column as it was, whatever its name.

    A character of several bytes that loses some of them loses all of them, so that the
    text stays valid. Null texts stay null; short ones, empty tables, null ids and
    repeated rows are treated as in ``digest``.
    """
    named, copies, rest = repeats(aside(docs), length, crowd)
    parts = cleaned(rest, characters=True).select("k1", "k2", "n_removed", "n_spans", F.decode(F.col("kept"), "UTF-8").alias("part"))
    out = _joined(named, copies, stored(parts, "parts"))
    text = F.when(F.col("whole"), F.lit("")).when(F.col("n_removed") > 0, F.col("part")).otherwise(F.col("text"))
    return restored(out, docs.columns, text=text)
