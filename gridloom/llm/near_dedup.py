"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Documents are sequences of five-word shingles. An Order MinHash sketch takes, for each
of several hash functions, the few smallest occurrence-labelled shingles and keeps them
in the order of the text, so that two texts meet in a sketch if they share those
shingles in that order. Pairs that meet are verified by aligning their shingle
sequences inside the band that the wanted similarity allows.

Only different texts are compared: exact copies are one class from the start. Within
the documents that share a sketch each is first compared with the smallest, then, only
where components still differ, with the others, so a large group of copies costs one
comparison a member.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.store import aside, restored, stored
from gridloom.llm.text import Texts, mix, owners, slices, window_hashes, word_hashes

WORDS, SIMILARITY = 5, 0.8
#: Shingles in a sketch, and sketches: a pair at similarity 0.8 meets in none with probability (1 - 0.8**5)**32, under 1 in 300,000.
TAKEN, SKETCHES = 5, 32
#: Texts of fewer shingles meet exactly: by every subsequence with up to a fifth of the shingles left out.
SHORT = 15
#: Matches for each shingle up to which they are listed, and shingles of a block of texts that are compared at once.
MATCHES, BLOCK_SHINGLES = 16, 1 << 22
_MULTIPLIERS = mix(np.arange(SKETCHES, dtype=np.uint64), 91) | np.uint64(1)
_SHIFTS = mix(np.arange(SKETCHES, dtype=np.uint64), 92)


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and shingle hashes of all documents, each with the number of a document's first."""
    hashes, first = word_hashes(t)
    windows, begin = window_hashes(hashes, first, WORDS)
    return hashes, first, windows, begin


def labelled(windows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Shingles told apart by how often the same one came before in its document."""
    if not len(windows):
        return windows
    with np.errstate(over="ignore"):
        own = mix(windows + mix(owners(begin).astype(np.uint64), 5))
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        nth = np.empty(len(own), np.uint64)
        nth[order] = (np.arange(len(own)) - start).astype(np.uint64)
        return np.where(nth > 0, mix(windows + nth * np.uint64(0x9E3779B97F4A7C15), 6), windows)


def _chain(parts: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """One hash for each row of parts, which depends on their order."""
    with np.errstate(over="ignore"):
        out = np.zeros(parts.shape[:-1], np.uint64) + seed
        for k in range(parts.shape[-1]):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[..., k], 7)
        return out


def sketch(labels: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """For each hash function the TAKEN smallest shingles in text order: (SKETCHES, TAKEN)."""
    n = len(labels)
    width = max(1, min(SKETCHES, (block * SKETCHES) // max(n, 1)))
    out = np.empty((SKETCHES, TAKEN), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, SKETCHES, width):
            values = labels[None, :] * _MULTIPLIERS[k : k + width, None] + _SHIFTS[k : k + width, None]
            if n > TAKEN:
                at = np.sort(np.argpartition(values, TAKEN - 1, axis=1)[:, :TAKEN], axis=1)
            else:
                at = np.tile(np.arange(TAKEN), (len(values), 1))
            out[k : k + width] = labels[at]
    return out


def keys_of(t: Texts) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Digests (two longs) of the word sequences, the keys a document meets others by, and its numbers of words and shingles."""
    hashes, first, windows, begin = shingles(t)
    labels = labelled(windows, begin)
    sizes = np.diff(begin)
    long = np.flatnonzero(sizes >= TAKEN)
    chosen = np.empty((len(long), SKETCHES, TAKEN), np.uint64)
    for row, i in enumerate(long):
        chosen[row] = sketch(labels[begin[i] : begin[i + 1]])
    met = _chain(chosen, _SHIFTS[None, :])
    keys: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(t)
    for row, i in enumerate(long):
        keys[i] = met[row]
    for i in np.flatnonzero((sizes > 0) & (sizes < SHORT)):
        own, n = windows[begin[i] : begin[i + 1]], int(sizes[i])
        parts = [keys[i]]
        for out in range(n // 5 + 1):
            at = np.array(list(combinations(range(n), n - out)))
            parts.append(_chain(own[at], 11))
        keys[i] = np.unique(np.concatenate(parts))
    digest = np.zeros((len(t), 2), np.uint64)
    if len(hashes):
        with np.errstate(over="ignore"):
            place = (np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
            for k in range(2):
                each = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + place * np.uint64(0xD1342543DE82EF95), 20 + k))])
                digest[:, k] = mix(each[first[1:]] - each[first[:-1]] + np.diff(first).astype(np.uint64), 30 + k)
    return digest, keys, np.diff(first), sizes


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, d1, d2 (a digest of the words, null for a text without any), n (shingles), keys."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches):
            digest, keys, n_words, sizes = keys_of(t)
            blank = n_words == 0
            d = [pa.array(digest[:, k].view(np.int64), mask=blank) for k in range(2)]
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([t.batch.column("doc_id"), *d, pa.array(sizes.astype(np.int32)), lists], ["doc_id", "d1", "d2", "n", "keys"])

    return kept.mapInArrow(run, "doc_id long, d1 long, d2 long, n int, keys array<long>")


def aligned(a: np.ndarray, b: np.ndarray, least: int, band: int) -> int:
    """The longest common subsequence of two shingle sequences inside a diagonal band, or less than ``least`` if it is shorter.

    A pair that shares ``least`` shingles in order leaves at most ``band`` unmatched, so its
    alignment stays that near the diagonal and no match outside the band is looked at.
    Where matches are few, as in most texts, the longest rising sequence of their columns is the
    alignment; else it runs row by row with one bit for each column of the band. Memory
    follows the lengths in the one case and, with few different shingles, the band in the other.
    """
    n = min(len(a), len(b))
    if n < least:
        return 0
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    common = head + tail
    if not len(a) or not len(b) or common >= least and min(len(a), len(b)) == 0:
        return common
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if common + int(np.minimum(ca[ia], cb[ib]).sum()) < least:
        return 0
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    first, times = np.searchsorted(ranked, a), np.searchsorted(ranked, a, side="right")
    times -= first
    if int(times.sum()) > MATCHES * (len(a) + len(b)):
        return common + _banded(a, b, band)
    # Matches inside the band by row, each row's from right to left: rising columns are an alignment.
    i = np.repeat(np.arange(len(a)), times)
    last = np.cumsum(times)
    j = order[np.repeat(first + last, times) - 1 - np.arange(len(i))]
    tails: list[int] = []
    for x in j[np.abs(i - j) <= band].tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return common + len(tails)


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The same for sequences that repeat themselves, row by row with one bit for each column of the band."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        places.setdefault(x, []).append(j)
    used = dict.fromkeys(places, 0)
    masks: dict[int, tuple[int, int]] = {}  # of items seen: their columns from some column on
    low, high = 0, min(band + 1, len(b))
    row, common = (1 << high) - 1, 0
    for i, x in enumerate(a.tolist()):
        if i > band and low < len(b):
            common += 1 - (row & 1)
            row >>= 1
            low += 1
        if i and high < len(b):
            row |= 1 << (high - low)
            high += 1
        own = places.get(x)
        if not own:
            continue
        mask, since = masks.get(x, (0, low))
        mask >>= low - since
        at = used[x]
        while at < len(own) and own[at] < high:
            if own[at] >= low:
                mask |= 1 << (own[at] - low)
            at += 1
        used[x] = at
        masks[x] = (mask, low)
        if mask:
            up = row & mask
            row = ((row + up) | (row - up)) & ((1 << (high - low)) - 1)
    return common + (high - low) - row.bit_count()


def least_common(na: int, nb: int, similarity: float = SIMILARITY) -> int:
    """The common shingles that sequences of these lengths need: c / (na + nb - c) >= similarity."""
    return int(np.ceil(similarity * (na + nb) / (1 + similarity) - 1e-9))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose aligned shingles reach the similarity. ``texts``: doc_id, text of all their documents.

    The texts come to the pairs by joins, so a document in many pairs is spread by Spark's
    splitting of hot keys, and no task holds more than a batch of pairs.
    """
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_sequences(batch, c) for c in ("ta", "tb"))
            good = []
            for a, b in zip(left, right, strict=True):
                least = least_common(len(a), len(b), similarity)
                good.append(bool(least) and aligned(a, b, least, len(a) + len(b) - 2 * least) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _sequences(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    for t in slices([batch], column):
        _, _, windows, begin = shingles(t)
        for i in range(len(t)):
            yield windows[begin[i] : begin[i + 1]]


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id of every row: documents linked by near-duplicate pairs, directly or not, are one class.

    Two documents are linked if their words are the same, or if c five-word shingles
    in common order make c / (na + nb - c) at least ``similarity`` (na, nb: their
    numbers of shingles, repeated ones counted as often as they occur). The class is
    named by its smallest doc_id. White space is not compared; case and signs are.

    Null, empty and wordless texts are alone in their class. Texts of one to four words
    have no shingle and are linked to equal ones only. Rows with null id get the class
    of an equal text, or null. Rows that share an id are in one class if their texts are
    linked to each other. Other columns are left out; an empty table gives an empty one.
    """
    found = stored(signatures(docs), "signatures")
    exact = stored(found.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("keys").alias("keys")), "exact")
    keyed = exact.where("rep IS NOT NULL").select("rep", F.col("n").cast("long").alias("n"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("key", "pivot")
    members = stored(keyed.join(stored(shared, "shared"), "key"), "members")

    met = members.select("rep").distinct()
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(met, F.col("doc_id") == F.col("rep"), "left_semi"), "texts")

    stars = members.where("pivot < rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    firsts = stored(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "firsts")
    links = stored(verified(firsts, texts, similarity), "links")
    roots = stored(components(links), "roots")
    others = stored(apart(stars.join(firsts, ["a", "b"], "left_anti"), roots), "others")
    more = stored(verified(others, texts, similarity), "links")
    # What is connected so far is a link of each node with its root.
    roots = stored(components(known(roots).union(more)), "roots")
    roots = components(known(roots).union(stored(within_groups(members, roots, texts, similarity), "links")))

    named = stored(exact.join(roots, exact["rep"] == roots["node"], "left").select("d1", "d2", F.coalesce("root", "rep").alias("class_id")), "named")
    return found.select("doc_id", "d1", "d2").join(named, ["d1", "d2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def within_groups(members: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float, block: int = 256) -> DataFrame:
    """Links between documents that share a sketch and are in different components so far.

    ``members``: key, rep and n (its shingles; counted as none where it is missing).

    Groups with the same members are looked at once. Members of a group's largest component
    need no comparison with each other, so a group of copies that are linked already costs
    what its few others cost. If a group has more than ``block`` members, or more than BLOCK_SHINGLES shingles, both sides are cut
    into blocks by a hash, and each pair of blocks is one piece of work of about twice as much: their shingles in
    common are counted by matrix products, and only pairs that could reach the similarity
    and that nothing connects yet are aligned. No pair is ever a row, and of a block's
    links only a spanning forest comes back.
    """
    if "n" not in members.columns:
        members = members.withColumn("n", F.lit(0).cast("long"))
    placed = stored(members.join(roots, members["rep"] == roots["node"], "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root")), "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("n").alias("long"), F.bit_xor(F.xxhash64("rep")).alias("x0"), F.bit_xor(F.xxhash64(F.lit(3), "rep")).alias("x1"))
    facts = parts.groupBy("key").agg(F.count("*").alias("components"), F.max(F.struct("n", "root", "long")).alias("most"), F.sum("n").alias("size"), F.sum("long").alias("long"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"))
    mixed = facts.where("components > 1").groupBy("size", "x0", "x1").agg(F.min_by(F.struct("key", "most", "long"), "key").alias("one"))
    rest, long_rest = F.col("size") - F.col("one.most.n"), F.col("one.long") - F.col("one.most.long")
    wide = (F.col("size") > block) | (F.col("one.long") > BLOCK_SHINGLES)
    blocks = lambda n, long: F.ceil(F.greatest(n / block, long / BLOCK_SHINGLES))
    shape = (F.when(wide, F.col("one.most.root")).alias("big"), F.when(wide, blocks(rest, long_rest)).otherwise(1).alias("few"), F.when(wide, blocks(F.col("one.most.n"), F.col("one.most.long"))).otherwise(0).alias("many"))
    mixed = stored(mixed.select("one.key", *shape), "mixed")
    # Blocks of the largest component have the numbers below 0; a group that fits one block is one piece of work.
    inside, name = F.col("root") == F.col("big"), F.xxhash64("rep")
    own = F.when(inside, -1 - F.pmod(name, F.col("many"))).otherwise(F.pmod(name, F.col("few")))
    others = F.when(inside, F.sequence(F.lit(0).cast("long"), F.col("few") - 1)).otherwise(F.sequence(-F.col("many"), F.col("few") - 1))
    spread = placed.join(mixed, "key").select("key", "rep", "root", own.alias("own"), F.explode(others).alias("other"))
    spread = stored(spread.select("key", "rep", "root", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj")), "spread")

    def run(group: pa.Table) -> pa.Table:
        cross = group.column("bi")[0].as_py() != group.column("bj")[0].as_py()
        ids, root, own = (group.column(c).to_numpy() for c in ("rep", "root", "own"))
        rows = [(w, x) for b in group.to_batches() for t in slices([b]) for w, x in _labelled_sequences(t)]
        found = block_links([w for w, _ in rows], [x for _, x in rows], root, own if cross else None, similarity)
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in found], pa.int64()), "b": pa.array([int(ids[j]) for _, j in found], pa.int64())})

    return spread.join(texts, spread["rep"] == texts["doc_id"]).select("key", "bi", "bj", "rep", "root", "own", "text").groupBy("key", "bi", "bj").applyInArrow(run, "a long, b long")


def _labelled_sequences(t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    _, _, windows, begin = shingles(t)
    labels = labelled(windows, begin)
    for i in range(len(t)):
        yield windows[begin[i] : begin[i + 1]], labels[begin[i] : begin[i + 1]]


def block_links(sequences: list[np.ndarray], labels: list[np.ndarray], root: np.ndarray, side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Pairs of documents of a block that are linked, enough to connect all that are; with ``side``, only across sides."""
    n = len(sequences)
    sizes = np.array([len(x) for x in labels], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *labels])
    _, term, times = np.unique(flat, return_inverse=True, return_counts=True)
    several = times > 1
    number = np.cumsum(several) - 1
    doc = np.repeat(np.arange(n), sizes)
    use = several[term]
    term, doc = number[term[use]], doc[use]
    order = np.argsort(term, kind="stable")
    term, doc = term[order], doc[order]
    common = np.zeros((n, n), np.float32)
    width = 4096
    for low in range(0, int(several.sum()), width):
        x, y = np.searchsorted(term, [low, low + width])
        part = np.zeros((n, width), np.float32)
        part[doc[x:y], term[x:y] - low] = 1
        common += part @ part.T
    least = np.ceil(similarity * (sizes[:, None] + sizes[None, :]) / (1 + similarity) - 1e-9)
    could = np.triu((common >= least) & (least > 0) & (root[:, None] != root[None, :]), 1)
    if side is not None:
        could &= side[:, None] != side[None, :]
    i, j = np.nonzero(could)
    order = np.argsort(-(common[i, j] / least[i, j]), kind="stable")
    parent = {int(r): int(r) for r in root}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        ra, rb = top(int(root[a])), top(int(root[b]))
        if ra == rb:
            continue
        need = int(least[a, b])
        if aligned(sequences[a], sequences[b], need, int(sizes[a] + sizes[b]) - 2 * need) >= need:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def known(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    ra = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    rb = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the near-duplicates: of each class one row with the class's own id stays, with all its columns.

    Of rows with equal words the one with the smallest id stays, and any one of those if
    it is repeated; of rows without an id one for each text that no row with an id has.
    Rows without words stay, those that share an id as one. Rows that share an id but
    not their words have one class, so they stay or go together, unless another id has
    the words. Other columns stay as they are, whatever their names; an empty table stays empty.
    """
    kept = near_duplicates(docs, similarity).where("doc_id = class_id").select(F.col("doc_id").alias("__kept")).distinct()
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    marked = aside(docs).withColumns({"__a": F.xxhash64(words), "__b": F.xxhash64(F.lit(7), words), "__blank": words == "", "__id": F.coalesce("doc_id", F.lit(0)), "__null": F.isnull("doc_id")})
    key = ["__a", "__b", "__id", "__null"]

    firsts = marked.groupBy("__a", "__b", F.when(F.col("__blank"), F.col("doc_id")).alias("__own")).agg(F.min("doc_id").alias("__rep"))
    stay = firsts.join(kept, firsts["__rep"] == kept["__kept"], "left").where("__rep IS NULL OR __kept IS NOT NULL")
    stay = stored(stay.select("__a", "__b", F.coalesce("__rep", F.lit(0)).alias("__id"), F.isnull("__rep").alias("__null")), "stay")
    nameless = F.col("__blank") & F.col("__null")
    one = marked.where(~nameless).join(stay, key, "left_semi").dropDuplicates(key)
    return restored(one.unionByName(marked.where(nameless)), docs.columns)
