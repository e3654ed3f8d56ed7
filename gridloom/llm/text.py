"""Vectorised word and line scanning over Arrow text columns.

All helpers work on the UTF-8 bytes of many documents at once, so that the cost a
byte is a few NumPy passes and no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one NumPy pass holds; a longer document is one slice, whose hashes are taken piece by piece.
SLICE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, SLICE_BYTES + 4096)
    made = []
    with np.errstate(over="ignore"):
        for base in (_BASE, _BASE_INVERSE):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            made.append(np.multiply.accumulate(step))
    if size <= 4 * SLICE_BYTES:
        _powers[:] = made  # those of a span much longer than a slice are not kept
    return made[0][:n], made[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences give the hash of any substring of ``data``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the substrings [start, end): equal substrings have equal hashes."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start], seed)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, limit: int = SLICE_BYTES) -> np.ndarray:
    """The same as ``span_hash`` without running sums of all of ``data``: spans that begin within ``limit`` bytes are hashed together."""
    if not len(start):
        return np.zeros(0, np.uint64)
    order = None if len(start) < 2 or (start[1:] >= start[:-1]).all() else np.argsort(start, kind="stable")
    s, e = (start, end) if order is None else (start[order], end[order])
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        low = int(s[i])
        j = max(i + 1, int(np.searchsorted(s, low + limit)))
        out[i:j] = span_hash(prefix_hash(data[low : int(e[i:j].max())]), s[i:j] - low, e[i:j] - low, seed)
        i = j
    if order is None:
        return out
    back = np.empty_like(out)
    back[order] = out
    return back


class Texts:
    """Some documents: their bytes in one array, and where each begins."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.batch, self.data, self.offsets = batch, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text(self, i: int) -> str:
        return self.bytes(i).decode("utf-8", "replace")

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Pieces of the batches with about ``limit`` bytes of text each; null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield Texts(batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to


def spaces(data: np.ndarray) -> np.ndarray:
    """Where the word separators ``[\\x20\\x09-\\x0D]`` are."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(t: Texts, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the number of the first of its words."""
    n = len(t.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(t) + 1, np.int64)
    inside = ~(spaces(t.data) if space is None else space)
    first = np.ones(n + 1, bool)
    first[1:n] = ~inside[:-1]
    first[t.offsets] = True
    starts = np.flatnonzero(inside & first[:n])
    after = np.ones(n + 1, bool)
    after[:n] = ~inside
    after[t.offsets] = True
    ends = np.flatnonzero(inside & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, t.offsets)


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each item, from the number of each document's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def word_hashes(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and for each document the number of its first word."""
    starts, ends, first = words(t)
    return spans_hash(t.data, starts, ends), first


def window_hashes(items: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive items of one document, and each document's first window."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out * _BASE + items[at + k])
    return out, begin
