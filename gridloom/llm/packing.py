"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the largest length are cut into full sequences and a rest. The
pieces are dealt into groups of bounded size by a hash of their document, and each
group is packed by best-fit decreasing: a piece goes to the open bin that it leaves
least room in; where none has room, a bin is opened with the permitted length that is
cheapest for each token it can be expected to hold. At the end every bin takes the
smallest permitted length that holds its contents. The lengths are optimised jointly: a
group is packed with every choice of lengths that bins may be opened with, and the
packing of least cost is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import stored

#: Permitted sequence lengths.
SIZES = (256, 512, 1024, 2048)
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bin_cost(size: int, fixed: float = 16.0, square: float = 8192.0) -> float:
    """What a sequence costs: a fixed part, its tokens, and attention that grows with the square."""
    return fixed + size + size * size / square


class OpenBins:
    """Bins by the room they have left: a set bit in ``mask`` says that some bin has exactly that room."""

    def __init__(self):
        self.mask, self.by_room = 0, {}

    def put(self, room: int, number: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(number)
            self.mask |= 1 << room

    def best(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of at least ``need``, taken out; of equals the one put in last."""
        fit = self.mask >> need
        if not fit:
            return None
        room = need + (fit & -fit).bit_length() - 1
        stack = self.by_room[room]
        number = stack.pop()
        if not stack:
            del self.by_room[room]
            self.mask &= ~(1 << room)
        return room, number


def cheapest(need: int, rest: int, sizes: Sequence[int], cost=bin_cost) -> int:
    """The permitted size that costs least for each token it is expected to hold: ``need`` now, and later pieces from the ``rest``."""
    return min((s for s in sizes if s >= need), key=lambda s: (cost(s) / min(s, need + rest), s))


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES, cost=bin_cost) -> tuple[list[int], list[int], list[int]]:
    """For pieces in descending order of length: each one's bin and place in it, and each bin's final size."""
    sizes = sorted(sizes)
    bins, where, at, used, held = OpenBins(), [], [], [], []
    rest = sum(lengths)
    for n in lengths:
        rest -= n
        found = bins.best(n)
        if found is None:
            number, room = len(used), cheapest(n, rest, sizes, cost)
            used.append(0)
            held.append(room)
        else:
            room, number = found
        where.append(number)
        at.append(used[number])
        used[number] += n
        bins.put(room - n, number)
    return where, at, [next(s for s in sizes if s >= u) for u in used]


def pack_jointly(lengths: Sequence[int], sizes: Sequence[int] = SIZES, cost=bin_cost) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of the packings that open bins with some of the sizes only; the largest is always among them."""
    *smaller, top = sorted(sizes)
    choices = [(*some, top) for n in range(len(smaller), -1, -1) for some in combinations(smaller, n)]

    def packed(choice: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
        where, at, _ = pack(lengths, choice, cost)
        used = [0] * (max(where, default=-1) + 1)
        for w, n in zip(where, lengths, strict=True):
            used[w] += n
        return where, at, [next(s for s in sorted(sizes) if s >= u) for u in used]

    return min(map(packed, choices), key=lambda p: sum(map(cost, p[2])))


def best_fit(docs: DataFrame, sizes: Sequence[int] = SIZES, length: Column | None = None, group_pieces: int = 1_500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: doc_id, piece, n_tokens, bin_id, bin_size, place.

    ``length`` is a document's number of tokens (its words by default). Pieces of
    one document are numbered from 0; all but the last have the largest permitted size.
    ``bin_id`` is the group and the number of the bin in it. ``group_pieces`` is about
    how many pieces are packed together: groups are dealt by a hash of id and piece, so
    a long document or a source with many documents is spread over all of them.

    Documents without tokens (null or empty text, negative or null length) have one row
    with null bin. Repeated rows are packed each for itself, and are spread over the groups
    by their place in the table, as rows without an id are. Ties of length go to the
    smaller id, null ids first. Only ids and lengths are shuffled. Other columns are left
    out; an empty table gives an empty one.
    """
    sizes = sorted(sizes)
    top = sizes[-1]
    length = word_count(F.col(text_col)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(length, F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("row"))
    last = F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0))
    sized = stored(sized.withColumn("last", last.cast("int")), "sized")
    total = sized.agg(F.sum(F.col("last") + 1)).first()[0] or 0
    groups = max(1, -(-total // group_pieces))
    again = sized.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").withColumnRenamed("doc_id", "same")
    sized = sized.join(again, F.col("doc_id").eqNullSafe(F.col("same")), "left")
    salt = F.when(F.col("count").isNotNull(), F.col("row")).otherwise(F.lit(0))
    pieces = sized.select("doc_id", "n", salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("piece"))
    grp = F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups)).cast("int")
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("int").alias("n_tokens"), grp.alias("grp"))
    schema = "doc_id long, piece int, n_tokens int, bin_id string, bin_size int, place int"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], na_position="first", kind="stable")
        full = group[group["n_tokens"] > 0]
        where, place, final = pack_jointly(full["n_tokens"].tolist(), sizes)
        out = group[["doc_id", "piece", "n_tokens"]].astype({"doc_id": "Int64"})
        name = f"{group['grp'].iloc[0]}-"
        spare = [None] * (len(group) - len(full))
        out["bin_id"] = [name + str(w) for w in where] + spare
        out["bin_size"] = pd.array([final[w] for w in where] + spare, dtype="Int32")
        out["place"] = pd.array(place + spare, dtype="Int32")
        return out

    return pieces.groupBy("grp").applyInPandas(run, schema)


def bins(packed: DataFrame) -> DataFrame:
    """One row for each bin: its size, tokens, and pieces in order."""
    piece = F.struct("place", "doc_id", "piece", "n_tokens")
    return packed.where("bin_id IS NOT NULL").groupBy("bin_id").agg(F.max("bin_size").alias("bin_size"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("pieces"))
