"""The trie of all beginnings of conversations, by the Euler-tour technique.

Every distinct beginning is a node. A tour of the trie enters and leaves each node once; the
arcs of the tour are one linked list, which is ranked over many tasks (``operators.ranking``).
What lies under a node are the arcs between its two, so every sum over a subtree is the
difference of two sums along the list, and no path is ever walked or expanded.

A node is named by its smallest member and its depth, so one conversation's own nodes are
neighbours in a range and most of the tour is followed without moving a row. A turn moves as
two hashes; a beginning is the sum of hashes of its turns and their places (128 bits).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.digests import pieces_sha256
from gridloom.llm.store import stored
from gridloom.operators.ordering import running
from gridloom.operators.ranking import suffix_sums

#: Ids of members in one piece of the text that is hashed.
PIECE = 1 << 16
_SUMS = ("p0", "p1", "p2", "p3")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (a turn's place from 1), t1, t2 (hashes of role and text), n_bytes (of the text).

    Turns are in order of ``turn``, nulls first; equal ones by role, then by hash of the
    text. Null roles and texts are empty. Rows without conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(17), text, role).alias("t2"), F.octet_length(text).cast("long").alias("n_bytes"))
    return running(turns, ["conv_id"], ["turn", "role", "t1", "t2"], {"k": F.lit(1)}).select("conv_id", "k", "t1", "t2", "n_bytes")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one: (conv_id, length) of all, and their turns (conv_id, d, t1, t2, n_bytes).

    Conversation c takes the first h turns of conversation c - c % family (all if it has
    fewer, none if it is absent), then its own after its first h; h is the CRC-32 of
    its decimal id modulo ``most``.
    """
    counts = stored(turns.groupBy("conv_id").agg(F.max("k").alias("n")), "counts")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = counts.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(family))).alias("base")).join(bases, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    row = ("t1", "t2", "n_bytes")
    heads = turns.where((F.col("k") < most) & (F.pmod("conv_id", F.lit(family)) == 0)).withColumnRenamed("conv_id", "base").join(convs, "base").where("k <= taken").select("conv_id", F.col("k").alias("d"), *row)
    own = turns.join(convs, "conv_id").where("k > h").select("conv_id", (F.col("k") - F.col("h") + F.col("taken")).alias("d"), *row)
    return convs.select("conv_id", "length"), stored(heads.union(own), "rebuilt")


def _key(sums: list[Column], depth: Column) -> list[Column]:
    return [F.xxhash64(depth, *sums), F.xxhash64(F.lit(29), *sums, depth)]


def prefix_nodes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each distinct beginning: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs``: conv_id, length; ``turns``: conv_id, d from 1 to length, t1, t2, n_bytes, each place
    once. Conversations without turns are members of the root only. Equal conversations are
    members of the same nodes. No conversations give no nodes, not even a root.
    """
    root = convs.agg(F.min("conv_id"), F.count("*")).first()
    halves = [F.xxhash64("d", "t1", "t2"), F.xxhash64(F.lit(5), "t2", "d", "t1")]
    low = F.lit(0xFFFFFFFF)
    each = dict(zip(_SUMS, (x for h in halves for x in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))), strict=True))
    sums = running(turns, ["conv_id"], ["d"], each)
    k1, k2 = _key([F.col(s) for s in _SUMS], F.col("d"))
    u1, u2 = _key([F.col(s) - each[s] for s in _SUMS], F.col("d") - 1)
    members = stored(sums.select("conv_id", F.col("d").alias("depth"), k1.alias("k1"), k2.alias("k2"), u1.alias("u1"), u2.alias("u2"), "n_bytes"), "members")

    key = ["depth", "k1", "k2"]
    nodes = stored(members.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("u1").alias("u1"), F.max("u2").alias("u2")), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    top = F.lit(root[0]).cast("long")
    plain = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_bytes", "k1", "k2"]
    zero = F.lit(0).cast("long")
    named = nodes.where("depth > 1").join(above, ["depth", "u1", "u2"]).select(*plain)
    named = named.union(nodes.where("depth = 1").withColumn("parent_conv_id", top).select(*plain))
    origin = convs.groupBy().agg(F.count("*").alias("n_convs")).where("n_convs > 0").select(top.alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", zero.alias("n_bytes"), zero.alias("k1"), zero.alias("k2"))
    named = stored(named.union(origin), "named")

    below = stored(_toured(named), "below")
    ends = members.join(convs.withColumnRenamed("length", "depth"), ["conv_id", "depth"], "left_semi").select(*key, "conv_id")
    ends = ends.union(convs.where("length = 0").select(zero, zero, zero, "conv_id"))
    hashed = named.join(_ends_hashed(ends, key), key, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    return hashed.join(below, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _toured(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_children, n_leaves, saved_tokens of every node, by sums along the Euler tour.

    Children are visited in order of conv_id. An arc is named by the node's conv_id and
    twice its depth, one more for the arc that leaves it.
    """
    inner = nodes.where("depth > 0").select("conv_id", "depth", "parent_conv_id")
    children = inner.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    ranked = stored(running(inner, ["parent_conv_id", "depth"], ["conv_id"], {"i": F.lit(1)}), "siblings")
    after = ranked.select("parent_conv_id", "depth", (F.col("i") - 1).alias("i"), F.col("conv_id").alias("sibling"))
    siblings = ranked.join(after, ["parent_conv_id", "depth", "i"]).select("conv_id", "depth", "sibling")
    whole = nodes.join(children, ["conv_id", "depth"], "left").join(siblings, ["conv_id", "depth"], "left")
    whole = stored(whole.select("conv_id", "depth", "parent_conv_id", "sibling", "first_child", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "whole")

    leaf, twice = F.col("n_children") == 0, 2 * F.col("depth")
    zero = F.lit(0).cast("long")
    arc = lambda b, na, nb, leaves, saved: F.struct(b.alias("b"), na.alias("na"), nb.alias("nb"), leaves.alias("leaves"), saved.alias("saved"))
    enter = arc(twice, F.when(leaf, F.col("conv_id")).otherwise(F.col("first_child")), F.when(leaf, twice + 1).otherwise(twice + 2), leaf.cast("long"), F.col("saved"))
    more = F.col("sibling").isNotNull()
    leave = arc(twice + 1, F.coalesce("sibling", "parent_conv_id"), F.when(more, twice).when(F.col("depth") > 0, twice - 1), zero, zero)
    arcs = whole.select(F.col("conv_id").alias("a"), F.explode(F.array(enter, leave)).alias("e")).select("a", "e.*")
    behind = suffix_sums(arcs, ["a", "b"], ["na", "nb"], ["leaves", "saved"])
    sign = F.when(F.col("b") % 2 == 0, 1).otherwise(-1)
    between = behind.groupBy(F.col("a").alias("conv_id"), F.floor(F.col("b") / 2).alias("depth")).agg(F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens"))
    return whole.select("conv_id", "depth", "n_children").join(between, ["conv_id", "depth"])


def _ends_hashed(ends: DataFrame, key: list[str]) -> DataFrame:
    """key and the digest of the ids that end there, in ascending order; a node's ids lie in pieces, however many they are."""
    placed = running(ends, key, ["conv_id"], {"i": F.lit(1)})
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = placed.groupBy(*key, F.floor((F.col("i") - 1) / PIECE).alias("piece")).agg(ids.alias("ids"))
    return pieces_sha256(pieces, key, "piece", "ids", ",")


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes (see ``prefix_nodes``) of conversations that share beginnings as ``rebuilt`` makes them; odd rows as in ``ordered_turns``."""
    return prefix_nodes(*rebuilt(ordered_turns(conversations)))


#: The same nodes by whole lists of turns, for DuckDB.
ORACLE = """WITH tb AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
  t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS k, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
  n AS (SELECT conv_id, max(k) AS n, conv_id - conv_id % 5 AS base FROM t GROUP BY conv_id),
  cv AS (SELECT n.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(n.conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM n, tb),
  ct AS (SELECT cv.*, least(h, coalesce(b.n, 0)) AS taken FROM cv LEFT JOIN n b ON b.conv_id = cv.base),
  r AS (SELECT ct.conv_id, k AS d, x FROM ct JOIN t ON t.conv_id = ct.base AND k <= taken UNION ALL SELECT ct.conv_id, k - h + taken, x FROM ct JOIN t ON t.conv_id = ct.conv_id AND k > h),
  m AS (SELECT conv_id, d, x, md5(list(x) OVER (PARTITION BY conv_id ORDER BY d)::VARCHAR) AS p FROM r UNION ALL SELECT conv_id, 0, NULL, '' FROM cv),
  z AS (SELECT conv_id, max(d) AS ends FROM m GROUP BY conv_id),
  nd AS (SELECT d, p, min(conv_id) AS own, count(*) AS n_convs, (count(*) - 1) * coalesce(octet_length(encode(any_value(x).text)), 0) AS saved FROM m GROUP BY d, p),
  up AS (SELECT nd.*, q.own AS parent FROM nd LEFT JOIN m ON m.conv_id = nd.own AND m.d = nd.d - 1 LEFT JOIN nd q ON q.d = m.d AND q.p = m.p),
  ch AS (SELECT parent AS own, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY 1, 2),
  u AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN ch USING (own, d)),
  s AS (SELECT m.d, m.p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u JOIN m ON m.conv_id = u.own AND m.d <= u.d GROUP BY 1, 2),
  e AS (SELECT m.d, m.p, sha256(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id)) AS ends FROM m JOIN z ON z.conv_id = m.conv_id AND z.ends = m.d GROUP BY 1, 2)
  SELECT own AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256 FROM u JOIN s USING (d, p) LEFT JOIN e USING (d, p)"""
