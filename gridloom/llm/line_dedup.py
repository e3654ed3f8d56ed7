"""Removal of lines that many documents share, in DataFrame functions only.

The lines of a document are hashed inside its row, once, and the hashes written. Distinct pairs of document and hash,
then documents for each hash, are counted with map-side aggregation at both levels, so
a line that every document has is no hot task. The frequent hashes (written once, so
that both sides of the join have exchanges of their own and Spark can split a hot hash)
meet the places of the lines, and the lines of a document move once, to meet the set of
its dropped places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
NEW = ("n_lines", "n_dropped", "kept_text")


def lines_of(text: Column) -> Column:
    """All lines of a text, split at \\n; a null text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, with A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def line_hash(key: Column) -> Column:
    """128 bits of hash of a line's key, as a struct of two longs."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` in place of nothing: all its columns stay.

    A key (line without surrounding blanks, A-Z lower-cased) of at least
    ``min_chars`` code points that is found in at least ``min_docs`` documents loses
    all its lines in every document. The other lines stay as they were, in order,
    joined by \\n.

    Rows that share an id are one document in the count, and all lose the frequent lines.
    Rows without an id lose them, too; those with equal texts are one document, different
    ones are different documents. Null or empty text: one empty line, which stays for
    ``min_chars`` of 1 or more. An empty table gives an empty table. Columns named as the
    three new ones are replaced; all others are kept.
    """
    lines = lines_of(F.col(text_col))
    # A row is named by its id and a hash of its text: rows that share both have the same lines.
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in NEW)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), lines.alias("lines"))

    keys = F.transform("lines", lambda x: line_key(x))
    long_enough = F.lit(max(0, min_chars))
    hashes = stored(named.select("id", "t", F.transform(keys, lambda k: F.when(F.char_length(k) >= long_enough, line_hash(k))).alias("hs")), "hashes")
    whose = F.when(F.col("id").isNull(), F.col("t")).otherwise(F.lit(0)).alias("t")
    held = hashes.select("id", whose, F.explode("hs").alias("h")).where("h IS NOT NULL").select("id", "t", "h.a", "h.b").distinct()
    common = stored(held.groupBy("a", "b").count().where(F.col("count") >= min_docs).select("a", "b"), "common")
    placed = hashes.select("id", "t", F.posexplode("hs").alias("pos", "h")).where("h IS NOT NULL").select("id", "t", "pos", "h.a", "h.b")
    hits = placed.join(common, ["a", "b"]).groupBy("id", "t").agg(F.collect_set("pos").alias("drop"))
    hits = hits.select(F.col("id").alias("hit_id"), F.col("t").alias("hit_t"), "drop")

    met = named.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("t") == F.col("hit_t")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("lines"), i)))
    new = (F.size("lines").cast("long"), F.coalesce(F.size("drop"), F.lit(0)).cast("long"), F.array_join(kept, "\n"))
    return met.select("row", *(v.alias(k) for k, v in zip(NEW, new, strict=True))).select("row.*", *NEW)


def digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays."""
    out = drop_common_lines(docs.select("doc_id", "text"), min_docs, min_chars)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH ls AS (
  SELECT doc_id, pos, lines[pos] AS line,
         translate(regexp_replace(lines[pos], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
               unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)),
common AS (SELECT k FROM ls WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM ls LEFT JOIN common c USING (k) GROUP BY doc_id
"""
