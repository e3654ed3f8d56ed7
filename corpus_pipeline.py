"""A corpus pipeline: quality rules, line, near-duplicate and substring dedup, then packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import line_dedup, near_dedup, packing, quality_rules, suffix_dedup
from gridloom.llm.store import aside, restored, stored, table

#: SQL has no learned rules, sketches or packing; the stages are tested against brute force.
ORACLE_SQL = None


#: Bytes from which a repeated string goes: under 4 for each word of a passage of over 50 words.
PASSAGE_BYTES = 200


def _with_text(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of documents with a new text, and n_chars (if there is one) counted anew."""
    replaced = {"text": text}
    if "n_chars" in columns:
        replaced["n_chars"] = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    return restored(rows, columns, **replaced)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject.

    Null, empty and short texts fail the base rules and go. Repeated rows go or stay together; null ids
    change nothing. All columns stay as they are, whatever their names; an empty table stays empty.
    """
    rules = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return restored(quality_rules.apply_rules(aside(docs), rules).where("kept"), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share.

    One that loses all its text stays as an empty one, and a null text becomes empty. Repeated rows of one
    id count as one document and lose the same lines. Other columns stay as they are, but for n_chars.
    """
    return _with_text(line_dedup.drop_common_lines(aside(docs)), docs.columns, F.col("kept_text"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, with all its columns; see ``near_dedup.one_of_each`` for repeated rows and null ids."""
    return near_dedup.one_of_each(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of PASSAGE_BYTES that start anywhere else.

    No row goes; one that is repeated throughout keeps an empty text. Other columns stay as they are, but for n_chars.
    """
    out = suffix_dedup.remove_repeats(docs, PASSAGE_BYTES)
    return _with_text(aside(out), docs.columns, F.col("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document stands in the training sequences; documents without words have a row with a null bin."""
    return packing.best_fit(docs)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("suffix_dedup", suffix_stage), ("best_fit_packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
