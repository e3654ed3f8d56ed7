"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import additive_ann, bpe, byte_bpe, lexicon, line_dedup, masked_lm, near_dedup, packing, prefix_trie, quality_rules, resample, structure_repair, suffix_dedup
from gridloom.llm.store import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"), passage=suffix_dedup.PASSAGE)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.held_out_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("is_representative", F.col("doc_id") == F.col("class_id"))


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.scored(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encoded_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_additive_ann, op2_importance_resampling, op3_quality_rules, op4_suffix_dedup, op5_bpe, op6_best_fit_packing, op7_toxicity, op8_line_dedup, op9_near_dedup, op10_masked_lm, op11_byte_bpe, op12_prefix_trie, op13_structure_repair)}
ORACLES = {"op1_additive_ann": additive_ann.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}
