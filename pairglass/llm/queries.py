"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, covertree, divergence, filteraudit, jaccard, mixing, piecetable, quality, rabitq, secretscan, suffixdedup, tokenfiles, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return tokenfiles.read_tokens(spark, files)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecetable.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rabitq.neighbours(rows, rows.where("vec_id % 20 = 0"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_documents(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_sentencepiece, op3_jaccard_join, op4_repeat_removal, op5_one_bit_neighbours, op6_secret_scan, op7_quality, op8_source_mix, op9_cover_tree, op10_toxicity, op11_filter_audit, op12_byte_bpe, op13_source_divergence)}
ORACLES = {"op3_jaccard_join": jaccard.ORACLE, "op5_one_bit_neighbours": rabitq.ORACLE, "op9_cover_tree": covertree.ORACLE, "op8_source_mix": mixing.ORACLE, "op11_filter_audit": filteraudit.ORACLE, "op13_source_divergence": divergence.ORACLE}
