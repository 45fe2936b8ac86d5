"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame.

Each applies its operator with production parameters to the whole table. The
operators run models, hashes, tokenizers or regular expressions with positions
that SQL cannot express, so ``ORACLES`` is empty and the queries are tested
against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanceflow.llm import (bpe, classifier, counts, fmindex, forest, licenses, mixing, periods, phrases, rans, rules,
                            secrets, simhash)
from stanceflow.llm.common import read_table

ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file (a parameter of the operators)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read_table(spark, sf_dir, "documents"))


def bpe_digest(encoded: DataFrame, *keep: str) -> DataFrame:
    return encoded.select(*keep, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe_digest(bpe.encode(docs, tokenizer_file("word_bpe_49k.json")), "doc_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(read_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.digest(spark, read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(read_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(read_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read_table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(read_table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secret_scans, op2_simhash_near_dedup, op3_bpe, op4_quality_rules, op5_quality_classifier, op6_token_files,
        op7_license_scans, op8_token_counts, op9_hash_prefix_forest, op10_mixing, op11_phrase_collocations,
        op12_periodic_runs, op13_decontamination)
}
