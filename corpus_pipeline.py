"""Corpus pipeline: documents through operators of ``stanceflow.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stanceflow.llm import bpe, classifier, mixing, secrets, simhash
from stanceflow.llm.common import read_table, scratch_path
from stanceflow.llm.queries import bpe_digest, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under one half) go. The
    model learns from the table ``labels``."""
    return classifier.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (three-word shingles,
    up to 3 differing bits)."""
    return simhash.one_per_group(docs, shingle=3, bits=3)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays."""
    return secrets.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A calibrated sample: source, language and content form at their token
    shares to the power 0.7, four fifths of the tokens."""
    return mixing.sampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the hash of the ids and of the text decoded from them."""
    return bpe_digest(bpe.encode(docs, tokenizer_file("word_bpe_49k.json")), "doc_id")


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", secret_scan),
    ("mixing", mix),
    ("bpe", tokens),
]

#: Models, hashes and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
