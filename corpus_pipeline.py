"""A training-corpus pipeline: documents in, token ids out. Each stage is one of the operators in siftline.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import decontaminate, mixing, simhash, toxicity
from siftline.llm.queries import token_files
from siftline.llm.shared import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.near_dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that are mostly such passages go."""
    return decontaminate.decontaminate(docs, decontaminate.bounded_items(table(spark, sf_dir, "benchmark")))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet files, read back."""
    return token_files(spark, docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed_to_weights),
    ("token_output", token_output),
]

# Classifiers, fingerprints, random draws and tokenizers are not expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
