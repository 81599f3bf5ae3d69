"""Training-corpus pipeline: toxicity, exact and near de-duplication, decontamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fibrelens.llm import bpe_automaton, decontamination, extendible_dedup, toxicity_trees, weighted_minhash
from fibrelens.llm.queries import VOCABULARY
from fibrelens.llm.shared import new_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated trees do not call toxic."""
    return toxicity_trees.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text, that with the largest doc_id."""
    return extendible_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per class of near-duplicates, that with the smallest doc_id."""
    return weighted_minhash.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; those that are mostly such go."""
    return decontamination.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe_automaton.tokenize(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("bpe", tokenize),
]

#: The trees and the sampled signatures have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what its predecessor wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
