"""A corpus pipeline of text operators: each stage is written as Parquet and reread as the next one's documents.

Every stage but the last returns the columns of documents, and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import common, mixing, pieces, pii, shingles, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It is fitted to labelled rows among those that come in."""
    return toxicity.reject(docs, toxicity.trained(docs, common.read(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8) stays: the one of the smallest id."""
    return shingles.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds."""
    return pii.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix of its source takes it whole: not at all, once or twice."""
    return mixing.apply_mix(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the ids of its pieces."""
    return pieces.encode(docs, pieces.vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", dedup_stage),
    ("pii", pii_stage),
    ("mix", mix_stage),
    ("pieces", pieces_stage),
]

#: A trained classifier, shingle sets and pieces are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
