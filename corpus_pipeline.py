"""Corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Part of the training-data
subpackage ``skyweave.llm``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skyweave.llm import decontaminate, packing, privacy, quality, simhash
from skyweave.llm.common import ensure_checkpoint_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the fitted model go."""
    return quality.passing_documents(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: those whose fingerprints link, and those whose shingles do."""
    return simhash.without_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and words that give it away, are replaced in the texts."""
    return privacy.sanitised(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("privacy", privacy_stage),
    ("packing", packing_stage),
]

#: No SQL: fingerprints, trees and tokens are beyond it. The tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
