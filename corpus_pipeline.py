"""A training corpus from raw documents in five stages, each written as Parquet before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import exact, mixing, packing, quality, simhash
from brindle.llm.common import documents, scratch_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language and source."""
    return quality.accept(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.keep_last(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8: SimHash balls first, then the exact way for pairs that lie further apart."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' targets."""
    return mixing.mix(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", best_fit),
]

#: Robust estimates, fingerprints and tokenization have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared scratch folder."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
