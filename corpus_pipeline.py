"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import mixing, neardup, packing, pii, toxicity
from quillon.llm.common import forget, stored


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject."""
    return toxicity.filtered(docs, toxicity.fit(spark, docs, sf_dir))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id."""
    return neardup.distinct(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return pii.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in curriculum order."""
    return mixing.copies_in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("near_duplicates", deduplicated), ("personal_data", masked), ("mixing", mixed), ("packing", packed)]
#: The first stage trains a model and the last runs a tokenizer; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences; each stage's result is written as Parquet and read again, and
    the one before it, which nothing reads any more, deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        after = stored(stage(spark, docs, sf_dir), name)
        if k:
            forget(docs)
        docs = after
    return docs
