"""The corpus pipeline: toxicity, exact dedup, MinHash near-dedup, mixing to target weights, packing.

Every stage works on all that the one before it kept and returns the columns of documents; the last one
returns the pieces of packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from annoweave.llm import dart_minhash, exact_dedup, mixing, packing, toxicity
from annoweave.llm.common import table
from annoweave.llm.token_counts import state_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (8) doesn't reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts (5)."""
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (6)."""
    return dart_minhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix (9): repeated by epochs, cut where a source's budget ends."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of cost-balanced sequences (10)."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier, signatures and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = state_folder(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
