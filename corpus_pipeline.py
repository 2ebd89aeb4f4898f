"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding. Each stage's rows are written before the next begins.

Each stage takes empty tables and gives one; a null or empty text is clean of toxic words as far as the network says so, near only to texts without words, holds no item and has size 0, so
that the mix does not take it. Rows of one id are told apart by their text; of rows that agree in both one is kept. Further columns stay, whatever their names; the last stage sets shard.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from silvaspark.common import ensure_checkpoint_dir, table
from silvaspark.llm import decontaminate, mixing, sharding, simhash, toxicity

#: A trained network scores and clusters of fingerprints decide: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go; it learns from the labels of documents that are still there."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: they meet by SimHash fingerprints, and by bands, and have five-word shingle sets of a similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard each goes to."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result but the last is written as Parquet under the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{n}-{name}")
            docs = spark.read.parquet(f"{folder}/{n}-{name}")
    return docs
