"""A corpus pipeline over ``documents``: reject toxic texts, drop exact and near copies, drop
documents with benchmark passages, mix the sources to target weights.

Each stage gets the documents that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from casestory.llm import exact_dedup, mixing, simhash, toxicity, winnowing
from casestory.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, with ``size, source_size, target, taken`` beside their columns."""
    return mixing.mixture(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("simhash", drop_near_copies),
          ("decontamination", drop_benchmark), ("mixing", mix_sources)]

#: Toxicity scores, SimHash components and the shuffle order have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
