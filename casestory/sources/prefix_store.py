"""W10 as a stored table: prefixes that share their pieces, written out only when read.

``blocks`` holds every piece once; ``prefixes`` has a row per prefix with its label and the block it
ends in, so it can be counted, split and sampled without a text. A reader asks for prefixes by a
condition and gets their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from casestory.operators import prefixes as px


def write_prefixes(stays: DataFrame, path: str, block: int = px.BLOCK) -> None:
    """The prefixes of a stay log; the size written grows with the pieces. A stay log without rows
    gives empty tables; a table that stands there is replaced."""
    spark = stays.sparkSession
    px.rope(px.emitted_pieces(px.stay_features(stays)), block).write.mode("overwrite").parquet(f"{path}/blocks")
    px.prefix_references(spark.read.parquet(f"{path}/blocks"), px.stay_labels(stays)).write.mode("overwrite").parquet(f"{path}/prefixes")


def references(spark: SparkSession, path: str) -> DataFrame:
    """``(stay_id, prefix_len, blk, label)`` of every stored prefix."""
    return spark.read.parquet(f"{path}/prefixes")


def read_prefixes(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """``(stay_id, prefix_len, prefix_text, label)`` of the prefixes that meet ``where`` (a condition on the
    columns of ``references``), all without one."""
    chosen = references(spark, path)
    if where is not None:
        chosen = chosen.where(where)
    blocks = spark.read.parquet(f"{path}/blocks")
    if where is not None:  # stays without a chosen prefix are left out before their texts are joined
        blocks = blocks.join(chosen.select("stay_id").distinct(), "stay_id", "left_semi")
    return px.expand(blocks, chosen)
