"""Writers and readers for every hand-over table.

Everything is written as partitioned Parquet / JSON / CSV under a base path (on a
cluster: a shared file system path, e.g. under ``spark.checkpoint.dir``); readers use
partition filters so a split or format is pruned at the scan. A partitioned writer replaces
only the partitions it writes: other formats, runs, models and modes stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stories(stories: DataFrame, path: str, fmt: str) -> None:
    """Stories with case ids and labels, partitioned by (format, split)."""
    (stories.withColumn("format", F.lit(fmt))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("format", "split").parquet(path))


def read_stories(spark: SparkSession, path: str, fmt: str, dataset: str = "test") -> DataFrame:
    """S5 + P13: one split, or 'all' = train then test (partition-pruned reads)."""
    df = spark.read.parquet(path).filter(F.col("format") == fmt)
    if dataset == "all":
        return df.filter(F.col("split") == "train").unionByName(df.filter(F.col("split") == "test"))
    return df.filter(F.col("split") == dataset)


def write_predictions(preds: DataFrame, path: str, fmt: str, model: str, mode: str) -> None:
    """Predictions, targets, probabilities."""
    (preds.withColumn("format", F.lit(fmt)).withColumn("model", F.lit(model)).withColumn("mode", F.lit(mode))
          .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("format", "model", "mode").parquet(path))


def write_json_table(df: DataFrame, path: str) -> None:
    """Small tables (metrics, report, summaries, mappings) as JSON."""
    df.write.mode("overwrite").json(path)


def read_json_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read back a JSON table (explicit schema when given)."""
    r = spark.read
    return (r.schema(schema) if schema is not None else r).json(path)


def write_epochs(epochs: DataFrame, path: str) -> None:
    """Epoch history partitioned by (run, fold)."""
    epochs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "fold").parquet(path)


def write_attributions(token_attr: DataFrame, path: str, fmt: str, model: str, mode: str, run_ts: str) -> None:
    """Raw attributions, token rows nested per document only at the sink; documents are so already."""
    if "tokens" in token_attr.columns:
        nested = token_attr.select("doc_id", "tokens")
    else:
        nested = token_attr.groupBy("doc_id").agg(
            F.sort_array(F.collect_list(F.struct("pos", "token", "score"))).alias("tokens"))
    (nested.withColumn("format", F.lit(fmt)).withColumn("model", F.lit(model)).withColumn("mode", F.lit(mode))
           .withColumn("run_ts", F.lit(run_ts))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("format", "model", "mode", "run_ts").parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    """Step-grid results as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_partitioned(spark: SparkSession, path: str, **parts) -> DataFrame:
    """Rows of a partitioned table, pruned to the partitions named."""
    df = spark.read.parquet(path)
    for name, value in parts.items():
        df = df.filter(F.col(name) == value)
    return df


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A step grid written by ``write_csv``."""
    return spark.read.csv(path, header=True, schema=schema)


def story_by_id(stories: DataFrame, case_id: str) -> DataFrame:
    """The story rows of one case, in every split and format that has it."""
    return stories.filter(F.col("case_id") == case_id)


def first_samples(rows: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows in the order of ``order`` (all of them for None)."""
    return rows if n is None else rows.orderBy(*order).limit(n)
