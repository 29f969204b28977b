"""Summaries that are written with what they were made from: k-fold results with their configuration
(S9), the token dictionary with metadata (S12), the step grid with its summary (S14).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casestory.operators.attribute import grid_summary
from casestory.operators.history import best_fold, kfold_aggregate
from casestory.operators.tokens import TOKEN_FORMAT
from casestory.sources.sinks import read_csv, read_json_table, write_csv, write_json_table


def write_kfold_summary(per_fold: DataFrame, config: dict, path: str, monitor: str, fold_col: str = "fold") -> None:
    """``folds`` (the per-fold metrics, partitioned by fold) and ``summary``: one row with the
    aggregated metrics, the best fold by ``monitor`` and the configuration.

    Configuration values are kept as JSON text by name, so any mix of types is read back as it was;
    a name that is not text or a value that JSON has no form for raises TypeError.
    """
    if not all(isinstance(k, str) for k in config):
        raise TypeError("names of a configuration are text")
    given = F.create_map(*[F.lit(x) for k in sorted(config) for x in (k, json.dumps(config[k], sort_keys=True))]) if config \
        else F.create_map().cast("map<string,string>")
    per_fold.write.mode("overwrite").partitionBy(fold_col).json(f"{path}/folds")
    metrics = kfold_aggregate(per_fold, fold_col).agg(F.array_sort(F.collect_list(F.struct("metric", "mean", "std", "min", "max"))).alias("metrics"))
    n = per_fold.agg(F.count("*").alias("n_folds"))
    write_json_table(metrics.join(n).join(best_fold(per_fold, monitor, fold_col)).select(  # single rows
        "n_folds", F.lit(monitor).alias("monitor"), "best_fold", "best_value", "metrics", given.alias("config")), f"{path}/summary")


_SUMMARY = ("n_folds long, monitor string, best_fold int, best_value double, "
            "metrics array<struct<metric:string,mean:double,std:double,min:double,max:double>>, config map<string,string>")


def read_kfold_summary(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The summary row and the configuration as it was given."""
    summary = read_json_table(spark, f"{path}/summary", _SUMMARY)
    return summary, {k: json.loads(v) for k, v in (summary.first()["config"] or {}).items()}


def read_folds(spark: SparkSession, path: str, schema) -> DataFrame:
    """The per-fold metrics, with ``schema`` as that of the table that was written."""
    return read_json_table(spark, f"{path}/folds", schema)


def write_token_dictionary(tokens: DataFrame, path: str) -> None:
    """``tokens`` and ``metadata``: number of tokens and sources, their format, shortest and
    longest phrase, and a fingerprint of the mapping that a reader can compare."""
    write_json_table(tokens, f"{path}/tokens")
    write_json_table(tokens.agg(
        F.count("*").alias("total_tokens"), F.count_distinct("src").alias("total_sources"), F.lit(TOKEN_FORMAT).alias("token_format"),
        F.min("length").alias("shortest"), F.max("length").alias("longest"), _fingerprint()), f"{path}/metadata")


def _fingerprint():
    return F.bit_xor(F.xxhash64("token", "phrase")).alias("fingerprint")


def read_token_dictionary(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """Tokens and metadata. A mapping that is not the one the metadata were written for raises ValueError."""
    tokens = read_json_table(spark, f"{path}/tokens", schema)
    metadata = read_json_table(spark, f"{path}/metadata",
                               "total_tokens long, total_sources long, token_format string, shortest int, longest int, fingerprint long")
    found = tokens.agg(F.count("*").alias("n"), _fingerprint()).first()
    told = metadata.first()
    if (found["n"], found["fingerprint"]) != (told["total_tokens"], told["fingerprint"]):
        raise ValueError(f"{path}: the tokens are not those of the metadata")
    return tokens, metadata


def write_step_grid(grid: DataFrame, path: str) -> None:
    """The grid as CSV, its summary per step count and the recommendation."""
    write_csv(grid.select("doc_id", "fold", "n_steps", "rel_error", "abs_error", "converged"), f"{path}/grid")
    summary, recommended = grid_summary(grid)
    write_json_table(summary, f"{path}/summary")
    write_json_table(recommended, f"{path}/recommended")


def read_step_grid(spark: SparkSession, path: str, id_type: str = "long") -> tuple[DataFrame, DataFrame, int | None]:
    """The grid, its summary and the recommended number of steps."""
    grid = read_csv(spark, f"{path}/grid", f"doc_id {id_type}, fold int, n_steps int, rel_error double, abs_error double, converged boolean")
    row = read_json_table(spark, f"{path}/recommended", "recommended_n_steps int").first()
    summary = read_json_table(spark, f"{path}/summary", "n_steps int, mean_rel_error double, median_rel_error double, std_rel_error double, "
                              "max_rel_error double, mean_abs_error double, median_abs_error double, converged long, total long, convergence_rate double")
    return grid, summary, row["recommended_n_steps"] if row else None
