"""Fold ensembles (M6-M9): mean class probabilities over folds, best-fold mode,
fold-artefact discovery and fold metrics with placeholders.

Predictions are kept long, ``(id, fold, class, p)``; the ensemble is one aggregation
on ``(id, class)`` (k folds per key, map-side partial aggregation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestory.operators.metrics import softmax


def long_probs(fold_logits: DataFrame) -> DataFrame:
    """``(id, fold, logits)`` -> ``(id, fold, class, p)`` with softmax probabilities (M3)."""
    p = fold_logits.withColumn("__p", softmax(F.col("logits")))
    return p.select("id", "fold", F.posexplode("__p").alias("class", "p")).withColumn("class", F.col("class").cast("int"))


def ensemble_predict(probs: DataFrame, keep_individual: bool = False) -> DataFrame:
    """M6: mean probability per (id, class) over folds; predicted class = highest mean,
    lowest class on ties. With ``keep_individual`` the per-fold probabilities stay as a
    ``fold_probs`` array (fold order)."""
    m = probs.groupBy("id", "class").agg(F.avg("p").alias("p_mean"),
                                         F.sort_array(F.collect_list(F.struct("fold", "p"))).alias("__fp"))
    pred = m.groupBy("id").agg(
        F.max_by(F.col("class"), F.struct(F.col("p_mean"), -F.col("class"))).alias("y_pred"),
        F.max("p_mean").alias("p_max"))
    out = m.join(pred, "id")
    if keep_individual:
        out = out.withColumn("fold_probs", F.transform("__fp", lambda x: x["p"]))
    return out.drop("__fp")


def best_fold_predict(probs: DataFrame, best: DataFrame) -> DataFrame:
    """M7 best-fold mode: the probabilities of the chosen fold only (``best`` has one row
    with ``best_fold``)."""
    b = F.broadcast(best.select(F.col("best_fold").alias("fold")))
    p = probs.join(b, "fold", "left_semi")
    return p.groupBy("id").agg(F.max_by(F.col("class"), F.struct(F.col("p"), -F.col("class"))).alias("y_pred"),
                               F.max("p").alias("p_max"))


FOLD_NAME_PATTERN = r"_fold(\d+)\."


def discover_folds(artefacts: DataFrame, name_col: str = "name") -> DataFrame:
    """M8: fold number from each artefact name; unparsable names are skipped; fails if
    none is found or the folds are not exactly 0..k-1. Returns ``(n_folds, folds)``."""
    f = artefacts.select(F.regexp_extract(name_col, FOLD_NAME_PATTERN, 1).alias("f")).filter(F.col("f") != "")
    s = f.agg(F.count_distinct("f").alias("n"), F.max(F.col("f").cast("int")).alias("mx"),
              F.min(F.col("f").cast("int")).alias("mn"),
              F.array_sort(F.collect_set(F.col("f").cast("int"))).alias("folds"))
    ok = (F.col("n") > 0) & (F.col("mn") == 0) & (F.col("mx") + 1 == F.col("n"))
    return s.select(F.when(ok, F.col("n")).otherwise(F.raise_error(F.concat(
        F.lit("fold artefacts missing or with gaps: "), F.coalesce(F.array_join(F.col("folds").cast("array<string>"), ","),
                                                                  F.lit("none")))).cast("long")).alias("n_folds"),
        F.array_join(F.col("folds").cast("array<string>"), ",").alias("folds"))


def fold_metrics_with_placeholders(folds: DataFrame, metrics: DataFrame, value: str = "best_value",
                                   fallback: float = 0.0) -> DataFrame:
    """M9: every fold with its metric, ``fallback`` where the metric is missing."""
    return folds.join(metrics, "fold", "left").select("fold", F.coalesce(F.col(value), F.lit(fallback)).alias(value))
