"""Epoch-history operators: best-so-far, early stopping, restore epoch, fold aggregates
(W13, W14, W14b, W15, A11, A11b, M10).

History tables are ``(run, fold, epoch, ...)``; a (run, fold) group holds one row per
epoch (bounded by the configured epoch count), so the per-group window / fold over the
ordered epochs is bounded by training length, not by data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def best_so_far(epochs: DataFrame, metric: str, mode: str = "max",
                keys: tuple[str, ...] = ("run", "fold")) -> DataFrame:
    """An epoch improves only if strictly better than every earlier epoch.

    Adds improved, delta (to the previous best, null when not improved), best_value,
    best_epoch (first epoch reaching it) and n_updates per group.
    """
    w = Window.partitionBy(*keys).orderBy("epoch")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    prev = (F.max if mode == "max" else F.min)(metric).over(before)
    better = (F.col(metric) > prev) if mode == "max" else (F.col(metric) < prev)
    d = epochs.withColumn("prev_best", prev).withColumn("improved", F.coalesce(better, F.lit(True)))
    d = d.withColumn("delta", F.when(F.col("improved") & F.col("prev_best").isNotNull(),
                                     F.col(metric) - F.col("prev_best")))
    best = (F.max if mode == "max" else F.min)(metric).over(whole)
    d = d.withColumn("best_value", best)
    d = d.withColumn("best_epoch", F.min(F.when(F.col(metric) == F.col("best_value"), F.col("epoch"))).over(whole))
    return d.withColumn("n_updates", F.sum(F.col("improved").cast("int")).over(whole)).drop("prev_best")


def _ordered(epochs: DataFrame, keys, cols) -> DataFrame:
    return epochs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("epoch", *cols))).alias("h"))


def early_stopping(epochs: DataFrame, val: str = "val_loss", train: str | None = "train_loss",
                   patience: int = 5, min_delta: float = 0.001, use_loss_ratio: bool = True,
                   loss_ratio_threshold: float = 1.15, loss_ratio_patience: int = 3,
                   restore_best_weights: bool = True, keys: tuple[str, ...] = ("run", "fold")) -> DataFrame:
    """W14 + W15: early stopping replayed over each group's ordered epochs.

    An epoch improves when val < best - min_delta; improving resets both the wait and
    the ratio-violation counters before the ratio (train/val, 0 if val <= 0) is tested;
    a ratio >= threshold is a violation. Stops at the first epoch with wait >= patience
    (reason 'patience') or violations >= ratio patience ('loss_ratio'). Restore epoch:
    the best epoch if kept, else the buffered epoch nearest trigger - patience.
    """
    cols = [F.col(val).alias("v")] + ([F.col(train).alias("t")] if train else [F.lit(None).cast("double").alias("t")])
    g = _ordered(epochs, keys, cols)
    init = F.struct(F.lit(INF).alias("best"), F.lit(-1).alias("best_epoch"), F.lit(0).alias("wait"),
                    F.lit(0).alias("viol"), F.lit(-1).alias("trigger"), F.lit(False).alias("stopped"),
                    F.lit(None).cast("string").alias("reason"), F.lit(0).alias("n_epochs"))

    def step(s, x):
        imp = x["v"] < s["best"] - F.lit(min_delta)
        best = F.when(imp, x["v"]).otherwise(s["best"])
        best_epoch = F.when(imp, x["epoch"]).otherwise(s["best_epoch"])
        wait = F.when(imp, F.lit(0)).otherwise(s["wait"] + 1)
        viol0 = F.when(imp, F.lit(0)).otherwise(s["viol"])
        ratio = F.when(x["v"] > 0, x["t"] / x["v"]).otherwise(F.lit(0.0))
        if use_loss_ratio:
            viol = F.when(x["t"].isNull(), viol0).when(ratio < loss_ratio_threshold, F.lit(0)).otherwise(viol0 + 1)
        else:
            viol = viol0
        by_p = wait >= patience
        by_r = (viol >= loss_ratio_patience) if use_loss_ratio else F.lit(False)
        stop = by_p | by_r
        new = F.struct(best.alias("best"), best_epoch.alias("best_epoch"), wait.alias("wait"), viol.alias("viol"),
                       F.when(stop, x["epoch"]).otherwise(F.lit(-1)).alias("trigger"), stop.alias("stopped"),
                       F.when(by_p, F.lit("patience")).when(by_r, F.lit("loss_ratio")).alias("reason"),
                       (s["n_epochs"] + 1).alias("n_epochs"))
        return F.when(s["stopped"], s).otherwise(new)

    r = g.select(*keys, F.aggregate("h", init, step).alias("s"))
    restore = (F.when(~F.col("s.stopped"), F.lit(None).cast("int"))
               .when(F.lit(restore_best_weights) & (F.col("s.best_epoch") >= 0), F.col("s.best_epoch"))
               .otherwise(F.greatest(F.lit(0), F.col("s.trigger") - patience + 1)))
    return r.select(*keys, F.col("s.stopped").alias("stopped"), F.col("s.trigger").alias("trigger_epoch"),
                    F.col("s.best").alias("best_val_loss"), F.col("s.best_epoch").alias("best_epoch"),
                    F.col("s.wait").alias("wait_count"), F.col("s.viol").alias("ratio_violations"),
                    F.col("s.reason").alias("reason"), F.col("s.n_epochs").alias("epochs_seen"),
                    restore.alias("restored_epoch"))


def early_stopping_v2(epochs: DataFrame, score: str = "val_loss", train: str | None = "train_loss",
                      patience: int = 5, min_delta: float = 0.001, use_loss_ratio: bool = False,
                      loss_ratio_threshold: float = 1.15, loss_ratio_patience: int = 3, mode: str = "min",
                      keys: tuple[str, ...] = ("run", "fold")) -> DataFrame:
    """The second early-stopping rule set.

    First epoch only sets the best; improvement is score < best - delta (min) or
    score > best + delta (max); stop when the counter reaches patience
    ('no_improvement'). The ratio is val/train (skipped when either is <= 0); a ratio
    above the threshold counts, otherwise the count resets; stop at ratio patience
    ('loss_ratio_overfitting'). Both rules are checked every epoch; where both stop, the
    ratio rule names the reason.
    """
    cols = [F.col(score).alias("v")] + ([F.col(train).alias("t")] if train else [F.lit(None).cast("double").alias("t")])
    g = _ordered(epochs, keys, cols)
    init = F.struct(F.lit(None).cast("double").alias("best"), F.lit(-1).alias("best_epoch"), F.lit(0).alias("counter"),
                    F.lit(0).alias("rc"), F.lit(-1).alias("stop_epoch"), F.lit(None).cast("string").alias("reason"))

    def step(s, x):
        first = s["best"].isNull()
        better = (x["v"] < s["best"] - min_delta) if mode == "min" else (x["v"] > s["best"] + min_delta)
        imp = first | better
        counter = F.when(first, s["counter"]).when(better, F.lit(0)).otherwise(s["counter"] + 1)
        std_stop = ~imp & (counter >= patience)
        if use_loss_ratio:
            ok = x["t"].isNotNull() & (x["t"] > 0) & (x["v"] > 0)
            ratio = x["v"] / x["t"]
            rc = F.when(~ok, s["rc"]).when(ratio > loss_ratio_threshold, s["rc"] + 1).otherwise(F.lit(0))
            r_stop = ok & (ratio > loss_ratio_threshold) & (rc >= loss_ratio_patience)
        else:
            rc, r_stop = s["rc"], F.lit(False)
        stop = std_stop | r_stop
        new = F.struct(F.when(imp, x["v"]).otherwise(s["best"]).alias("best"),
                       F.when(imp, x["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"),
                       counter.alias("counter"), rc.alias("rc"),
                       F.when(stop, x["epoch"]).otherwise(F.lit(-1)).alias("stop_epoch"),
                       F.when(r_stop, F.lit("loss_ratio_overfitting")).when(std_stop, F.lit("no_improvement"))
                        .alias("reason"))
        return F.when(s["stop_epoch"] >= 0, s).otherwise(new)

    r = g.select(*keys, F.aggregate("h", init, step).alias("s"))
    return r.select(*keys, (F.col("s.stop_epoch") >= 0).alias("stopped"), F.col("s.stop_epoch").alias("stop_epoch"),
                    F.col("s.best").alias("best_score"), F.col("s.best_epoch").alias("best_epoch"),
                    F.col("s.reason").alias("stop_reason"))


def kfold_aggregate(fold_metrics: DataFrame, fold_col: str = "fold") -> DataFrame:
    """Mean, population std, min and max of every numeric fold metric (fold excluded)."""
    num = [c for c, t in fold_metrics.dtypes if c != fold_col and t in ("double", "float", "int", "bigint", "long")]
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                for c in num]))
    long = fold_metrics.select(stack.alias("m")).select("m.metric", "m.value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      F.min("value").alias("min"), F.max("value").alias("max"))


def best_fold(fold_metrics: DataFrame, value: str, fold_col: str = "fold") -> DataFrame:
    """The fold with the highest value, the lowest fold on ties."""
    return fold_metrics.agg(F.max_by(F.col(fold_col), F.struct(F.col(value), -F.col(fold_col))).alias("best_fold"),
                            F.max(value).alias("best_value"))


def monitored_metrics(fold_metrics: DataFrame, names: list[str], fold_col: str = "fold") -> DataFrame:
    """``(fold, metric, value)`` of the metrics asked for by name; a name that no column
    has gives 0.0 in every fold."""
    value = [F.struct(F.lit(n).alias("metric"),
                      (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in fold_metrics.columns else F.lit(0.0)).alias("value"))
             for n in names]
    return fold_metrics.select(fold_col, F.explode(F.array(*value)).alias("m")).select(fold_col, "m.metric", "m.value")


def fold_report(fold_metrics: DataFrame, fold_col: str = "fold") -> DataFrame:
    """Per metric ``mean +/- std (min - max)`` as text with 4 digits, beside the numbers."""
    a = kfold_aggregate(fold_metrics, fold_col)
    four = lambda c: F.format_string("%.4f", F.col(c))
    return a.withColumn("summary", F.concat(four("mean"), F.lit(" +/- "), four("std"), F.lit(" ("), four("min"),
                                            F.lit(" - "), four("max"), F.lit(")")))
