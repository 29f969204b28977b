"""Classification metrics, class statistics and losses as table operations
(A2-A15, M3).

Every metric first reduces the predictions to the confusion table (A4):
``groupBy(y_true, y_pred).count()`` with map-side partial aggregation, so all later
arithmetic is on k^2 rows whatever the data size. Zero divisions give 0.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestory.functions.seq import scan_by_key



def _all():
    """Window over a whole k- or k^2-row table (class or confusion sized only)."""
    return Window.partitionBy()


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


# ------------------------------------------------------------------ A2 / A3

def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A2: count, percent and imbalance ratio (max count / max(count, 1)) for every
    class 0..max(label); absent classes show 0."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))
    top = counts.agg(F.max(label_col).alias("__k"))
    grid = top.select(F.explode(F.sequence(F.lit(0), F.col("__k"))).alias(label_col))
    c = grid.join(counts, label_col, "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    total = F.sum("count").over(_all())
    return c.select(label_col, "count",
                    (F.col("count") / total * 100).alias("percentage"),
                    (F.max("count").over(_all()) / F.greatest(F.col("count"), F.lit(1))).alias("imbalance_ratio"))


def class_weights(df: DataFrame, label_col: str = "label", method: str = "balanced",
                  num_classes: int | None = None) -> DataFrame:
    """A3: 'balanced' n/(k*c) or 'sqrt' sqrt(n/c) with counts floored at 1, then scaled
    so the weights sum to k."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("c"))
    stats = df.agg(F.count(F.lit(1)).alias("__n"), F.max(label_col).alias("__mx"))
    k = F.lit(num_classes) if num_classes else (F.col("__mx") + 1)
    grid = stats.select(F.explode(F.sequence(F.lit(0), k - 1)).alias(label_col), "__n", k.alias("__k"))
    g = grid.join(counts, label_col, "left").withColumn("c", F.greatest(F.coalesce("c", F.lit(0)), F.lit(1)))
    if method == "balanced":
        raw = F.col("__n") / (F.col("__k") * F.col("c"))
    elif method == "sqrt":
        raw = F.sqrt(F.col("__n") / F.col("c"))
    else:
        raise ValueError(f"method {method!r} not supported: use 'balanced' or 'sqrt'")
    g = g.withColumn("__w", raw)
    return g.select(label_col, (F.col("__w") * F.col("__k") / F.sum("__w").over(_all())).alias("weight"))


def class_weights_present(df: DataFrame, label_col: str = "label") -> DataFrame:
    """N / (classes present * count) for classes 0 and 1; 1.0 for an absent one."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("c"))
    w = counts.select(label_col, (F.sum("c").over(_all()) / (F.count(F.lit(1)).over(_all()) * F.col("c"))).alias("w"))
    grid = df.sparkSession.range(2).select(F.col("id").cast("int").alias(label_col))
    return grid.join(w, label_col, "left").select(label_col, F.coalesce("w", F.lit(1.0)).alias("weight"))


# ------------------------------------------------------------------ A4-A12

def confusion(preds: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """A4: ``(y_true, y_pred, n)`` over the labels seen in either column, zeros filled."""
    cm = preds.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))
    # label grid (k x k) from the k labels seen, expanded from one array
    ls = cm.select(F.col("y_true").alias("l")).union(cm.select("y_pred")).agg(
        F.sort_array(F.collect_set("l")).alias("ls"))
    grid = ls.select(F.explode("ls").alias("y_true"), "ls").select("y_true", F.explode("ls").alias("y_pred"))
    return grid.join(cm, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label from the confusion table."""
    tp = cm.filter(F.col("y_true") == F.col("y_pred")).select(F.col("y_true").alias("label"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"))
    pred = cm.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    t = tp.join(sup, "label").join(pred, "label")
    p = _div(F.col("tp"), F.col("predicted"))
    r = _div(F.col("tp"), F.col("support"))
    return t.select("label", p.alias("precision"), r.alias("recall"),
                    F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"),
                    F.col("support").cast("long").alias("support"), "tp", F.col("predicted").cast("long"))


def summary_metrics(cm: DataFrame, average: str = "binary", pos_label: int = 1) -> DataFrame:
    """A5 + A8 + A10 (one row): accuracy, balanced accuracy, precision/recall/F1 by
    ``average`` (binary | macro | weighted), MCC, Cohen's kappa, minority-focused score
    0.7 * recall_1 + 0.3 * balanced accuracy (all 0 with fewer than two labels)."""
    pc = per_class(cm)
    if average == "binary":
        agg_p = F.max(F.when(F.col("label") == pos_label, F.col("precision")))
        agg_r = F.max(F.when(F.col("label") == pos_label, F.col("recall")))
        agg_f = F.max(F.when(F.col("label") == pos_label, F.col("f1")))
    elif average == "macro":
        agg_p, agg_r, agg_f = F.avg("precision"), F.avg("recall"), F.avg("f1")
    elif average == "weighted":
        tot = F.sum("support")
        agg_p = F.sum(F.col("precision") * F.col("support")) / tot
        agg_r = F.sum(F.col("recall") * F.col("support")) / tot
        agg_f = F.sum(F.col("f1") * F.col("support")) / tot
    else:
        raise ValueError(average)
    s = pc.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.coalesce(agg_p, F.lit(0.0)).alias("precision"),
        F.coalesce(agg_r, F.lit(0.0)).alias("recall"),
        F.coalesce(agg_f, F.lit(0.0)).alias("f1"),
        F.sum("tp").cast("double").alias("__c"),
        F.sum("support").cast("double").alias("__s"),
        F.sum(F.col("predicted").cast("double") * F.col("support")).alias("__pt"),
        F.sum(F.col("predicted").cast("double") ** 2).alias("__pp"),
        F.sum(F.col("support").cast("double") ** 2).alias("__tt"),
        F.count(F.lit(1)).alias("__k"),
        F.max(F.when(F.col("label") == 1, F.col("recall"))).alias("__r1"),
        F.max(F.when(F.col("label") == 0, F.col("recall"))).alias("__r0"),
    )
    mcc_den = F.sqrt((F.col("__s") ** 2 - F.col("__pp")) * (F.col("__s") ** 2 - F.col("__tt")))
    po = F.col("__c") / F.col("__s")
    pe = F.col("__pt") / (F.col("__s") ** 2)
    two = F.col("__k") >= 2
    return s.select(
        "accuracy", "balanced_accuracy", "precision", "recall", "f1",
        F.when(mcc_den == 0, 0.0).otherwise((F.col("__c") * F.col("__s") - F.col("__pt")) / mcc_den).alias("mcc"),
        F.when(pe == 1, 0.0).otherwise((po - pe) / (1 - pe)).alias("cohen_kappa"),
        F.when(two, 0.7 * F.coalesce("__r1", F.lit(0.0)) + 0.3 * F.col("balanced_accuracy"))
         .otherwise(0.0).alias("class1_focused_score"),
        F.when(two, F.coalesce("__r1", F.lit(0.0))).otherwise(0.0).alias("recall_class1"),
        F.when(two, F.coalesce("__r0", F.lit(0.0))).otherwise(0.0).alias("recall_class0"),
    )


def classification_report(cm: DataFrame, names: dict[int, str] | None = None, digits: int = 4) -> DataFrame:
    """Per-class rows, then accuracy, macro avg and weighted avg, rounded."""
    pc = per_class(cm)
    name = F.col("label").cast("string")
    if names:
        m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        name = F.coalesce(F.element_at(m, F.col("label")), name)
    rows = pc.select(name.alias("row"), F.col("label").alias("ord"), "precision", "recall", "f1", "support")
    tot = F.sum("support")
    acc = pc.agg(F.lit("accuracy").alias("row"), F.lit(1_000_001).alias("ord"),
                 F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                 (F.sum("tp") / tot).alias("f1"), tot.cast("long").alias("support"))
    mac = pc.agg(F.lit("macro avg").alias("row"), F.lit(1_000_002).alias("ord"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.cast("long").alias("support"))
    wtd = pc.agg(F.lit("weighted avg").alias("row"), F.lit(1_000_003).alias("ord"),
                 (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                 (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                 (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.cast("long").alias("support"))
    out = rows.unionByName(acc).unionByName(mac).unionByName(wtd)
    return out.select("row", "ord", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support")


def plain_accuracy(preds: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Accuracy with correct and total counts."""
    ok = (F.col(y_true) == F.col(y_pred)).cast("long")
    return preds.agg(F.sum(ok).alias("correct"), F.count(F.lit(1)).alias("total"),
                     F.avg(ok.cast("double")).alias("accuracy"))


def roc_auc(preds: DataFrame, y_true: str = "y_true", score: str = "score", n_buckets: int = 1024) -> DataFrame:
    """Exact ROC AUC by rank sums (ties count one half); null with one class only.

    Rows are first reduced to one row per distinct score (positives, negatives). The
    running count of negatives below each score comes from a bucketed scan over those
    rows: buckets are score ranges cut at approximate quantiles of the distinct
    scores, so no global window ever holds all scores.
    """
    g = preds.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum((F.col(y_true) == 1).cast("long")).alias("pos"),
        F.sum((F.col(y_true) != 1).cast("long")).alias("neg"))
    qs = g.approxQuantile("s", [i / n_buckets for i in range(1, n_buckets)], 1.0 / (4 * n_buckets))
    splits = sorted(set(q for q in qs if q is not None and not math.isnan(q)))
    splits = [-math.inf] + splits + [math.inf]
    gb = Bucketizer(splits=splits, inputCol="s", outputCol="__bk", handleInvalid="keep").transform(g) \
        if len(splits) > 2 else g.withColumn("__bk", F.lit(0.0))
    cs = scan_by_key(gb, [], ["s"], F.col("__bk"), cumsums={"cneg": F.col("neg")})
    below = F.col("cneg") - F.col("neg")
    r = cs.agg((F.sum(F.col("pos").cast("double") * (below + 0.5 * F.col("neg")))).alias("__num"),
               F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    return r.select(F.when((F.col("__p") == 0) | (F.col("__n") == 0), F.lit(None).cast("double"))
                    .otherwise(F.col("__num") / F.col("__p").cast("double") / F.col("__n").cast("double")).alias("auc_roc"))


# ------------------------------------------------------------------ M3 + losses

def softmax(logits: Column) -> Column:
    """M3: class probabilities from an array of logits (max-shifted exp)."""
    m = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def argmax(arr: Column) -> Column:
    """M3: index of the largest value, lowest index on ties (0-based)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def focal_loss(df: DataFrame, logits: str = "logits", target: str = "y_true", alpha=None,
               gamma: float = 2.0, reduction: str = "mean", ignore_index: int = -100,
               clamp: bool = True) -> DataFrame:
    """A13 (and A13b with ``clamp=False``, alpha [0.25, 0.75]).

    per row: -alpha_y * (1 - p_y)^gamma * ln p_y with p_y the softmax probability of the
    target, clamped to [1e-8, 1]; alpha None -> 1, scalar a -> [1-a, a], list -> list.
    Rows with the ignore label add 0 and are left out of the mean.
    """
    p = F.element_at(softmax(F.col(logits)), F.col(target) + 1)
    pt = F.least(F.greatest(p, F.lit(1e-8)), F.lit(1.0)) if clamp else p
    if alpha is None:
        a = F.lit(1.0)
    else:
        al = [1 - alpha, alpha] if isinstance(alpha, (int, float)) else list(alpha)
        a = F.element_at(F.array(*[F.lit(float(x)) for x in al]), F.col(target) + 1)
    valid = F.col(target) != ignore_index
    loss = F.when(valid, -a * F.pow(1 - pt, gamma) * F.log(pt)).otherwise(0.0)
    rows = df.withColumn("loss", loss).withColumn("__valid", valid.cast("long"))
    if reduction == "none":
        return rows.drop("__valid")
    if reduction == "sum":
        return rows.agg(F.sum("loss").alias("loss"))
    if reduction == "mean":
        return rows.agg(F.when(F.sum("__valid") > 0, F.sum("loss") / F.sum("__valid"))
                        .otherwise(F.sum("loss")).alias("loss"))
    raise ValueError(f"reduction {reduction!r} not supported: use 'mean', 'sum' or 'none'")


def weighted_cross_entropy(df: DataFrame, weights: DataFrame, logits: str = "logits",
                           target: str = "y_true", label_col: str = "label") -> DataFrame:
    """sum(w_y * nll) / sum(w_y) with ``weights(label, weight)`` (k rows, broadcast)."""
    nll = -F.log(F.element_at(softmax(F.col(logits)), F.col(target) + 1))
    j = df.join(F.broadcast(weights.withColumnRenamed(label_col, target)), target, "left")
    return j.agg((F.sum(F.col("weight") * nll) / F.sum("weight")).alias("loss"))


def epoch_loss(batches: DataFrame, loss: str = "loss") -> DataFrame:
    """Epoch loss = mean over batches of the batch mean (rows: run, fold, epoch, batch)."""
    b = batches.groupBy("run", "fold", "epoch", "batch").agg(F.avg(loss).alias("__bm"))
    # batch means summed in batch order (one row per batch of an epoch: bounded by the
    # batch count), so the result does not depend on the shuffle's arrival order
    e = b.groupBy("run", "fold", "epoch").agg(F.sort_array(F.collect_list(F.struct("batch", "__bm"))).alias("__b"))
    return e.select("run", "fold", "epoch",
                    (F.aggregate("__b", F.lit(0.0), lambda a, x: a + x["__bm"]) / F.size("__b")).alias("epoch_loss"))
