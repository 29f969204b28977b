"""Actions (multi-word phrases) found in texts and scored from word attributions
(J3, J6, X12-X14), and the chart tables built on them (J7, J8, X15-X17).

The phrase search (J3) itself is in ``phrases``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casestory.functions.seq import let
from casestory.functions.text import shorten
from casestory.operators.attribute import explode_late, top_k
from casestory.operators.phrases import hit_documents as hit_documents
from casestory.operators.phrases import phrase_hits as phrase_hits
from casestory.operators.phrases import with_actions as with_actions


def action_scores(hits: DataFrame, word_attr: DataFrame) -> DataFrame:
    """X12 + J6: score of each hit = sum of |score| of the action's words (split on
    whitespace, repeats counted), each word matched case-insensitively to the text's
    word scores (first spelling in word order wins); kept when at least half of the
    words were found."""
    parts = F.filter(F.split("action", r"\s+"), lambda w: w != "")  # a blank action has no words
    words = hits.select("doc_id", "action", F.posexplode_outer(parts).alias("wi", "aw"))
    words = words.withColumn("__lw", F.lower("aw"))
    ws = (word_attr.groupBy("doc_id", F.lower("word").alias("__lw"))
                   .agg(F.min_by("score", "first_word_id").alias("__s")))
    j = words.join(ws, ["doc_id", "__lw"], "left")
    g = j.groupBy("doc_id", "action").agg(F.sum(F.abs("__s")).alias("score"),
                                          F.count("__s").alias("words_found"), F.count("aw").alias("n_words"))
    return g.filter(F.col("words_found") >= F.col("n_words") / 2).select(
        "doc_id", "action", F.coalesce("score", F.lit(0.0)).alias("score"), "words_found", "n_words")


def document_action_scores(documents: DataFrame) -> DataFrame:
    """The rows of ``action_scores`` from documents with ``words`` (``attribute.document_words``) and
    ``actions``, with their ``y_pred``; no word leaves its document.

    The words that the actions ask for are sorted among the document's words, so each is found beside
    its first spelling; only these are looked up."""
    parts = F.transform("actions", lambda a: F.struct(a.alias("action"), F.filter(F.split(a, r"\s+"), lambda w: w != "").alias("aw")))
    lowered = F.transform(parts, lambda x: F.struct(x["action"].alias("action"), F.transform(x["aw"], lambda w: F.lower(w)).alias("aw")))

    def known(asked):
        none = F.lit(None).cast("long")
        own = F.transform("words", lambda x: F.struct(F.lower(x["word"]).alias("lw"), x["first_word_id"].alias("no"), x["score"].alias("s")))
        wanted = F.transform(F.array_distinct(F.flatten(F.transform(asked, lambda x: x["aw"]))),
                             lambda w: F.struct(w.alias("lw"), none.alias("no"), F.lit(None).cast("double").alias("s")))

        def beside(s):  # a null number comes first: the word after it is the first spelling
            return F.filter(s, lambda x, i: x["no"].isNotNull() & (i > 0) & F.coalesce(
                F.get(s, i - 1)["no"].isNull() & (F.get(s, i - 1)["lw"] == x["lw"]), F.lit(False)))
        return let(F.sort_array(F.concat(own, wanted)), beside)

    def score(x, ws):
        found = F.filter(F.transform(x["aw"], lambda w: F.abs(ws[w])), lambda v: v.isNotNull())
        return let(found, lambda v: F.struct(
            x["action"].alias("action"), F.aggregate(v, F.lit(0.0), lambda a, y: a + y).alias("score"),
            F.size(v).cast("long").alias("words_found"), F.size(x["aw"]).cast("long").alias("n_words")))
    scored = let(lowered, lambda asked: let(known(asked), lambda k: let(
        F.map_from_arrays(F.transform(k, lambda x: x["lw"]), F.transform(k, lambda x: x["s"])),
        lambda ws: F.transform(asked, lambda x: score(x, ws)))))
    rows = documents.select("doc_id", "y_pred", explode_late(scored).alias("x")).select("doc_id", "x.*", "y_pred")
    return rows.where(F.col("words_found") >= F.col("n_words") / 2)


def action_statistics(scores: DataFrame, preds: DataFrame | None = None) -> DataFrame:
    """Per class (predicted 0 vs others; 'all' without predictions) and action:
    mean, population std, count and total of the scores. Scores may bring their ``y_pred``."""
    if preds is not None or "y_pred" in scores.columns:
        s = scores if preds is None else scores.join(preds.select("doc_id", "y_pred"), "doc_id")
        cls = F.when(F.col("y_pred") == 0, "class_0").otherwise("class_1")
    else:
        s, cls = scores, F.lit("all")
    return s.groupBy(cls.alias("class"), "action").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"),
        F.count(F.lit(1)).alias("count"), F.sum("score").alias("total_score"))


def top_actions(stats: DataFrame, k: int = 25, sort_by: str = "mean_score") -> DataFrame:
    """Top-k actions per class by mean_score, count or total_score (ties by name)."""
    if sort_by not in ("mean_score", "count", "total_score"):
        raise ValueError(sort_by)
    return top_k(stats, ["class"], sort_by, "action", k)


def chart_table(stats: DataFrame, value: str = "mean_score", k: int = 25, joint_scale: bool = True,
                lead: str = "class_1", other: str = "class_0", inverse: DataFrame | None = None) -> DataFrame:
    """X15 / X16 / X17 + J7 + J8 + T13: top-k of the leading class, the other class
    aligned (0 where absent), scaled by the joint max (X15) or each class's own max
    (X16); labels optionally translated back (J8) and shortened to 50 characters.

    Both classes of an action meet in one aggregation, so the statistics are worked out once."""
    of = lambda name: F.max(F.when(F.col("class") == name, F.col(value)))  # noqa: E731  # a class has one row per action
    both = stats.groupBy("action").agg(of(lead).alias("lead_value"), of(other).alias("other_value"),
                                       F.max(F.when(F.col("class") == lead, F.col("class"))).alias("class"))
    top = top_k(both.filter(F.col("class").isNotNull()), ["class"], "lead_value", "action", k)
    t = top.select("action", "rank", "lead_value", F.coalesce("other_value", F.lit(0.0)).alias("other_value"))
    all_ = Window.partitionBy()  # k rows
    if joint_scale:
        mx = F.greatest(F.max("lead_value").over(all_), F.max("other_value").over(all_))
        t = t.withColumn("lead_scaled", F.when(mx == 0, 0.0).otherwise(F.col("lead_value") / mx)) \
             .withColumn("other_scaled", F.when(mx == 0, 0.0).otherwise(F.col("other_value") / mx))
    else:
        m1, m2 = F.max("lead_value").over(all_), F.max("other_value").over(all_)
        t = t.withColumn("lead_scaled", F.when(m1 == 0, 0.0).otherwise(F.col("lead_value") / m1)) \
             .withColumn("other_scaled", F.when(m2 == 0, 0.0).otherwise(F.col("other_value") / m2))
    label = F.col("action")
    if inverse is not None:
        t = t.join(inverse.select(F.col("dst").alias("action"), F.col("src").alias("__src")), "action", "left")
        label = F.coalesce("__src", "action")
    return t.withColumn("label", shorten(label, 50)).drop("__src")


def inverse_dictionary(dictionary: DataFrame) -> DataFrame:
    """Target -> source with the last source winning."""
    return dictionary.groupBy("dst").agg(F.max_by("src", "pos").alias("src"))
