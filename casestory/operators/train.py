"""Text classifier training and scoring on Spark ML (M2, M4, M5), re-aimed from the
reference's GPU fine-tuning: tokenise -> term counts -> IDF -> weighted logistic
regression. Every fit is distributed; the k-fold loop runs k fits over fold filters.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestory.operators.metrics import class_weights, confusion, summary_metrics


#: No bound of its own: CountVectorizer counts the distinct terms and keeps as many as there are.
ALL_TERMS = (1 << 31) - 1


def text_pipeline(vocab_size: int = ALL_TERMS, max_iter: int = 50, reg: float = 0.01) -> Pipeline:
    """M4 estimator (CountVectorizer keeps token <-> index for attribution). Every distinct term of
    the training texts is a feature; the term index and the coefficients stand on the driver."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"\W+", minTokenLength=1),
        CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=vocab_size, minDF=1.0),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                           maxIter=max_iter, regParam=reg, family="multinomial"),
    ])


def with_class_weights(df: DataFrame, method: str = "balanced") -> DataFrame:
    """A3 weights attached to every row as ``weight`` (k-row table, broadcast)."""
    w = class_weights(df, "label", method)
    return df.join(w, "label", "left")


def fit(train: DataFrame, pipeline: Pipeline | None = None) -> PipelineModel:
    """M4: fit with class weighting."""
    return (pipeline or text_pipeline()).fit(with_class_weights(train))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M2: probabilities (array), predicted class and target per row."""
    out = model.transform(df)
    return out.select("doc_id", F.col("label").alias("y_true"),
                      vector_to_array("probability").alias("probs"),
                      F.col("prediction").cast("int").alias("y_pred"))


def kfold_train(folded: DataFrame, k: int, pipeline: Pipeline | None = None, train_fn=None) -> DataFrame:
    """M5: per fold fit on the other folds, score the fold, record metrics and sizes.

    ``train_fn(train, fold)`` replaces the fit (the model factory hook); the rows are kept once
    for all folds and the sizes come from one count per fold.
    """
    folded = folded.persist()
    sizes = dict(folded.groupBy("fold").count().collect())  # k rows
    total, rows = sum(sizes.values()), None
    for f in range(k):
        train, held = folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f)
        model = train_fn(train, f) if train_fn else fit(train, pipeline)
        m = summary_metrics(confusion(score(model, held)), "macro").withColumn("fold", F.lit(f))
        m = m.withColumn("n_train", F.lit(total - sizes.get(f, 0))).withColumn("n_val", F.lit(sizes.get(f, 0)))
        rows = m if rows is None else rows.unionByName(m)
    return rows


def train_epochs(train: DataFrame, val: DataFrame, epochs: int, pipeline: Pipeline | None = None,
                 run: int = 0, fold: int = 0) -> tuple[DataFrame, PipelineModel]:
    """M4: epochs with validation after each and the best model kept.

    An epoch is a fit with one more optimiser iteration than the one before (the optimiser is
    deterministic, so this replays its path). Returns the history ``run, fold, epoch, train_loss,
    val_loss, accuracy``, which W13 to W15 take, and the model of the lowest validation loss.
    """
    spark = train.sparkSession
    base = pipeline or text_pipeline()
    features = Pipeline(stages=base.getStages()[:-1]).fit(train)
    tr, va = features.transform(with_class_weights(train)).persist(), features.transform(val).persist()
    history, best, kept = [], None, None
    for e in range(epochs):
        last = base.getStages()[-1].copy().setMaxIter(e + 1).fit(tr)
        model = PipelineModel(stages=[*features.stages, last])
        losses = [_mean_loss(last.transform(d)).first() for d in (tr, va)]
        history.append((run, fold, e, losses[0][0], losses[1][0], losses[1][1]))
        if best is None or losses[1][0] < best:
            best, kept = losses[1][0], model
    tr.unpersist()
    va.unpersist()
    return spark.createDataFrame(history, "run int, fold int, epoch int, train_loss double, val_loss double, accuracy double"), kept


def _mean_loss(scored: DataFrame) -> DataFrame:
    p = F.element_at(vector_to_array("probability"), F.col("label").cast("int") + 1)
    return scored.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))), F.avg((F.col("prediction") == F.col("label")).cast("double")))


def token_weights(model: PipelineModel, spark) -> tuple[DataFrame, list[float]]:
    """Weights ``(token, w)`` and bias of a fitted model, for attribution: the coefficient of a
    token in each class times its IDF, so that the sum over a text's tokens plus the bias is the
    model's logit."""
    vocabulary = model.stages[1].vocabulary
    idf, last = model.stages[2].idf, model.stages[3]
    rows = last.coefficientMatrix.toArray().T * idf.toArray()[:, None]
    w = spark.createDataFrame([(t, [float(x) for x in r]) for t, r in zip(vocabulary, rows)], "token string, w array<double>")
    return w, [float(x) for x in last.interceptVector]


def model_tokens(model: PipelineModel, docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, pos, token`` as the model's own tokenizer cuts the texts."""
    cut = model.stages[0].transform(docs.withColumn("text", F.col(text)))
    return cut.select("doc_id", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
