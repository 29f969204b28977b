from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from casestory.operators import train as trn


def test_no_term_is_dropped(spark):
    """More distinct terms than the former bound of 262,144: all are in the vocabulary."""
    rows, each = 300, 1000
    words = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda k: F.concat(F.lit("t"), (F.col("id") * each + k).cast("string")))
    texts = spark.range(rows).select(F.array_join(F.concat(words, F.array(F.lit("common"))), " ").alias("text"))
    model = Pipeline(stages=trn.text_pipeline().getStages()[:2]).fit(texts)
    assert len(model.stages[1].vocabulary) == rows * each + 1 and model.stages[1].vocabulary[0] == "common"
