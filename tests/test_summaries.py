"""Rows paired by position, and summaries read back by value."""

import math

import pytest
from pyspark.sql import functions as F

from casestory.operators import attribute as at
from casestory.sources import positions as po
from casestory.sources import summaries as su


def test_numbers_follow_the_source_order(spark, tmp_path):
    """Several files, each read in several splits by several tasks."""
    n = 3000
    rows = spark.range(n, numPartitions=4).select("id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("pad"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        for kind in ("json", "csv", "parquet"):
            path = str(tmp_path / kind)
            rows.write.format(kind).save(path)
            back = spark.read.schema("id long, pad string").format(kind).load(path)
            assert kind == "parquet" or back.rdd.getNumPartitions() > 4
            got = po.numbered(back).select("id", "pos").collect()
            assert len(got) == n and all(r["id"] == r["pos"] for r in got), kind
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pairs_by_position(spark, tmp_path):
    a, b, c, none = (str(tmp_path / x) for x in "abcd")
    spark.range(10, numPartitions=3).select(F.col("id").alias("x")).write.json(a)
    spark.range(10, numPartitions=2).select((F.col("id") * 2).alias("y"), F.lit(None).cast("string").alias("z")).write.json(b)
    spark.range(9).select(F.col("id").alias("y")).write.json(c)
    spark.range(0).select(F.col("id").alias("y")).write.json(none)
    read = lambda p, s: spark.read.schema(s).json(p)
    got = po.pair_by_position(read(a, "x long"), read(b, "y long, z string")).orderBy("pos").collect()
    assert [(r["pos"], r["x"], r["y"], r["z"]) for r in got] == [(k, k, 2 * k, None) for k in range(10)]
    with pytest.raises(ValueError, match="10 and 9 rows"):
        po.pair_by_position(read(a, "x long"), read(c, "y long"))
    with pytest.raises(ValueError, match="both tables"):
        po.pair_by_position(read(a, "x long"), read(a, "x long"))
    assert po.pair_by_position(read(none, "x long"), read(none, "y long")).collect() == []


def test_kfold_summary_with_configuration(spark, tmp_path):
    folds = spark.createDataFrame([(0, 0.5, 10), (1, 0.75, 11), (2, 0.75, 9)], "fold int, accuracy double, n_val long")
    config = {"k": 3, "reg": 0.01, "names": ["a", "b"], "nested": {"x": None}, "on": True, "text": "é \"q\""}
    path = str(tmp_path / "k")
    su.write_kfold_summary(folds, config, path, "accuracy")
    summary, back = su.read_kfold_summary(spark, path)
    assert back == config
    row = summary.first()
    assert (row["n_folds"], row["monitor"], row["best_fold"], row["best_value"]) == (3, "accuracy", 1, 0.75)
    m = {x["metric"]: x for x in row["metrics"]}
    assert m["accuracy"]["mean"] == pytest.approx(2 / 3) and m["n_val"]["std"] == pytest.approx(math.sqrt(2 / 3)) and set(m) == {"accuracy", "n_val"}
    assert sorted(map(tuple, su.read_folds(spark, path, folds.schema).select(*folds.columns).collect())) == sorted(map(tuple, folds.collect()))
    su.write_kfold_summary(folds, {}, path, "accuracy")
    assert su.read_kfold_summary(spark, path)[1] == {}
    with pytest.raises(TypeError):
        su.write_kfold_summary(folds, {"f": object()}, path, "accuracy")


def test_token_dictionary_with_metadata(spark, tmp_path):
    tokens = spark.createDataFrame([(1, "[CLIN_001]", "long phrase", "s1", 11, 0), (2, "[CLIN_002]", "short", "s2", 5, 1)],
                                   "token_no int, token string, phrase string, src string, length int, first_pos int")
    path = str(tmp_path / "t")
    su.write_token_dictionary(tokens, path)
    back, metadata = su.read_token_dictionary(spark, path, tokens.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tokens.collect()))
    assert tuple(metadata.first())[:5] == (2, 2, "[CLIN_%03d]", 5, 11)
    tokens.withColumn("phrase", F.upper("phrase")).write.mode("overwrite").json(f"{path}/tokens")
    with pytest.raises(ValueError, match="not those of the metadata"):
        su.read_token_dictionary(spark, path, tokens.schema)


def test_step_grid_with_summary(spark, tmp_path):
    rows = [(d, 0, n, e / n, e, e / n < 0.1) for d, e in ((1, 0.1), (2, 0.4), (3, float("inf"))) for n in (2, 8)]
    grid = spark.createDataFrame(rows, "doc_id long, fold int, n_steps int, rel_error double, abs_error double, converged boolean")
    path = str(tmp_path / "g")
    su.write_step_grid(grid, path)
    back, summary, recommended = su.read_step_grid(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    want, rec = at.grid_summary(grid)
    key = lambda r: [None if isinstance(x, float) and math.isnan(x) else x for x in r]
    assert sorted(map(key, summary.collect())) == sorted(map(key, want.collect())) and recommended == rec.first()[0]
    assert {r["n_steps"]: r["median_rel_error"] for r in summary.collect()} == {2: 0.2, 8: 0.05}
