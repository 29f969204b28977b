"""Training with coefficients as a table, against Spark ML and against single fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casestory.operators import linear
from casestory.operators import train as trn


def texts(n=240, folds=3, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choice([0, 0, 1])
        own = ["good", "fine", "calm"] if y == 0 else ["bad", "poor", "worn"]
        words = [rng.choice(own if rng.random() < 0.35 else [f"w{k}" for k in range(25)]) for _ in range(rng.randint(1, 30))]
        rows.append((i, "The " + " ".join(words), y, i % folds))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, label int, fold int").withColumn("terms", F.lit("clash")).withColumn("block", F.lit(1))


def of_model(model, fold=0):
    w, bias = linear.token_weights(model, fold)
    return {r["token"]: r["w"] for r in w.collect()}, bias


def test_same_optimum_as_spark_ml(spark):
    df = frame(spark, texts(150))
    mine = linear.fit(df, max_iter=40, tol=1e-8)
    theirs = trn.fit(df.select("doc_id", "text", "label"), trn.text_pipeline(max_iter=200))
    w, bias = trn.token_weights(theirs, spark)
    want = {r["token"]: r["w"] for r in w.collect()}
    got, got_bias = of_model(mine)
    assert set(got) == set(want) and "the" in got
    assert got["the"] == [0.0, 0.0]  # in every text
    assert max(abs(a - b) for t in want for a, b in zip(got[t], want[t])) < 5e-3
    assert abs((got_bias[1] - got_bias[0]) - (bias[1] - bias[0])) < 5e-3
    probs = {r["doc_id"]: r["probs"][1] for r in linear.probabilities(mine, F.lit(0)).collect()}
    ml = {r["doc_id"]: r["probs"][1] for r in trn.score(theirs, df).collect()}
    assert max(abs(probs[i] - ml[i]) for i in ml) < 2e-3


def test_folds_at_once_equal_single_fits(spark, monkeypatch):
    rows = texts(120, folds=2)
    monkeypatch.setattr(linear, "BLOCK_DOCS", 50)
    together = linear.fit(frame(spark, rows), 2, fold_col="fold", max_iter=5, tol=0)
    for f in range(2):
        alone = linear.fit(frame(spark, [r for r in rows if r[3] != f]), max_iter=5, tol=0)
        a, b = of_model(together, f), of_model(alone)
        assert set(b[0]) <= set(a[0])
        assert max(abs(x - y) for t in b[0] for x, y in zip(a[0][t], b[0][t])) < 1e-6
        assert all(a[0][t] == [0.0, 0.0] for t in set(a[0]) - set(b[0]))  # terms of the held-out rows alone
        assert abs(together.losses[f] - alone.losses[0]) < 1e-9
    assert together.evaluations <= max(together.iterations) + 4  # one scan per iteration but for halved steps


def test_blocks_shards_and_parts_do_not_matter(spark, monkeypatch):
    rows = texts(100)
    whole = of_model(linear.fit(frame(spark, rows), max_iter=3, tol=0))
    for name, value in (("BLOCK_DOCS", 7), ("SHARD_TERMS", 3), ("FAN", 3)):
        monkeypatch.setattr(linear, name, value)
    split = of_model(linear.fit(frame(spark, rows), max_iter=3, tol=0))
    assert set(whole[0]) == set(split[0])
    assert max(abs(x - y) for t in whole[0] for x, y in zip(whole[0][t], split[0][t])) < 1e-9


def test_awkward_rows(spark):
    rows = texts(60) + [(100, None, 1, 0), (101, "", 0, 1), (102, "!!! ...", None, 2), (None, "good fine", None, None), (5, "bad bad", 1, 0), (5, "bad bad", 1, 0), (103, "ÀÉ İx Kelvin", 0, 1), (104, "w1 " * 40_000, 0, 2)]
    model = linear.fit(frame(spark, rows), 3, fold_col="fold", max_iter=3)
    out = linear.probabilities(model, F.coalesce("fold", F.lit(0))).collect()
    assert len(out) == len(rows)
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in out)
    assert sorted(r["y_true"] is None for r in out).count(True) == 2
    # the join finds the same scores as the blocks
    joined = linear.score(model, frame(spark, rows), fold=1)
    key = lambda r: (repr(r["doc_id"]), [round(x, 9) for x in r["probs"]], r["y_pred"])
    assert sorted(map(key, joined.collect())) == sorted(map(key, linear.probabilities(model, F.lit(1)).collect()))
    with pytest.raises(ValueError):
        linear.fit(frame(spark, []))
    with pytest.raises(ValueError):
        linear.fit(frame(spark, [(1, "a", None, 0)]))


def test_direction_is_two_loop_recursion():
    rng = np.random.default_rng(1)
    s, y = rng.normal(size=(3, 8)), rng.normal(size=(3, 8))
    y += 2 * s
    g = rng.normal(size=8)
    q, alpha = g.copy(), []
    for a, b in zip(s[::-1], y[::-1]):
        alpha.append(a @ q / (a @ b))
        q = q - alpha[-1] * b
    q = q * (s[-1] @ y[-1]) / (y[-1] @ y[-1])
    for (a, b), al in zip(zip(s, y), alpha[::-1]):
        q = q + a * (al - b @ q / (a @ b))
    basis = np.concatenate([s, y, g[None]])
    assert np.allclose(linear.direction(basis @ basis.T, 3) @ basis, -q)


def test_an_evaluation_sends_all_classes_but_the_last_and_sorts_no_block(spark, monkeypatch):
    seen = []

    def watched(blocks, messages, shape, weights, parts, own=linear._gradients):
        found = own(blocks, messages, shape, weights, parts)
        answers = found.selectExpr("sum(length(sums)) / sum(length(pos))").first()[0]
        asked = messages.selectExpr("sum(length(`values`)) / sum(length(pos))").first()[0]
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        cached = next(i for i, line in enumerate(plan) if "InMemoryTableScan" in line)
        seen.append((asked, answers, any(" Sort " in line or "Exchange" in line for line in plan[cached - 2:cached])))
        return found
    monkeypatch.setattr(linear, "_gradients", watched)
    linear.fit(frame(spark, texts(40)), 3, fold_col="fold", max_iter=1)
    assert seen and set(seen) == {(3 * 2 * 1, 3 * 2 * 1, False)}  # folds x 8 bytes for 4 of a place, one class of two


def test_three_classes_reach_the_optimum_of_spark_ml(spark):
    rows = [(i, x + (" odd" if i % 3 == 2 else ""), i % 3, f) for i, x, _, f in texts(90)]
    mine, theirs = linear.fit(frame(spark, rows), max_iter=40, tol=1e-8), trn.fit(frame(spark, rows).select("doc_id", "text", "label"), trn.text_pipeline(max_iter=200))
    got = {r["doc_id"]: r["probs"] for r in linear.probabilities(mine, F.lit(0)).collect()}
    want = {r["doc_id"]: r["probs"] for r in trn.score(theirs, frame(spark, rows)).collect()}
    assert max(abs(a - b) for i in want for a, b in zip(got[i], want[i])) < 2e-3


def test_rows_and_batches_stay_small(spark, monkeypatch):
    """Many terms times folds: a shard's row and an Arrow batch hold a few megabytes."""
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []

    def watched(df, name, own=linear._stash):
        out = own(df, name)
        if name == "state":
            seen.append((out.agg(F.max(F.length("vectors"))).first()[0], int(spark.conf.get(key).rstrip("b"))))
        return out
    monkeypatch.setattr(linear, "_stash", watched)
    before = spark.conf.get(key)
    rows = [(1000 + k, " ".join(f"v{i}" for i in range(k, 200_000, 8)), k % 2, k % 3) for k in range(8)]
    linear.fit(frame(spark, texts(20) + rows), 3, fold_col="fold", max_iter=1)
    row, batch = map(max, zip(*seen))
    assert row < 3 << 20 and batch <= 8 << 20
    assert spark.conf.get(key) == before
