"""Selection of medians, phrase search by measured keys, the shrinking step ladder, own scorers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from casestory.functions import quantile
from casestory.operators import attribute as at
from casestory.operators import phrases as ph
from casestory.operators import scorer


def test_exact_medians(spark, monkeypatch):
    monkeypatch.setattr(quantile, "RANGES", 3)
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.gauss(0, 10.0 ** rng.randint(-8, 8)), 0.5, 0.5, -1e308, 1e308]), float(k)) for g in (1, 2, None) for k in range(60 + (g or 0))]
    rows += [(3, x, None) for x in (float("inf"), 1.0, float("inf"), float("inf"))] + [(4, None, None)] + [(5, float("-inf"), 1.0), (5, 2.0, 2.0), (5, float("nan"), 4.0)]
    rows += [(6, 0.1, 7.0)] * 50 + [(6, math.nextafter(0.1, 1), 7.0)] * 51
    df = spark.createDataFrame(rows, "g int, a double, b double").withColumn("v", F.lit("clash")).withColumn("rank", F.lit(1))
    got = {r["g"]: (r["a"], r["b"]) for r in quantile.exact_medians(df, "g", ["a", "b"]).collect()}
    want = {r["g"]: (r["a"], r["b"]) for r in df.groupBy("g").agg(F.median("a").alias("a"), F.median("b").alias("b")).collect()}
    assert got.keys() == want.keys()
    for g in got:
        for x, y in zip(got[g], want[g]):
            assert x == y or abs(x - y) <= 1e-12 * abs(y), g
    assert quantile.exact_medians(df.limit(0), "g", ["a"]).collect() == []


def test_phrases_by_measured_words(spark, monkeypatch):
    rng = random.Random(3)
    words = ["the", "cat", "sat", "on", "mat", "THE", "scatter", "mats", "x"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for k in range(300)]
    texts += [(1000, None), (1001, ""), (1002, "  lead the  cat\n"), (1003, "the\tcat"), (1004, "x" * 50_000 + " the cat sat"), (7, texts[7][1]), (7, texts[7][1])]
    phrases = ["the cat sat", "cat", "the mat", "", " ", "THE CAT", "at on", "on", None, "the  cat", " the", "cat ", "a cat sat on the mat", "nowhere at all here", "sat on the x cat", "the", "\n", "at sat o"]
    t, p = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(a,) for a in phrases], "action string")
    for few, ignore in ((ph.FEW, True), (200, False)):
        monkeypatch.setattr(ph, "FEW", few)
        got = sorted((r[0], r[1]) for r in ph.phrase_hits(t, p, ignore_case=ignore).collect())
        want = sorted({(i, a) for i, x in texts if x is not None for a in phrases if a is not None and (a.lower() in x.lower() if ignore else a in x)})
        assert got == want
    assert ph.phrase_hits(t.limit(0), p).collect() == [] and ph.phrase_hits(t, p.limit(0)).collect() == []


def test_rarest_measured_word_is_chosen(spark):
    texts = spark.createDataFrame([(1, "a b c d e"), (2, "a b x d e"), (3, "b d e")], "doc_id long, text string").withColumn("__l", F.lower("text"))
    p = spark.createDataFrame([("a b c d e",), ("x b q d x",)], "action string")
    assert [(r["action"], r["word"], r["df"]) for r in ph.chosen_words(texts, p).collect()] == [("a b c d e", "c", 1)]


def test_ladder_goes_on_with_open_documents_alone(spark, monkeypatch):
    tw = spark.createDataFrame([(i, [0.3 * i, -0.2 * i]) for i in range(12) for _ in range(3)], "doc_id long, w array<double>")
    rungs, tried = at.step_ladder(2, 1000, 6), []
    real = at._path_terms
    monkeypatch.setattr(at, "_path_terms", lambda s, b, k: tried.append(s.count()) or real(s, b, k))
    got = {r["doc_id"]: r for r in at.optimal_steps(tw, [0.1, 0.0], rungs, 0.01).collect()}
    assert len(got) == 12 and tried[0] == 12 and all(a >= b for a, b in zip(tried, tried[1:])) and tried[-1] < 12
    monkeypatch.setattr(at, "_path_terms", real)
    every = {n: {r["doc_id"]: r["rel_error"] for r in at.completeness(at.doc_path_summary(tw, [0.1, 0.0], n)).collect()} for n in rungs}
    for i, r in got.items():
        met = [n for n in rungs if every[n][i] is not None and every[n][i] <= 0.01]
        assert r["n_steps"] == (met[0] if met else rungs[-1])


def test_own_scorer(spark):
    rows = [(1, "good good", 1), (2, "bad", 0), (3, None, 1), (4, "", None), (None, "good bad", 0), (5, "bad", 0), (5, "bad", 0), (6, "good " * 40_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumn("probs", F.lit("clash"))
    own = scorer.linear_scorer({"good": (0.0, 1.0), "bad": (2.0, 0.0)}, (0.0, 0.0))
    got = sorted(((r["doc_id"], r["y_true"], r["y_pred"], round(r["probs"][1], 6)) for r in scorer.score_with(df, own, 2, batch=3, label_col="label").collect()), key=repr)
    p = lambda z: round(1 / (1 + math.exp(-z)), 6)
    want = [(1, 1, 1, p(2)), (2, 0, 0, p(-2)), (3, 1, 0, 0.5), (4, None, 0, 0.5), (None, 0, 0, p(-1)), (5, 0, 0, p(-2)), (5, 0, 0, p(-2)), (6, 1, 1, 1.0)]
    assert got == sorted(want, key=repr)
    assert scorer.score_with(df.limit(0), own, 2).collect() == []
    sizes = scorer.score_with(df, lambda: lambda texts: [[float(len(texts)), 0.0]] * len(texts), 2, batch=3, logits=False).collect()
    assert max(r["probs"][0] for r in sizes) <= 3
    for bad in (lambda texts: [[0.0]] * len(texts), lambda texts: [[float("nan"), 0.0]] * len(texts), lambda texts: []):
        with pytest.raises(Exception, match="the scorer returned"):
            scorer.score_with(df, lambda bad=bad: bad, 2).collect()


def test_own_scorer_agrees_with_the_trained_model(spark):
    from casestory.operators import linear
    from tests.test_linear import frame, texts
    df = frame(spark, texts(60))
    model = linear.fit(df, max_iter=3)
    weights, bias = linear.token_weights(model)
    own = scorer.linear_scorer({r["token"]: tuple(r["w"]) for r in weights.collect()}, bias)
    a = {r["doc_id"]: r for r in scorer.score_with(df, own, 2, label_col="label").collect()}
    for r in linear.probabilities(model, F.lit(0)).collect():
        assert a[r["doc_id"]]["y_true"] == r["y_true"] and abs(a[r["doc_id"]]["probs"][1] - r["probs"][1]) < 1e-9
