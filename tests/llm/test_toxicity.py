import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from casestory.llm import queries
from casestory.llm import toxicity as op
from tests.llm.helpers import frame, prose


def brute_segments(scores):
    """Maximal segments by their definition: the best segment, then the same left and right of it."""
    scores = list(scores)
    best = None
    for s in range(len(scores)):
        total = 0
        for e in range(s, len(scores)):
            total += scores[e]
            if total > 0 and (best is None or total > best[2]):
                best = (s, e + 1, total)
    if best is None:
        return []
    s, e, _ = best
    return brute_segments(scores[:s]) + [best] + [(e + a, e + b, v) for a, b, v in brute_segments(scores[e:])]


def test_maximal_segments():
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores = rng.normal(0, 1, rng.integers(0, 14))  # no ties, so the segments are unique
        got, want = op.maximal_segments(scores), brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([v for *_, v in got], [v for *_, v in want])


def test_maximal_segments_in_linear_time():
    # every segment of a falling sum stays; looking at all of them for each token would never end
    assert len(op.maximal_segments(np.tile([1.0, -2.0], 300_000))) == 300_000
    # rising sums merge into one, and a last high token takes all before it
    assert op.maximal_segments(np.tile([2.0, -1.0], 300_000)) == [(0, 599_999, 300_001.0)]
    assert op.maximal_segments(np.concatenate([np.tile([1.0, -2.0], 50_000), [1e6]])) == [(s, s + 1, 1.0) for s in range(0, 100_000, 2)] + [(100_000, 100_001, 1e6)]


def test_parts():
    assert op.log_odds(10, 0, 100, 900)[0] > 0 > op.log_odds(0, 10, 100, 900)[0] and abs(op.log_odds(10, 90, 100, 900)[0]) < 1e-2
    assert op.log_odds(10, 90, 100, 900)[1] < 1e-6 and op.log_odds(5, 0, 30, 270)[1] > op.SIGNIFICANT_ROOT
    drift, lam = op.background({0.0: 10_000, 2.0: 10})
    p = np.array([10_000, 10, 1]) / 10_011
    assert drift > 0 and abs((p * np.exp(lam * (np.array([0.0, 2.0, 1.0]) - drift))).sum() - 1) < 1e-6 or lam == 4.0
    a, b = op.logistic([(-10.0, 5, 995), (20.0, 98, 2)])
    sigmoid = lambda x: 1 / (1 + np.exp(-(a + b * x)))
    assert sigmoid(-10) < 0.05 and sigmoid(20) > 0.9


def sample(n=600, seed=3):
    """A twelfth is toxic: one to four of a few bad words, some inflected, in one passage."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = prose(rng, rng.randint(5, 150)).replace("w", "word").split()
        toxic = k % 12 == 0
        if toxic:
            at = rng.randint(0, len(words))
            words[at:at] = [rng.choice(["vilefoo", "nastybar", "grotbaz" + rng.choice("abcdefgh")]) for _ in range(rng.randint(2, 4))]
        rows.append((k, " ".join(words), f"s{k % 3}"))
        labels.append((k, 0, int(toxic)))
    return rows, labels


def test_held_out_rows_and_awkward_rows(spark):
    rows, labels = sample()
    rows += [(None, "vilefoo nastybar", "s"), (9001, None, "s"), (9002, "", None), (9003, "vilefoo " * 50_000, "hot"), (9003, "plain again", "hot"), (0, rows[0][1], "s0")]
    labels += [(None, 0, 1), (9004, 1, None), (0, 1, 1), (9999, 0, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    docs = frame(spark, rows)
    out = op.score(docs, op.fit(docs, lab)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    truth = {i: t for i, _, t in labels[:600]}
    held = [r for r in out if r["id"] in truth and zlib.crc32(str(r["id"]).encode()) % 4 == 2]
    hits = sum(r["score"] >= op.THRESHOLD for r in held if truth[r["id"]])
    false = sum(r["score"] >= op.THRESHOLD for r in held if not truth[r["id"]])
    toxic = sum(truth[r["id"]] for r in held)
    assert toxic > 8 and hits >= 0.9 * toxic and false <= 0.03 * len(held)
    by = {(r["id"], len(r["segments"])) for r in out if r["id"] in (None, 9001, 9002, 9003)}
    assert (9001, 0) in by and (9002, 0) in by and (9003, 1) in by and (None, 1) in by


def test_without_labels_or_rows(spark):
    rows, labels = sample(24)
    docs = frame(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r["score"] for r in op.score(docs, op.fit(docs, lab.limit(0))).collect()} == {0.5}
    assert len({r["score"] for r in op.score(docs, op.fit(docs, lab.where("toxic = 0"))).collect()}) == 1
    assert op.score(docs.limit(0), op.fit(docs.limit(0), lab)).count() == 0
    kept = op.accepted(docs, lab)
    assert kept.columns == docs.columns


def test_query(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op4_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("toxic"), F.sum(F.col("predicted") * (1 - F.col("toxic"))), F.count("*")).first()
    assert r[0] >= 0.6 * r[1] and r[2] <= 0.03 * r[3]
