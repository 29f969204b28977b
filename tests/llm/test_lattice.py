import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casestory.llm import lattice as op
from casestory.llm import queries
from tests.llm.helpers import frame, prose

PIECES = [b" ", b" a", b" ab", b"a", b"b", b"ab", b"ba", b"bab", b"c"]


def segmentations(word, pieces):
    """All ways to cut ``word`` into pieces, as lists of piece numbers."""
    if not word:
        return [[]]
    return [[k, *rest] for k, p in enumerate(pieces) if word.startswith(p) for rest in segmentations(word[len(p):], pieces)]


@pytest.fixture(scope="module")
def model():
    p = np.random.default_rng(1).random(len(PIECES))
    return op.Lattice(PIECES, np.log(p / p.sum())[None, :]), p / p.sum()


def test_marginal_is_the_sum_over_segmentations(model):
    lattice, p = model
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    want = [math.log(sum(math.prod(p[k] for k in s) for s in segmentations(b" " + w, PIECES))) for w in words]
    assert np.allclose(lattice.score(words)[0], want)
    assert np.allclose([lattice.score_long(b" " + w)[0] for w in words], want)
    assert np.isclose(lattice.score([b"ab" * 200])[0, 0], lattice.forward(lattice.arcs(np.frombuffer(b" " + b"ab" * 200, np.uint8)[None, :]), 1, 401)[-1][0, 0])


def test_expected_counts(model):
    lattice, p = model
    words, want = [b"abab", b"bab", b"cab"], np.zeros(len(PIECES))
    for w in words:
        ways = segmentations(b" " + w, PIECES)
        weights = [math.prod(p[k] for k in s) for s in ways]
        for s, x in zip(ways, weights):
            for k in s:
                want[k] += x / sum(weights)
    counts = np.zeros(len(PIECES))
    for _, data in op.grouped(words):
        lattice.expected(data, counts)
    assert np.allclose(counts, want)


def test_expected_counts_of_several_classes(model):
    """Classes together are as each alone, also where probabilities underflow and logarithms are summed."""
    rng = np.random.default_rng(4)
    logp = np.log(rng.dirichlet(np.ones(len(PIECES)), 3))
    for scores in (logp, logp - 60):
        both, words = op.Lattice(PIECES, scores), [bytes(rng.choice(list(b"abc"), 12).tolist()) for _ in range(40)]
        has, got = rng.random((40, 3)) < 0.4, np.zeros(logp.shape)
        for at, data in op.grouped(words):
            both.expected(data, got, has[at])
        for k in range(3):
            want, alone = np.zeros(len(PIECES)), op.Lattice(PIECES, scores[k:k + 1])
            for _, data in op.grouped([w for w, h in zip(words, has[:, k]) if h]):
                alone.expected(data, want)
            assert np.allclose(got[k], want) and want.sum() > 0


def test_expected_counts_of_a_long_word():
    """As the sums over matrices, class by class, and finite where the matrices' probabilities underflow."""
    rng = np.random.default_rng(5)
    logp = np.log(rng.dirichlet(np.ones(len(PIECES)), 3))
    lattice, has = op.Lattice(PIECES, logp), np.array([True, False, True])
    for size in (1, 9, 63, 2000):
        word = b" " + bytes(rng.choice(list(b"abc"), size).tolist())
        got, want = np.zeros(logp.shape), np.zeros(logp.shape)
        lattice.expected_long(word, got, has)
        lattice.expected(np.frombuffer(word, np.uint8)[None, :], want, has[None, :])
        assert np.allclose(got, want) and got[0].sum() > 0 and not got[1].any()


def test_long_words_train_the_pieces(spark, monkeypatch):
    """Words beyond the matrices' length count as if they were in a matrix."""
    table = spark.createDataFrame([(bytearray(b"ab" * 100), 1, 0), (bytearray(b"cab"), 1, 1), (bytearray(b"b" * 70), 0, 2), (bytearray(b""), 1, 1)], "word binary, c0 long, c1 long")
    got = op.train_pieces(table, PIECES, 2, rounds=2)
    monkeypatch.setattr(op, "LONG_WORD", 1000)
    assert np.allclose(got, op.train_pieces(table, PIECES, 2, rounds=2))
    assert got[0, PIECES.index(b"ab")] > got[0, PIECES.index(b"c")]


def test_broadcasts_hold_no_class_of_the_package(spark, monkeypatch):
    """Executors need not have the package, and broadcasts are pickled by reference."""
    held, real = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: held.append(pickle.dumps(value)) or real(value))
    op.document_scores(frame(spark, [(k, "a few words", "s") for k in range(9)]), classes=2, rounds=1).collect()
    assert len(held) >= 5 and not any(b"casestory" in h for h in held)


def test_words_seen_once_train_the_pieces(spark):
    """One round over the different words of each class, those that a class has once included."""
    words = {b"abab": (1, 0), b"bab": (0, 1), b"cab": (1, 1), b"ab": (2, 0), b"": (5, 5), b"ba": (0, 0)}
    table = spark.createDataFrame([(bytearray(w), *c) for w, c in words.items()], "word binary, c0 long, c1 long")
    got = op.train_pieces(table, PIECES, 2, rounds=1)
    start = 1.0 / np.arange(1, len(PIECES) + 2)
    for k in range(2):
        want = np.array([1e-3] * len(PIECES) + [1.0])
        for w in (w for w, c in words.items() if w and c[k]):
            ways = segmentations(b" " + w, PIECES)
            weights = [math.prod(start[j] / start.sum() for j in s) for s in ways]
            for s, x in zip(ways, weights):
                for j in s:
                    want[j] += x / sum(weights)
        assert np.allclose(got[k], np.log(want / want.sum()))


def test_probabilities_sum_to_at_most_one(model):
    """Words of up to 7 letters and the end share the mass of the start pieces."""
    lattice, p = model
    words = [b""]
    total = 0.0
    for _ in range(7):
        words = [w + c for w in words for c in (b"a", b"b", b"c")]
        total += np.exp(lattice.score(words)).sum()
    assert total < 1.0


def sample():
    rng = random.Random(3)
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n\t", "s"), (None, "w1 w2", "s"), (4, "W1 ÜBER é", "s"), (4, "W1 ÜBER é", "s"), (5, "x" * 5000 + " w1", "s")]
    rows += [(10 + k, prose(rng, rng.randint(0, 80), 60), "s") for k in range(80)] + [(200 + k, "hot hot copy", "s") for k in range(60)]
    return rows + [(999, "w1 w2\x0bw3 " * 20_000, "s")]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_against_brute_force(spark):
    """Every count, the base and the score, recomputed row by row from the trained pieces and classes."""
    rows, classes = sample(), 2
    found = [op.document_scores(frame(spark, rows), frequent=f, classes=classes).collect() for f in (5, op.FREQUENT)]
    kind = {r["id"]: r["class"] for r in found[0]}  # the class is the model's own choice
    counts, ends = [Counter() for _ in range(classes)], [0] * classes
    for i, t, _ in rows:
        if not held(i):
            counts[kind[i]].update(op.words_of(t))
            ends[kind[i]] += 1
    every = sum(counts, Counter())
    facts = [(sum(c.values()) + e, len(c) + (e > 0), sum(x == 1 for x in c.values()) + (e == 1), sum(x == 2 for x in c.values()) + (e == 2))
             for c, e in zip([every, *counts], [sum(ends), *ends])]
    pieces = op.read_pieces(op.VOCABULARY)
    table = spark.createDataFrame([(bytearray(w), *(c[w] for c in counts)) for w in every], "word binary, c0 long, c1 long")
    logp = op.train_pieces(table, pieces, classes)
    lattice, d0 = op.Lattice(pieces, logp), op.discount(*facts[0][2:])

    def token(w, k):
        c, ck, lp = (sum(ends), ends[k], logp[k, -1]) if w is None else (every[w], counts[k][w], lattice.score([w])[k, 0])
        (n, v, _, _), (nk, vk, n1, n2) = facts[0], facts[1 + k]
        p = 0.3 * max(c - d0, 0) / n + (0.7 + 0.3 * d0 * v / n) * math.exp(max(lp, -700))
        if nk:
            p = max(ck - op.discount(n1, n2), 0) / nk + op.discount(n1, n2) * vk / nk * p
        return math.log10((c + 1) / (n + v + 1)), math.log10(p)
    want = []
    for i, t, _ in rows:
        tokens = Counter([*op.words_of(t), None])
        each = {w: token(w, kind[i]) for w in tokens}
        want.append((i, held(i), sum(tokens.values()), sum(n for w, n in tokens.items() if w is None or every[w] > 0), facts[0][0],
                     sum(n * each[w][0] for w, n in tokens.items()), sum(n * each[w][1] for w, n in tokens.items())))
    for got in found:  # with nearly all words joined, and with nearly all looked up
        prior = {}
        for g, w in zip(sorted(map(tuple, got), key=repr), sorted(want, key=repr), strict=True):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
            if g[0] != 5:  # its long word underflows here
                prior.setdefault(g[7], g[6] - w[6])
                assert math.isclose(g[6], w[6] + prior[g[7]], rel_tol=1e-5, abs_tol=1e-4)
        assert math.isclose(sum(10**x for x in prior.values()), 1.0, abs_tol=0.02) or len(prior) < classes


def test_empty_and_untrained(spark):
    assert op.document_scores(frame(spark, [])).count() == 0
    only = next(i for i in range(100) if held(i))
    r = op.document_scores(frame(spark, [(only, "a word", "s")])).first()
    assert r["held_out"] and r["train_tokens"] == 0 and r["base_score"] == 0.0 and r["score"] < 0


def test_query_beats_the_base_on_held_out_rows(spark):
    """With enough text (10,000 rows); on a tenth of it the base, which is no distribution, is ahead."""
    df = queries.op1_lattice_likelihood(spark, "/root/testdata/sf0.1")
    r = df.where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens"), F.count("*")).first()
    assert r[1] > r[0] and r[3] > 1000
    assert df.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
