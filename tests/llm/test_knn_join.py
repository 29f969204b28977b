import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casestory.llm import knn_join as op
from casestory.llm import queries
from tests.llm.helpers import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, vec int, cell string, unit int, query_id string, rank int"


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, 0, "x", 1, "y", 2, "z", 3) for i, v in rows], SCHEMA).repartition(partitions)


def brute(rows, k, mod):
    fit = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
           if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(fit):
        if i is None or i % mod:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), j is None, j or 0, b) for b, (j, v) in enumerate(fit) if b != a)
        out += [(i, r, None if gone else j, -s) for r, (s, gone, j, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, k=5, mod=4, **kw):
    out = op.top_products(frame(spark, rows), F.col("query_id") % mod == 0, k, **kw)
    return rows_of(out, "query_id", "rank", "vec_id", "score")


def clustered(rng, n, dims=6, centres=5):
    middle = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize("kw", [{}, {"pivots": 8, "queries": 4, "chunk": 16}, {"pivots": 1, "queries": 7, "chunk": 50}])
def test_against_brute_force(spark, kw):
    rng = random.Random(3)
    rows = clustered(rng, 230)
    rows += [(1000 + i, rows[5][1]) for i in range(90)]  # one vector holds a quarter of the rows
    rows += [(8, rows[8][1]), (8, rows[8][1]), (400, None), (404, []), (408, [None, 1.0]), (412, [float("nan")] * 6), (416, [float("inf")] * 6),
             (420, [0.0] * 6), (424, [0.5, -0.5]), (None, rows[12][1]), (None, [9.0] * 6), (428, [-3.0] * 6)]
    assert found(spark, rows, **kw) == brute(rows, 5, 4)


def test_rows_far_from_a_cell_are_not_sent(spark):
    rng = random.Random(4)
    rows = clustered(rng, 600, dims=4, centres=6)
    every = op.quantised(frame(spark, rows), "vec_id", "embedding", 64)
    x = np.array([r["vec"] for r in every.collect()])
    space = op.Space(x[:6], float((x ** 2).sum(1).max()), int(np.abs(x).max()))
    d = space.distances(x, True)
    cell = d.argmin(1)
    width = 2 * np.sqrt(space.square) / op.BINS + space.slack
    steps = (d.min(1) / width).astype(int)
    counts = [(int(c), int(b), int(((cell == c) & (steps == b)).sum())) for c, b in {*zip(cell, steps)}]
    q = space.distances(x, False)
    near = q.argmin(1)
    asking = [(int(c), float(q[near == c, c].max()), int((near == c).sum())) for c in set(near)]
    for c, radius, bound, sent in op.bounds(space, counts, asking, 3, width):
        need = d[:, c] - radius <= bound + space.slack
        assert need.sum() <= sent  # the plan's estimate is an upper one
        for i in np.flatnonzero(near == c):  # the true neighbours are among the rows that are sent
            s = x @ x[i]
            s[i] = np.iinfo(s.dtype).min
            assert need[np.argsort(-s, kind="stable")[:3]].all()


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(2**22 + i), float(2**22 - 3 * i), 1.0]) for i in range(30)]
    assert found(spark, rows) == brute(rows, 5, 4)


def test_few_and_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0])]) == []
    assert found(spark, [(4, [1.0])]) == []
    assert found(spark, [(4, [1.0]), (5, [0.5])]) == [(4, 1, 5, 2048)]
    assert found(spark, [(4, []), (8, [])]) == [(4, 1, 8, 0), (8, 1, 4, 0)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = queries.op11_knn_join(spark, sf)
    assert [(c, t) for c, t in out.dtypes] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert rows_of(out, "query_id", "rank", "vec_id", "score") == brute(rows, 20, 20)
