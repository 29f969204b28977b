import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casestory.llm import queries
from casestory.llm import ranked_search as op
from tests.llm.helpers import ascii_lower, frame, prose, rows_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k):
    texts = [(i, Counter(TERM.findall(ascii_lower(t)))) for i, t, *_ in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n_docs, length = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in texts:
            m = 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(TERM.findall(ascii_lower(text))) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def sample():
    rng = random.Random(6)
    docs = [(1, None, "s"), (2, "", "s"), (3, " .,;", None), (None, "w1 w2 null id", "s"), (4, "W1 w2", "s"), (4, "W1 w2", "s"), (5, "only here", "s")]
    docs += [(10 + k, prose(rng, rng.randint(1, 80), 40 + k % 90), "s") for k in range(200)]
    docs += [(500 + k, "w1 w2 w3 copies", "hot") for k in range(120)]
    docs += [(900, "w5 " * 30_000 + "rare", "s"), (901, "Über-w1 straße_w2 w3'x", "s"), (-7, "w1 w2 w3 copies", "s")]
    items = [(k, prose(rng, rng.randint(1, 30), 60)) for k in range(20)]
    items += [(100, None), (101, ""), (102, "nowhere at all"), (103, "w1 w2 w3 copies"), (103, "rare w5"), (None, "ÜBER über straße"), (104, "w1 W1 w1")]
    return docs, items


@pytest.mark.parametrize("item_terms", [op.ITEM_TERMS, 60])
def test_against_brute_force(spark, item_terms):
    docs, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    found = op.search(frame(spark, docs), bench, 7, item_terms=item_terms)
    assert rows_of(found, "item", "rank", "doc", "score") == brute(docs, items, 7)


def test_small_blocks_give_the_same_rows(spark, monkeypatch):
    docs, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(op, "BLOCK_DOCS", 1)
    found = op.search(frame(spark, docs, 2), bench, 7)
    assert rows_of(found, "item", "rank", "doc", "score") == brute(docs, items, 7)


def test_accumulators_are_limited():
    """A common term makes no accumulators once it cannot reach the k-th partial score; the
    documents that have one still get its part."""
    n = 1000
    ids, rare = np.arange(n), np.arange(0, 40)
    doc = np.concatenate([rare, ids])
    term = np.concatenate([np.zeros(40, np.int64), np.ones(n, np.int64)])
    value = np.concatenate([100 + rare, 10 + ids % 7])
    block = op.Block(ids, doc, term, value)
    score, found, made = block.search(np.array([0, 1]), np.array([5, 1]), 10, 0)
    assert made == 40
    full = np.zeros(n, np.int64)
    np.add.at(full, doc, np.where(term == 0, 5, 1) * value)
    best = np.lexsort((ids, -full))[:10]
    assert found.tolist() == best.tolist() and score.tolist() == full[best].tolist()
    # a floor from earlier blocks that no new document reaches
    assert block.search(np.array([1]), np.array([1]), 10, 17)[2] == 0
    # equal bounds still make accumulators: a smaller id may win the tie
    assert block.search(np.array([1]), np.array([1]), 10, 16)[1].tolist() == list(range(6, 76, 7))


def test_empty_tables(spark):
    docs, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert op.search(frame(spark, docs), empty, 7).collect() == []
    assert op.search(frame(spark, []), bench, 7).collect() == []
    assert op.search(frame(spark, [(1, None, "s"), (2, "", "s")]), bench, 7).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = queries.op12_ranked_search(spark, sf)
    assert [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert rows_of(out, "item_id", "rank", "doc_id", "score") == brute(docs, items, 50)
