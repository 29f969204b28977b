import random

import numpy as np
import xxhash

from casestory.llm import components, queries
from casestory.llm import simhash as op
from tests.llm.helpers import WORDS, ascii_lower, frame, prose, rows_of


def brute_print(text):
    w = WORDS.findall(ascii_lower(text))
    if not w:
        return 0
    grams = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_print(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    a = np.array(fps, dtype=np.uint64)
    for k in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:k] ^ a[k]) <= 4):
            root[find(k)] = find(int(j))
    least = {}
    for k, (i, _, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else (least[r] if i is None else min(least[r], i))
    return sorted(((i, f"{fps[k]:016x}", least[find(k)]) for k, (i, _, _) in enumerate(rows)), key=repr)


def sample():
    rng = random.Random(2)
    rows = [(1, None, "s"), (2, "", "s"), (3, " \t", "s"), (4, "one", "s"), (5, "One", "s"), (6, "a b c", "s"), (None, "a b c d", "s"), (7, "a b c d", "s")]
    for k in range(120):
        base = prose(rng, rng.randint(30, 400))
        rows.append((100 + 10 * k, base, "s"))
        for j in range(rng.randint(0, 3)):
            w = base.split()
            w[rng.randrange(len(w))] = "edit"
            rows.append((101 + 10 * k + j, " ".join(w), "s"))
    rows += [(5000 + k, "same text for a group of copies here", "hot") for k in range(100)] + [(5000, "same text for a group of copies here", "hot")]
    rows.append((9000, "long " * 30_000 + "end", "s"))
    return rows


def test_against_brute_force(spark):
    rows = sample()
    found = op.near_groups(frame(spark, rows), leaf=16)
    got = sorted(((r["id"], f"{r['fp'] & (2**64 - 1):016x}", r["component"]) for r in found.collect()), key=repr)
    assert got == brute(rows)


def test_trie_join_finds_all_links(spark):
    """Dense regions, small leaves: the links' components equal those of all pairs."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = {0, 2**64 - 1}
    for c in centres.tolist() * 40:
        for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
            c ^= 1 << b
        fps.add(c)
    a = np.array(sorted(fps), dtype=np.uint64)
    root = list(range(len(a)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for k in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:k] ^ a[k]) <= 4):
            root[find(k)] = find(int(j))
    signed = a.view(np.int64).tolist()
    groups = {}
    for k, fp in enumerate(signed):
        groups.setdefault(find(k), set()).add(fp)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for leaf in (4, 64, 100_000):
        got = {}
        for r in components.components(op.link_table(df, leaf=leaf)).collect():
            got.setdefault(r["root"], set()).add(r["node"])
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_links_in_a_task():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64) & np.uint64(0xFFF0000000000FFF))
    b = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64) & np.uint64(0xFFF0000000000FFF))
    got = sorted((int(x), int(y)) for i, j in op.links(a, b, False, 3, block=64) for x, y in zip(i, j))
    assert got == sorted((i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(b ^ a[i]) <= 3))
    got = sorted((int(x), int(y)) for i, j in op.links(a, a, True, 4) for x, y in zip(i, j))
    assert got == sorted((i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4) if i < j)


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(rows_of(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table_and_stage(spark):
    assert op.near_groups(frame(spark, [])).count() == 0 and op.representatives(frame(spark, [])).count() == 0
    rows = sample()
    kept = op.representatives(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted({r[2] for r in brute(rows)}, key=repr)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert rows_of(queries.op6_simhash(spark, d), "doc_id", "fingerprint", "component_id") == brute(docs)
