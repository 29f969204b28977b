import random
from collections import defaultdict

from casestory.llm import mixing as op
from casestory.llm import queries
from tests.llm.helpers import WORDS, frame, prose, rows_of


def brute_targets(sizes):
    """Water filling by rounds: cap what is above, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def sample():
    rng = random.Random(8)
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (None, "x y z", "b"), (4, " lead and trail \n", "only"), (5, " non break x", "ü")]
    for k in range(900):
        rows.append((10 + k, prose(rng, rng.randint(1, 60)), "hot" if k % 3 else f"s{k % 7}"))
    return rows + [(10, rows[6][1], "s0")] * 3 + [(2000, "long " * 50_000, "big")]


def test_against_the_contract(spark):
    rows = sample()
    got = op.mix(frame(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    assert sorted((r["id"] or -1, r["size"]) for r in got) == sorted((i or -1, len(WORDS.findall(t or ""))) for i, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) <= sum(want.values()) + 1e-6
    largest = {s: max(len(WORDS.findall(t or "")) for _, t, x in rows if x == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1


def test_order_is_that_of_a_single_sort(spark, monkeypatch):
    """Slices change nothing: one slice for all rows gives the same as many."""
    rows = sample()
    many = []
    for n in (50, 10**9):
        monkeypatch.setattr(op, "SLICE_ROWS", n)
        many.append(rows_of(op.mix(frame(spark, rows, 4)), "id", "source", "size", "taken"))
    assert many[0] == many[1]
    monkeypatch.setattr(op, "SLICE_ROWS", 100)
    assert rows_of(op.mix(frame(spark, list(reversed(rows)), 7)), "id", "source", "size", "taken") == many[0]


def test_targets(spark):
    for sizes in ({"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, "d": 100, None: 3}, {"x": 7}, {"x": 0, "y": 0}):
        got = {r["source"]: r["target"] for r in op.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in got)


def test_empty_table_and_stage(spark):
    assert op.mix(frame(spark, [])).count() == 0 and op.mixture(frame(spark, [])).count() == 0
    rows = sample()
    plain = sorted(((r["id"], r["taken"]) for r in op.mix(frame(spark, rows)).collect() if r["taken"]), key=repr)
    docs = frame(spark, rows).drop("size", "taken")
    out = op.mixture(docs)
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    assert sorted(((r["doc_id"], r["taken"]) for r in out.collect()), key=repr) == plain


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op10_mixing(spark, d)
    again = rows_of(got, *got.columns)
    assert again == rows_of(queries.op10_mixing(spark, d), *got.columns)
    sizes = {(r["doc_id"], len(WORDS.findall(r["text"] or ""))) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {(r["doc_id"], r["size"]) for r in got.collect()} == sizes
