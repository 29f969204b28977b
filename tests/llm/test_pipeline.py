"""The pipeline against brute-force versions of its stages, on the smallest tables."""

from collections import defaultdict

import corpus_pipeline
from casestory.llm import toxicity
from tests.llm import test_exact_dedup, test_simhash, test_winnowing
from tests.llm.helpers import WORDS, frame

DIR = "/root/testdata/sf0.001"


def brute_kept(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: (r["doc_id"], r["text"], r["source"]) for r in docs.collect()}
    toxic = {r["id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r["score"] >= 0.3}  # itself held to labels elsewhere
    left = [r for i, r in rows.items() if i not in toxic]
    kept = {r[0] for r in test_exact_dedup.brute(left) if r[3]}
    left = [r for r in left if r[0] in kept]
    kept = {r[2] for r in test_simhash.brute(left)}
    left = [r for r in left if r[0] in kept]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in test_winnowing.brute(left, items) if not r[2]}
    return rows, toxic, [r for r in left if r[0] in clean]


def test_run(spark):
    rows, toxic, left = brute_kept(spark)
    out = corpus_pipeline.run(spark, DIR).collect()
    assert {r["doc_id"] for r in out} <= {r[0] for r in left} and len({r["doc_id"] for r in out}) == len(out)
    sizes = defaultdict(int)
    for _, t, s in left:
        sizes[s] += len(WORDS.findall(t or ""))
    taken = defaultdict(int)
    for r in out:
        assert rows[r["doc_id"]] == (r["doc_id"], r["text"], r["source"]) and r["source_size"] == sizes[r["source"]]
        assert r["size"] == len(WORDS.findall(r["text"])) and r["taken"] in (r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in {r["source"] for r in out}:
        target = next(r["target"] for r in out if r["source"] == s)
        assert abs(taken[s] - target) <= max(len(WORDS.findall(t or "")) for _, t, x in left if x == s) + 1


def test_stages_keep_columns_and_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "mixing"]
    extra = frame(spark, [(1, None, None), (None, "", "s"), (2, "some text here", "s"), (2, "some text here", "s")]).drop("size", "taken")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DIR).columns == docs.columns
        got = stage(spark, extra, DIR)
        assert got.columns == extra.columns and got.where("doc_id = 2").count() in (1, 2)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DIR).count() == 0
