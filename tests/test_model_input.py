from casestory.operators import attribute as at
from casestory.plans import catalog


def test_texts_keep_the_reference_length(spark):
    """510 pieces of a text stay."""
    m = at.model_input(spark.createDataFrame([(1, "word " * 600), (2, "word " * 100), (3, None)], "doc_id int, text string"), catalog.POSITIONS)
    got = {r["doc_id"]: (len(r["tokens"]), sum(r["mask"]), r["tokens"].count("word")) for r in m.collect()}
    assert got == {1: (512, 512, 510), 2: (512, 102, 100), 3: (512, 2, 0)}


def test_training_keeps_the_end(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k:03d}" for k in range(600))), (2, "a b"), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: [t for t, m in zip(r["tokens"], r["mask"]) if m] for r in at.model_input(docs, 512, side="left").collect()}
    assert got[1] == ["[CLS]", *[f"w{k:03d}" for k in range(90, 600)], "[SEP]"]
    assert got[2] == ["[CLS]", "a", "b", "[SEP]"] and got[3] == ["[CLS]", "[SEP]"]


def test_queries_keep_either_end(spark):
    d = "/root/testdata/sf0.001"
    first = {r["doc_id"]: r for r in catalog.q_model_input_full(spark, d).collect()}
    last = {r["doc_id"]: r for r in catalog.q_model_input(spark, d).collect()}
    assert first.keys() == last.keys() and all(len(r["tokens"].split(" ")) == 512 for r in [*first.values(), *last.values()])
    assert all(first[k]["n_real"] == last[k]["n_real"] for k in first)
    assert any(first[k]["tokens"] != last[k]["tokens"] for k in first)
    assert all(first[k]["tokens"] == last[k]["tokens"] for k in first if first[k]["n_real"] < 512)
