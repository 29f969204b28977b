"""Attribution on documents (tokens as arrays) gives the rows of attribution on token rows, without a shuffle of tokens."""

import pytest
from pyspark.sql import functions as F

from casestory.operators import actions as ac
from casestory.operators import attribute as at

BIAS = [0.0625, -0.0625]
TEXTS = ["the cat and The cat and THE Cat", "##ab ab ##ab x##y ##", None, "", " \t\n", "Straßenbahnen 😀😀😀😀😀😀 naïve", "a " * 300 + "extraordinarily a",
         "[SEP] [CLS] [PAD] the [SEP]s", "and the and of an is and"]
ACTIONS = ["the", "and the", "cat and The", "   ", "of an unknown", "extraordinarily a", "##AB ab"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def _rows(df):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()], key=str)


def _both(docs, steps=20):
    tw = at.with_weights(at.wordpiece_tokens(docs), weight_fn=lambda t: at.token_weights_expr(t))
    summary = at.doc_path_summary(tw, BIAS, steps)
    own = at.with_weights(at.document_tokens(docs), weight_fn=at.token_weights_expr)
    return at.token_attributions(tw, summary), summary, at.document_attributions(at.doc_path_summary(own, BIAS, steps))


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_tokens_and_words_of_documents(docs):
    rows, summary, own = _both(docs)
    assert _rows(at.token_rows(own)) == _rows(rows)
    assert _rows(own.select(*summary.columns)) == _rows(summary)
    words = at.word_rows(at.document_words(own))
    assert _rows(words) == _rows(at.word_attributions(rows).select("doc_id", "word", "score", "first_word_id"))
    assert _shuffles(words) == 0 and _shuffles(at.token_rows(own)) == 0


def test_pieces_of_any_length(docs):
    """The marked text splits as the words cut by hand do."""
    for piece in (1, 3, 4):
        got = {r["doc_id"]: r["tokens"] for r in at.document_tokens(docs, piece=piece).collect()}
        for no, text in enumerate(TEXTS):
            cut = [("##" if j else "") + w[j:j + piece] for w in (text or "").split() for j in range(0, len(w), piece)]
            assert got[no] == ["[CLS]", *cut, "[SEP]"]


def test_action_scores_of_documents(spark, docs):
    rows, summary, _ = _both(docs)
    hits = ac.phrase_hits(docs, spark.createDataFrame([(a,) for a in ACTIONS], "action string"))
    want = ac.action_scores(hits, at.word_attributions(rows))
    found = at.with_weights(at.document_tokens(ac.with_actions(docs, hits)), weight_fn=at.token_weights_expr)
    got = ac.document_action_scores(at.document_words(at.document_attributions(at.doc_path_summary(found, BIAS, 20))))
    assert want.count() >= 8 and _rows(got.drop("y_pred")) == _rows(want)
    assert _rows(ac.action_statistics(got)) == _rows(ac.action_statistics(want, summary))


def test_fold_scores_of_documents(docs):
    tokens = at.wordpiece_tokens(docs)
    want = at.fold_token_scores(tokens, at.fold_summaries(tokens, BIAS, [20], [0, 1, 2]), [0, 1, 2])
    got = at.document_fold_scores(at.document_tokens(docs), BIAS, 20, [0, 1, 2])
    assert _rows(got) == _rows(want) and _shuffles(got) == 0


def test_phrase_pairs_stay_with_their_texts(spark, monkeypatch):
    """A frequent word that leads to many phrases: its pairs with the texts are not shuffled, in one batch or several."""
    from casestory.operators import phrases as ph
    texts = [(i, f"x the w{i} the end") for i in range(60)]
    actions = [f"the w{i} the" for i in range(40)] + ["the", "e w"]
    d, p = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(a,) for a in actions], "action string")
    want = sorted((i, a) for i, x in texts for a in actions if a in x)
    for few in (ph.FEW, 7):
        monkeypatch.setattr(ph, "FEW", few)
        hits = ac.phrase_hits(d, p)
        assert sorted((r["doc_id"], r["action"]) for r in hits.collect()) == want
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        shuffled = [line for line in hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning" in line]
        assert "action" in plan and shuffled and all("doc_id" in line and "REPARTITION_BY_COL" in line for line in shuffled)


def test_texts_are_dealt_out_once_for_their_actions(spark, monkeypatch):
    """Hits are found on the exchange on which they meet their texts, in one batch or several."""
    from casestory.operators import phrases as ph
    texts = [(i, f"x the w{i} the end") for i in range(60)] + [(60, None), (None, "x the end"), (61, "none")]
    actions = [f"the w{i} the" for i in range(40)] + ["the", "e w"]
    d, p = spark.createDataFrame(texts, "doc_id long, text string").localCheckpoint(), spark.createDataFrame([(a,) for a in actions], "action string")
    want = {i: sorted(a for a in actions if a in x) for i, x in texts if i is not None and x and "the" in x}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (ph.FEW, 7):
            monkeypatch.setattr(ph, "FEW", few)
            found = ac.hit_documents(d, p)
            got = found.collect()
            assert {r["doc_id"]: sorted(r["actions"]) for r in got} == want and len(got) == len(want)
            plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            of_texts = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line and "REPARTITION_BY_COL" in line]
            dealt = [line for line in of_texts if "ReusedExchange" not in line]
            assert len(of_texts) > len(dealt) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_frequent_short_phrase_meets_every_text_once(spark):
    """Its many words would be as many rows to broadcast as the vocabulary has."""
    from casestory.operators import phrases as ph
    texts = spark.createDataFrame([(f"the the{i}a w{i} rare",) if i else ("the qux rare",) for i in range(50)], "__l string")
    phrases = spark.createDataFrame([("The",), ("qu",)], "action string")
    assert sorted((r["action"], r["word"], r["df"]) for r in ph.chosen_words(texts, phrases).collect()) == [("The", "", 50), ("qu", "qux", 1)]


def test_few_short_phrases_need_no_vocabulary(spark, monkeypatch):
    """Only the words that are probes are counted and written; beyond the limit the corpus's words are, with the same hits."""
    from casestory.operators import phrases as ph
    texts = [(i, f"The w{i} rare v{i} of an u{i} x{i}the") for i in range(200)] + [(200, None), (201, ""), (202, " OF AN"), (203, "qu \t")]
    actions = ["the", "of an", "W7 Rare v7", "qu", "", " ", "w1 of", "none of these words", None]
    d, p = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(a,) for a in actions], "action string")
    want = sorted((i, a) for i, x in texts if x is not None for a in actions if a is not None and a.lower() in x.lower())
    written = {}

    def stash(df, name, keep=ph.stash):
        out = keep(df, name)
        written[name] = out.count()
        return out
    monkeypatch.setattr(ph, "stash", stash)
    for few, short in ((ph.FEW, 32), (2, 32), (ph.FEW, 3)):
        monkeypatch.setattr(ph, "FEW", few)
        monkeypatch.setattr(ph, "SHORT", short, raising=False)
        written.clear()
        assert sorted((r["doc_id"], r["action"]) for r in ph.phrase_hits(d, p).collect()) == want
        assert ("inside" in written, written["words"] > 600) == ((False, False) if short > 3 else (True, True))
        assert short <= 3 or written["words"] <= 5  # "", "rare", "of", "these"


def test_batches_of_chosen_words_follow_each_other(spark, monkeypatch):
    """However many batches there are, one is broadcast at a time; a phrase of many words is one row of them."""
    from casestory.operators import phrases as ph
    texts = [(i, f"a{i}cat sat{i} on cat{i} Tom{i}y b{i}cat") for i in range(60)] + [(60, "cat  sat1"), (60, "cat sat1"), (61, None), (62, "scat sat")]
    actions = [f"cat sat{i}" for i in range(30)] + [f"om{i}y" for i in range(30)] + ["cat", "cat s", "at o", "cat ", " cat1", "t sat"]
    d, p = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(a,) for a in actions], "action string")
    want = sorted({(i, a) for i, x in texts if x is not None for a in actions if a.lower() in x.lower()})
    lowered = d.where("text is not null").selectExpr("lower(text) __l")
    monkeypatch.setattr(ph, "MANY", 20, raising=False)
    chosen = [tuple(r) for r in ph.chosen_words(lowered, p).select("action", "word").collect()]
    assert [w for a, w in chosen if a == "cat"] == [""]
    assert sorted(w for a, w in chosen if a == " cat1") == ["cat1", *(f"cat{k}" for k in range(10, 20))]  # words that start so
    assert [w for a, w in chosen if a == "om7y"] == ["tom7y"]
    for name, few in (("FEW", 40), ("FEW_BYTES", 600)):
        with monkeypatch.context() as m:
            m.setattr(ph, name, few, raising=False)
            hits = ph.phrase_hits(d, p)
            assert hits._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 1
            assert sorted((r["doc_id"], r["action"]) for r in hits.collect()) == want


def test_chart_reads_its_statistics_once(spark):
    stats = spark.createDataFrame([("class_1", "a", 2.0), ("class_0", "a", 4.0), ("class_1", "b", 3.0), ("class_0", "c", 9.0)], "class string, action string, mean_score double")
    chart = ac.chart_table(stats.localCheckpoint(), k=2)
    assert sorted(tuple(r) for r in chart.select("action", "rank", "lead_value", "other_value", "lead_scaled").collect()) == [("a", 2, 2.0, 4.0, 0.5), ("b", 1, 3.0, 0.0, 0.75)]
    assert chart._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_weights_of_a_function_make_no_arrays(docs):
    rows, summary, _ = _both(docs)
    weigh = at.token_weights_expr
    path = at.doc_path_summary(at.document_tokens(docs), BIAS, 20, weight_fn=weigh)
    own = at.document_attributions(path, weight_fn=weigh)
    assert _rows(at.token_rows(own)) == _rows(rows) and _rows(path.select(*summary.columns)) == _rows(summary)
    assert "w" not in path.columns
    assert "arrays_zip" not in own._jdf.queryExecution().optimizedPlan().toString()
