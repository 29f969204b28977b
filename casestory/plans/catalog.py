"""Query catalogue: one entry per operator, bound to the driver tables.

``QUERIES[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``. Every
query reads the given tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casestory.operators import stories as st
from casestory.operators import textgen, traces
from casestory.plans import oracle as O
from casestory.plans.bindings import dictionary_sql, event_dictionary, events_log, events_log_sql

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# ------------------------------------------------------------------ E1: stories

@register("stories_narrative", O.stories_sql("narrative"))
def q_stories_narrative(spark, sf):
    """W4 W5 J1 T1 T2 T3 T6 P5 P12 on the EV log: the flagship."""
    return st.stories(events_log(spark, sf), event_dictionary(spark), "narrative")


@register("stories_bullets", O.stories_sql("bullet_points"))
def q_stories_bullets(spark, sf):
    """T4 bullet form."""
    return st.stories(events_log(spark, sf), event_dictionary(spark), "bullet_points")


_EV = events_log_sql()


@register("translate_exact_ci", f"SELECT event_idx, activity_en FROM {O.translate_sql(_EV, 'activity', 'activity_en', 'exact_ci')}")
def q_translate_exact_ci(spark, sf):
    """J1."""
    return textgen.translate(events_log(spark, sf), event_dictionary(spark), mode="exact_ci") \
        .select("event_idx", "activity_en")


@register("translate_upper_ci", f"SELECT event_idx, activity_en FROM {O.translate_sql(_EV, 'activity', 'activity_en', 'upper_ci')}")
def q_translate_upper_ci(spark, sf):
    """J1b."""
    return textgen.translate(events_log(spark, sf), event_dictionary(spark), mode="upper_ci") \
        .select("event_idx", "activity_en")


@register("translate_exact", f"SELECT event_idx, activity_en FROM {O.translate_sql(_EV, 'activity', 'activity_en', 'exact')}")
def q_translate_exact(spark, sf):
    """J1c."""
    return textgen.translate(events_log(spark, sf), event_dictionary(spark), mode="exact") \
        .select("event_idx", "activity_en")


@register("activity_phrase", "SELECT event_idx, activity_en, phrase FROM "
          + O.phrase_sql(O.translate_sql(_EV, "activity", "activity_en"), "activity_en", "phrase"))
def q_activity_phrase(spark, sf):
    """J2 + T1 per event."""
    ev = textgen.translate(events_log(spark, sf), event_dictionary(spark))
    return textgen.with_activity_phrase(ev).select("event_idx", "activity_en", "phrase")


@register("case_metadata", f"SELECT * FROM {O.metadata_sql(_EV)}")
def q_case_metadata(spark, sf):
    """P4 P5 P6 P7."""
    return traces.case_metadata(events_log(spark, sf))


@register("log_statistics", f"""SELECT CAST(count(*) AS BIGINT) AS total_events,
  CAST(count(DISTINCT case_id) AS BIGINT) AS total_cases, CAST(count(DISTINCT activity) AS BIGINT) AS unique_activities,
  min(ts) AS ts_start, max(ts) AS ts_end FROM {_EV}""")
def q_log_statistics(spark, sf):
    """A1 (totals)."""
    return traces.log_statistics(events_log(spark, sf))


@register("class_by_case", f"""SELECT class_label, CAST(count(*) AS BIGINT) AS n_cases
  FROM (SELECT DISTINCT case_id, class_label FROM {_EV}) WHERE class_label IS NOT NULL GROUP BY class_label""")
def q_class_by_case(spark, sf):
    """A1 (class counts over distinct case/class pairs)."""
    return traces.class_distribution_by_case(events_log(spark, sf))


@register("event_order", f"""SELECT case_id, event_idx, CAST(row_number() OVER w - 1 AS INTEGER) AS row_position,
  round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0.0), 6) AS time_since_last,
  {O.delta_sql('min(ts) OVER (PARTITION BY case_id)', 'ts')} AS time_since_start
  FROM {events_log_sql('user', False)} WHERE ts IS NOT NULL
  WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_idx)""")
def q_event_order(spark, sf):
    """W1 W2 W3 W7 on the EU log (one case per user, raw timestamps)."""
    o = traces.event_order(events_log(spark, sf, "user", False))
    return o.select("case_id", "event_idx", F.col("row_position").cast("int").alias("row_position"),
                    F.round("time_since_last", 6).alias("time_since_last"), "time_since_start")


# ------------------------------------------------------------------ E4: prefixes

from casestory.operators import prefixes as px  # noqa: E402
from casestory.plans.bindings import stays  # noqa: E402


@register("stay_features", O.stay_features_sql())
def q_stay_features(spark, sf):
    """W1 W2 W3 W6 W7 P10 P11 on the stay log."""
    f = px.stay_features(stays(spark, sf))
    return f.select("stay_id", "row_idx", "row_position",
                    F.round("timesincelastevent", 6).alias("timesincelastevent"),
                    "timesincecasestart", "next_activity", "name_etc")


@register("prefix_pieces", O.pieces_sql())
def q_prefix_pieces(spark, sf):
    """Emitted, rendered pieces with run lists."""
    p = px.emitted_pieces(px.stay_features(stays(spark, sf)))
    return p.select("stay_id", "prefix_len", "row_idx", "piece")


@register("prefix_texts", O.prefixes_sql())
def q_prefix_texts(spark, sf):
    """Cumulative prefix texts with the stay label."""
    return px.prefix_texts(stays(spark, sf))


@register("temporal_split", O.temporal_split_sql())
def q_temporal_split(spark, sf):
    """First 66 % of stays by start time go to train."""
    return px.temporal_split(stays(spark, sf))


@register("temporal_split_rows", f"""WITH sp AS ({O.temporal_split_sql()})
SELECT sp.split, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT s.stay_id) AS BIGINT) AS n_stays
FROM {__import__('casestory.plans.bindings', fromlist=['x']).stays_sql()} s JOIN sp USING (stay_id) GROUP BY sp.split""")
def q_temporal_split_rows(spark, sf):
    """Rows of train and test stays by semi / anti join on the split ids."""
    s = stays(spark, sf)
    tr, te = px.split_rows(s, px.temporal_split(s))
    def summ(d, name):
        return d.agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("n_rows"),
                     F.countDistinct("stay_id").alias("n_stays"))
    return summ(tr, "train").unionByName(summ(te, "test"))


# ------------------------------------------------------------------ T9-T12: tokens

from casestory.operators import tokens as tk  # noqa: E402
from casestory.plans.bindings import table  # noqa: E402


def benchmark_dictionary(spark, sf):
    """Phrase dictionary from ``benchmark``: key 'item N' -> the whole passage text."""
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").cast("int").alias("pos"),
                    F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("src"),
                    F.col("text").alias("dst"))


_BENCH_TOKENS_SQL = """(SELECT CAST(row_number() OVER (ORDER BY length(dst) DESC, first_pos) AS INTEGER) AS token_no,
    printf('[CLIN_%03d]', row_number() OVER (ORDER BY length(dst) DESC, first_pos)) AS token,
    dst AS phrase, src, CAST(length(dst) AS INTEGER) AS length, first_pos
  FROM (SELECT text AS dst, CAST(min(item_id) AS INTEGER) AS first_pos,
          arg_max('item ' || CAST(item_id AS VARCHAR), item_id) AS src FROM benchmark GROUP BY text))"""


@register("token_dictionary", f"SELECT * FROM {_BENCH_TOKENS_SQL}")
def q_token_dictionary(spark, sf):
    """T9 on the benchmark passages."""
    return tk.token_dictionary(benchmark_dictionary(spark, sf)).select(
        F.col("token_no").cast("int"), "token", "phrase", "src", F.col("length").cast("int"), "first_pos")


@register("token_replace", f"""WITH t AS {_BENCH_TOKENS_SQL},
arr AS (SELECT list({{'p': phrase, 't': token}} ORDER BY token_no) AS l FROM t)
SELECT d.doc_id, list_reduce(list_prepend({{'p': '', 't': ''}}, arr.l),
  lambda acc, x: CASE WHEN x.p = '' THEN acc ELSE {{'p': replace(acc.p, x.p, x.t), 't': ''}} END,
  {{'p': d.text, 't': ''}}).p AS text_tokens
FROM documents d, arr""")
def q_token_replace(spark, sf):
    """Benchmark passages in the documents replaced by their tokens, longest first."""
    toks = tk.token_dictionary(benchmark_dictionary(spark, sf))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tk.replace_with_tokens(docs, toks, "text", "text_tokens").select("doc_id", "text_tokens")


@register("token_lookup", f"""WITH t AS {_BENCH_TOKENS_SQL}
SELECT printf('[CLIN_%03d]', b.item_id) AS token, t.phrase AS interpretation
FROM benchmark b LEFT JOIN t ON t.token = printf('[CLIN_%03d]', b.item_id)""")
def q_token_lookup(spark, sf):
    """Token -> phrase for the token names of every benchmark id (unknown -> null)."""
    toks = tk.token_dictionary(benchmark_dictionary(spark, sf))
    probe = table(spark, sf, "benchmark").select(F.format_string(tk.TOKEN_FORMAT, F.col("item_id")).alias("token"))
    return tk.token_lookup(probe, toks).select("token", "interpretation")


@register("token_summary", f"""WITH t AS {_BENCH_TOKENS_SQL}
SELECT CAST(count(*) AS BIGINT) AS total_tokens, arg_min(phrase, (-length, token_no)) AS longest_procedure,
  arg_min(phrase, (length, token_no)) AS shortest_procedure,
  (SELECT string_agg(token || ': ' || phrase || ' (' || CAST(length AS VARCHAR) || ')', ' | ' ORDER BY token_no)
     FROM (SELECT * FROM t ORDER BY token_no LIMIT 5)) AS examples,
  CAST(count(*) AS VARCHAR) || '/' || (SELECT CAST(count(*) AS VARCHAR) FROM benchmark) || ' (100%)' AS coverage
FROM t""")
def q_token_summary(spark, sf):
    """T12."""
    d = benchmark_dictionary(spark, sf)
    return tk.token_summary(tk.token_dictionary(d), d)


@register("stories_tokens", f"""WITH t AS (SELECT dst AS phrase, printf('[CLIN_%03d]', row_number() OVER (ORDER BY length(dst) DESC, min(pos))) AS token,
  row_number() OVER (ORDER BY length(dst) DESC, min(pos)) AS token_no FROM {dictionary_sql()} GROUP BY dst),
arr AS (SELECT list({{'p': phrase, 't': token}} ORDER BY token_no) AS l FROM t),
st AS ({O.stories_sql("narrative")})
SELECT case_id, list_reduce(list_prepend({{'p': '', 't': ''}}, arr.l),
  lambda acc, x: CASE WHEN x.p = '' THEN acc ELSE {{'p': replace(acc.p, x.p, x.t), 't': ''}} END,
  {{'p': story_text, 't': ''}}).p AS story_text, language, label FROM st, arr""")
def q_stories_tokens(spark, sf):
    """T6 with T10: stories whose dictionary phrases are replaced by tokens."""
    d = event_dictionary(spark)
    return st.stories(events_log(spark, sf), d, "narrative", token_dict=tk.token_dictionary(d))


# ------------------------------------------------------------------ D2-D5, J4: splits

from casestory.operators import splits as sp  # noqa: E402


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label")


def _alloc_sql(take: str, src: str) -> str:
    """Per-class take counts by largest remainder (integer arithmetic)."""
    return f"""(WITH c AS (SELECT label, count(*) AS n_c FROM {src} GROUP BY label),
t AS (SELECT *, sum(n_c) OVER () AS n, n_c * ({take}) AS num FROM c),
u AS (SELECT *, num // n AS base, num % n AS rem FROM t),
v AS (SELECT *, ({take}) - sum(base) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, label) AS r FROM u)
SELECT label, base + CASE WHEN r <= lft THEN 1 ELSE 0 END AS take FROM v)"""


def _strat_sql(src: str, test_size: float, salt: str = "") -> str:
    take = f"CAST(ceil((SELECT count(*) FROM {src}) * {test_size}) AS BIGINT)"
    return f"""(SELECT r.vec_id, r.label, CASE WHEN r.rk <= a.take THEN 'test' ELSE 'train' END AS split FROM
  (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42{salt}'), vec_id) AS rk
   FROM {src}) r JOIN {_alloc_sql(take, src)} a USING (label))"""


@register("stratified_split", f"SELECT * FROM {_strat_sql('embeddings', 0.2)}")
def q_stratified_split(spark, sf):
    """20 % test, stratified by label, seed 42."""
    return sp.stratified_split(_emb(spark, sf), "vec_id", "label", 0.2, 42)


@register("train_val_test_split", f"""WITH s1 AS {_strat_sql('embeddings', 0.2)},
rest AS (SELECT vec_id, label FROM s1 WHERE split = 'train'),
s2 AS {_strat_sql('rest', 0.1 / (1 - 0.2), 'v')}
SELECT * FROM s1 WHERE split = 'test'
UNION ALL SELECT vec_id, label, CASE WHEN split = 'test' THEN 'val' ELSE 'train' END FROM s2""")
def q_train_val_test_split(spark, sf):
    """D3: test 20 %, validation 10 %."""
    return sp.train_val_test_split(_emb(spark, sf), "vec_id", "label", 0.2, 0.1, 42)


@register("stratified_kfold", """SELECT vec_id, label, CAST((off + rk - 1) % 5 AS INTEGER) AS fold FROM
  (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42'), vec_id) AS rk
   FROM embeddings) r
  JOIN (SELECT label, coalesce(sum(n_c) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
        FROM (SELECT label, count(*) AS n_c FROM embeddings GROUP BY label)) o USING (label)""")
def q_stratified_kfold(spark, sf):
    """5 stratified folds."""
    return sp.stratified_kfold(_emb(spark, sf), "vec_id", "label", 5, 42)


@register("kfold_plain", """WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42'), vec_id) - 1 AS p,
  count(*) OVER () AS n FROM embeddings),
q AS (SELECT *, n // 5 AS q, n % 5 AS rem FROM r)
SELECT vec_id, CAST(CASE WHEN p < (q + 1) * rem THEN p // (q + 1) ELSE rem + (p - (q + 1) * rem) // q END AS INTEGER) AS fold FROM q""")
def q_kfold_plain(spark, sf):
    """Plain shuffled 5-fold."""
    return sp.kfold(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 5, True, 42)


@register("kfold_union_train_val", f"""WITH s1 AS {_strat_sql('embeddings', 0.2)},
r AS (SELECT vec_id, label FROM s1 WHERE split = 'train'),
k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42'), vec_id) AS rk FROM r),
o AS (SELECT label, coalesce(sum(n_c) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM (SELECT label, count(*) AS n_c FROM r GROUP BY label))
SELECT k.vec_id, k.label, CAST((o.off + k.rk - 1) % 5 AS INTEGER) AS fold FROM k JOIN o USING (label)""")
def q_kfold_union(spark, sf):
    """K-fold over train and validation rows together, the test rows held out."""
    tvt = sp.train_val_test_split(_emb(spark, sf), "vec_id", "label", 0.2, 0.1, 42)
    return sp.train_val_folds(tvt, "vec_id", "label", 5, 42)


@register("label_encode", f"""WITH s AS {_strat_sql('embeddings', 0.2)},
m AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id
      FROM (SELECT DISTINCT label FROM s WHERE split = 'train'))
SELECT s.vec_id, s.split, m.label_id FROM s JOIN m USING (label)""")
def q_label_encode(spark, sf):
    """Train labels sorted -> 0..n-1, applied to train and test."""
    s = sp.stratified_split(_emb(spark, sf), "vec_id", "label", 0.2, 42)
    tr, te, _ = sp.encode_labels(s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test"))
    return tr.unionByName(te).select("vec_id", "split", "label_id")


# ------------------------------------------------------------------ A2-A15, M3: metrics

from casestory.operators import metrics as mt  # noqa: E402
from casestory.plans.bindings import (BINARY_PREDS_SQL, FOLD_LOGITS_SQL, binary_preds,  # noqa: E402
                                      fold_logits)

_MULTI_SQL = f"(SELECT id, y_true, {O.argmax_sql('logits')} AS y_pred FROM {FOLD_LOGITS_SQL})"


def _multi(spark, sf):
    """Multi-class predictions of all folds: argmax of the logits (M3)."""
    return fold_logits(spark, sf).select(
        "id", "y_true", mt.argmax(F.col("logits")).alias("y_pred"))


def _r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("class_distribution", """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
g AS (SELECT CAST(range AS INTEGER) AS label FROM range(0, (SELECT max(label) + 1 FROM embeddings)))
SELECT g.label, CAST(coalesce(c.n, 0) AS BIGINT) AS count,
  round(coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER () * 100, 6) AS percentage,
  round(max(coalesce(c.n, 0)) OVER () / greatest(coalesce(c.n, 0), 1), 6) AS imbalance_ratio
FROM g LEFT JOIN c USING (label)""")
def q_class_distribution(spark, sf):
    """A2 on the embedding labels (10 classes)."""
    return _r6(mt.class_distribution(_emb(spark, sf)))


def _weights_sql(method):
    raw = "n / (k * c)" if method == "balanced" else "sqrt(n / c)"
    return f"""WITH s AS (SELECT count(*) AS n, max(label) + 1 AS k FROM embeddings),
g AS (SELECT CAST(range AS INTEGER) AS label FROM range(0, (SELECT k FROM s))),
c AS (SELECT label, count(*) AS c FROM embeddings GROUP BY label),
w AS (SELECT g.label, greatest(coalesce(c.c, 0), 1) AS c, s.n, s.k FROM g LEFT JOIN c USING (label), s),
r AS (SELECT label, {raw} AS w, k FROM w)
SELECT label, round(w * k / sum(w) OVER (), 6) AS weight FROM r"""


@register("class_weights_balanced", _weights_sql("balanced"))
def q_class_weights_balanced(spark, sf):
    """A3 balanced."""
    return _r6(mt.class_weights(_emb(spark, sf), "label", "balanced"))


@register("class_weights_sqrt", _weights_sql("sqrt"))
def q_class_weights_sqrt(spark, sf):
    """A3 sqrt."""
    return _r6(mt.class_weights(_emb(spark, sf), "label", "sqrt"))


@register("class_weights_present", """WITH c AS (SELECT toxic AS label, count(*) AS c FROM labels GROUP BY toxic),
w AS (SELECT label, sum(c) OVER () / (count(*) OVER () * c) AS w FROM c)
SELECT CAST(g.range AS INTEGER) AS label, round(coalesce(w.w, 1.0), 6) AS weight FROM range(2) g LEFT JOIN w ON w.label = g.range""")
def q_class_weights_present(spark, sf):
    """A3b on the toxic labels."""
    return _r6(mt.class_weights_present(table(spark, sf, "labels").select(F.col("toxic").alias("label"))))


@register("confusion_binary", f"SELECT * FROM {O.confusion_sql(BINARY_PREDS_SQL)}")
def q_confusion_binary(spark, sf):
    """A4 on binary predictions."""
    return mt.confusion(binary_preds(spark, sf))


@register("confusion_multiclass", f"SELECT * FROM {O.confusion_sql(_MULTI_SQL)}")
def q_confusion_multiclass(spark, sf):
    """A4 on 10-class predictions."""
    return mt.confusion(_multi(spark, sf))


@register("per_class_metrics", f"SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, "
          f"round(f1, 6) AS f1, support FROM {O.per_class_sql(_MULTI_SQL)}")
def q_per_class_metrics(spark, sf):
    """A6 per-class precision/recall/F1/support."""
    return _r6(mt.per_class(mt.confusion(_multi(spark, sf))).select("label", "precision", "recall", "f1", "support"))


for _avg, _src in (("binary", "binary"), ("macro", "multi"), ("weighted", "multi")):
    def _mk(avg=_avg, src=_src):
        def fn(spark, sf):
            p = binary_preds(spark, sf) if src == "binary" else _multi(spark, sf)
            return _r6(mt.summary_metrics(mt.confusion(p), avg))
        fn.__doc__ = f"A5 A8 A10 with average={avg}"
        return fn
    _sql = O.summary_sql(BINARY_PREDS_SQL if _src == "binary" else _MULTI_SQL, _avg)
    _cols = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc", "cohen_kappa",
             "class1_focused_score", "recall_class1", "recall_class0"]
    register(f"metrics_{_avg}", "SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in _cols)
             + f" FROM ({_sql})")(_mk())


@register("classification_report", f"""WITH pc AS {O.per_class_sql(_MULTI_SQL)}
SELECT CAST(label AS VARCHAR) AS row, label AS ord, round(precision, 4) AS precision, round(recall, 4) AS recall,
  round(f1, 4) AS f1, support FROM pc
UNION ALL SELECT 'accuracy', 1000001, NULL, NULL, round(sum(tp) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'macro avg', 1000002, round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', 1000003, round(sum(precision * support) / sum(support), 4),
  round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM pc""")
def q_classification_report(spark, sf):
    """Report rows rounded to 4 digits."""
    return mt.classification_report(mt.confusion(_multi(spark, sf)))


@register("roc_auc", f"""WITH p AS {BINARY_PREDS_SQL},
g AS (SELECT score, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y_true <> 1 THEN 1 ELSE 0 END) AS neg
      FROM p GROUP BY score),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN NULL ELSE sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) END, 6) AS auc_roc FROM c""")
def q_roc_auc(spark, sf):
    """Exact AUC of document length as a score for the toxic label."""
    return _r6(mt.roc_auc(binary_preds(spark, sf)))


@register("plain_accuracy", f"""SELECT CAST(sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  CAST(count(*) AS BIGINT) AS total, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {_MULTI_SQL}""")
def q_plain_accuracy(spark, sf):
    """A12."""
    return _r6(mt.plain_accuracy(_multi(spark, sf)))


@register("softmax_argmax", f"""SELECT id, fold, {O.argmax_sql('logits')} AS y_pred,
  round(list_max({O.softmax_sql('logits')}), 6) AS p_max,
  round(list_sum({O.softmax_sql('logits')}), 6) AS p_sum FROM {FOLD_LOGITS_SQL}""")
def q_softmax_argmax(spark, sf):
    """M3: probabilities (max and sum shown) and argmax per fold row."""
    fl = fold_logits(spark, sf).withColumn("p", mt.softmax(F.col("logits")))
    return _r6(fl.select("id", "fold", mt.argmax(F.col("logits")).alias("y_pred"),
                         F.array_max("p").alias("p_max"),
                         F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("p_sum")))


def _focal_sql(alpha_list, clamp=True, reduction="mean"):
    p = f"{O.softmax_sql('logits')}[y_true + 1]"
    pt = f"least(greatest({p}, 1e-8), 1.0)" if clamp else p
    a = "1.0" if alpha_list is None else "[" + ", ".join(str(float(x)) for x in alpha_list) + "][y_true + 1]"
    loss = f"-({a}) * pow(1 - {pt}, 2.0) * ln({pt})"
    agg = "avg" if reduction == "mean" else "sum"
    return f"SELECT round({agg}({loss}), 6) AS loss FROM {FOLD_LOGITS_SQL}"


@register("focal_loss_mean", _focal_sql(None))
def q_focal_loss_mean(spark, sf):
    """Focal loss, gamma 2, no alpha, mean."""
    fl = fold_logits(spark, sf)
    return _r6(mt.focal_loss(fl, alpha=None, gamma=2.0, reduction="mean"))


@register("focal_loss_alpha_sum", _focal_sql([0.05 * (i + 1) for i in range(10)], True, "sum"))
def q_focal_loss_alpha_sum(spark, sf):
    """Focal loss with a per-class alpha list, sum."""
    fl = fold_logits(spark, sf)
    return _r6(mt.focal_loss(fl, alpha=[0.05 * (i + 1) for i in range(10)], gamma=2.0, reduction="sum"))


@register("focal_loss_binary_ce", f"""SELECT round(avg(-([0.25, 0.75][y_true + 1]) * pow(1 - p, 2.0) * ln(p)), 6) AS loss FROM
  (SELECT toxic AS y_true, {O.softmax_sql("[0.0, CAST(n_chars AS DOUBLE) / 1000.0]")}[toxic + 1] AS p
   FROM labels JOIN documents USING (doc_id))""")
def q_focal_loss_binary_ce(spark, sf):
    """Cross-entropy form, alpha [0.25, 0.75], logits [0, length/1000]."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        F.col("toxic").alias("y_true"),
        F.array(F.lit(0.0), F.col("n_chars").cast("double") / 1000.0).alias("logits"))
    return _r6(mt.focal_loss(d, alpha=[0.25, 0.75], gamma=2.0, reduction="mean", clamp=False))


@register("weighted_cross_entropy", f"""WITH w AS ({_weights_sql('balanced').replace('round(w * k / sum(w) OVER (), 6)', 'w * k / sum(w) OVER ()')}),
f AS (SELECT y_true, -ln({O.softmax_sql('logits')}[y_true + 1]) AS nll FROM {FOLD_LOGITS_SQL})
SELECT round(sum(w.weight * f.nll) / sum(w.weight), 6) AS loss FROM f JOIN w ON w.label = f.y_true""")
def q_weighted_cross_entropy(spark, sf):
    """A14 with A3 balanced weights."""
    fl = fold_logits(spark, sf)
    w = mt.class_weights(_emb(spark, sf), "label", "balanced")
    return _r6(mt.weighted_cross_entropy(fl, w))


@register("epoch_loss", """SELECT run, fold, epoch,
  round(list_reduce(list(bm ORDER BY batch), lambda a, x: a + x, 0.0) / count(*) / 100.0, 6) AS epoch_loss FROM
  (SELECT user_id % 10 AS run, 0 AS fold, CAST(dayofmonth(ts) AS INTEGER) AS epoch, CAST(hour(ts) AS INTEGER) AS batch,
          avg(CAST(round(value * 100) AS DOUBLE)) AS bm FROM events GROUP BY ALL) GROUP BY run, fold, epoch""")
def q_epoch_loss(spark, sf):
    """Mean of batch means (runs = user_id mod 10, epoch = day, batch = hour, loss = value)."""
    e = table(spark, sf, "events").select((F.col("user_id") % 10).alias("run"), F.lit(0).alias("fold"),
                                          F.dayofmonth("ts").alias("epoch"), F.hour("ts").alias("batch"),
                                          F.round(F.col("value") * 100).cast("double").alias("loss"))
    # loss in whole cents: batch sums are exact integers, so no summation-order noise
    return mt.epoch_loss(e).withColumn("epoch_loss", F.round(F.col("epoch_loss") / 100.0, 6))


# ------------------------------------------------------------------ E1 on the order log

from casestory.plans.bindings import orders_log, orders_log_sql  # noqa: E402


@register("stories_orders", O.stories_sql("narrative", orders_log_sql()))
def q_stories_orders(spark, sf):
    """E1 on lineitem x orders: one story per order, one event per shipped line."""
    return st.stories(orders_log(spark, sf), event_dictionary(spark), "narrative", bucket_seconds=30 * 86400)


# ------------------------------------------------------------------ W13-W15, A11, M10

from casestory.operators import history as hs  # noqa: E402
from casestory.plans.bindings import EPOCH_HISTORY_SQL, epoch_history  # noqa: E402


@register("best_so_far", f"""WITH h AS {EPOCH_HISTORY_SQL},
p AS (SELECT *, max(balanced_accuracy) OVER (PARTITION BY run, fold ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM h),
q AS (SELECT *, coalesce(balanced_accuracy > pb, true) AS improved,
        max(balanced_accuracy) OVER (PARTITION BY run, fold) AS best_value FROM p)
SELECT run, fold, epoch, improved, round(CASE WHEN improved AND pb IS NOT NULL THEN balanced_accuracy - pb END, 6) AS delta,
  round(best_value, 6) AS best_value,
  min(CASE WHEN balanced_accuracy = best_value THEN epoch END) OVER (PARTITION BY run, fold) AS best_epoch,
  CAST(sum(CAST(improved AS INTEGER)) OVER (PARTITION BY run, fold) AS BIGINT) AS n_updates FROM q""")
def q_best_so_far(spark, sf):
    """W13 on balanced accuracy (mode max)."""
    b = hs.best_so_far(epoch_history(spark, sf), "balanced_accuracy", "max")
    return b.select("run", "fold", "epoch", "improved", F.round("delta", 6).alias("delta"),
                    F.round("best_value", 6).alias("best_value"), "best_epoch", F.col("n_updates").cast("long"))


def _es_sql(patience=3, min_delta=0.01, thr=1.15, rp=3):
    return f"""WITH h AS {EPOCH_HISTORY_SQL},
g AS (SELECT run, fold, list({{'epoch': epoch, 'v': val_loss, 't': train_loss}} ORDER BY epoch) AS l FROM h GROUP BY run, fold),
r AS (SELECT run, fold, list_reduce(l, lambda s, x: CASE WHEN s.stopped THEN s ELSE (
  WITH_PLACEHOLDER) END,
  {{'best': CAST('inf' AS DOUBLE), 'best_epoch': -1, 'wait': 0, 'viol': 0, 'trigger': -1, 'stopped': false,
    'reason': CAST(NULL AS VARCHAR), 'n': 0}}) AS s FROM g)
SELECT run, fold, s.stopped AS stopped, s.trigger AS trigger_epoch, round(s.best, 6) AS best_val_loss,
  s.best_epoch AS best_epoch, s.wait AS wait_count, s.viol AS ratio_violations, s.reason AS reason, s.n AS epochs_seen,
  CASE WHEN NOT s.stopped THEN NULL WHEN s.best_epoch >= 0 THEN s.best_epoch ELSE greatest(0, s.trigger - {patience} + 1) END
    AS restored_epoch FROM r"""


def _es_step(patience=3, min_delta=0.01, thr=1.15, rp=3):
    imp = f"(x.v < s.best - {min_delta})"
    wait = f"(CASE WHEN {imp} THEN 0 ELSE s.wait + 1 END)"
    viol0 = f"(CASE WHEN {imp} THEN 0 ELSE s.viol END)"
    ratio = "(CASE WHEN x.v > 0 THEN x.t / x.v ELSE 0.0 END)"
    viol = f"(CASE WHEN x.t IS NULL THEN {viol0} WHEN {ratio} < {thr} THEN 0 ELSE {viol0} + 1 END)"
    stop = f"({wait} >= {patience} OR {viol} >= {rp})"
    return (f"{{'best': CASE WHEN {imp} THEN x.v ELSE s.best END, "
            f"'best_epoch': CASE WHEN {imp} THEN x.epoch ELSE s.best_epoch END, 'wait': {wait}, 'viol': {viol}, "
            f"'trigger': CASE WHEN {stop} THEN x.epoch ELSE -1 END, 'stopped': {stop}, "
            f"'reason': CASE WHEN {wait} >= {patience} THEN 'patience' WHEN {viol} >= {rp} THEN 'loss_ratio' END, "
            f"'n': s.n + 1}}")


@register("early_stopping", _es_sql().replace("WITH_PLACEHOLDER", _es_step()))
def q_early_stopping(spark, sf):
    """W14 + W15: patience 3, min delta 0.01, loss-ratio rule 1.15 / 3."""
    r = hs.early_stopping(epoch_history(spark, sf), patience=3, min_delta=0.01, use_loss_ratio=True,
                          loss_ratio_threshold=1.15, loss_ratio_patience=3)
    return r.withColumn("best_val_loss", F.round("best_val_loss", 6))


def _es2_sql(patience=3, min_delta=0.01, thr=1.15, rp=2):
    first, better = "(s.best IS NULL)", f"coalesce(x.v < s.best - {min_delta}, false)"
    imp = f"({first} OR {better})"
    counter = f"(CASE WHEN {first} THEN s.counter WHEN {better} THEN 0 ELSE s.counter + 1 END)"
    ok = "coalesce(x.t > 0 AND x.v > 0, false)"
    high = f"({ok} AND x.v / x.t > {thr})"
    rc = f"(CASE WHEN NOT {ok} THEN s.rc WHEN {high} THEN s.rc + 1 ELSE 0 END)"
    by_ratio, by_score = f"({high} AND {rc} >= {rp})", f"(NOT {imp} AND {counter} >= {patience})"
    return f"""WITH h AS {EPOCH_HISTORY_SQL},
g AS (SELECT run, fold, list({{'epoch': epoch, 'v': val_loss, 't': train_loss}} ORDER BY epoch) AS l FROM h GROUP BY run, fold),
r AS (SELECT run, fold, list_reduce(l, lambda s, x: CASE WHEN s.stop_epoch >= 0 THEN s ELSE {{
    'best': CASE WHEN {imp} THEN x.v ELSE s.best END, 'best_epoch': CASE WHEN {imp} THEN x.epoch ELSE s.best_epoch END,
    'counter': {counter}, 'rc': {rc}, 'stop_epoch': CASE WHEN {by_ratio} OR {by_score} THEN x.epoch ELSE -1 END,
    'reason': CASE WHEN {by_ratio} THEN 'loss_ratio_overfitting' WHEN {by_score} THEN 'no_improvement' END}} END,
  {{'best': CAST(NULL AS DOUBLE), 'best_epoch': -1, 'counter': 0, 'rc': 0, 'stop_epoch': -1, 'reason': CAST(NULL AS VARCHAR)}}) AS s FROM g)
SELECT run, fold, s.stop_epoch >= 0 AS stopped, s.stop_epoch AS stop_epoch, round(s.best, 6) AS best_score, s.best_epoch AS best_epoch,
  s.reason AS stop_reason FROM r"""


@register("early_stopping_v2", _es2_sql())
def q_early_stopping_v2(spark, sf):
    """Min mode with the val/train ratio rule."""
    r = hs.early_stopping_v2(epoch_history(spark, sf), patience=3, min_delta=0.01, use_loss_ratio=True,
                             loss_ratio_threshold=1.15, loss_ratio_patience=2)
    return r.withColumn("best_score", F.round("best_score", 6))


_FOLD_METRICS_SQL = f"""(SELECT fold, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy,
  CAST(count(*) AS BIGINT) AS n_val FROM (SELECT id, fold, y_true, {O.argmax_sql('logits')} AS y_pred FROM {FOLD_LOGITS_SQL})
  GROUP BY fold)"""


def _fold_metrics(spark, sf):
    fl = fold_logits(spark, sf).withColumn("y_pred", mt.argmax(F.col("logits")))
    return fl.groupBy("fold").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
                                  F.count(F.lit(1)).alias("n_val"))


@register("kfold_aggregate", f"""WITH f AS {_FOLD_METRICS_SQL},
l AS (SELECT 'accuracy' AS metric, accuracy AS value FROM f UNION ALL SELECT 'n_val', CAST(n_val AS DOUBLE) FROM f)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min,
  round(max(value), 6) AS max FROM l GROUP BY metric""")
def q_kfold_aggregate(spark, sf):
    """Mean / population std / min / max of the per-fold metrics."""
    return _r6(hs.kfold_aggregate(_fold_metrics(spark, sf)))


@register("fold_report", f"""WITH f AS {_FOLD_METRICS_SQL},
l AS (SELECT 'accuracy' AS metric, accuracy AS value FROM f UNION ALL SELECT 'n_val', CAST(n_val AS DOUBLE) FROM f)
SELECT metric, printf('%.4f +/- %.4f (%.4f - %.4f)', avg(value), stddev_pop(value), min(value), max(value)) AS summary FROM l GROUP BY metric""")
def q_fold_report(spark, sf):
    """The per-fold metrics as text."""
    return hs.fold_report(_fold_metrics(spark, sf)).select("metric", "summary")


@register("monitored_metrics", f"""WITH f AS {_FOLD_METRICS_SQL}
SELECT fold, metric, round(CASE metric WHEN 'accuracy' THEN accuracy WHEN 'n_val' THEN CAST(n_val AS DOUBLE) ELSE 0.0 END, 6) AS value
FROM f, (VALUES ('accuracy'), ('n_val'), ('no_such_metric')) m(metric)""")
def q_monitored_metrics(spark, sf):
    """Metrics by name, 0.0 for an unknown one."""
    return _r6(hs.monitored_metrics(_fold_metrics(spark, sf), ["accuracy", "n_val", "no_such_metric"]))


@register("best_fold", f"""SELECT arg_max(fold, (accuracy, -fold)) AS best_fold, round(max(accuracy), 6) AS best_value
  FROM {_FOLD_METRICS_SQL}""")
def q_best_fold(spark, sf):
    """Best fold by accuracy, lowest fold on ties."""
    return _r6(hs.best_fold(_fold_metrics(spark, sf), "accuracy"))


# ------------------------------------------------------------------ M6-M9: ensembles

from casestory.operators import ensemble as en  # noqa: E402

_LONG_SQL = f"""(SELECT id, fold, CAST(c.i - 1 AS INTEGER) AS class, p[c.i] AS p FROM
  (SELECT id, fold, {O.softmax_sql('logits')} AS p FROM {FOLD_LOGITS_SQL}) t, range(1, {10 + 1}) c(i))"""


@register("ensemble_predict", f"""WITH l AS {_LONG_SQL},
m AS (SELECT id, class, avg(p) AS p_mean FROM l GROUP BY id, class),
b AS (SELECT id, arg_max(class, (p_mean, -class)) AS y_pred, max(p_mean) AS p_max FROM m GROUP BY id)
SELECT m.id, m.class, round(m.p_mean, 6) AS p_mean, b.y_pred, round(b.p_max, 6) AS p_max FROM m JOIN b USING (id)""")
def q_ensemble_predict(spark, sf):
    """M6: mean of the 5 folds' class probabilities, argmax."""
    return _r6(en.ensemble_predict(en.long_probs(fold_logits(spark, sf))))


@register("ensemble_accuracy", f"""WITH l AS {_LONG_SQL},
m AS (SELECT id, class, avg(p) AS p_mean FROM l GROUP BY id, class),
b AS (SELECT id, arg_max(class, (p_mean, -class)) AS y_pred FROM m GROUP BY id)
SELECT CAST(sum(CASE WHEN e.label = b.y_pred THEN 1 ELSE 0 END) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS total,
  round(avg(CASE WHEN e.label = b.y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM b JOIN embeddings e ON e.vec_id = b.id""")
def q_ensemble_accuracy(spark, sf):
    """M6 + A12: ensemble predictions scored against the labels."""
    e = en.ensemble_predict(en.long_probs(fold_logits(spark, sf))).select("id", "y_pred").distinct()
    y = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y_true"))
    return _r6(mt.plain_accuracy(e.join(y, "id")))


@register("best_fold_predict", f"""WITH l AS {_LONG_SQL}, f AS {_FOLD_METRICS_SQL},
bf AS (SELECT arg_max(fold, (accuracy, -fold)) AS fold FROM f)
SELECT id, arg_max(class, (p, -class)) AS y_pred, round(max(p), 6) AS p_max FROM l JOIN bf USING (fold) GROUP BY id""")
def q_best_fold_predict(spark, sf):
    """M7: predictions of the best fold (M10) only."""
    probs = en.long_probs(fold_logits(spark, sf))
    return _r6(en.best_fold_predict(probs, hs.best_fold(_fold_metrics(spark, sf), "accuracy")))


@register("discover_folds", """SELECT CAST(count(DISTINCT f) AS BIGINT) AS n_folds,
  array_to_string(list_sort(list(DISTINCT CAST(f AS INTEGER))), ',') AS folds FROM
  (SELECT regexp_extract(name, '_fold(\\d+)\\.', 1) AS f FROM
    (SELECT 'narrativo_bert_fold' || CAST(vec_id % 5 AS VARCHAR) || '.pth' AS name FROM embeddings
     UNION ALL SELECT 'narrativo_bert_final.pth' FROM embeddings WHERE vec_id % 97 = 0)) WHERE f <> ''""")
def q_discover_folds(spark, sf):
    """M8: fold numbers parsed from artefact names (one per row of the prediction table)."""
    e = table(spark, sf, "embeddings")
    names = e.select(F.concat(F.lit("narrativo_bert_fold"), (F.col("vec_id") % 5).cast("string"),
                              F.lit(".pth")).alias("name")).unionByName(
        e.filter(F.col("vec_id") % 97 == 0).select(F.lit("narrativo_bert_final.pth").alias("name")))
    return en.discover_folds(names)


@register("fold_metrics_placeholder", f"""WITH f AS {_FOLD_METRICS_SQL}
SELECT CAST(g.range AS INTEGER) AS fold, round(coalesce(f.accuracy, 0.0), 6) AS best_value
FROM range(7) g LEFT JOIN (SELECT * FROM f WHERE fold <> 2) f ON f.fold = g.range""")
def q_fold_metrics_placeholder(spark, sf):
    """M9: folds 0..6 with metrics where present (fold 2's are withheld), 0.0 otherwise."""
    folds = spark.range(7).select(F.col("id").cast("int").alias("fold"))
    m = _fold_metrics(spark, sf).filter(F.col("fold") != 2).select("fold", F.col("accuracy").alias("best_value"))
    return _r6(en.fold_metrics_with_placeholders(folds, m))


# ------------------------------------------------------------------ M1, X1-X11: attribution

from casestory.operators import attribute as at  # noqa: E402

BIAS = [0.0625, -0.0625]
N_STEPS = 50


def _attribution_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _tw(spark, sf, fold=0):
    tk_ = at.wordpiece_tokens(_spread_docs(spark, sf))
    return tk_.withColumn("w", at.token_weights_expr(F.col("token"), fold))


def _spread_docs(spark, sf):
    """The texts dealt out by id, so that their tokens are worked out on all cores however few row groups
    the table has; what is grouped by ``doc_id`` later stays where it is."""
    return _attribution_docs(spark, sf).repartition("doc_id")


def _documents(spark, sf):
    """The documents with their tokens and the weights of these."""
    return at.with_weights(_token_documents(spark, sf), weight_fn=at.token_weights_expr)


def _token_documents(spark, sf):
    return at.document_tokens(_spread_docs(spark, sf))


def _attributed(docs, n_steps=N_STEPS):
    """Documents with scored tokens; the weights are worked out where they are used."""
    summary = at.doc_path_summary(docs, BIAS, n_steps, weight_fn=at.token_weights_expr)
    return at.document_attributions(summary, weight_fn=at.token_weights_expr)


_TOKENS_SQL = """(WITH d AS (SELECT doc_id, text FROM documents),
w AS (SELECT doc_id, wpos, word FROM (SELECT doc_id, unnest(regexp_split_to_array(trim(text), '\\s+')) AS word,
        unnest(range(len(regexp_split_to_array(trim(text), '\\s+')))) AS wpos FROM d) WHERE word <> ''),
p AS (SELECT doc_id, wpos, pp, CASE WHEN pp = 0 THEN substr(word, 1, 4) ELSE '##' || substr(word, pp * 4 + 1, 4) END AS token
      FROM (SELECT *, unnest(range(CAST(greatest(ceil(length(word) / 4), 1) AS BIGINT))) AS pp FROM w)),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY wpos, pp) AS pos, token FROM p)
SELECT doc_id, CAST(0 AS BIGINT) AS pos, '[CLS]' AS token FROM d
UNION ALL SELECT d.doc_id, coalesce(max(b.pos), 0) + 1, '[SEP]' FROM d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id
UNION ALL SELECT doc_id, pos, token FROM b)"""

def _tw_sql(fold=0):
    return f"""(SELECT *, ((ascii(token) + 3 * length(token) + {fold}) % 17 - 8) / 8.0 AS w0,
  ((ascii(token) * 3 + length(token) + {2 * fold}) % 19 - 9) / 8.0 AS w1 FROM {_TOKENS_SQL})"""


def _path_sql(steps=N_STEPS, fold=0):
    return f"""(WITH s AS (SELECT doc_id, sum(w0) AS s0, sum(w1) AS s1 FROM {_tw_sql(fold)} GROUP BY doc_id),
t AS (SELECT *, CASE WHEN {BIAS[1]} + s1 > {BIAS[0]} + s0 THEN 1 ELSE 0 END AS target FROM s),
st AS (SELECT t.*, r.j, CASE WHEN r.j = 0 OR r.j = {steps} THEN 0.5 ELSE 1.0 END AS tw,
         {BIAS[0]} + (r.j / {steps}) * s0 AS z0, {BIAS[1]} + (r.j / {steps}) * s1 AS z1
       FROM t, range(0, {steps} + 1) r(j)),
pr AS (SELECT *, exp(z0 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) AS p0 FROM st),
pq AS (SELECT *, exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) AS p1
       FROM pr),
m AS (SELECT doc_id, s0, s1, target,
        sum(tw * (CASE WHEN target = 0 THEN p0 ELSE p1 END) * ((CASE WHEN target = 0 THEN 1.0 ELSE 0.0 END) - p0)) / {steps} AS m0,
        sum(tw * (CASE WHEN target = 0 THEN p0 ELSE p1 END) * ((CASE WHEN target = 1 THEN 1.0 ELSE 0.0 END) - p1)) / {steps} AS m1,
        max(CASE WHEN j = {steps} THEN (CASE WHEN target = 0 THEN p0 ELSE p1 END) END) AS f_x,
        max(CASE WHEN j = 0 THEN (CASE WHEN target = 0 THEN p0 ELSE p1 END) END) AS f_baseline
      FROM pq GROUP BY doc_id, s0, s1, target)
SELECT *, m0 * s0 + m1 * s1 AS sum_attributions FROM m)"""


def _diag_sql(steps=N_STEPS, fold=0):
    """Completeness diagnostics of one fold model at one step count."""
    return f"""(WITH d AS (SELECT *, abs(f_x - f_baseline - sum_attributions) AS abs_error, abs(f_x - f_baseline) AS denominator
  FROM {_path_sql(steps, fold)}),
e AS (SELECT *, CASE WHEN denominator < 1e-4 AND abs_error < 1e-4 THEN 0.0 WHEN denominator < 1e-4 THEN CAST('inf' AS DOUBLE)
        ELSE abs_error / denominator END AS rel_error FROM d)
SELECT doc_id, {fold} AS fold, {steps} AS n_steps, m0, m1, rel_error, abs_error, denominator < 1e-4 AS numerical_instability,
  rel_error < 0.05 AND denominator >= 1e-4 AS converged FROM e)"""


def _grid_sql(grid, folds):
    return "(" + " UNION ALL ".join(f"SELECT * FROM {_diag_sql(n, f)}" for n in grid for f in folds) + ")"


_TW_SQL, _PATH_SQL = _tw_sql(), _path_sql()


@register("wordpiece_tokens", r"""SELECT doc_id, unnest(range(len(f))) AS pos, unnest(f) AS token FROM (SELECT doc_id, list_concat(['[CLS]'],
  flatten(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''),
    lambda w: list_transform(range(0, length(w), 4), lambda j: CASE WHEN j = 0 THEN '' ELSE '##' END || substr(w, j + 1, 4)))), ['[SEP]']) AS f FROM documents)""")
def q_wordpiece_tokens(spark, sf):
    """M1: whole texts as [CLS] word pieces [SEP]."""
    return at.wordpiece_tokens(_attribution_docs(spark, sf)).select("doc_id", F.col("pos").cast("long"), "token")


@register("token_attributions", f"""SELECT t.doc_id, CAST(t.pos AS BIGINT) AS pos, t.token, p.target,
  round(p.m0 * t.w0 + p.m1 * t.w1, 6) AS score FROM {_TW_SQL} t JOIN {_PATH_SQL} p USING (doc_id)""")
def q_token_attributions(spark, sf):
    """X1 + X3: IG token scores against the predicted class, 50 trapezoid steps."""
    return _r6(at.token_rows(_attributed(_token_documents(spark, sf))))


_WA_CTES = f"""ta AS (SELECT t.doc_id, t.pos, t.token, p.m0 * t.w0 + p.m1 * t.w1 AS score
    FROM {_TW_SQL} t JOIN {_PATH_SQL} p USING (doc_id) WHERE t.token NOT IN ('[CLS]', '[SEP]', '[PAD]')),
wi AS (SELECT *, sum(CASE WHEN starts_with(token, '##') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS word_id FROM ta),
wd AS (SELECT doc_id, word_id, string_agg(CASE WHEN starts_with(token, '##') THEN substr(token, 3) ELSE token END, ''
         ORDER BY pos) AS word, sum(score) AS score FROM wi GROUP BY doc_id, word_id),
wa AS (SELECT doc_id, word, arg_max(score, word_id) AS score, CAST(min(word_id) AS BIGINT) AS first_word_id
FROM wd WHERE word <> '' GROUP BY doc_id, word)"""


@register("word_attributions", f"""WITH {_WA_CTES}
SELECT doc_id, word, round(score, 6) AS score, first_word_id FROM wa""")
def q_word_attributions(spark, sf):
    """Word pieces merged into words; a repeated word keeps its last score."""
    return _r6(at.word_rows(at.document_words(_attributed(_token_documents(spark, sf)))))


@register("ig_completeness", f"""WITH p AS {_PATH_SQL},
d AS (SELECT *, f_x - f_baseline - sum_attributions AS delta, abs(f_x - f_baseline) AS denominator FROM p),
e AS (SELECT *, abs(delta) AS abs_error FROM d)
SELECT doc_id, target, round(f_x, 6) AS f_x, round(f_baseline, 6) AS f_baseline,
  round(sum_attributions, 6) AS sum_attributions, round(abs_error, 6) AS abs_error,
  CASE WHEN denominator < 1e-4 AND abs_error < 1e-4 THEN 0.0 WHEN denominator < 1e-4 THEN CAST('inf' AS DOUBLE)
       ELSE round(abs_error / denominator, 6) END AS rel_error,
  denominator < 1e-4 AS numerical_instability,
  (CASE WHEN denominator < 1e-4 AND abs_error < 1e-4 THEN 0.0 WHEN denominator < 1e-4 THEN CAST('inf' AS DOUBLE)
        ELSE abs_error / denominator END) < 0.05 AND denominator >= 1e-4 AS converged FROM e""")
def q_ig_completeness(spark, sf):
    """Completeness diagnostics per document."""
    c = at.completeness(at.doc_path_summary(_documents(spark, sf), BIAS, N_STEPS))
    return c.select("doc_id", "target", *[F.round(x, 6).alias(x) for x in
                                          ("f_x", "f_baseline", "sum_attributions", "abs_error")],
                    F.when(F.col("rel_error") == float("inf"), F.col("rel_error"))
                     .otherwise(F.round("rel_error", 6)).alias("rel_error"),
                    "numerical_instability", "converged")


@register("top_words", f"""WITH {_WA_CTES}, p AS {_PATH_SQL},
g AS (SELECT CASE WHEN p.target = 0 THEN 'class_0' ELSE 'class_1' END AS class, word, avg(abs(score)) AS mean_abs_score
      FROM wa JOIN p USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY class ORDER BY round(mean_abs_score, 9) DESC, word) AS INTEGER) AS rank FROM g)
SELECT class, word, round(mean_abs_score, 6) AS mean_abs_score, rank FROM r WHERE rank <= 25""")
def q_top_words(spark, sf):
    """Top 25 words by mean |score| per predicted class (rows-only)."""
    wa = at.word_rows(at.document_words(_attributed(_token_documents(spark, sf))), "y_pred")
    return _r6(at.top_words(wa, None, 25, True))


@register("optimal_steps", f"""WITH g AS {_grid_sql(at.step_ladder(4, 1000, 5), [0])},
o AS (SELECT doc_id, coalesce(min(CASE WHEN rel_error <= 0.01 THEN n_steps END), max(n_steps)) AS n_steps FROM g GROUP BY doc_id)
SELECT g.doc_id, g.n_steps, CASE WHEN isinf(rel_error) THEN rel_error ELSE round(rel_error, 6) END AS rel_error, converged FROM g JOIN o USING (doc_id, n_steps)""")
def q_optimal_steps(spark, sf):
    """Doubling ladder 4 -> 8 -> ... below 1000, target 1 %; one pass (rows-only)."""
    o = at.optimal_steps(_documents(spark, sf), BIAS, at.step_ladder(4, 1000, 5), 0.01)
    return o.select("doc_id", "n_steps", F.round("rel_error", 6).alias("rel_error"), "converged")


@register("adaptive_steps", f"""WITH g AS {_diag_sql(8)}, u AS (SELECT CASE WHEN rel_error <= 0.05 THEN 0 ELSE 1 END AS up FROM g)
SELECT CAST(count(*) AS BIGINT) AS n_samples, CAST(sum(up) AS BIGINT) AS n_upgraded, round(avg(up), 6) AS upgrade_share,
  round((1 - avg(up)) * (64 - 8) / 64, 6) AS estimated_saving FROM u""")
def q_adaptive_steps(spark, sf):
    """8 steps, 64 for documents above 5 % error; report row (rows-only)."""
    _, rep = at.adaptive(_tw(spark, sf), BIAS, 8, 64, 0.05)
    return _r6(rep)


@register("ensemble_attributions", f"""SELECT doc_id, CASE WHEN isinf(avg(rel_error)) THEN avg(rel_error) ELSE round(avg(rel_error), 6) END AS avg_rel_error,
  CAST(sum(converged::INT) AS BIGINT) AS converged_folds, CAST(count(*) AS BIGINT) AS total_folds FROM {_grid_sql([N_STEPS], range(5))} GROUP BY doc_id""")
def q_ensemble_attributions(spark, sf):
    """Five fold models, per document the error summary."""
    d = at.completeness(at.fold_summaries(at.wordpiece_tokens(_spread_docs(spark, sf)), BIAS, [N_STEPS], list(range(5))))
    return _r6(at.fold_errors(d))


@register("ensemble_token_scores", "WITH " + ", ".join(
    f"t{f} AS (SELECT t.doc_id, t.pos, t.token, p.m0 * t.w0 + p.m1 * t.w1 AS s FROM {_tw_sql(f)} t JOIN {_path_sql(N_STEPS, f)} p USING (doc_id))"
    for f in range(3)) + """ SELECT doc_id, CAST(pos AS BIGINT) AS pos, t0.token, round((t0.s + t1.s + t2.s) / 3, 6) AS score
FROM t0 JOIN t1 USING (doc_id, pos) JOIN t2 USING (doc_id, pos)""")
def q_ensemble_token_scores(spark, sf):
    """Mean token scores over three fold models."""
    return _r6(at.document_fold_scores(at.document_tokens(_spread_docs(spark, sf)), BIAS, N_STEPS, [0, 1, 2]))


@register("classify_samples", f"""WITH g AS (SELECT doc_id, bool_or(numerical_instability) AS any_unstable,
  max(CASE WHEN NOT isinf(rel_error) THEN rel_error END) AS max_finite_error, bool_and(converged) AS all_converged FROM {_grid_sql([8], range(5))} GROUP BY doc_id)
SELECT doc_id, any_unstable, round(max_finite_error, 6) AS max_finite_error, all_converged,
  CASE WHEN any_unstable THEN 'numerical' WHEN max_finite_error > 1 THEN 'algorithmic' WHEN all_converged THEN 'converged' ELSE 'none' END AS category FROM g""")
def q_classify_samples(spark, sf):
    """Numerical / algorithmic / converged / none over 5 folds at 8 steps (rows-only)."""
    g = at.step_grid(at.wordpiece_tokens(_spread_docs(spark, sf)), BIAS, [8], list(range(5)))
    return _r6(at.classify_samples(g))


@register("step_grid", f"""SELECT doc_id, fold, n_steps, CASE WHEN isinf(rel_error) THEN rel_error ELSE round(rel_error, 6) END AS rel_error, converged
FROM {_grid_sql([2, 4, 8, 16, 32], [0, 1])}""")
def q_step_grid(spark, sf):
    """Sample x fold x n_steps diagnostics (rows-only)."""
    return at.step_grid(at.wordpiece_tokens(_spread_docs(spark, sf)), BIAS, [2, 4, 8, 16, 32], [0, 1]) \
             .select("doc_id", "fold", "n_steps", F.round("rel_error", 6).alias("rel_error"), "converged")


@register("step_grid_summary", f"""WITH g AS {_grid_sql([2, 4, 8, 16, 32], [0, 1])},
s AS (SELECT n_steps, avg(rel_error) AS m, median(rel_error) AS md, CASE WHEN bool_or(isinf(rel_error)) THEN 'NaN'::DOUBLE ELSE stddev_samp(CASE WHEN isinf(rel_error) THEN 0 ELSE rel_error END) END AS sd,
  max(rel_error) AS mx, avg(abs_error) AS ma, median(abs_error) AS mda, CAST(count(*) FILTER (WHERE converged) AS BIGINT) AS converged, count(*) AS total,
  count(*) FILTER (WHERE converged) / count(*) AS convergence_rate FROM g GROUP BY n_steps)
SELECT n_steps, round(m, 6) AS mean_rel_error, round(md, 6) AS median_rel_error, round(sd, 6) AS std_rel_error, round(mx, 6) AS max_rel_error, round(ma, 6) AS mean_abs_error,
  round(mda, 6) AS median_abs_error, converged, total, convergence_rate,
  (SELECT coalesce(min(n_steps) FILTER (WHERE convergence_rate >= 0.95 AND m <= 0.01), min(n_steps) FILTER (WHERE convergence_rate >= 0.80), arg_min(n_steps, m)) FROM s) AS recommended_n_steps FROM s""")
def q_step_grid_summary(spark, sf):
    """X11: per-n_steps summary and the recommendation."""
    g = at.step_grid(at.wordpiece_tokens(_spread_docs(spark, sf)), BIAS, [2, 4, 8, 16, 32], [0, 1])
    s, rec = at.grid_summary(g)
    return s.withColumn("recommended_n_steps", rec.select("recommended_n_steps").scalar())


# ------------------------------------------------------------------ J3, J6, X12-X17: actions

from casestory.operators import actions as ac  # noqa: E402

# Short demo action phrases searched besides the benchmark passages.
SHORT_ACTIONS = ["the", "and the", "Is and", "of an", "with the", "that the"]


def _actions(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("text").alias("action"))
    short = spark.createDataFrame([(a,) for a in SHORT_ACTIONS], "action string")
    return b.unionByName(short)


_ACTIONS_SQL = "(SELECT text AS action FROM benchmark UNION SELECT * FROM (VALUES " + \
    ", ".join(f"('{a}')" for a in SHORT_ACTIONS) + ") v(action))"


@register("phrase_hits", f"""SELECT d.doc_id, a.action FROM documents d JOIN {_ACTIONS_SQL} a
  ON contains(lower(d.text), lower(a.action))""")
def q_phrase_hits(spark, sf):
    """Which actions occur in each document (case-insensitive substring)."""
    return ac.phrase_hits(table(spark, sf, "documents"), _actions(spark, sf))


@register("phrase_hits_automaton", f"""SELECT d.doc_id, a.action FROM documents d JOIN
  (SELECT text AS action FROM benchmark UNION SELECT text FROM documents WHERE length(text) BETWEEN 1 AND 60) a
  ON contains(lower(d.text), lower(a.action))""")
def q_phrase_hits_automaton(spark, sf):
    """J3 for a phrase list that grows with the data: every short document as a phrase."""
    b = table(spark, sf, "benchmark").select(F.col("text").alias("action"))
    d = table(spark, sf, "documents").filter(F.length("text").between(1, 60)).select(F.col("text").alias("action"))
    return ac.phrase_hits(table(spark, sf, "documents"), b.unionByName(d))


def _action_scores(spark, sf):
    """Scores of the actions in the documents that have any, each with its document's ``y_pred``."""
    found = at.document_tokens(ac.hit_documents(_attribution_docs(spark, sf), _actions(spark, sf)))
    words = at.document_words(_attributed(found))
    return ac.document_action_scores(words)


_ACTION_SCORES_CTES = f"""{_WA_CTES},
hits AS (SELECT DISTINCT d.doc_id, a.action FROM documents d JOIN {_ACTIONS_SQL} a ON contains(lower(d.text), lower(a.action))),
aw AS (SELECT doc_id, action, lower(unnest(regexp_split_to_array(trim(action), '\\s+'))) AS lw FROM hits),
ws AS (SELECT doc_id, lower(word) AS lw, arg_min(score, first_word_id) AS s FROM wa GROUP BY doc_id, lower(word)),
sc AS (SELECT aw.doc_id, aw.action, sum(abs(ws.s)) AS score, count(ws.s) AS words_found, count(*) AS n_words
       FROM aw LEFT JOIN ws USING (doc_id, lw) GROUP BY aw.doc_id, aw.action),
asc_ AS (SELECT doc_id, action, coalesce(score, 0.0) AS score, words_found, n_words FROM sc WHERE words_found >= n_words / 2)"""


@register("action_scores", f"""WITH {_ACTION_SCORES_CTES}
SELECT doc_id, action, round(score, 6) AS score, CAST(words_found AS BIGINT) AS words_found,
  CAST(n_words AS BIGINT) AS n_words FROM asc_""")
def q_action_scores(spark, sf):
    """X12 + J6: action scores from word attributions, half-found rule."""
    return _r6(_action_scores(spark, sf).drop("y_pred"))


@register("action_statistics", f"""WITH {_ACTION_SCORES_CTES}, p AS {_PATH_SQL}
SELECT CASE WHEN p.target = 0 THEN 'class_0' ELSE 'class_1' END AS class, a.action,
  round(avg(a.score), 6) AS mean_score, round(stddev_pop(a.score), 6) AS std_score,
  CAST(count(*) AS BIGINT) AS count, round(sum(a.score), 6) AS total_score
FROM asc_ a JOIN p USING (doc_id) GROUP BY 1, 2""")
def q_action_statistics(spark, sf):
    """Per predicted class and action: mean, population std, count, total."""
    s = _action_scores(spark, sf)
    return _r6(ac.action_statistics(s))


_STATS_CTES = f"""{_ACTION_SCORES_CTES}, p AS {_PATH_SQL},
stt AS (SELECT CASE WHEN p.target = 0 THEN 'class_0' ELSE 'class_1' END AS class, a.action, avg(a.score) AS mean_score,
  stddev_pop(a.score) AS std_score, CAST(count(*) AS BIGINT) AS count, sum(a.score) AS total_score
  FROM asc_ a JOIN p USING (doc_id) GROUP BY 1, 2)"""


@register("top_actions", f"""WITH {_STATS_CTES},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY class ORDER BY round(total_score, 9) DESC, action) AS INTEGER) AS rank FROM stt)
SELECT class, action, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, count, round(total_score, 6) AS total_score, rank
FROM r WHERE rank <= 10""")
def q_top_actions(spark, sf):
    """Top 10 actions per class by total score (rows-only)."""
    s = _action_scores(spark, sf)
    return _r6(ac.top_actions(ac.action_statistics(s), 10, "total_score"))


@register("chart_joint_scale", f"""WITH {_STATS_CTES},
t AS (SELECT * FROM (SELECT action, CAST(row_number() OVER (ORDER BY round(mean_score, 9) DESC, action) AS INTEGER) AS rank, mean_score AS lead_value
  FROM stt WHERE class = 'class_1') WHERE rank <= 10),
j AS (SELECT t.action, t.rank, t.lead_value, coalesce(CAST(o.mean_score AS DOUBLE), 0.0) AS other_value
  FROM t LEFT JOIN (SELECT action, mean_score FROM stt WHERE class = 'class_0') o USING (action)),
m AS (SELECT *, greatest(max(lead_value) OVER (), max(other_value) OVER ()) AS m1, greatest(max(lead_value) OVER (), max(other_value) OVER ()) AS m2 FROM j)
SELECT action, rank, round(lead_value, 6) AS lead_value, round(other_value, 6) AS other_value, CASE WHEN m1 = 0 THEN 0.0 ELSE round(lead_value / m1, 6) END AS lead_scaled,
  CASE WHEN m2 = 0 THEN 0.0 ELSE round(other_value / m2, 6) END AS other_scaled, CASE WHEN length(coalesce((SELECT arg_max('item ' || CAST(item_id AS VARCHAR), item_id) FROM benchmark WHERE text = action), action)) > 50 THEN substr(coalesce((SELECT arg_max('item ' || CAST(item_id AS VARCHAR), item_id) FROM benchmark WHERE text = action), action), 1, 50) || '...' ELSE coalesce((SELECT arg_max('item ' || CAST(item_id AS VARCHAR), item_id) FROM benchmark WHERE text = action), action) END AS label FROM m""")
def q_chart_joint_scale(spark, sf):
    """X15 + J7 + J8 + T13: class-1-led chart table on one scale (rows-only)."""
    s = _action_scores(spark, sf)
    inv = ac.inverse_dictionary(benchmark_dictionary(spark, sf))
    return _r6(ac.chart_table(ac.action_statistics(s), "mean_score", 10, True, inverse=inv))


@register("chart_own_scale", f"""WITH {_STATS_CTES},
t AS (SELECT * FROM (SELECT action, CAST(row_number() OVER (ORDER BY round(mean_score, 9) DESC, action) AS INTEGER) AS rank, mean_score AS lead_value
  FROM stt WHERE class = 'class_1') WHERE rank <= 10),
j AS (SELECT t.action, t.rank, t.lead_value, coalesce(CAST(o.mean_score AS DOUBLE), 0.0) AS other_value
  FROM t LEFT JOIN (SELECT action, mean_score FROM stt WHERE class = 'class_0') o USING (action)),
m AS (SELECT *, max(lead_value) OVER () AS m1, max(other_value) OVER () AS m2 FROM j)
SELECT action, rank, round(lead_value, 6) AS lead_value, round(other_value, 6) AS other_value, CASE WHEN m1 = 0 THEN 0.0 ELSE round(lead_value / m1, 6) END AS lead_scaled,
  CASE WHEN m2 = 0 THEN 0.0 ELSE round(other_value / m2, 6) END AS other_scaled, CASE WHEN length(action) > 50 THEN substr(action, 1, 50) || '...' ELSE action END AS label FROM m""")
def q_chart_own_scale(spark, sf):
    """Each class scaled by its own max (rows-only)."""
    s = _action_scores(spark, sf)
    return _r6(ac.chart_table(ac.action_statistics(s), "mean_score", 10, False))


@register("chart_class0_led", f"""WITH {_STATS_CTES},
t AS (SELECT * FROM (SELECT action, CAST(row_number() OVER (ORDER BY count DESC, action) AS INTEGER) AS rank, count AS lead_value
  FROM stt WHERE class = 'class_0') WHERE rank <= 10),
j AS (SELECT t.action, t.rank, t.lead_value, coalesce(CAST(o.count AS DOUBLE), 0.0) AS other_value
  FROM t LEFT JOIN (SELECT action, count FROM stt WHERE class = 'class_1') o USING (action)),
m AS (SELECT *, greatest(max(lead_value) OVER (), max(other_value) OVER ()) AS m1, greatest(max(lead_value) OVER (), max(other_value) OVER ()) AS m2 FROM j)
SELECT action, rank, lead_value AS lead_value, round(other_value, 6) AS other_value, CASE WHEN m1 = 0 THEN 0.0 ELSE round(lead_value / m1, 6) END AS lead_scaled,
  CASE WHEN m2 = 0 THEN 0.0 ELSE round(other_value / m2, 6) END AS other_scaled, CASE WHEN length(action) > 50 THEN substr(action, 1, 50) || '...' ELSE action END AS label FROM m""")
def q_chart_class0_led(spark, sf):
    """Class-0-led chart on counts (rows-only)."""
    s = _action_scores(spark, sf)
    return _r6(ac.chart_table(ac.action_statistics(s), "count", 10, True, lead="class_0", other="class_1"))


@register("inverse_dictionary", """SELECT text AS dst, arg_max('item ' || CAST(item_id AS VARCHAR), item_id) AS src
  FROM benchmark GROUP BY text""")
def q_inverse_dictionary(spark, sf):
    """Target -> last source."""
    return ac.inverse_dictionary(benchmark_dictionary(spark, sf))


@register("english_vocabulary", """SELECT lower(text) AS key, arg_max(text, item_id) AS dst FROM benchmark GROUP BY lower(text)""")
def q_english_vocabulary(spark, sf):
    """J1d: case-folded target -> target, last entry wins."""
    return textgen.english_vocabulary(benchmark_dictionary(spark, sf))


# ------------------------------------------------------------------ M2, M4, M5: training

from casestory.operators import linear  # noqa: E402


def _labelled_texts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")


@register("train_and_score")
def q_train_and_score(spark, sf):
    """M4 + M2: weighted logistic regression on whole texts, all terms, coefficients as a table;
    stratified 20 % test scored (rows-only: a fitted model has no SQL form)."""
    s = sp.stratified_split(_labelled_texts(spark, sf), "doc_id", "label", 0.2, 42)
    model = linear.fit(s.withColumn("fold", F.when(F.col("split") == "test", 0)), fold_col="fold")
    return linear.probabilities(model, F.lit(0)).where("fold = 0").select("doc_id", "y_true", "y_pred")


@register("kfold_train")
def q_kfold_train(spark, sf):
    """M5 + A11: three models in one pass, out-of-fold metrics aggregated (rows-only)."""
    folded = sp.stratified_kfold(_labelled_texts(spark, sf), "doc_id", "label", 3, 42)
    per_fold, _ = linear.kfold_train(folded, 3)
    return hs.kfold_aggregate(per_fold.select("fold", "accuracy", "balanced_accuracy", "f1", "n_val"))


# ------------------------------------------------------------------ S4-S14: sinks

from casestory.session import scratch_path  # noqa: E402
from casestory.sources import sinks as sk  # noqa: E402


@register("sink_stories_roundtrip", f"""WITH s AS ({O.stories_sql('narrative')})
SELECT 'narrative' AS format, split, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS n_label1 FROM
  (SELECT s.*, CASE WHEN md5(case_id || '-42') < '33' THEN 'test' ELSE 'train' END AS split FROM s) GROUP BY split""")
def q_sink_stories_roundtrip(spark, sf):
    """S4 + S5 + P13: stories written partitioned by (format, split) and read back per split."""
    s = st.stories(events_log(spark, sf), event_dictionary(spark), "narrative")
    s = s.withColumn("split", F.when(F.md5(F.concat("case_id", F.lit("-42"))) < "33", "test").otherwise("train"))
    path = scratch_path(spark, f"stories_{abs(hash(sf))}")
    sk.write_stories(s, path, "narrative")
    back = sk.read_stories(spark, path, "narrative", "all")
    return back.groupBy("format", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("n_label1"))


@register("sink_metrics_json", f"""WITH p AS (SELECT y_true, y_pred FROM {BINARY_PREDS_SQL})
SELECT 'confusion' AS source, y_true || '/' || y_pred AS name, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY y_true, y_pred
UNION ALL SELECT 'label_map', CAST(l AS VARCHAR), CAST(row_number() OVER (ORDER BY l) - 1 AS DOUBLE) FROM (SELECT DISTINCT y_true AS l FROM p)
UNION ALL SELECT 'metrics', 'accuracy', round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) FROM p
UNION ALL SELECT 'report', 'accuracy', CAST(count(*) AS DOUBLE) FROM p""")
def q_sink_metrics_json(spark, sf):
    """S7 + S8 + S9 + S11: metrics, report, confusion table and label map (J4) written as JSON and
    all read back."""
    preds = binary_preds(spark, sf)
    cm = mt.confusion(preds)
    base = scratch_path(spark, f"metrics_{abs(hash(sf))}")
    sk.write_json_table(mt.summary_metrics(cm, "binary"), base + "/metrics")
    sk.write_json_table(mt.classification_report(cm), base + "/report")
    sk.write_json_table(cm, base + "/confusion")
    sk.write_json_table(sp.encode_labels(preds.select(F.col("y_true").alias("label")), None)[2], base + "/label_map")

    def part(name, label, value):
        d = sk.read_json_table(spark, f"{base}/{name}")
        return d.select(F.lit(name).alias("source"), label.alias("name"), value.cast("double").alias("value"))
    report = sk.read_json_table(spark, base + "/report").filter(F.col("row") == "accuracy")
    return (part("confusion", F.concat_ws("/", "y_true", "y_pred"), F.col("n"))
            .unionByName(part("label_map", F.col("label").cast("string"), F.col("label_id")))
            .unionByName(part("metrics", F.lit("accuracy"), F.round("accuracy", 6)))
            .unionByName(report.select(F.lit("report").alias("source"), F.col("row").alias("name"), F.col("support").cast("double").alias("value"))))


@register("sink_epochs_grid", f"""SELECT 'epochs' AS source, CAST(count(*) AS BIGINT) AS n FROM {EPOCH_HISTORY_SQL}
UNION ALL SELECT 'grid', CAST(2 * count(*) AS BIGINT) FROM documents
UNION ALL SELECT 'tokens', CAST(count(DISTINCT text) AS BIGINT) FROM benchmark
UNION ALL SELECT 'attributions', CAST(count(*) AS BIGINT) FROM {_TOKENS_SQL}
UNION ALL SELECT 'predictions', CAST(count(*) AS BIGINT) FROM {BINARY_PREDS_SQL}""")
def q_sink_epochs_grid(spark, sf):
    """S6 + S10 + S12 + S13 + S14: epochs, step grid, token dictionary, attributions and predictions
    written, then every table read back in full and counted."""
    base = scratch_path(spark, f"hist_{abs(hash(sf))}")
    sk.write_epochs(epoch_history(spark, sf), base + "/epochs")
    g = at.step_grid(at.wordpiece_tokens(_spread_docs(spark, sf)), BIAS, [4, 8], [0])
    g = g.select("doc_id", "fold", "n_steps", "rel_error", "converged")
    sk.write_csv(g, base + "/grid")
    sk.write_json_table(tk.token_dictionary(benchmark_dictionary(spark, sf)), base + "/tokens")
    sk.write_attributions(_attributed(_token_documents(spark, sf), 8), base + "/attr", "narrative", "linear", "single", "r1")
    sk.write_predictions(binary_preds(spark, sf), base + "/preds", "narrative", "linear", "single")
    back = {"epochs": sk.read_partitioned(spark, base + "/epochs"), "grid": sk.read_csv(spark, base + "/grid", g.schema),
            "tokens": sk.read_json_table(spark, base + "/tokens"),
            "attributions": sk.read_partitioned(spark, base + "/attr", run_ts="r1").select(F.explode("tokens")),
            "predictions": sk.read_partitioned(spark, base + "/preds", model="linear")}
    out = [d.agg(F.lit(k).alias("source"), F.count(F.lit(1)).alias("n")) for k, d in back.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@register("first_samples", f"""SELECT case_id, story_text FROM ({O.stories_sql('narrative')}) ORDER BY case_id LIMIT 20""")
def q_first_samples(spark, sf):
    """The first 20 stories in case order."""
    s = st.stories(events_log(spark, sf), event_dictionary(spark), "narrative")
    return sk.first_samples(s.select("case_id", "story_text"), ["case_id"], 20)


@register("story_by_id", f"""SELECT case_id, story_text FROM ({O.stories_sql('narrative')}) WHERE case_id =
  (SELECT max(case_id) FROM {_EV})""")
def q_story_by_id(spark, sf):
    """The story of one case (the last id)."""
    log = events_log(spark, sf)
    last = log.agg(F.max("case_id").alias("c")).select("c").scalar()
    s = st.stories(log, event_dictionary(spark), "narrative")
    return sk.story_by_id(s.select("case_id", "story_text"), last)


@register("traces", f"""SELECT case_id, CAST(count(*) AS BIGINT) AS n_events, min(ts) AS ts_start, max(ts) AS ts_end
  FROM {_EV} WHERE case_id IS NOT NULL AND ts IS NOT NULL GROUP BY case_id""")
def q_traces(spark, sf):
    """Whole traces, checked by their length and ends."""
    t = traces.traces(events_log(spark, sf))
    return t.select("case_id", F.size("events").cast("long").alias("n_events"), F.element_at("events", 1)["ts"].alias("ts_start"),
                    F.element_at("events", -1)["ts"].alias("ts_end"))


#: Positions of a model input.
POSITIONS = 512


@register(f"model_input_{POSITIONS}", f"""WITH t AS (SELECT doc_id, token, pos, max(pos) OVER (PARTITION BY doc_id) AS last FROM {_TOKENS_SQL}),
b AS (SELECT doc_id, list(token ORDER BY pos) FILTER (WHERE pos > 0 AND pos < last AND pos <= {POSITIONS - 2}) AS body FROM t GROUP BY doc_id)
SELECT doc_id, CAST(least(coalesce(len(body), 0), {POSITIONS - 2}) + 2 AS BIGINT) AS n_real, '[CLS] ' || coalesce(array_to_string(body, ' ') || ' ', '') || '[SEP]' ||
  repeat(' [PAD]', {POSITIONS - 2} - coalesce(len(body), 0)) AS tokens FROM b""")
def q_model_input_full(spark, sf):
    """M1 for attribution: the first positions, with padding and mask."""
    m = at.model_input(_attribution_docs(spark, sf), POSITIONS)
    return m.select("doc_id", F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"), F.array_join("tokens", " ").alias("tokens"))


@register("model_input", f"""WITH t AS (SELECT doc_id, token, pos, max(pos) OVER (PARTITION BY doc_id) AS last FROM {_TOKENS_SQL}),
b AS (SELECT doc_id, list(token ORDER BY pos) FILTER (WHERE pos > 0 AND pos < last AND pos >= last - {POSITIONS - 2}) AS body FROM t GROUP BY doc_id)
SELECT doc_id, CAST(least(coalesce(len(body), 0), {POSITIONS - 2}) + 2 AS BIGINT) AS n_real, '[CLS] ' || coalesce(array_to_string(body, ' ') || ' ', '') || '[SEP]' ||
  repeat(' [PAD]', {POSITIONS - 2} - coalesce(len(body), 0)) AS tokens FROM b""")
def q_model_input(spark, sf):
    """M1 for training and evaluation: a longer text keeps its last positions, with padding and mask."""
    m = at.model_input(_attribution_docs(spark, sf), POSITIONS, side="left")
    return m.select("doc_id", F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"), F.array_join("tokens", " ").alias("tokens"))


# ------------------------------------------------------------------ M2: a caller's own scorer

from casestory.operators import scorer  # noqa: E402

#: A demo model: weights of some words per class, exact in binary.
WORD_WEIGHTS = {"the": (0.25, 0.0), "and": (0.0, 0.125), "der": (0.0, 0.5), "la": (0.5, 0.25), "de": (-0.125, 0.25), "in": (0.0625, 0.0)}


@register("own_scorer", f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_]+') AS ws FROM documents),
z AS (SELECT doc_id, {', '.join(f"0.125 * {c} + " + ' + '.join(f"({x[c]}) * len(list_filter(ws, lambda y: y = '{t}'))" for t, x in WORD_WEIGHTS.items()) + f' AS z{c}' for c in (0, 1))} FROM w)
SELECT doc_id, CAST(CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS INTEGER) AS y_pred, round(CAST(1 / (1 + exp(CAST(z0 - z1 AS DOUBLE))) AS DOUBLE), 6) AS prob FROM z""")
def q_own_scorer(spark, sf):
    """M2: whole texts scored in batches by a model that the caller brings."""
    own = scorer.linear_scorer(WORD_WEIGHTS, (0.0, 0.125))
    return scorer.score_with(table(spark, sf, "documents"), own, 2).select("doc_id", "y_pred", F.round(F.element_at("probs", 2), 6).alias("prob"))


# ------------------------------------------------------------------ S9, S12, S14 by value, J9

import uuid  # noqa: E402

from casestory.sources import positions, prefix_store, summaries  # noqa: E402


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("sink_kfold_summary", f"""WITH f AS {_FOLD_METRICS_SQL},
l AS (SELECT 'accuracy' AS metric, accuracy AS value FROM f UNION ALL SELECT 'n_val', CAST(n_val AS DOUBLE) FROM f)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
  (SELECT CAST(fold AS INTEGER) FROM f ORDER BY accuracy DESC, fold LIMIT 1) AS best_fold, (SELECT count(*) FROM f) AS n_folds, 'accuracy' AS monitor, '5' AS k FROM l GROUP BY metric""")
def q_sink_kfold_summary(spark, sf):
    """Fold table, aggregated metrics, best fold and configuration written and read back."""
    path = _fresh(spark, "kfold")
    summaries.write_kfold_summary(_fold_metrics(spark, sf), {"k": 5, "seed": 42}, path, "accuracy")
    summary, _ = summaries.read_kfold_summary(spark, path)
    m = summary.select(F.explode("metrics").alias("m"), "best_fold", "n_folds", "monitor", F.col("config")["k"].alias("k"))
    return _r6(m.select("m.metric", "m.mean", "m.std", "m.min", "m.max", "best_fold", "n_folds", "monitor", "k"))


@register("sink_token_dictionary", f"""WITH t AS (SELECT * FROM {_BENCH_TOKENS_SQL})
SELECT token, phrase, src, length, (SELECT count(*) FROM t) AS total_tokens, (SELECT count(DISTINCT src) FROM t) AS total_sources,
  '[CLIN_%03d]' AS token_format, (SELECT min(length) FROM t) AS shortest, (SELECT max(length) FROM t) AS longest FROM t""")
def q_sink_token_dictionary(spark, sf):
    """The token dictionary with its metadata written, read back and compared with it."""
    tokens, path = tk.token_dictionary(benchmark_dictionary(spark, sf)), _fresh(spark, "token-dictionary")
    summaries.write_token_dictionary(tokens, path)
    back, metadata = summaries.read_token_dictionary(spark, path, tokens.schema)
    return back.select("token", "phrase", "src", "length").join(F.broadcast(metadata.drop("fingerprint")))  # one row


@register("sink_step_grid", f"""WITH g AS {_grid_sql([4, 8], [0])},
m AS (SELECT n_steps, round(median(abs_error), 6) AS median_abs_error, count(*) AS total FROM g GROUP BY n_steps)
SELECT g.doc_id, g.n_steps, CASE WHEN isinf(g.rel_error) THEN g.rel_error ELSE round(g.rel_error, 6) END AS rel_error, g.converged, m.median_abs_error, m.total
FROM g JOIN m USING (n_steps)""")
def q_sink_step_grid(spark, sf):
    """The step grid as CSV with its summary, read back by value."""
    path = _fresh(spark, "step-grid")
    summaries.write_step_grid(at.step_grid(at.wordpiece_tokens(_spread_docs(spark, sf)), BIAS, [4, 8], [0]), path)
    grid, summary, _ = summaries.read_step_grid(spark, path)
    return grid.join(summary.select("n_steps", "median_abs_error", "total"), "n_steps").select(
        "doc_id", "n_steps", F.round("rel_error", 6).alias("rel_error"), "converged", "median_abs_error", "total")


@register("pairs_by_position", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents")
def q_pairs_by_position(spark, sf):
    """Two tables of files without a key, written from one, paired again row by row."""
    docs, a, b = table(spark, sf, "documents"), _fresh(spark, "left"), _fresh(spark, "right")
    docs.select("doc_id").write.json(a)
    docs.select(F.length("text").alias("n")).write.csv(b)
    return positions.pair_by_position(spark.read.schema("doc_id long").json(a), spark.read.schema("n int").csv(b)).select("doc_id", "n")



@register("sink_prefix_store", O.prefixes_sql())
def q_sink_prefix_store(spark, sf):
    """W10 written as pieces and references to them, read back as texts."""
    path = _fresh(spark, "prefixes")
    prefix_store.write_prefixes(stays(spark, sf), path)
    return prefix_store.read_prefixes(spark, path)
