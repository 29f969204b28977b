"""DuckDB SQL pieces for the correctness oracle.

These are independent SQL formulations of the same operator semantics, built over the
pre-registered driver views. Fixed-value tables (templates, affixes, dictionary) are
emitted from the same constants the Spark side uses.
"""

from __future__ import annotations

from casestory.operators.textgen import (ACTIVITY_TEMPLATES, EMPTY_CASE_TEXT, INTRO_TAIL,
                                         TEMPLATE_AFFIXES)
from casestory.plans.bindings import dictionary_sql, events_log_sql

NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def templates_sql() -> str:
    rows = ", ".join(f"({i}, {q(c)}, {q(t)})" for i, (c, t) in enumerate(ACTIVITY_TEMPLATES))
    return f"(SELECT * FROM (VALUES {rows}) AS t(pos, cat, template))"


def strip_sql(x: str) -> str:
    parts = []
    for a in TEMPLATE_AFFIXES:
        n = len(a)
        parts.append(f"WHEN ends_with({x}, {q(a)}) THEN left({x}, length({x}) - {n})")
        parts.append(f"WHEN starts_with({x}, {q(a)}) THEN substr({x}, {n + 1})")
    return "CASE " + " ".join(parts) + f" ELSE {x} END"


def translate_sql(src: str, col: str, out: str, mode: str = "exact_ci") -> str:
    """J1 / J1b / J1c as left joins against the dictionary."""
    d = dictionary_sql()
    ci = f"(SELECT upper(src) AS k, arg_min(dst, pos) AS dst FROM {d} GROUP BY upper(src))"
    if mode == "exact_ci":
        return (f"(SELECT s.*, coalesce(ex.dst, ci.dst, s.{col}) AS {out} FROM {src} s "
                f"LEFT JOIN {d} ex ON ex.src = s.{col} LEFT JOIN {ci} ci ON ci.k = upper(s.{col}))")
    if mode == "upper_ci":
        return (f"(SELECT s.*, coalesce(CASE WHEN ex.dst <> '' THEN ex.dst END, ci.dst, s.{col}) AS {out} "
                f"FROM {src} s LEFT JOIN {d} ex ON ex.src = upper(s.{col}) "
                f"LEFT JOIN {ci} ci ON ci.k = upper(s.{col}))")
    if mode == "exact":
        return (f"(SELECT s.*, coalesce(ex.dst, s.{col}) AS {out} FROM {src} s "
                f"LEFT JOIN {d} ex ON ex.src = s.{col})")
    raise ValueError(mode)


def phrase_sql(src: str, col: str, out: str) -> str:
    """J2 + T1: category by exact match, else first contained category, else DEFAULT."""
    t = templates_sql()
    cat = (f"coalesce((SELECT t.cat FROM {t} t WHERE t.cat = upper(s.{col})), "
           f"(SELECT t.cat FROM {t} t WHERE t.cat <> 'DEFAULT' AND contains(upper(s.{col}), t.cat) "
           f"ORDER BY t.pos LIMIT 1), 'DEFAULT')")
    inner = (f"(SELECT s.*, {cat} AS __cat FROM {src} s)")
    desc = f"replace(t2.template, '{{activity}}', c.{col})"
    return (f"(SELECT c.* EXCLUDE (__cat), {strip_sql(desc)} AS {out} FROM {inner} c "
            f"JOIN {t} t2 ON t2.cat = c.__cat)")


def english_list_sql(items: str, n: str) -> str:
    return (f"CASE WHEN {n} = 1 THEN {items}[1] WHEN {n} = 2 THEN {items}[1] || ' and ' || {items}[2] "
            f"ELSE array_to_string({items}[1:{n} - 1], ', ') || ', and ' || {items}[{n}] END")


def narrative_sql(delta: str, items: str, n: str) -> str:
    return (f"CASE WHEN {n} = 1 AND {delta} = 0 THEN 'The ' || {items}[1] || "
            f"' was performed at the beginning of hospitalization, after 0 seconds.' "
            f"WHEN {n} = 1 THEN 'After ' || format('{{:,}}', {delta}) || ' seconds, ' || {items}[1] || ' was performed.' "
            f"ELSE 'After ' || format('{{:,}}', {delta}) || "
            f"' seconds, the following examinations were performed simultaneously: ' || "
            f"{english_list_sql(items, n)} || '.' END")


def cap_sql(x: str) -> str:
    return f"(upper(left({x}, 1)) || substr({x}, 2))"


def bullet_sql(delta: str, items: str, n: str) -> str:
    sub = (f"array_to_string(list_transform(list_zip({items}, range(1, {n} + 1)), "
           f"lambda z: '    - ' || {cap_sql('z[1]')} || CASE WHEN z[2] > 1 THEN ' (concurrent)' ELSE '' END), {NL})")
    return (f"CASE WHEN {n} = 1 THEN '- After ' || CAST({delta} AS VARCHAR) || ' seconds: ' || {cap_sql(items + '[1]')} "
            f"ELSE '- After ' || CAST({delta} AS VARCHAR) || ' seconds:' || {NL} || {sub} END")


def age_sql(x: str) -> str:
    s = f"trim({x})"
    p0 = f"trim(string_split({s}, '-')[1])"
    p1 = f"trim(string_split({s}, '-')[2])"
    pl = f"trim(replace({s}, '+', ''))"
    r = "'^[+-]?[0-9]+$'"
    return (f"CASE WHEN {s} IS NULL THEN NULL "
            f"WHEN contains({s}, '-') AND len(string_split({s}, '-')) = 2 AND regexp_matches({p0}, {r}) "
            f"AND regexp_matches({p1}, {r}) THEN CAST(floor((CAST({p0} AS BIGINT) + CAST({p1} AS BIGINT)) / 2) AS INTEGER) "
            f"WHEN contains({s}, '+') AND regexp_matches({pl}, {r}) THEN CAST({pl} AS INTEGER) + 5 "
            f"WHEN regexp_matches({s}, {r}) THEN CAST({s} AS INTEGER) END")


def metadata_sql(log: str) -> str:
    """P5 on a log: the first row per case in event_idx order."""
    return (f"(SELECT case_id, CAST(class_label AS INTEGER) AS class_label, age_range, "
            f"CAST(coalesce(age, {age_sql('age_range')}) AS INTEGER) AS age, gender FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY event_idx) AS __rn FROM {log} "
            f"WHERE case_id IS NOT NULL) WHERE __rn = 1)")


def intro_sql(g: str, a: str) -> str:
    gw = f"(CASE WHEN {g} = 'M' THEN 'male' ELSE 'female' END)"
    hg = f"({g} IS NOT NULL AND {g} <> '')"
    ha = f"({a} IS NOT NULL AND {a} <> 0)"
    return (f"(CASE WHEN {hg} AND {ha} THEN 'The patient, a ' || CAST({a} AS VARCHAR) || '-year-old ' || {gw} || ',' "
            f"WHEN {hg} THEN 'The patient, ' || {gw} || ',' "
            f"WHEN {ha} THEN 'The patient, ' || CAST({a} AS VARCHAR) || ' years old,' "
            f"ELSE 'The patient' END || {q(' ' + INTRO_TAIL)})")


def delta_sql(prev: str, cur: str) -> str:
    """Whole seconds from ``prev`` to ``cur`` (truncated)."""
    return f"CAST(trunc((epoch_us({cur}) - epoch_us({prev})) / 1000000.0) AS BIGINT)"


def stories_sql(style: str = "narrative", log: str | None = None) -> str:
    log = log or events_log_sql()
    tr = translate_sql(f"(SELECT * FROM {log} WHERE case_id IS NOT NULL AND ts IS NOT NULL)",
                       "activity", "activity_en")
    ph = phrase_sql(tr, "activity_en", "phrase")
    sep = f"{NL} || {NL}" if style == "narrative" else NL
    text = narrative_sql("delta", "items", "n") if style == "narrative" else bullet_sql("delta", "items", "n")
    return f"""
WITH ph AS {ph},
g AS (SELECT case_id, ts, list(phrase ORDER BY event_idx, phrase) AS items, count(*) AS n FROM ph GROUP BY case_id, ts),
g2 AS (SELECT *, coalesce({delta_sql('lag(ts) OVER (PARTITION BY case_id ORDER BY ts)', 'ts')}, 0) AS delta FROM g),
s AS (SELECT case_id, ts, {text} AS t FROM g2),
body AS (SELECT case_id, string_agg(t, {sep} ORDER BY ts) AS body FROM s GROUP BY case_id),
meta AS {metadata_sql(log)}
SELECT m.case_id, {intro_sql('m.gender', 'm.age')} || {sep} || coalesce(b.body, {q(EMPTY_CASE_TEXT)}) AS story_text,
       'en' AS language, CAST(coalesce(m.class_label, 0) AS INTEGER) AS label
FROM meta m LEFT JOIN body b ON b.case_id = m.case_id
"""


# ------------------------------------------------------------------ E4: prefixes

def _render_sql(tmpl: str, numeric: set[str]) -> str:
    import re
    parts = []
    for i, chunk in enumerate(re.split(r"\{\{(\w+)\}\}", tmpl)):
        if i % 2 == 0:
            if chunk:
                parts.append(q(chunk))
        elif chunk == "timesincecasestart":
            parts.append("CAST(tsc AS VARCHAR)")
        elif chunk in numeric:
            parts.append(f"coalesce(CAST({chunk} AS VARCHAR), 'N/A')")
        else:
            parts.append(f"coalesce({chunk}, 'N/A')")
    return " || ".join(parts)


def stay_steps_sql() -> str:
    """CTEs f3 (ordered rows with run ids and prefix lengths) and pc (pieces)."""
    from casestory.operators.prefixes import (DISCHARGE, EVENT_TEMPLATES, LIST_ACTIVITIES,
                                              NUMERIC_COLUMNS)
    from casestory.plans.bindings import stays_sql
    lst = ", ".join(q(a) for a in LIST_ACTIVITIES)
    val = " ".join(f"WHEN {q(a)} THEN {'name_etc2' if c == 'name_etc' else c}" for a, c in LIST_ACTIVITIES.items())
    rend = " ".join(f"WHEN activity = {q(a)} THEN {_render_sql(t, set(NUMERIC_COLUMNS))}"
                    for a, t in EVENT_TEMPLATES.items())
    return f"""
s AS {stays_sql()},
f AS (SELECT *, lag(activity) OVER w AS prev_activity, lead(activity) OVER w AS next_act,
        row_number() OVER w AS rn, min(timestamps) OVER (PARTITION BY stay_id) AS st,
        lag(timestamps) OVER w AS prev_ts
      FROM s WINDOW w AS (PARTITION BY stay_id ORDER BY timestamps, row_idx)),
f2 AS (SELECT *, CASE WHEN prev_activity IS NOT DISTINCT FROM activity THEN 0 ELSE 1 END AS start_run,
        CAST(trunc((epoch_us(timestamps) - epoch_us(st)) / 1000000.0) AS BIGINT) AS tsc,
        coalesce(name || ' that is ' || etcdescription, 'N/A') AS name_etc2 FROM f),
f3 AS (SELECT *, sum(start_run) OVER w AS run_id,
         sum(CASE WHEN activity NOT IN ({lst}) OR start_run = 1 THEN 1 ELSE 0 END) OVER w AS prefix_len
       FROM f2 WINDOW w AS (PARTITION BY stay_id ORDER BY timestamps, row_idx
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
runs AS (SELECT stay_id, run_id, string_agg(coalesce(CASE activity {val} END, 'N/A'), ', '
           ORDER BY timestamps, row_idx) AS run_list FROM f3 WHERE activity IN ({lst}) GROUP BY stay_id, run_id),
em AS (SELECT f3.*, runs.run_list, CASE {rend} END AS tx FROM f3 LEFT JOIN runs USING (stay_id, run_id)
       WHERE activity NOT IN ({lst}) OR start_run = 1),
pc AS (SELECT stay_id, prefix_len, timestamps, row_idx, activity,
         CASE WHEN activity = {q(DISCHARGE)} THEN tx || ' ' || run_list || '.'
              WHEN activity IN ({lst}) THEN tx || ' ' || run_list || '. '
              ELSE tx || '. ' END AS piece FROM em)"""


def stay_features_sql() -> str:
    return f"""WITH {stay_steps_sql()}
SELECT stay_id, row_idx, CAST(rn - 1 AS BIGINT) AS row_position,
  round(coalesce((epoch_us(timestamps) - epoch_us(prev_ts)) / 1e6, 0.0), 6) AS timesincelastevent,
  tsc AS timesincecasestart, coalesce(next_act, 'Discharge from the ED') AS next_activity, name_etc2 AS name_etc
FROM f2"""


def pieces_sql() -> str:
    return f"WITH {stay_steps_sql()}\nSELECT stay_id, CAST(prefix_len AS BIGINT) AS prefix_len, row_idx, piece FROM pc"


def prefixes_sql() -> str:
    return f"""WITH {stay_steps_sql()},
lbl AS (SELECT DISTINCT stay_id, first_value(coalesce(disposition, 'N/A')) OVER
          (PARTITION BY stay_id ORDER BY timestamps DESC, row_idx DESC) AS label FROM s)
SELECT p.stay_id, CAST(p.prefix_len AS INTEGER) AS prefix_len,
  string_agg(p.piece, '' ORDER BY p.prefix_len) OVER (PARTITION BY p.stay_id ORDER BY p.prefix_len
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix_text, l.label
FROM pc p JOIN lbl l USING (stay_id)"""


def temporal_split_sql(share: float = 0.66) -> str:
    from casestory.plans.bindings import stays_sql
    return f"""WITH st AS (SELECT stay_id, min(timestamps) AS start FROM {stays_sql()} GROUP BY stay_id),
p AS (SELECT *, row_number() OVER (ORDER BY start, stay_id) AS position, count(*) OVER () AS n FROM st)
SELECT stay_id, start, CAST(position AS BIGINT) AS position,
  CASE WHEN position <= floor({share} * n) THEN 'train' ELSE 'test' END AS split FROM p"""


# ------------------------------------------------------------------ metrics

def confusion_sql(preds: str) -> str:
    return f"""(WITH p AS {preds},
cm AS (SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY y_true, y_pred),
ls AS (SELECT y_true AS l FROM cm UNION SELECT y_pred FROM cm),
grid AS (SELECT a.l AS y_true, b.l AS y_pred FROM ls a, ls b)
SELECT g.y_true, g.y_pred, CAST(coalesce(cm.n, 0) AS BIGINT) AS n FROM grid g LEFT JOIN cm USING (y_true, y_pred))"""


def per_class_sql(preds: str) -> str:
    return f"""(WITH cm AS {confusion_sql(preds)},
t AS (SELECT l.label, coalesce(tp.n, 0) AS tp, s.support, pr.predicted FROM
  (SELECT DISTINCT y_true AS label FROM cm) l
  LEFT JOIN (SELECT y_true AS label, n FROM cm WHERE y_true = y_pred) tp USING (label)
  JOIN (SELECT y_true AS label, sum(n) AS support FROM cm GROUP BY 1) s USING (label)
  JOIN (SELECT y_pred AS label, sum(n) AS predicted FROM cm GROUP BY 1) pr USING (label)),
m AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM t)
SELECT label, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0
  ELSE 2 * precision * recall / (precision + recall) END AS f1, CAST(support AS BIGINT) AS support,
  CAST(tp AS BIGINT) AS tp, CAST(predicted AS BIGINT) AS predicted FROM m)"""


def summary_sql(preds: str, average: str = "binary") -> str:
    if average == "binary":
        p, r, f = ("max(CASE WHEN label = 1 THEN precision END)", "max(CASE WHEN label = 1 THEN recall END)",
                   "max(CASE WHEN label = 1 THEN f1 END)")
    elif average == "macro":
        p, r, f = "avg(precision)", "avg(recall)", "avg(f1)"
    else:
        p, r, f = ("sum(precision * support) / sum(support)", "sum(recall * support) / sum(support)",
                   "sum(f1 * support) / sum(support)")
    return f"""WITH pc AS {per_class_sql(preds)},
s AS (SELECT sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy,
  coalesce({p}, 0.0) AS precision, coalesce({r}, 0.0) AS recall, coalesce({f}, 0.0) AS f1,
  CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(support) AS DOUBLE) AS s_, sum(CAST(predicted AS DOUBLE) * support) AS pt,
  sum(CAST(predicted AS DOUBLE) ^ 2) AS pp, sum(CAST(support AS DOUBLE) ^ 2) AS tt, count(*) AS k,
  max(CASE WHEN label = 1 THEN recall END) AS r1, max(CASE WHEN label = 0 THEN recall END) AS r0 FROM pc)
SELECT accuracy, balanced_accuracy, precision, recall, f1,
  CASE WHEN sqrt((s_ ^ 2 - pp) * (s_ ^ 2 - tt)) = 0 THEN 0.0 ELSE (c * s_ - pt) / sqrt((s_ ^ 2 - pp) * (s_ ^ 2 - tt)) END AS mcc,
  CASE WHEN pt / s_ ^ 2 = 1 THEN 0.0 ELSE (c / s_ - pt / s_ ^ 2) / (1 - pt / s_ ^ 2) END AS cohen_kappa,
  CASE WHEN k >= 2 THEN 0.7 * coalesce(r1, 0.0) + 0.3 * balanced_accuracy ELSE 0.0 END AS class1_focused_score,
  CASE WHEN k >= 2 THEN coalesce(r1, 0.0) ELSE 0.0 END AS recall_class1,
  CASE WHEN k >= 2 THEN coalesce(r0, 0.0) ELSE 0.0 END AS recall_class0 FROM s"""


def softmax_sql(l: str) -> str:
    return (f"list_transform({l}, lambda x: exp(x - list_max({l})) / "
            f"list_sum(list_transform({l}, lambda y: exp(y - list_max({l})))))")


def argmax_sql(l: str) -> str:
    return f"CAST(list_position({l}, list_max({l})) - 1 AS INTEGER)"
