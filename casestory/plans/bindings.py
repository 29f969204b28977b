"""Views of the driver tables in the shapes the operators take.

Each binding has a Spark form and the matching DuckDB SQL (used by the oracle), so the
two sides of the correctness check read the same rows the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casestory.sources.dictionary import from_pairs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A small demo dictionary from event types to clinical activity names.
# It has an exact key, keys equal up to case (first one wins), an upper-case key (used
# by the upper-case lookup), a name that is an exact category ("TSRM ...") and leaves
# "error" untranslated.
EVENT_DICTIONARY = [
    ("CLICK", "Emergency surgical visit"),
    ("Click", "Psychiatric visit"),
    ("view", "Upper abdomen CT"),
    ("purchase", "TSRM in operating room"),
    ("signup", "Psychiatric follow-up visit"),
    ("VIEW", "Lower abdomen ultrasound"),
    ("logout", "Full spine X-ray"),
    ("refund", "Psychiatric visit"),
]


def event_dictionary(spark: SparkSession) -> DataFrame:
    return from_pairs(spark, EVENT_DICTIONARY)


def dictionary_sql() -> str:
    rows = ", ".join(f"({i}, '{s}', '{d}')" for i, (s, d) in enumerate(EVENT_DICTIONARY))
    return f"(SELECT * FROM (VALUES {rows}) AS t(pos, src, dst))"


def events_log(spark: SparkSession, sf_dir: str, case_grain: str = "user_day",
               hour_grain: bool = True) -> DataFrame:
    """Event log "EV" (case = user and day) or "EU" (case = user) from ``events``.

    activity = event_type, event_idx = event_id; timestamps truncated to the hour make
    simultaneous groups. Case attributes are derived from the rows themselves: class
    from the event type (purchase 1, error null, else 0; the case takes its first
    event's), demographics from the user id.
    """
    e = table(spark, sf_dir, "events")
    ts = F.date_trunc("HOUR", "ts").cast("timestamp_ntz") if hour_grain else F.col("ts")
    case = (F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
            if case_grain == "user_day" else F.col("user_id").cast("string"))
    u = F.col("user_id")
    return e.select(
        case.alias("case_id"),
        F.col("event_id").alias("event_idx"),
        F.col("event_type").alias("activity"),
        ts.alias("ts"),
        F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", None)
         .otherwise(0).cast("int").alias("class_label"),
        F.when(u % 13 == 0, None).when(u % 11 == 0, "unknown").when(u % 7 == 0, "65+")
         .otherwise(F.concat((u % 50 + 20).cast("string"), F.lit("-"), (u % 50 + 24).cast("string")))
         .alias("age_range"),
        F.when(u % 5 == 0, u % 90).cast("int").alias("age"),
        F.when(u % 3 == 0, "M").when(u % 3 == 1, "F").alias("gender"),
        F.from_json("props", "map<string,string>").alias("attrs"),
    )


def events_log_sql(case_grain: str = "user_day", hour_grain: bool = True) -> str:
    case = ("CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d')" if case_grain == "user_day"
            else "CAST(user_id AS VARCHAR)")
    ts = "date_trunc('hour', ts)" if hour_grain else "ts"
    return f"""(SELECT {case} AS case_id, event_id AS event_idx, event_type AS activity, {ts} AS ts,
  CAST(CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN NULL ELSE 0 END AS INTEGER) AS class_label,
  CASE WHEN user_id % 13 = 0 THEN NULL WHEN user_id % 11 = 0 THEN 'unknown' WHEN user_id % 7 = 0 THEN '65+'
       ELSE CAST(user_id % 50 + 20 AS VARCHAR) || '-' || CAST(user_id % 50 + 24 AS VARCHAR) END AS age_range,
  CAST(CASE WHEN user_id % 5 = 0 THEN user_id % 90 END AS INTEGER) AS age,
  CASE WHEN user_id % 3 = 0 THEN 'M' WHEN user_id % 3 = 1 THEN 'F' END AS gender
FROM events)"""


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log "OL": one case per order, one event per line item, shipped on l_shipdate.

    activity = return flag and line status; the case class is the order status
    (F -> 1, O -> 0, P -> null). Ties on equal dates are broken by line number.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                                 "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.select(
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.col("l_linenumber").cast("long").alias("event_idx"),
        F.concat(F.lit("line "), F.col("l_returnflag"), F.col("l_linestatus")).alias("activity"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
         .cast("int").alias("class_label"),
        F.lit(None).cast("string").alias("age_range"),
        F.lit(None).cast("int").alias("age"),
        F.when(F.col("o_orderpriority").startswith("1"), "M").otherwise("F").alias("gender"),
        F.create_map().cast("map<string,string>").alias("attrs"),
    )


# Event types of ``events`` as the stay-log activities of the prefix texts.
STAY_ACTIVITIES = [
    ("signup", "Triage in the ED"),
    ("view", "Vital sign check"),
    ("click", "Medicine dispensations"),
    ("purchase", "Medicine reconciliation"),
    ("error", "Discharge from the ED"),
]


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat stay log (F2 shape) from ``events``: one stay per user, raw timestamps.

    Text and vital-sign fields are derived from the row (some left null on purpose so
    the 'N/A' rule and the null ``name_etc`` show).
    """
    e = table(spark, sf_dir, "events")
    act = F.when(F.lit(False), F.lit(None))
    for k, v in STAY_ACTIVITIES:
        act = act.when(F.col("event_type") == k, v)
    i, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return e.select(
        u.alias("stay_id"),
        F.col("ts").alias("timestamps"),
        act.alias("activity"),
        F.when(v >= 40, "ADMITTED").when(v >= 10, "HOME").alias("disposition"),
        F.when(u % 3 == 0, "M").otherwise("F").alias("gender"),
        F.when(u % 4 == 0, "WHITE").when(u % 4 == 1, "BLACK").when(u % 4 == 2, "ASIAN").alias("race"),
        F.when(u % 2 == 0, "AMBULANCE").otherwise("WALK IN").alias("arrival_transport"),
        F.concat(F.lit("Diagnosis "), (i % 23).cast("string")).alias("icd_title"),
        F.concat(F.lit("Complaint "), (u % 9).cast("string")).alias("chiefcomplaint"),
        F.lit(None).cast("string").alias("rhythm"),
        (i % 11).cast("string").alias("pain"),
        F.concat(F.lit("Drug "), (i % 29).cast("string")).alias("name"),
        F.when(i % 5 == 0, None).otherwise(F.concat(F.lit("class "), (i % 7).cast("string"))).alias("etcdescription"),
        v.alias("temperature"),
        F.when(i % 7 == 0, None).otherwise(v).alias("heartrate"),
        F.lit(16.0).alias("resprate"),
        F.lit(98.0).alias("o2sat"),
        F.lit(120.0).alias("sbp"),
        F.lit(80.0).alias("dbp"),
        (i % 5).cast("double").alias("acuity"),
        i.alias("row_idx"),
    )


def stays_sql() -> str:
    act = " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in STAY_ACTIVITIES)
    return f"""(SELECT user_id AS stay_id, ts AS timestamps, CASE {act} END AS activity,
  CASE WHEN value >= 40 THEN 'ADMITTED' WHEN value >= 10 THEN 'HOME' END AS disposition,
  CASE WHEN user_id % 3 = 0 THEN 'M' ELSE 'F' END AS gender,
  CASE WHEN user_id % 4 = 0 THEN 'WHITE' WHEN user_id % 4 = 1 THEN 'BLACK' WHEN user_id % 4 = 2 THEN 'ASIAN' END AS race,
  CASE WHEN user_id % 2 = 0 THEN 'AMBULANCE' ELSE 'WALK IN' END AS arrival_transport,
  'Diagnosis ' || CAST(event_id % 23 AS VARCHAR) AS icd_title,
  'Complaint ' || CAST(user_id % 9 AS VARCHAR) AS chiefcomplaint,
  CAST(NULL AS VARCHAR) AS rhythm,
  CAST(event_id % 11 AS VARCHAR) AS pain,
  'Drug ' || CAST(event_id % 29 AS VARCHAR) AS name,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'class ' || CAST(event_id % 7 AS VARCHAR) END AS etcdescription,
  value AS temperature, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS heartrate,
  16.0::DOUBLE AS resprate, 98.0::DOUBLE AS o2sat, 120.0::DOUBLE AS sbp, 80.0::DOUBLE AS dbp,
  CAST(event_id % 5 AS DOUBLE) AS acuity, event_id AS row_idx
FROM events)"""


# ------------------------------------------------------------ predictions and labels

def binary_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary predictions: y_true = toxic, y_pred = 1 - quality, score = document length."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id", "left").select(
        "doc_id", F.col("toxic").alias("y_true"), (1 - F.col("quality")).alias("y_pred"),
        F.col("n_chars").cast("double").alias("score"))


BINARY_PREDS_SQL = """(SELECT l.doc_id, l.toxic AS y_true, 1 - l.quality AS y_pred, CAST(d.n_chars AS DOUBLE) AS score
  FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)"""

N_FOLDS = 5
N_CLASSES = 10


def fold_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-class predictions of 5 "folds": fold f's logits are embedding[10f : 10f+10].

    Columns: id, fold, logits array<double>, y_true.
    """
    e = table(spark, sf_dir, "embeddings")
    folds = F.array(*[F.lit(f) for f in range(N_FOLDS)])
    x = e.select("vec_id", "label", "embedding", F.explode(folds).alias("fold"))
    return x.select(F.col("vec_id").alias("id"), F.col("fold").cast("int"),
                    F.transform(F.slice("embedding", F.col("fold") * N_CLASSES + 1, N_CLASSES),
                                lambda v: v.cast("double")).alias("logits"),
                    F.col("label").alias("y_true"))


FOLD_LOGITS_SQL = f"""(SELECT vec_id AS id, CAST(f AS INTEGER) AS fold,
  CAST(embedding[f * {N_CLASSES} + 1 : f * {N_CLASSES} + {N_CLASSES}] AS DOUBLE[]) AS logits, label AS y_true
  FROM embeddings, range({N_FOLDS}) t(f))"""


def orders_log_sql() -> str:
    return """(SELECT CAST(l.l_orderkey AS VARCHAR) AS case_id, CAST(l.l_linenumber AS BIGINT) AS event_idx,
  'line ' || l.l_returnflag || l.l_linestatus AS activity, l.l_shipdate AS ts,
  CAST(CASE WHEN o.o_orderstatus = 'F' THEN 1 WHEN o.o_orderstatus = 'O' THEN 0 END AS INTEGER) AS class_label,
  CAST(NULL AS VARCHAR) AS age_range, CAST(NULL AS INTEGER) AS age,
  CASE WHEN starts_with(o.o_orderpriority, '1') THEN 'M' ELSE 'F' END AS gender
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)"""


def epoch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch histories from ``events``: run = user_id mod 10, fold = day of month mod 5,
    epoch = hour of day; losses from exact per-epoch minima/maxima of ``value``."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy((F.col("user_id") % 10).cast("int").alias("run"),
                  (F.dayofmonth("ts") % 5).cast("int").alias("fold"),
                  F.hour("ts").cast("int").alias("epoch"))
    return g.agg((F.min("value") / 10.0).alias("val_loss"), (F.max("value") / 100.0).alias("train_loss"),
                 (1 - F.min("value") / 50.0).alias("balanced_accuracy"))


EPOCH_HISTORY_SQL = """(SELECT CAST(user_id % 10 AS INTEGER) AS run, CAST(dayofmonth(ts) % 5 AS INTEGER) AS fold,
  CAST(hour(ts) AS INTEGER) AS epoch, min(value) / 10.0 AS val_loss, max(value) / 100.0 AS train_loss,
  1 - min(value) / 50.0 AS balanced_accuracy FROM events GROUP BY ALL)"""
