"""Event-log readers (S1 XES, S2 flat stay CSV) and the column renames/checks.

Every reader returns the common event-log shape::

    case_id string, event_idx bigint, activity string, ts timestamp,
    class_label int, age_range string, age int, gender string,
    attrs map<string,string>        -- trace (case) attributes not mapped above

``event_idx`` is the position of the event in the source and is the tie-breaker for
equal timestamps everywhere: events of a case are ordered by ``(ts, event_idx)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casestory.functions.text import try_cast
from pyspark.sql import types as T

EVENT_LOG_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("event_idx", T.LongType()),
    T.StructField("activity", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("class_label", T.IntegerType()),
    T.StructField("age_range", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])

# XES attribute element kinds that carry a key/value pair.
XES_KINDS = ["string", "date", "int", "float", "boolean", "id"]
# XES attribute keys with a meaning (standard XES keys and the case
# attributes the reference reads).
XES_CASE_NAME = "concept:name"
XES_ACTIVITY = "concept:name"
XES_TIMESTAMP = "time:timestamp"
CASE_CLASS_KEY = "class_ricovero_dimissioni"
CASE_AGE_RANGE_KEY = "Fascia_Eta"
CASE_AGE_KEY = "age"
CASE_GENDER_KEY = "gender"
# Column names a pandas conversion of a log gives the builtin types; skipped by P3.
BUILTIN_TYPE_NAMES = ["int", "float", "str", "bool", "date", "datetime", "list", "dict", "tuple", "set"]

_KV = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()),
                                T.StructField("_value", T.StringType())]))
_XES_EVENT = T.StructType([T.StructField(k, _KV) for k in XES_KINDS])
XES_TRACE_SCHEMA = T.StructType([T.StructField(k, _KV) for k in XES_KINDS]
                                + [T.StructField("event", T.ArrayType(_XES_EVENT))])


def _kv_map(node) -> F.Column:
    """All key/value children of an XES element as one map; the first of a repeated key wins."""
    pairs = F.flatten(F.array(*[F.coalesce(node[k], F.array().cast(_KV)) for k in XES_KINDS]))
    keys = F.transform(pairs, lambda p: p["_key"])
    firsts = F.filter(pairs, lambda p, i: F.array_position(keys, p["_key"]) == i + 1)
    return F.map_from_entries(F.transform(firsts, lambda p: F.struct(p["_key"], p["_value"])))


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """XES file(s) -> event rows; trace attributes kept on each event.

    The XML source splits the file by ``<trace>`` so a large log is read in parallel;
    nested attributes, globals and classifiers are not read.
    """
    raw = (spark.read.format("xml").option("rowTag", "trace").option("ignoreNamespace", "true")
           .schema(XES_TRACE_SCHEMA).load(path))
    tr = raw.select(_kv_map(F.struct(*[F.col(k) for k in XES_KINDS])).alias("tattrs"), "event")
    ev = tr.select("tattrs", F.posexplode_outer("event").alias("pos", "e"))
    ev = ev.select(
        F.col("tattrs"),
        F.col("pos").cast("long").alias("event_idx"),
        _kv_map(F.col("e")).alias("eattrs"),
    )
    t = F.col("tattrs")
    log = ev.select(
        t[XES_CASE_NAME].alias("case_id"),
        "event_idx",
        F.col("eattrs")[XES_ACTIVITY].alias("activity"),
        F.try_to_timestamp(F.col("eattrs")[XES_TIMESTAMP]).alias("ts"),
        F.col("eattrs")[XES_TIMESTAMP].alias("ts_raw"),
        t[CASE_CLASS_KEY].alias("class_raw"),
        t[CASE_AGE_RANGE_KEY].alias("age_range"),
        t[CASE_AGE_KEY].alias("age_raw"),
        t[CASE_GENDER_KEY].alias("gender"),
        F.map_filter(t, lambda k, v: k != XES_CASE_NAME).alias("attrs"),
    ).filter(F.col("event_idx").isNotNull())
    return log.select(
        "case_id", "event_idx", "activity", "ts",
        try_cast(try_cast(F.col("class_raw"), "double"), "int").alias("class_label"),
        "age_range",
        try_cast(try_cast(F.col("age_raw"), "double"), "int").alias("age"),
        "gender", "attrs")


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail when a required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Required columns missing: {missing}")
    return df


def from_flat_frame(df: DataFrame, case_col: str = "case:concept:name",
                    activity_col: str = "concept:name", ts_col: str = "time:timestamp",
                    idx_col: str | None = None) -> DataFrame:
    """P1 + P2 + P3 for a flat event table with XES-style column names.

    Renames the three key columns (failing if one is absent), parses timestamps (null or
    unparsable -> null, the event is later dropped), maps the ``case:`` columns the
    reference reads and keeps every other non-null column as a string attribute.
    """
    require_columns(df, [case_col, activity_col, ts_col])
    idx = F.col(idx_col) if idx_col else F.monotonically_increasing_id()
    ts = F.col(ts_col)
    if not isinstance(df.schema[ts_col].dataType, (T.TimestampType, T.TimestampNTZType)):
        ts = F.try_to_timestamp(ts.cast("string"))
    std = {case_col, activity_col, ts_col, f"case:{CASE_CLASS_KEY}", f"case:{CASE_AGE_RANGE_KEY}",
           f"case:{CASE_AGE_KEY}", f"case:{CASE_GENDER_KEY}"} | ({idx_col} if idx_col else set())
    extra = [c for c in df.columns if c not in std]

    def opt(name, typ):
        return F.col(f"`{name}`").cast(typ) if name in df.columns else F.lit(None).cast(typ)

    return df.select(
        F.col(f"`{case_col}`").cast("string").alias("case_id"),
        idx.cast("long").alias("event_idx"),
        F.col(f"`{activity_col}`").cast("string").alias("activity"),
        ts.alias("ts"),
        try_cast(opt(f"case:{CASE_CLASS_KEY}", "string"), "double").cast("int").alias("class_label"),
        opt(f"case:{CASE_AGE_RANGE_KEY}", "string").alias("age_range"),
        try_cast(opt(f"case:{CASE_AGE_KEY}", "string"), "double").cast("int").alias("age"),
        opt(f"case:{CASE_GENDER_KEY}", "string").alias("gender"),
        extra_attributes(extra).alias("attrs"),
    )


def extra_attributes(cols: list[str]) -> F.Column:
    """Non-standard, non-null columns as a string map; builtin-type names skipped."""
    keep = [c for c in cols if c not in BUILTIN_TYPE_NAMES]
    if not keep:
        return F.create_map().cast("map<string,string>")
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in keep]),
                          F.array(*[F.col(f"`{c}`").cast("string") for c in keep]))
    return F.map_filter(m, lambda k, v: v.isNotNull())


# ---------------------------------------------------------------- S2: flat stay CSV

STAY_CSV_SCHEMA = T.StructType([
    T.StructField("stay_id", T.LongType()),
    T.StructField("timestamps", T.StringType()),
    T.StructField("activity", T.StringType()),
    T.StructField("disposition", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("race", T.StringType()),
    T.StructField("arrival_transport", T.StringType()),
    T.StructField("icd_title", T.StringType()),
    T.StructField("chiefcomplaint", T.StringType()),
    T.StructField("rhythm", T.StringType()),
    T.StructField("pain", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("etcdescription", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("heartrate", T.DoubleType()),
    T.StructField("resprate", T.DoubleType()),
    T.StructField("o2sat", T.DoubleType()),
    T.StructField("sbp", T.DoubleType()),
    T.StructField("dbp", T.DoubleType()),
    T.StructField("acuity", T.DoubleType()),
])


def read_stay_csv(spark: SparkSession, path: str) -> DataFrame:
    """The flat stay log with an explicit schema; timestamps parsed (bad -> null).

    ``row_idx`` is the place in the input (``source_order``) for the stable timestamp order; the
    engine orders splits by size, so a plain running id would not follow the files.
    """
    df = spark.read.csv(path, header=True, schema=STAY_CSV_SCHEMA)
    return (df.withColumn("row_idx", source_order())
              .withColumn("timestamps", F.try_to_timestamp(F.col("timestamps"))))


def source_order() -> F.Column:
    """Place of a row in its input, comparable over files and splits: file path, start of the
    split in the file, number inside the split (the low bits of the partition-wise id)."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), inside.alias("no"))
