"""Case-level metadata, traces and log statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestory.functions.text import try_cast

from casestory.functions.seq import scan_by_key, ts_bucket

_INT = "^[+-]?[0-9]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_age(age_range) -> Column:
    """P4: '55-59' -> 57 (floor of the middle), '65+' -> 70, '40' -> 40, else null.

    A '-' form whose parts are not both integers falls through to the other rules.
    """
    s = F.trim(_c(age_range))
    parts = F.split(s, "-")
    p0, p1 = F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))
    is_range = F.contains(s, F.lit("-")) & (F.size(parts) == 2) & p0.rlike(_INT) & p1.rlike(_INT)
    rng = F.floor((try_cast(p0, "long") + try_cast(p1, "long")) / 2).cast("int")
    plus = F.trim(F.replace(s, F.lit("+"), F.lit("")))
    is_plus = F.contains(s, F.lit("+")) & plus.rlike(_INT)
    return (F.when(s.isNull(), F.lit(None).cast("int"))
            .when(is_range, rng)
            .when(is_plus, try_cast(plus, "int") + 5)
            .when(s.rlike(_INT), try_cast(s, "int")))


def check_class(label) -> Column:
    """Class values other than 0/1 (or null) abort the job."""
    c = _c(label)
    return F.when(c.isNull() | c.isin(0, 1), c).otherwise(
        F.raise_error(F.concat(F.lit("class value not in (0, 1): "), c.cast("string"))).cast("int"))


def case_metadata(log: DataFrame, fallback_class_key: str = "class_ricovero_dimissioni") -> DataFrame:
    """P5 + P6: metadata from the first event row of the case in source order.

    One aggregation (partial aggregation on the map side: one row per case per task);
    class falls back to the case attribute map; an explicit age overrides the range.
    """
    # only the fallback value of the attribute map travels (a map in the buffer would force
    # a sort-based aggregate)
    first = F.min_by(F.struct("class_label", "age_range", "age", "gender",
                              F.col("attrs")[fallback_class_key].alias("fallback")), "event_idx")
    m = (log.filter(F.col("case_id").isNotNull())
            .groupBy("case_id").agg(first.alias("m")))
    cls = F.coalesce(F.col("m.class_label"),
                     try_cast(try_cast(F.col("m.fallback"), "double"), "int"))
    return m.select(
        "case_id",
        check_class(cls).alias("class_label"),
        F.col("m.age_range").alias("age_range"),
        F.coalesce(F.col("m.age"), parse_age(F.col("m.age_range"))).alias("age"),
        F.col("m.gender").alias("gender"),
    )


def valid_events(log: DataFrame) -> DataFrame:
    """Events with a null case or a null/unparsable timestamp are dropped."""
    return log.filter(F.col("case_id").isNotNull() & F.col("ts").isNotNull())


def traces(log: DataFrame) -> DataFrame:
    """One row per case with its ordered events and metadata.

    Only for consumers that need the whole trace in one row; the story and prefix
    operators stay on exploded rows so a long case is not collected into one task.
    """
    ev = valid_events(log)
    tr = ev.groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("ts", "event_idx", "activity"))).alias("events"))
    meta = case_metadata(log)
    return meta.join(tr, "case_id", "left").withColumn(
        "events", F.coalesce("events", F.array().cast(tr.schema["events"].dataType)))


def event_order(log: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """W1 + W2 + W3 + W7: position, seconds since the previous event and since case start.

    W2 is fractional seconds (0 for the first event), W3 truncated integer seconds.
    Runs through the bucketed scan, so a hot case is split over many tasks.
    """
    ev = valid_events(log)
    start = ev.groupBy("case_id").agg(F.min("ts").alias("case_start"))
    s = scan_by_key(ev, ["case_id"], ["ts", "event_idx"], ts_bucket("ts", bucket_seconds),
                    lags={"prev_ts": F.col("ts")}, rownum="row_position")
    s = s.join(start, "case_id")
    return s.select(
        *ev.columns,
        (F.col("row_position") - 1).alias("row_position"),
        F.coalesce(seconds_between("prev_ts", "ts"), F.lit(0.0)).alias("time_since_last"),
        F.timestamp_diff("SECOND", F.col("case_start"), F.col("ts")).alias("time_since_start"),
    )


def seconds_between(a, b) -> Column:
    """Fractional seconds from ``a`` to ``b`` (microsecond exact)."""
    return F.timestamp_diff("MICROSECOND", _c(a), _c(b)) / F.lit(1e6)


def log_statistics(log: DataFrame) -> DataFrame:
    """A1: events, distinct cases, distinct activities, first and last timestamp."""
    return log.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct("case_id").alias("total_cases"),
        F.countDistinct("activity").alias("unique_activities"),
        F.min("ts").alias("ts_start"),
        F.max("ts").alias("ts_end"),
    )


def class_distribution_by_case(log: DataFrame) -> DataFrame:
    """A1: class counts over distinct (case, class) pairs; null class not counted."""
    return (log.select("case_id", "class_label").dropDuplicates()
               .filter(F.col("class_label").isNotNull())
               .groupBy("class_label").agg(F.count(F.lit(1)).alias("n_cases")))
