"""Ordered scans inside a key (a case) that do not put a whole key into one task.

A plain ``Window.partitionBy(case_id)`` sends every event of a case to one task; a case
holding a third of the log would then run on one core. Here each key is cut into
ordered *buckets* (by default: time slices of the event timestamp), the window runs per
``(key, bucket)``, and only a one-row-per-bucket summary is scanned per key to carry
values across bucket borders:

* ``lags``      value of the previous row in key order
* ``leads``     value of the next row
* ``cumsums``   running sum from the first row of the key (inclusive)
* ``rownum``    1-based position in the key

Keys and buckets may be null: both travel in one struct, whose comparison treats null as a
value, so rows with a null key or a null order value form a group or a first bucket of their
own and no row is lost.

The bucket column must be non-decreasing in the row order (true for a time slice of
the leading ``ts`` ordering column). The summary has one row per non-empty bucket, so
its per-key window is small even for a hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestory.session import checkpoint_dir


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ts_bucket(ts: Column | str, seconds: int = 3600) -> Column:
    """Time slice number of a timestamp (LTZ or NTZ); non-decreasing in ``ts``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000))


def scan_by_key(df: DataFrame, key: list[str], order: list[Column | str], bucket: Column,
                lags: dict[str, Column] | None = None,
                leads: dict[str, Column] | None = None,
                cumsums: dict[str, Column] | None = None,
                rownum: str | None = None,
                keep_bucket: str | None = None) -> DataFrame:
    lags, leads, cumsums = lags or {}, leads or {}, cumsums or {}
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    k = "__k"
    d = df.withColumn(k, F.struct(*[F.col(c) for c in key], bucket.alias("__b")))
    w = Window.partitionBy(k).orderBy(*order_cols)
    okey = F.struct(*order_cols)
    d = d.withColumn("__rn", F.row_number().over(w))
    if leads:
        d = d.withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    # local (in-bucket) values
    for name, c in lags.items():
        d = d.withColumn(f"__lag_{name}", F.lag(c).over(w)).withColumn(f"__v_{name}", c)
    for name, c in leads.items():
        d = d.withColumn(f"__lead_{name}", F.lead(c).over(w)).withColumn(f"__v_{name}", c)
    for name, c in cumsums.items():
        d = d.withColumn(f"__cs_{name}",
                         F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        d = d.withColumn(f"__t_{name}", c)

    aggs = [F.count(F.lit(1)).alias("__n")]
    for name in lags:
        aggs.append(F.max_by(F.col(f"__v_{name}"), okey).alias(f"__blast_{name}"))
    for name in leads:
        aggs.append(F.min_by(F.col(f"__v_{name}"), okey).alias(f"__bfirst_{name}"))
    for name in cumsums:
        aggs.append(F.sum(F.col(f"__t_{name}")).alias(f"__btot_{name}"))
    summ = d.groupBy(k).agg(*aggs)
    ws = Window.partitionBy(*[F.col(f"{k}.{c}") for c in key]).orderBy(F.col(f"{k}.__b"))
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    sel = [k]
    sel.append(F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off_n"))
    for name in lags:
        sel.append(F.lag(f"__blast_{name}").over(ws).alias(f"__prev_{name}"))
    for name in leads:
        sel.append(F.lead(f"__bfirst_{name}").over(ws).alias(f"__next_{name}"))
    for name in cumsums:
        sel.append(F.coalesce(F.sum(f"__btot_{name}").over(before), F.lit(0)).alias(f"__off_{name}"))
    summ = summ.select(*sel)

    out = d.join(summ, on=k, how="inner")
    for name in lags:
        out = out.withColumn(name, F.when(F.col("__rn") == 1, F.col(f"__prev_{name}"))
                             .otherwise(F.col(f"__lag_{name}")))
    for name in leads:
        out = out.withColumn(name, F.when(F.col("__last"), F.col(f"__next_{name}"))
                             .otherwise(F.col(f"__lead_{name}")))
    for name in cumsums:
        out = out.withColumn(name, F.col(f"__cs_{name}") + F.col(f"__off_{name}"))
    if rownum:
        out = out.withColumn(rownum, F.col("__rn") + F.col("__off_n"))
    if keep_bucket:
        out = out.withColumn(keep_bucket, F.col(f"{k}.__b"))
    keep = set(df.columns) | set(lags) | set(leads) | set(cumsums) | {rownum, keep_bucket}
    return out.drop(*[c for c in out.columns if c.startswith("__") and c not in keep])


def range_buckets(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, the number of the row's range in the order of ``order``.

    Rows are range-partitioned by the whole order, so equal leading values spread over ranges as
    long as the order differs; a number never falls along the order, which makes it a bucket for
    ``scan_by_key`` with any leading part of the order as key. The ranges are sampled, so the rows
    and their numbers are kept in a reliable checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*(F.col(c) for c in order)).withColumn(out, F.spark_partition_id()).checkpoint()


def global_position(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """1-based position of every row in the order of ``order`` over the whole table.

    Rows are numbered inside their range (``range_buckets``), and a table with one row per range
    carries the counts over. Nulls come first.
    """
    cols = [F.col(c) for c in order]
    d = range_buckets(df, order, "__range")
    first = d.groupBy("__range").agg(F.min(F.struct(*cols)).alias("__min"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__min").rowsBetween(Window.unboundedPreceding, -1))
    offsets = first.select("__range", F.coalesce(before, F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*cols))
    return d.withColumn("__in", inside).join(offsets, "__range").withColumn(out, F.col("__in") + F.col("__off")).drop("__range", "__in", "__off")
