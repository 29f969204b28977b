"""Exact medians per group by distributed selection: no group is sorted or held in one task.

The values of a group are counted in equal ranges between their least and greatest, the range that holds
the wanted rank is taken with its own least and greatest value, and so on until one value is
left. A round is one scan and one aggregate of at most ``RANGES`` rows per group and rank, which
combines on the map side; two different values always fall into different ranges at last, as the
least and the greatest of a range do at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestory.session import scratch_path

RANGES = 1024


def stash(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: the lineage ends here."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _range(v: Column, low: Column, high: Column) -> Column:
    """Number of the range of v in [low, high]; halves keep the difference finite."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2)
    return F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int")


def exact_medians(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """``group`` and, per column of ``values``, its median: the mean of the two middle values of an even
    number. Nulls do not count, a group without values has a null median. Infinite values are
    ordered as such, NaN is above them; a mean of both infinities is NaN. A null group is a group."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in values]))
    long = stash(df.select(F.struct(F.col(group)).alias("g"), each.alias("e")).select("g", "e.*").where("v is not null"), "values")
    finite = ~F.isnan("v") & (F.abs("v") != F.lit(float("inf")))
    low, n, fin = F.count_if(F.col("v") == F.lit(float("-inf"))), F.count("*"), F.count_if(finite)
    first = long.groupBy("g", "name").agg(n.alias("n"), low.alias("under"), fin.alias("fin"), F.count_if(F.isnan("v")).alias("nans"),
                                          F.min(F.when(finite, F.col("v"))).alias("low"), F.max(F.when(finite, F.col("v"))).alias("high"))
    ranks = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))))  # counted from 0
    state = stash(first.select("*", ranks.alias("rank")), "ranks")
    outside = (F.when(F.col("rank") < F.col("under"), F.lit(float("-inf")))
               .when(F.col("rank") >= F.col("n") - F.col("nans"), F.lit(float("nan")))
               .when(F.col("rank") >= F.col("under") + F.col("fin"), F.lit(float("inf"))))
    parts = [state.where(outside.isNotNull()).select("g", "name", "rank", outside.alias("v"))]
    open_ = state.where(outside.isNull()).select("g", "name", "rank", "low", "high", (F.col("rank") - F.col("under")).alias("left"))
    inside = long.where(finite)
    while True:
        parts.append(open_.where("low = high").select("g", "name", "rank", F.col("low").alias("v")))
        open_ = open_.where("low < high")
        if open_.isEmpty():
            break
        met = inside.join(open_, ["g", "name"]).where("v between low and high")
        counts = met.groupBy("g", "name", "rank", "left", _range(F.col("v"), F.col("low"), F.col("high")).alias("r")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("n").over(Window.partitionBy("g", "name", "rank").orderBy("r")) - F.col("n")  # RANGES rows
        held = counts.withColumn("before", before).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n")))
        open_ = stash(held.select("g", "name", "rank", "low", "high", (F.col("left") - F.col("before")).alias("left")), "ranks")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    middle = found.groupBy("g", "name").agg((F.min("v") / 2 + F.max("v") / 2).alias("v"))  # one row or two
    wide = middle.groupBy("g").agg(*[F.max(F.when(F.col("name") == c, F.col("v"))).alias(c) for c in values])
    every = df.select(F.struct(F.col(group)).alias("g")).distinct()
    return every.join(wide, "g", "left").select(f"g.{group}", *values)
