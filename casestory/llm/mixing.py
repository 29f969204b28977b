"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source queues its documents in a shuffled order, twice over. A copy's virtual finish time is
the number of source tokens up to and including it, divided by the source's target; all queues
are served in the order of finish times until the total budget is spent.

No window covers a source: running sums are taken in slices of the shuffle order and carried over
from a table of slice sums (sources x slices rows), so a source with a third of all rows is spread
over its slices. The budget is cut in the same way, by ranges of the finish time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestory.llm.common import stash

#: Rows that one slice of a queue or of the finish times should hold.
SLICE_ROWS = 4_000
MAX_COPIES = 2
#: The cycle of source weights by rank, and the budget as a share of all sizes (fixed by contract).
WEIGHTS, BUDGET = (5, 2, 1), (3, 2)


def word_count(text: Column) -> Column:
    """Number of runs of characters outside [\\x20\\x09-\\x0D]; null counts as empty."""
    line = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(line, " "), lambda w: w != F.lit(""))).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` of ``source, source_size`` rows, one per source.

    Sources rank by code point, null last. With caps copies x size, all sources whose cap is
    below level x weight are full and the others get level x weight, where the level spends the
    budget: reading sources by cap / weight, the level is the first that the next cap allows.
    """
    cycle = F.array(*(F.lit(w) for w in weights))
    order = Window.orderBy(F.col("source").isNull(), "source")
    d = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    d = d.withColumn("cap", F.col("source_size") * copies)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * budget[0] / budget[1]
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    d = (d.withColumn("left", total - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("open", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", F.col("left") / F.col("open")))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    d = d.withColumn("final", F.first(fits, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return d.select("source", "source_size",
                    F.coalesce(F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def running(df: DataFrame, keys: list[str], slice_col: str, order: list, value: str, out: str) -> DataFrame:
    """Running sum of ``value`` inside ``keys`` in the order (slice, order), inclusive."""
    w = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys, slice_col).agg(F.sum(value).alias("__sum"))
    ahead = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, slice_col, F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__before"))
    sums = sums.select(*(F.col(k).alias(f"__r_{k}") for k in [*keys, slice_col]), "__before")
    same = F.lit(True)
    for k in [*keys, slice_col]:
        same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    d = df.withColumn(out, F.sum(value).over(w)).join(sums, same)
    return d.withColumn(out, F.col(out) + F.col("__before")).drop("__before", *(f"__r_{k}" for k in [*keys, slice_col]))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, budget=BUDGET, copies: int = MAX_COPIES, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: ``id, th, size, source, source_size, target, taken``.

    ``taken`` is 0 to ``copies`` times the size. The shuffle order is a hash of id, text and seed,
    so reruns agree; rows that repeat id, text and source are interchangeable. A null source is a
    source; null and empty texts have size 0 and take nothing; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stash(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(source_col).alias("source"),
                             word_count(text).alias("size")), "sizes")
    facts = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    aims = targets(facts.select("source", "source_size"), weights, budget, copies)
    facts = stash(facts.select(F.col("source").alias("s"), "n_rows").join(aims, F.col("s").eqNullSafe(F.col("source"))).drop("s"), "targets")
    n_rows = facts.agg(F.sum("n_rows"), F.sum("target")).first()
    budget_words, n_slices = n_rows[1] or 0.0, -(-(n_rows[0] or 0) * copies // SLICE_ROWS) or 1
    aims = facts.select(F.col("source").alias("__s"), "source_size", "target", "n_rows")
    # the slice is a monotonic step of the unsigned draw, which orders the queue
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "th"), 1)
    queue = (rows.join(aims, F.col("source").eqNullSafe(F.col("__s"))).withColumn("draw", draw)
             .withColumn("slice", F.floor(F.col("draw") / F.lit(2.0**63) * F.ceil(F.col("n_rows") / SLICE_ROWS))))
    queue = running(queue, ["source"], "slice", ["draw", "id", "th"], "size", "through")
    queue = stash(queue.select("id", "th", "size", "source", "source_size", "target", "draw", "through"), "queues")

    def finish(turn):
        return (turn * F.col("source_size") + F.col("through")) / F.col("target")

    served = (queue.where("size > 0 and target > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
              .withColumn("finish", finish(F.col("turn")))
              .withColumn("slice", F.floor(F.col("finish") * n_slices)))
    last = last_served(served, budget_words)
    place = lambda turn: F.struct(finish(F.lit(turn)).alias("finish"), F.col("source"), F.col("draw"), F.lit(turn).alias("turn"))
    taken = sum((F.when(place(t) <= last, F.col("size")).otherwise(F.lit(0)) for t in range(copies)), F.lit(0))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0)).cast("long")
    return queue.select("id", "th", "size", "source", "source_size", "target", taken.alias("taken"))


def last_served(served: DataFrame, budget: float) -> Column:
    """Place (finish, source, draw, turn) of the last copy that the budget pays in the order of
    finish times: slice sums find the slice in which it runs out, a window over that slice the copy."""
    order = ["finish", "source", "draw", "turn"]
    sums = served.groupBy("slice").agg(F.sum("size").alias("words"))
    through = F.sum("words").over(Window.orderBy("slice"))
    row = sums.withColumn("through", through).where(F.col("through") > budget).orderBy("slice").first()
    if row is None:  # nothing to serve, or the budget pays for all
        return F.struct(F.lit(float("inf")).alias("finish"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("draw"), F.lit(0).alias("turn"))
    rest = budget - (row["through"] - row["words"])
    inside = served.where(F.col("slice") == row["slice"]).withColumn(
        "spent", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    end = inside.where(F.col("spent") <= rest).agg(F.max(F.struct(*order)).alias("end")).first()["end"]
    if end is None:
        end = served.where(F.col("slice") < row["slice"]).agg(F.max(F.struct(*order)).alias("end")).first()["end"]
    if end is None:
        return F.struct(F.lit(-1.0).alias("finish"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("draw"), F.lit(0).alias("turn"))
    return F.struct(F.lit(end["finish"]).alias("finish"), F.lit(end["source"]).cast("string").alias("source"),
                    F.lit(end["draw"]).cast("long").alias("draw"), F.lit(end["turn"]).alias("turn"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``size, source_size, target, taken`` beside
    their columns (in place of equally named ones); ``taken / size`` is the number of copies to
    train on."""
    plan = stash(mix(docs, id_col, text_col, source_col).where("taken > 0").select(
        F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("source").alias("__source"),
        "size", "source_size", "target", "taken"), "mix")
    key, facts = ["__id", "__th", "__source"], ["size", "source_size", "target", "taken"]
    each = (plan.groupBy(*key).agg(*(F.first(c).alias(f"__m_{c}") for c in facts[:3]), F.array_sort(F.collect_list("taken")).alias("__each")))
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumn("__t", th).withColumn("__no", F.lit(1))
    if not each.where(F.size("__each") > 1).isEmpty():  # rows that repeat id, text and source: one share each
        rows = rows.withColumn("__no", F.row_number().over(Window.partitionBy(id_col, "__t", source_col).orderBy("__t")))
    out = rows.join(each, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th"))
                    & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__no") <= F.size("__each")))
    out = out.withColumn("__m_taken", F.element_at("__each", F.col("__no")))
    return out.select(*(c for c in docs.columns if c not in facts), *(F.col(f"__m_{c}").alias(c) for c in facts))
