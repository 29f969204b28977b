"""Rows of files without a key, numbered in source order and paired by position.

The source order is that of the file names, then the order inside a file. A file may be read in several
splits by several tasks, in any order: a split knows its file and its first byte, and the rows of a
split are numbered as they are read. The rows are written with these three numbers; a table with one row per
split carries the counts over, so no window runs over the rows and no file has to be in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casestory.functions.quantile import stash


def numbered(source: DataFrame, out: str = "pos") -> DataFrame:
    """``source`` with its row numbers in source order, from 0, in ``out``.

    ``source`` is a table just read from files (Parquet, JSON, CSV or text), columns chosen or
    computed but no row dropped or moved. Columns of ``source`` keep their names; ``out`` must be new.
    """
    if out in source.columns:
        raise ValueError(f"{out} is a column of the table")
    rows = source.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
                         F.monotonically_increasing_id().alias("__at"))
    held = stash(rows, "numbered")
    splits = held.groupBy("__file", "__start").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    files = splits.groupBy("__file").agg(F.sum("n").alias("n"))
    files = files.select("__file", (F.sum("n").over(Window.orderBy("__file")) - F.col("n")).alias("before"))  # one row per file
    inside = F.sum("n").over(Window.partitionBy("__file").orderBy("__start")) - F.col("n")  # one row per split
    offset = splits.withColumn("inside", inside).join(files, "__file").select(
        "__file", "__start", (F.col("before") + F.col("inside") - F.col("first")).alias("__shift"))
    return held.join(offset, ["__file", "__start"]).withColumn(out, F.col("__at") + F.col("__shift")).drop("__file", "__start", "__at", "__shift")


def pair_by_position(left: DataFrame, right: DataFrame, out: str = "pos") -> DataFrame:
    """The rows of two tables of files side by side, row by row, with their position.

    Columns must differ. Tables of unequal length raise ValueError, as a silent cut would pair wrong
    rows with no one noticing; two empty tables give none.
    """
    both = set(left.columns) & set(right.columns)
    if both:
        raise ValueError(f"columns of both tables: {sorted(both)}")
    a, b = stash(numbered(left, out), "left"), stash(numbered(right, out), "right")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"tables of {n} and {m} rows cannot be paired by position")
    return a.join(b, out)
