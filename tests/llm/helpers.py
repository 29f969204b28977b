"""Fixtures of awkward rows and brute-force versions of the operators."""

from __future__ import annotations

import re
from pyspark.sql import types as T

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns whose names clash with those the operators use inside.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()),
    T.StructField("th", T.LongType()), T.StructField("size", T.StringType()), T.StructField("taken", T.StringType()),
    T.StructField("word", T.StringType()), T.StructField("copies", T.IntegerType()), T.StructField("n", T.IntegerType())])


def frame(spark, rows, partitions=3):
    """rows: (doc_id, text, source)."""
    data = [(i, t, "en", s, None, "x", 1, "y", "z", None, 2, 3) for i, t, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


def ascii_lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, words=300):
    vocabulary = [f"w{k}" for k in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
