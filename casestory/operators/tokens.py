"""Atomic phrase tokens (T9-T12): dictionary -> ``[CLIN_nnn]`` tokens and text replacement.

Numbers are positions in the order of length, taken by length and carried over the table of
lengths; replacements use the hits of the shared phrase search. No step collects the
dictionary or numbers it in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestory.functions.seq import scan_by_key
from casestory.operators.actions import phrase_hits

TOKEN_FORMAT = "[CLIN_%03d]"


def token_dictionary(dictionary: DataFrame) -> DataFrame:
    """Distinct target phrases, longest first (ties by first position), numbered.

    Columns: token_no, token, phrase, src (the last source of the phrase), length,
    first_pos.
    """
    d = (dictionary.groupBy(F.col("dst").alias("phrase"))
                   .agg(F.min("pos").alias("first_pos"), F.max_by("src", "pos").alias("src")))
    d = d.withColumn("length", F.length("phrase"))
    d = scan_by_key(d, [], [F.col("length").desc(), F.col("first_pos")], -F.col("length"), rownum="token_no")
    return d.select(F.col("token_no").cast("int").alias("token_no"), F.format_string(TOKEN_FORMAT, F.col("token_no")).alias("token"),
                    "phrase", "src", "length", "first_pos")


def replace_with_tokens(df: DataFrame, tokens: DataFrame, col: str, out: str | None = None,
                        id_col: str = "doc_id") -> DataFrame:
    """Replace phrases by tokens, longest first, case-sensitive, one after another
    on the already-replaced text (``id_col`` names a row).

    Phrases that stand in the original text come from the phrase search. A phrase can also
    arise by a replacement, inside a token or over its edge; such a phrase has a bracket or
    consists of a token's characters, and these few are tried on every replaced text. The
    fold over both in token order equals the sequential rule.
    """
    entry = F.struct("token_no", "phrase", "token")
    hits = phrase_hits(df.select(F.col(id_col).alias("doc_id"), F.col(col).alias("text")), tokens.select(F.col("phrase").alias("action")),
                       ignore_case=False)
    own = (hits.join(tokens.select("token_no", "phrase", "token"), hits["action"] == tokens["phrase"])
           .groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(entry).alias("__own")))
    arising = tokens.where(F.col("phrase").rlike(r"[\[\]]|^[CLIN_0-9]+$")).agg(F.collect_list(entry).alias("all")).select("all").scalar()
    d = df.join(own, F.col(id_col) == F.col("__id"), "left").withColumn("__arising", arising)
    steps = F.array_sort(F.array_union("__own", "__arising"))
    folded = F.aggregate(steps, F.col(col), lambda acc, x: F.replace(acc, x["phrase"], x["token"]))
    return d.withColumn(out or col, F.when(F.size("__own") > 0, folded).otherwise(F.col(col))).drop("__id", "__own", "__arising")


def token_lookup(df: DataFrame, tokens: DataFrame, col: str = "token") -> DataFrame:
    """Token -> phrase (null when unknown), by a join with the token table."""
    t = tokens.select(F.col("token").alias("__tk"), F.col("phrase").alias("interpretation"))
    return df.join(t, df[col] == t["__tk"], "left").drop("__tk")


def token_summary(tokens: DataFrame, total_in_dictionary: DataFrame) -> DataFrame:
    """Count, coverage text, longest and shortest phrase (first in token order on
    ties) and the first five examples as text."""
    n_src = total_in_dictionary.agg(F.count(F.lit(1)).alias("total_procedures"))
    s = tokens.agg(
        F.count(F.lit(1)).alias("total_tokens"),
        F.min_by("phrase", F.struct(-F.col("length"), F.col("token_no"))).alias("longest_procedure"),
        F.min_by("phrase", F.struct(F.col("length"), F.col("token_no"))).alias("shortest_procedure"),
        F.array_join(F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col("token_no") <= 5, F.struct("token_no", "token", "phrase")))),
                                         lambda x: F.concat(x["token"], F.lit(": "), x["phrase"], F.lit(" ("),
                                                             F.length(x["phrase"]).cast("string"), F.lit(")"))), 1, 5),
                     " | ").alias("examples"),
    )
    return s.select("*", F.concat(F.col("total_tokens").cast("string"), F.lit("/"),
                                  n_src.select("total_procedures").scalar().cast("string"),
                                  F.lit(" (100%)")).alias("coverage"))
