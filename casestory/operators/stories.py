"""One English story per case (W4, W5, T3, T4, T6, T6b) without a per-case window.

Plan (per event log):

1. events are repartitioned once by ``(case_id, time bucket)``; a long case is spread
   over many tasks;
2. the events of a ``(case_id, bucket)`` are collected in order -- the shuffle of step 1 already
   satisfies this grouping -- and inside the row simultaneous ones become groups (W4), each with
   its delta to the group before (W5); one aggregation, no window and no further sort;
3. each bucket keeps its first group unrendered (its delta depends on the previous
   bucket) and renders the rest;
4. one row per bucket goes to the per-case aggregation, which renders the first group
   of each bucket from the previous bucket's last timestamp and joins the chunks.

Only step 4 gathers a case into one row -- that row *is* the story, so its size is the
output's; the work of building it is spread over buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestory.functions.seq import let, ts_bucket
from casestory.operators import textgen
from casestory.operators.traces import case_metadata, valid_events


def event_phrases(log: DataFrame, dictionary: DataFrame, mode: str = "exact_ci") -> DataFrame:
    """J1 + T1 on each event row."""
    ev = valid_events(log)
    ev = textgen.translate(ev, dictionary, "activity", "activity_en", mode)
    return textgen.with_activity_phrase(ev, "activity_en", "phrase")


def time_groups(phrases: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """W4 + W5: per case and bucket the array ``groups`` of its groups of simultaneous events in time order:
    ``ts``, ``items`` (phrases in event order), ``delta`` to the previous group (null for the
    first one of a bucket -- filled by ``stories``)."""
    ev = phrases.withColumn("bucket", ts_bucket("ts", bucket_seconds)).repartition("case_id", "bucket")
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_idx", "phrase")))
    b = ev.groupBy("case_id", "bucket").agg(ordered.alias("events"))

    def groups(e):
        starts = F.filter(F.transform(e, lambda x, i: F.when(F.when(i == 0, F.lit(True)).otherwise(F.get(e, i - 1)["ts"] != x["ts"]), i)),
                          lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, no: F.struct(
            F.get(e, i)["ts"].alias("ts"),
            F.transform(F.slice(e, i + 1, F.coalesce(F.get(at, no + 1), F.size(e)) - i), lambda x: x["phrase"]).alias("items"),
            F.when(i > 0, F.timestamp_diff("SECOND", F.get(e, i - 1)["ts"], F.get(e, i)["ts"])).alias("delta"))))
    return b.select("case_id", "bucket", let(F.col("events"), groups).alias("groups"))


def stories(log: DataFrame, dictionary: DataFrame, style: str = "narrative",
            token_dict: DataFrame | None = None, bucket_seconds: int = 3600,
            mode: str = "exact_ci") -> DataFrame:
    """``(case_id, story_text, language, label)`` for every case of the log.

    Cases whose events are all invalid get the empty-case text; ``label`` is the case
    class with null -> 0 (P12).
    """
    sep = textgen.STYLE_SEPARATORS[style][0]
    g = time_groups(event_phrases(log, dictionary, mode), bucket_seconds)
    rest = F.transform(F.slice("groups", F.lit(2), F.size("groups")), lambda x: textgen.group_text(style, x["delta"], x["items"]))
    chunks = g.select(
        "case_id", "bucket", F.get("groups", F.lit(0))["ts"].alias("first_ts"), F.element_at("groups", -1)["ts"].alias("last_ts"),
        F.get("groups", F.lit(0))["items"].alias("first_items"),
        F.array_join(F.filter(rest, lambda t: t.isNotNull()), sep).alias("rest"))
    per_case = chunks.groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "first_ts", "last_ts", "first_items", "rest")))
        .alias("cs"))

    def render(c, i):
        prev_last = F.get(F.col("cs"), i - 1)["last_ts"]
        delta = F.when(i == 0, F.lit(0)).otherwise(F.timestamp_diff("SECOND", prev_last, c["first_ts"]))
        head = textgen.group_text(style, delta, c["first_items"])
        return F.when(c["rest"] == "", head).otherwise(F.concat(head, F.lit(sep), c["rest"]))

    body = per_case.select("case_id", F.array_join(F.transform("cs", render), sep).alias("body"))
    meta = case_metadata(log)
    intro = textgen.patient_intro(F.col("gender"), F.col("age"))
    out = meta.join(body, "case_id", "left").select(
        "case_id",
        F.concat(intro, F.lit(textgen.STYLE_SEPARATORS[style][1]),
                 F.coalesce(F.col("body"), F.lit(textgen.EMPTY_CASE_TEXT))).alias("story_text"),
        F.lit("en").alias("language"),
        F.coalesce(F.col("class_label"), F.lit(0)).alias("label"),
    )
    if token_dict is not None:
        from casestory.operators.tokens import replace_with_tokens
        out = replace_with_tokens(out, token_dict, "story_text", id_col="case_id")
    # A story that could not be rendered falls back to a fixed sentence
    return out.withColumn("story_text", F.coalesce(
        F.col("story_text"),
        F.concat(F.lit("Error generating narrative for patient "), F.col("case_id"), F.lit("."))))
