"""Flat stay log -> growing prefix texts.

A stay's prefixes are the cumulative concatenation of its rendered events; list-valued
activities (dispensations, reconciliations, discharge) emit once per run of equal
consecutive activities with the run's values joined by ', '.

Scale: all ordered work goes through ``scan_by_key`` over ranges of the log in the order of
stay and time, so a stay that holds most rows, even within a day or an instant, is spread like
any other. The values of a run are joined in chunks of ``CHUNK`` rows whose texts combine in
order, and the quadratic prefix text is a *rope*: pieces are stored once, in blocks, and a prefix
refers to the blocks before its own and to a number of pieces in it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestory.functions.seq import global_position, range_buckets, scan_by_key
from casestory.functions.text import py_str

# Per-activity sentence templates of the prefix texts ({{field}} is
# replaced by the row's value).
EVENT_TEMPLATES = {
    "Discharge from the ED": "The patient was discharged {{timesincecasestart}} seconds ago with the diagnosis:",
    "Enter the ED": "{{race}} {{gender}} entered in the emergency department by {{arrival_transport}} "
                    "{{timesincecasestart}} seconds ago.",
    "Medicine dispensations": "The patient was administered {{timesincecasestart}} seconds ago:",
    "Medicine reconciliation": "Medicine reconciliation included {{timesincecasestart}} seconds ago:",
    "Triage in the ED": "The patient was assessed {{timesincecasestart}} seconds ago in the triage with: "
                        "Body temperature {{temperature}}, Heart rate {{heartrate}}, Breath rate {{resprate}}, "
                        "Oxygen Saturation {{o2sat}}, Systolic Blood Pressure {{sbp}}, Diastolic Blood Pressure "
                        "{{dbp}}, Pain level {{pain}}, Acuity level {{acuity}}. Symptoms are: {{chiefcomplaint}}",
    "Vital sign check": "The patient received vital signs check {{timesincecasestart}} seconds ago  with: "
                        "Body temperature {{temperature}}, Heart rate {{heartrate}}, Breath rate {{resprate}}, "
                        "Oxygen Saturation {{o2sat}}, Systolic Blood Pressure {{sbp}}, Diastolic Blood Pressure "
                        "{{dbp}}, Pain level {{pain}}, Acuity level {{acuity}}",
}
# List-valued activities and the column whose values the run lists.
LIST_ACTIVITIES = {
    "Medicine dispensations": "name",
    "Medicine reconciliation": "name_etc",
    "Discharge from the ED": "icd_title",
}
DISCHARGE = "Discharge from the ED"
TEXT_COLUMNS = ["activity", "gender", "race", "arrival_transport", "icd_title", "chiefcomplaint",
                "rhythm", "pain", "name", "etcdescription", "disposition"]
NUMERIC_COLUMNS = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "acuity"]
#: Rows of a run whose values one group joins; pieces of a stay that stand in one block.
CHUNK, BLOCK = 4096, 64


def stay_features(stays: DataFrame) -> DataFrame:
    """W1 W2 W3 W6 W7 + P11 + P10 on the flat stay log.

    Adds row_position (0-based), timesincelastevent (float s), timesincecasestart
    (truncated int s), next_activity ('Discharge from the ED' after the last row),
    name_etc (null if either part is null), then every null -> 'N/A' (as text).
    """
    ev = range_buckets(stays.filter(F.col("stay_id").isNotNull()), ["stay_id", "timestamps", "row_idx"], "bucket")
    start = ev.groupBy("stay_id").agg(F.min("timestamps").alias("_start"))
    s = scan_by_key(ev, ["stay_id"], ["timestamps", "row_idx"], F.col("bucket"),
                    lags={"_prev_ts": F.col("timestamps"), "prev_activity": F.col("activity")},
                    leads={"_next": F.col("activity")}, rownum="_rn")
    s = s.join(start, "stay_id")
    s = (s.withColumn("row_position", F.col("_rn") - 1)
          .withColumn("timesincelastevent",
                      F.coalesce(F.timestamp_diff("MICROSECOND", F.col("_prev_ts"), F.col("timestamps")) / 1e6,
                                 F.lit(0.0)))
          .withColumn("timesincecasestart", F.timestamp_diff("SECOND", F.col("_start"), F.col("timestamps")))
          .withColumn("next_activity", F.coalesce(F.col("_next"), F.lit(DISCHARGE)))
          .withColumn("name_etc", F.concat(F.col("name"), F.lit(" that is "), F.col("etcdescription"))))
    # P10: every null becomes the text 'N/A' (numbers are printed as Python prints them)
    for c in TEXT_COLUMNS + ["name_etc"]:
        s = s.withColumn(c, F.coalesce(F.col(c), F.lit("N/A")))
    for c in NUMERIC_COLUMNS:
        s = s.withColumn(c, F.coalesce(py_str(F.col(c)), F.lit("N/A")))
    return s.drop("_prev_ts", "_next", "_rn", "_start")


def render_template(activity: Column) -> Column:
    """The activity's sentence with the current row's fields; unknown activity fails."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for act, tmpl in EVENT_TEMPLATES.items():
        parts = []
        for i, chunk in enumerate(re.split(r"\{\{(\w+)\}\}", tmpl)):
            if i % 2 == 0:
                if chunk:
                    parts.append(F.lit(chunk))
            else:
                parts.append(F.col(chunk).cast("string"))
        out = out.when(activity == act, F.concat(*parts))
    return out.otherwise(F.raise_error(F.concat(F.lit("no template for activity: "), activity)).cast("string"))


def emitted_pieces(feat: DataFrame) -> DataFrame:
    """W8 + W9 + T7: one rendered piece per emitting row, with its 1-based prefix length.

    A run is a maximal stretch of equal consecutive activities (gaps-and-islands:
    run_id = running count of rows whose previous activity differs). List activities
    emit on the first row of their run only, with the run's values listed. Lists combine:
    the values of ``CHUNK`` successive rows become one text, the texts of a run its list, so
    only these texts meet in the run's one row.
    """
    start_run = (~F.col("prev_activity").eqNullSafe(F.col("activity"))).cast("long")
    is_list = F.col("activity").isin(*LIST_ACTIVITIES)
    emit = (~is_list | (start_run == 1)).cast("long")
    f = feat.withColumn("__start_run", start_run).withColumn("__emit", emit)
    f = scan_by_key(f, ["stay_id"], ["timestamps", "row_idx"], F.col("bucket"),
                    cumsums={"run_id": F.col("__start_run"), "prefix_len": F.col("__emit")})
    list_value = F.when(F.lit(False), F.lit(None).cast("string"))
    for act, col in LIST_ACTIVITIES.items():
        list_value = list_value.when(F.col("activity") == act, F.col(col))
    ordered = lambda col: F.array_join(F.transform(F.sort_array(col), lambda x: x["v"]), ", ")
    parts = (f.filter(is_list)
              .groupBy("stay_id", "run_id", F.floor(F.col("row_position") / CHUNK).alias("part"))
              .agg(ordered(F.collect_list(F.struct("timestamps", "row_idx", list_value.alias("v")))).alias("v")))
    runs = parts.groupBy("stay_id", "run_id").agg(ordered(F.collect_list(F.struct("part", "v"))).alias("run_list"))
    em = f.filter(F.col("__emit") == 1)
    em = em.join(runs, ["stay_id", "run_id"], "left").withColumn("__t", render_template(F.col("activity")))
    piece = (F.when(F.col("activity") == DISCHARGE, F.concat("__t", F.lit(" "), "run_list", F.lit(".")))
             .when(is_list, F.concat("__t", F.lit(" "), "run_list", F.lit(". ")))
             .otherwise(F.concat("__t", F.lit(". "))))
    return em.select("stay_id", "prefix_len", "timestamps", "row_idx", "activity", piece.alias("piece"))


def stay_labels(stays: DataFrame) -> DataFrame:
    """The label of a stay is the disposition of its last row ('N/A' if null)."""
    return (stays.filter(F.col("stay_id").isNotNull()).groupBy("stay_id")
                 .agg(F.max_by(F.coalesce(F.col("disposition"), F.lit("N/A")),
                               F.struct("timestamps", "row_idx")).alias("label")))


def rope(pieces: DataFrame, block: int = BLOCK) -> DataFrame:
    """W10 stored once: ``(stay_id, blk, first_len, pieces)``, ``block`` successive pieces of a stay a row.

    Prefix j of a stay is all blocks before j's and the pieces ``first_len`` to j of its own, so what
    is kept grows with the pieces, not with their prefixes.
    """
    blk = F.floor((F.col("prefix_len") - 1) / block).cast("int")
    b = pieces.groupBy("stay_id", blk.alias("blk")).agg(F.sort_array(F.collect_list(F.struct("prefix_len", "piece"))).alias("p"))
    return b.select("stay_id", "blk", (F.col("blk") * block + 1).alias("first_len"), F.transform("p", lambda x: x["piece"]).alias("pieces"))


def prefix_references(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """``(stay_id, prefix_len, blk, label)``: every prefix by the block that it ends in."""
    last = F.col("first_len") + F.size("pieces") - 1
    return blocks.select("stay_id", "blk", F.explode(F.sequence("first_len", last)).alias("prefix_len")) \
                 .join(labels, "stay_id").select("stay_id", "prefix_len", "blk", "label")


def expand(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """``(stay_id, prefix_len, prefix_text, label)`` of the prefixes referred to.

    The text before a block is one running text over the few blocks of its stay; the part within the
    block is cut from its pieces.
    """
    w = Window.partitionBy("stay_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = blocks.withColumn("before", F.array_join(F.collect_list(F.array_join("pieces", "")).over(w), ""))
    own = F.slice("pieces", F.lit(1), F.col("prefix_len") - F.col("first_len") + 1)
    return references.join(whole, ["stay_id", "blk"]).select(
        "stay_id", F.col("prefix_len").cast("int").alias("prefix_len"), F.concat("before", F.array_join(own, "")).alias("prefix_text"), "label")


def prefix_texts(stays: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(stay_id, prefix_len, prefix_text, label)``, one row per emitted event."""
    blocks = rope(emitted_pieces(stay_features(stays)), block)
    return expand(blocks, prefix_references(blocks, stay_labels(stays)))


def temporal_split(stays: DataFrame, train_share: float = 0.66) -> DataFrame:
    """D1 + W12: stays ordered by start time (ties by id); the first int(share * n) train.

    Position without a global window: windows over the ranges of a range partitioning plus the
    running count of earlier ranges, so a day that has most stays is spread too.
    Returns ``(stay_id, start, position, split)``.
    """
    starts = stays.filter(F.col("stay_id").isNotNull()).groupBy("stay_id").agg(F.min("timestamps").alias("start"))
    pos = global_position(starts, ["start", "stay_id"], "position")
    n = starts.select(F.count(F.lit(1))).scalar()  # scalar subquery: one value
    return pos.select("stay_id", "start", "position",
                      F.when(F.col("position") <= F.floor(F.lit(train_share) * n), "train")
                       .otherwise("test").alias("split"))


def split_rows(rows: DataFrame, split: DataFrame, key: str = "stay_id") -> tuple[DataFrame, DataFrame]:
    """Train / test rows by id membership (left semi / left anti join)."""
    train_ids = split.filter(F.col("split") == "train").select(key)
    return rows.join(train_ids, key, "left_semi"), rows.join(train_ids, key, "left_anti")
