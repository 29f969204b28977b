"""Runs joined in chunks, ranges that split a hot stay, prefixes stored once and expanded on reading."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casestory.functions import seq
from casestory.functions.text import py_str
from casestory.operators import prefixes as px
from casestory.sources import prefix_store
from casestory.sources.eventlog import STAY_CSV_SCHEMA

T0 = dt.datetime(2024, 1, 1, 10)
SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STAY_CSV_SCHEMA.fields).replace(
    "timestamps string", "timestamps timestamp") + ", row_idx long, label string"


def row(stay, i, activity, minute=0, disposition=None):
    """A stay row; ``label`` clashes with the prefix label."""
    return (stay, T0 + dt.timedelta(minutes=minute), activity, disposition, "M", "WHITE", "WALK IN", f"dx{i}", "pain", None, "5", f"drug{i}", None,
            98.0, None, 16.0, 99.0, 120.0, 80.0, 3.0, i, "clash")


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sample():
    rng = random.Random(7)
    acts = ["Enter the ED", "Medicine dispensations", "Medicine reconciliation", "Vital sign check", "Discharge from the ED"]
    rows = [row(s, 1000 * s + k, rng.choice(acts), rng.randint(0, 40) * 60, rng.choice([None, "HOME", "ADMITTED"])) for s in range(1, 9) for k in range(rng.randint(1, 90))]
    rows += [row(50, 90_000 + k, "Medicine dispensations") for k in range(300)]  # one run at one instant
    return rows + [row(None, 99_999, "Enter the ED"), row(60, 99_998, "Vital sign check", 0, "HOME")]


def brute(rows):
    """Prefixes of every stay, row by row."""
    out = []
    for stay in sorted({r[0] for r in rows if r[0] is not None}):
        mine = sorted((r for r in rows if r[0] == stay), key=lambda r: (r[1], r[20]))
        label, text, n, k = mine[-1][3] or "N/A", "", 0, 0
        while k < len(mine):
            r, end = mine[k], k + 1
            lists = r[2] in px.LIST_ACTIVITIES
            while lists and end < len(mine) and mine[end][2] == r[2]:
                end += 1
            fields = {"timesincecasestart": int((r[1] - mine[0][1]).total_seconds()), "race": "WHITE", "gender": "M", "arrival_transport": "WALK IN", "temperature": "98.0",
                      "heartrate": "N/A", "resprate": "16.0", "o2sat": "99.0", "sbp": "120.0", "dbp": "80.0", "pain": "5", "acuity": "3.0", "chiefcomplaint": "pain"}
            piece = px.EVENT_TEMPLATES[r[2]]
            for name, value in fields.items():
                piece = piece.replace("{{" + name + "}}", str(value))
            values = ", ".join({"Medicine dispensations": x[11], "Medicine reconciliation": "N/A"}.get(x[2], x[7]) for x in mine[k:end])
            text += piece + (f" {values}." if r[2] == px.DISCHARGE else f" {values}. " if lists else ". ")
            n, k = n + 1, end
            out.append((stay, n, text, label))
    return out


@pytest.fixture(scope="module")
def expected():
    return brute(sample())


def test_runs_combine_over_chunks(spark, monkeypatch, expected):
    for chunk in (1, 7, px.CHUNK):
        monkeypatch.setattr(px, "CHUNK", chunk)
        got = px.prefix_texts(log(spark, sample()), block=5)
        assert sorted(map(tuple, got.collect())) == expected, chunk
        assert got.columns == ["stay_id", "prefix_len", "prefix_text", "label"]


def test_chunks_of_a_run_are_groups_of_their_own(spark, monkeypatch):
    """A long run's rows meet in groups of CHUNK rows, and only the groups' texts in its row."""
    monkeypatch.setattr(px, "CHUNK", 16)
    rows = log(spark, [row(1, k, "Medicine dispensations") for k in range(1000)])
    f = px.stay_features(rows).groupBy(F.floor(F.col("row_position") / px.CHUNK)).count()
    assert f.agg(F.max("count"), F.count("*")).first() == (16, 63)
    (piece,) = px.emitted_pieces(px.stay_features(rows)).collect()
    assert piece["piece"].endswith(": " + ", ".join(f"drug{k}" for k in range(1000)) + ". ")


def test_ranges_split_a_hot_stay(spark):
    """One stay has nearly all rows at one instant: its rows are in many ranges, in order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.lit(1).alias("stay"), F.lit(5).alias("t"), F.col("id").alias("row_idx")).unionByName(
            spark.range(50).select(F.lit(2).alias("stay"), F.lit(5).alias("t"), F.col("id").alias("row_idx")))
        d = seq.range_buckets(df, ["stay", "t", "row_idx"], "b")
        each = [r["count"] for r in d.groupBy("b").count().collect()]
        assert len(each) > 4 and max(each) < 10_000 and sum(each) == 20_050
        s = seq.scan_by_key(d, ["stay"], ["t", "row_idx"], F.col("b"), lags={"before": F.col("row_idx")}, rownum="n")
        bad = s.where((F.col("n") != F.col("row_idx") + 1) | ~F.col("before").eqNullSafe(F.when(F.col("row_idx") > 0, F.col("row_idx") - 1)))
        assert bad.count() == 0 and s.count() == 20_050
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stored_prefixes_share_their_pieces(spark, tmp_path, expected):
    path = str(tmp_path / "p")
    prefix_store.write_prefixes(log(spark, sample()), path, block=5)
    assert sorted(map(tuple, prefix_store.read_prefixes(spark, path).collect())) == expected
    # every piece once: what is stored of a stay is as long as its longest prefix
    stored = {r[0]: r[1] for r in spark.read.parquet(f"{path}/blocks").groupBy("stay_id").agg(F.sum(F.length(F.array_join("pieces", "")))).collect()}
    longest = {s: max(len(x[2]) for x in expected if x[0] == s) for s in stored}
    assert stored == longest and sum(longest.values()) < sum(len(x[2]) for x in expected) / 4
    assert prefix_store.references(spark, path).count() == len(expected)
    some = prefix_store.read_prefixes(spark, path, (F.col("prefix_len") == 6) & (F.col("stay_id") < 5))
    assert sorted(map(tuple, some.collect())) == [x for x in expected if x[1] == 6 and x[0] < 5]
    assert prefix_store.read_prefixes(spark, path, F.lit(False)).count() == 0


def test_empty_log_and_replaced_store(spark, tmp_path):
    path = str(tmp_path / "p")
    prefix_store.write_prefixes(log(spark, [row(1, 0, "Enter the ED")]), path)
    assert [r["prefix_len"] for r in prefix_store.read_prefixes(spark, path).collect()] == [1]
    prefix_store.write_prefixes(log(spark, []), path)
    assert prefix_store.read_prefixes(spark, path).collect() == [] and px.prefix_texts(log(spark, [])).collect() == []


def test_number_text_ahead_of_its_tests(spark):
    """The exponent of a number without one is null, wherever the optimiser computes it."""
    d = spark.createDataFrame([(80.0,), (5e-05,), (1e16,), (None,)], "x double")
    spark.conf.set("spark.sql.subexpressionElimination.enabled", "true")
    assert [r[0] for r in d.select(F.coalesce(py_str("x"), F.lit("N/A"))).collect()] == ["80.0", "5e-05", "1e+16", "N/A"]
