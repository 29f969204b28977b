"""Groups of simultaneous events are made inside the row of their bucket."""

import datetime as dt

from pyspark.sql import functions as F

from casestory.operators import stories as st


def test_groups_of_a_bucket(spark):
    at = lambda h, m=0, s=0: dt.datetime(2024, 1, 1, h, m, s)
    rows = [("a", 3, "z", at(1)), ("a", 1, "y", at(1)), ("a", 2, "x", at(1, 0, 7)), ("a", 4, "w", at(1, 1)), ("a", 5, None, at(1, 1)), ("a", 6, "v", at(3)),
            ("b", 1, "u", at(1)), ("b", None, "t", at(1))]
    g = st.time_groups(spark.createDataFrame(rows, "case_id string, event_idx long, phrase string, ts timestamp_ntz"))
    got = {(r["case_id"], r["bucket"] % 24): [(x["ts"], x["items"], x["delta"]) for x in r["groups"]] for r in g.collect()}
    assert got == {("a", 1): [(at(1), ["y", "z"], None), (at(1, 0, 7), ["x"], 7), (at(1, 1), ["w", None], 53)], ("a", 3): [(at(3), ["v"], None)],
                   ("b", 1): [(at(1), ["t", "u"], None)]}
    # a bucket is grouped once, where its events are
    plan = g.select("case_id", F.size("groups"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
