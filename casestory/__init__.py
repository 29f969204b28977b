"""casestory: process event logs to case stories, splits, metrics and attributions on Spark.

Sub-packages
------------
sources    readers and writers (XES, CSV, JSON dictionaries, Parquet/JSON/CSV sinks) and
           the bindings that view the driver tables as event logs, predictions, texts
functions  Column-level helpers (text formatting, skew-safe sequence scans)
operators  DataFrame -> DataFrame operators, one module per family
plans      end-to-end flows (stories, prefixes, train/evaluate, attribution) and the
           query catalogue used by ``__spark_entry__``
streaming  nothing: the reference has no streaming operator (see README)
"""

__all__ = ["session"]
