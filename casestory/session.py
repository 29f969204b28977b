"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every job here relies on; a cluster's own settings win where already set.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Only for sessions this module starts itself (local tests / bench).
LOCAL_DEFAULTS = {"spark.driver.memory": "8g"}


def get_spark(master: str | None = None, cpus: int | None = None, app: str = "casestory",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. ``master`` defaults to ``local[cpus]`` for tests/bench."""
    b = SparkSession.builder.appName(app)
    # settings of spark-submit, spark-defaults.conf or a running session hold
    running = SparkSession.getActiveSession()
    given = {k for k in DEFAULTS if running is not None and running.conf.get(k, None) is not None}
    if not master and not cpus and running is None:
        from pyspark import SparkConf
        given = {k for k in DEFAULTS if SparkConf().contains(k)}
    if master or cpus:
        b = b.master(master or f"local[{cpus}]")
        for k, v in LOCAL_DEFAULTS.items():
            b = b.config(k, v)
    for k, v in DEFAULTS.items():
        if k not in given:
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the cluster (a shared file system); without it the call
    fails there. Only a local session -- tests -- gets ``fallback`` or a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if fallback is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile
            fallback = tempfile.mkdtemp(prefix="casestory-ckpt-")
        d = fallback
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), "tables", name)
