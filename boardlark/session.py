"""The Spark session that the engine expects: UTC, ANSI casts, adaptive plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings.  On a cluster leave master out; adaptive execution then sizes shuffles by their data."""
    builder = SparkSession.builder.appName("boardlark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's spark.checkpoint.dir.  Where that is unset, a local session gets a folder of its
    own machine; on a cluster there is none to choose, which is an error.  The session's settings stay as they are."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"file://{tempfile.gettempdir()}/boardlark-{spark.sparkContext.applicationId}"
    raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that the driver and all executors share")
