"""Spark session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loam", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on; on a cluster leave ``master`` and ``shuffle_partitions`` to its configuration.

    Adaptive execution coalesces small shuffle partitions and splits skewed joins, so shuffle partitions are set for the
    largest stage (about 128 MB each), not for the smallest.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()
