"""Session settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC dates, runtime re-planning and skew splitting.

    Partition counts are left to the cluster: set spark.sql.shuffle.partitions to two or
    three times its cores, or leave it to AQE's coalescing of a generous number.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
