"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# Fixed at session start, for sessions built by the caller: call-site capture per
# column costs more than the rest of plan building.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings (UTC, AQE) to a session the caller owns."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def fan_out(spark: SparkSession) -> int:
    """Task count for stages whose input is small but whose work is not.

    AQE sizes partitions by bytes, which says nothing about rows still to be
    generated, so those stages ask for the configured parallelism explicitly.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
