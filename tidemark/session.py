"""Sessions with the settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",  # buckets are cut in a zone given by name, never in the session's
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",  # rollups replace the partitions that they recompute
    "spark.sql.parquet.compression.codec": "snappy",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName("tidemark").config(map=SETTINGS | more)
    return (b.master(master) if master else b).getOrCreate()
