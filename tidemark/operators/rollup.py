"""Calendar rollups with metrics that merge: hour, day, month, year in a named zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.sources.points import finite

METRICS = ("sum", "avg", "min", "max", "count", "min_time", "max_time")
LOWER_LEVEL = {"1d": "1h", "1M": "1d", "1y": "1M"}


def _first_at(least: Column) -> tuple[Column, Column]:
    """Value and time of the extreme, out of the least (value, time): ties go to the earliest."""
    return least["v"], least["t"]


def rollup(long: DataFrame, level: str, tz: str = "UTC") -> DataFrame:
    """Raw long points to ``id, field, bucket`` with all metrics. NaN and infinite values don't count."""
    x = long.where(finite(F.col("value"))).select("id", "field", calendar.bucket(F.col("time"), level, tz).alias("bucket"), "time", "value")
    low = F.min(F.struct(F.col("value").alias("v"), F.col("time").alias("t")))
    high = F.min(F.struct((-F.col("value")).alias("v"), F.col("time").alias("t")))
    x = x.groupBy("id", "field", "bucket").agg(F.count("*").alias("count"), F.sum("value").alias("sum"), low.alias("_low"), high.alias("_high"), F.sum(F.col("value") * F.col("value")).alias("sum_squares"))
    return _finished(x)


def merge(parts: DataFrame, level: str, tz: str = "UTC") -> DataFrame:
    """Rollups of a lower level to a higher one, as if made from the raw points."""
    x = parts.withColumn("bucket", calendar.bucket(F.col("bucket"), level, tz))
    low = F.min(F.struct(F.col("min").alias("v"), F.col("min_time").alias("t")))
    high = F.min(F.struct((-F.col("max")).alias("v"), F.col("max_time").alias("t")))
    x = x.groupBy("id", "field", "bucket").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), low.alias("_low"), high.alias("_high"), F.sum("sum_squares").alias("sum_squares"))
    return _finished(x)


def _finished(x: DataFrame) -> DataFrame:
    low, low_at = _first_at(F.col("_low"))
    high, high_at = _first_at(F.col("_high"))
    return x.select("id", "field", "bucket", "count", "sum", (F.col("sum") / F.col("count")).alias("avg"), low.alias("min"), (F.lit(0.0) - high).alias("max"), low_at.alias("min_time"), high_at.alias("max_time"), "sum_squares")


def variance(rollups: DataFrame) -> DataFrame:
    """Adds the population variance and deviation that the metrics imply; 0 for single values."""
    spread = F.when(F.col("count") > 1, F.greatest(F.col("sum_squares") / F.col("count") - F.col("avg") * F.col("avg"), F.lit(0.0))).otherwise(0.0)
    return rollups.withColumn("variance", spread).withColumn("stddev", F.sqrt("variance"))


def metric(name: str) -> Column:
    """One metric as a double; times are milliseconds. Unknown names mean the sum."""
    if name in ("min_time", "max_time"):
        return F.unix_millis(name).cast("double")
    return F.col(name if name in METRICS else "sum").cast("double")


def project(rollups: DataFrame, name: str, fields: list[str] | None = None) -> DataFrame:
    """Long points out of rollups: the bucket is the time, the metric is the value."""
    x = rollups if fields is None else rollups.where(F.col("field").isin(list(fields)))
    return x.select("id", F.col("bucket").alias("time"), "field", metric(name).alias("value")).where("value is not null")


def scan(rollups: DataFrame, ids=None, start=None, end=None, level: str | None = None, tz: str = "UTC") -> DataFrame:
    """Rollup rows whose bucket lies in a range; both ends count.

    Of a stored table, whose level is given, the range also bounds the partitions, as Spark can't derive them from the buckets.
    """
    x = rollups if ids is None else rollups.where(F.col("id").isin(list(ids)))
    part = calendar.partition_column(level) if level else None
    for t, after in ((start, True), (end, False)):
        if t is None:
            continue
        t = F.lit(t).cast("timestamp")
        x = x.where(F.col("bucket") >= t if after else F.col("bucket") <= t)
        if part and part in x.columns:
            own = calendar.partition_value(t, level, tz).cast(x.schema[part].dataType)
            x = x.where(F.col(part) >= own if after else F.col(part) <= own)
    return x


#: Rows that one written file holds at most.
FILE_ROWS = 2_000_000


def write(rollups: DataFrame, path: str, level: str, tz: str = "UTC") -> None:
    """Replaces the partitions that the rows belong to, and no others. Ranges of the key, cut by the data, share a partition's rows among tasks."""
    part = calendar.partition_column(level)
    x = rollups.withColumn(part, calendar.partition_value(F.col("bucket"), level, tz))
    keys = [part, "id", "field", "bucket"]
    x.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").partitionBy(part).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
