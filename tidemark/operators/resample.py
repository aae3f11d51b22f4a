"""Gap filling: regular steps of time, with or without a value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import SHORT_STEPS

from .profile import SERIES
from .rollup import rollup

DAY = 86_400_000_000


def wall_steps(span: DataFrame, level: str, tz: str) -> DataFrame:
    """``bucket`` for each hour or day of the wall clock from ``a`` to ``b``."""
    step = {"1h": "INTERVAL 1 HOUR", "1d": "INTERVAL 1 DAY"}[level]
    local = lambda c: F.from_utc_timestamp(c, tz)
    return span.select(*SERIES, F.explode(F.sequence(local("a"), local("b"), F.expr(step))).alias("l")).select(*SERIES, F.to_utc_timestamp("l", tz).alias("bucket")).distinct()


def short_steps(span: DataFrame, step: int) -> DataFrame:
    """``bucket`` for each ``step`` microseconds from ``a`` to ``b``: days first, so that no row holds more than a day's steps."""
    x = span.select(*SERIES, F.unix_micros("a").alias("a"), F.unix_micros("b").alias("b"))
    begin = lambda c: F.col(c) - F.pmod(c, F.lit(DAY))
    x = x.withColumn("day", F.explode(F.sequence(begin("a"), begin("b"), F.lit(DAY))))
    first, last = F.greatest("a", "day"), F.least("b", F.col("day") + (DAY - step))
    return x.select(*SERIES, F.explode(F.sequence(first, last, F.lit(step))).alias("us")).select(*SERIES, F.timestamp_micros("us").alias("bucket"))


def fill_gaps(long: DataFrame, level: str = "1h", tz: str = "UTC", carry: bool = False) -> DataFrame:
    """Means of all buckets (1m, 5m, 1h, 1d) from each series' first to its last: ``id, field, bucket, count, value``.

    A bucket without points has count 0 and no value, or with ``carry`` the last value before it.
    """
    have = rollup(long, level, tz).select(*SERIES, "bucket", "count", F.col("avg").alias("value"))
    span = have.groupBy(*SERIES).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    every = short_steps(span, SHORT_STEPS[level]) if level in SHORT_STEPS else wall_steps(span, level, tz)
    x = every.join(have, [*SERIES, "bucket"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    if carry:
        x = x.withColumn("value", F.last("value", ignorenulls=True).over(Window.partitionBy(*SERIES).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    return x.select(*SERIES, "bucket", "count", "value")
