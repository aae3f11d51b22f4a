"""Last write wins, overlays of partial points, and steps between series that have the shape of joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.points import KEYS, fields_of


def latest(points: DataFrame, keys: Iterable[str] = KEYS) -> DataFrame:
    """One row for each key: the last inserted, then the highest seq. Tasks drop losers before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col("inserted_at").desc(), F.col("seq").desc())
    return points.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def merge_tiers(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """Stored and recent points together; the newer write of a moment stays."""
    return latest(cold.unionByName(hot, allowMissingColumns=True))


def overlay(points: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """One row for each device and moment, each field with its own last value that isn't null."""
    fields = list(fields or fields_of(points))
    order = F.struct("inserted_at", "seq")
    return points.groupBy("id", "time").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields])


def at_times_of(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """The points of a device at the moments chosen for it; of equal moments the first written."""
    order = Window.partitionBy("id", "time").orderBy("inserted_at", "seq")
    return points.join(chosen.select("id", "time").distinct(), ["id", "time"], "left_semi").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def limit_rows(points: DataFrame, limit: int | None) -> DataFrame:
    """The first rows by device and time, over all devices; 0 or none: all; below 0: 1000."""
    if limit is None or limit == 0:
        return points
    tie = [c for c in ("seq",) if c in points.columns]
    return points.orderBy("id", "time", *tie).limit(1000 if limit < 0 else limit)
