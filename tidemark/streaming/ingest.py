"""Streaming ingest: points go to the raw table, and the rollups of what they touch are made anew.

Late data is never dropped: there is no watermark on the way in; a batch names the local dates, months and
years that it touches, and these partitions are recomputed from all raw points, so that a batch can be
repeated without harm. ``windowed`` is the append-only alternative, with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import calendar
from tidemark.operators import merge, rollup
from tidemark.plans.query import Store
from tidemark.sources import points as P


def from_files(spark: SparkSession, path: str, fields: dict[str, str], files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines that arrive as files."""
    reader = spark.readStream.option("latestFirst", "false")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return P.parse_json(reader.text(path), fields)


def from_kafka(spark: SparkSession, servers: str, topic: str, fields: dict[str, str], per_trigger: int = 10_000) -> DataFrame:
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", per_trigger).load()
    return P.parse_json(raw.select(F.col("value").cast("string").alias("value")), fields)


def to_kafka(points: DataFrame, servers: str, topic: str) -> None:
    """Publishes points as JSON, keyed by device."""
    points.select(F.col("id").alias("key"), F.to_json(F.struct("*")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def absorb(store: Store, database: str, collection: str, batch: DataFrame, batch_id: int) -> None:
    """One batch into the raw table and the rollups that it touches."""
    batch = batch.withColumns({"inserted_at": F.coalesce(*([F.col("inserted_at")] if "inserted_at" in batch.columns else []), F.current_timestamp()), "seq": (F.lit(batch_id).cast("long") * (1 << 40) + F.monotonically_increasing_id()) if "seq" not in batch.columns else F.col("seq")})
    held = batch = batch.persist()
    try:
        bad = batch.where("id is null or time is null")
        if not bad.isEmpty():  # one bad message must not stop the stream; it goes where it can be counted and mended
            bad.withColumn("batch", F.lit(batch_id)).write.mode("append").option("ignoreNullFields", "false").json(f"{store.path(database, collection)}_rejected")
        batch = batch.where("id is not null and time is not null")
        touched = sorted(r[0] for r in batch.select(calendar.local_date(F.col("time"), store.tz)).distinct().collect() if r[0])
        if not touched:
            return
        path = store.path(database, collection)
        # a repeated batch writes its rows again; the last write of a moment is the same one
        P.write_points(batch, path, store.tz)
        refresh(store, database, collection, touched)
    finally:
        held.unpersist()


def refresh(store: Store, database: str, collection: str, dates: list) -> None:
    """Recomputes the hours of some local dates, the days of their months, and the months and years of their years."""
    at = lambda level: store.path(database, collection, level)
    raw = P.read_points(store.spark, at("raw")).where(F.col("local_date").isin(dates)).drop("local_date")
    rollup.write(rollup.rollup(P.to_long(merge.latest(raw)), "1h", store.tz), at("1h"), "1h", store.tz)
    months, years = sorted({d.strftime("%Y-%m") for d in dates}), sorted({d.year for d in dates})
    hours = rollup.read(store.spark, at("1h")).where(F.date_format("local_date", "yyyy-MM").isin(months)).drop("local_date")
    rollup.write(rollup.merge(hours, "1d", store.tz), at("1d"), "1d", store.tz)
    days = rollup.read(store.spark, at("1d")).where(F.substring(F.col("local_month").cast("string"), 1, 4).cast("int").isin(years)).drop("local_month")
    rollup.write(rollup.merge(days, "1M", store.tz), at("1M"), "1M", store.tz)
    of_year = rollup.read(store.spark, at("1M")).where(F.col("local_year").isin(years)).drop("local_year")
    rollup.write(rollup.merge(of_year, "1y", store.tz), at("1y"), "1y", store.tz)


def ingest(store: Store, database: str, collection: str, points: DataFrame, checkpoint: str, once: bool = True, every: str = "1 second") -> StreamingQuery:
    """Starts the stream; ``once`` takes what is there and ends."""
    writer = points.writeStream.foreachBatch(lambda df, n: absorb(store, database, collection, df, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def windowed(points: DataFrame, field: str, window: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts, sums and extremes in windows of event time, for append mode; later points than ``late`` don't count."""
    span = F.window("time", window, slide) if slide else F.window("time", window)
    x = points.withWatermark("time", late).groupBy("id", span.alias("w"))
    return x.agg(F.count(field).alias("count"), F.sum(field).alias("sum"), F.min(field).alias("min"), F.max(field).alias("max")).select("id", F.col("w.start").alias("bucket"), "count", "sum", "min", "max")


def sessions(points: DataFrame, field: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """The same in sessions that end with a gap."""
    x = points.withWatermark("time", late).groupBy("id", F.session_window("time", gap).alias("w"))
    return x.agg(F.count(field).alias("count"), F.sum(field).alias("sum")).select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count", "sum")
