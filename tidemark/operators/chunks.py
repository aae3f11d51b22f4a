"""Results in chunks: by number of points, by whole devices, or by stretches of time."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import CHUNK_STEPS


def by_size(points: DataFrame, size: int) -> DataFrame:
    """Adds ``chunk``: slices of ``size`` points of the order by device and time.

    Points are numbered within devices; the devices' running totals, a row each, shift these numbers.
    """
    tie = [c for c in ("field", "seq") if c in points.columns]
    own = points.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("time", *tie)) - 1)
    totals = points.groupBy("id").agg(F.count("*").alias("_n"))
    totals = totals.select("id", F.coalesce(F.sum("_n").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(totals, "id").withColumn("chunk", F.floor((F.col("_before") + F.col("_k")) / size).cast("long")).drop("_k", "_before")


def by_devices(points: DataFrame, size: int) -> DataFrame:
    """Adds ``chunk``: whole devices, in order; a chunk is full once it has ``size`` points, and no device is split."""
    totals = points.groupBy("id").agg(F.count("*").alias("_n"))
    ordered = totals.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return points.join(ordered.select("id", F.floor(F.col("_before") / size).cast("long").alias("chunk")), "id")


def by_interval(points: DataFrame, start, step: str | timedelta) -> DataFrame:
    """Adds ``chunk``: stretches of time from ``start`` on, each without its end, so that no point is in two."""
    step = CHUNK_STEPS[step] if isinstance(step, str) else step
    since = F.unix_micros("time") - F.unix_micros(F.lit(start).cast("timestamp"))
    return points.withColumn("chunk", F.floor(since / int(step.total_seconds() * 1_000_000)).cast("long"))


def events(chunked: DataFrame) -> Iterator[dict]:
    """start, one event for each chunk, end, done; or an error in place of what follows it. One partition is held at a time."""
    yield {"event": "start"}
    try:
        rows = chunked.repartitionByRange("chunk").sortWithinPartitions("chunk", "id", "time").toLocalIterator(prefetchPartitions=False)
        current, held, sent = None, [], 0
        for r in rows:
            if current is not None and r["chunk"] != current:
                yield {"event": "chunk", "chunk": current, "rows": held}
                held, sent = [], sent + 1
            current = r["chunk"]
            held.append(r.asDict())
        if held:
            yield {"event": "chunk", "chunk": current, "rows": held}
            sent += 1
        yield {"event": "end", "chunks": sent}
    except Exception as e:  # the reader gets to know, as on a broken stream
        yield {"event": "error", "message": str(e)}
    yield {"event": "done"}
