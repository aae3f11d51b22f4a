"""Calendar buckets in a named time zone, and the names of levels and intervals."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rollup levels and the calendar unit of each.
UNITS = {"1h": "hour", "1d": "day", "1M": "month", "1y": "year"}
#: What requests call the levels.
LEVEL_OF_INTERVAL = {"1h": "1h", "1d": "1d", "1mo": "1M", "1y": "1y"}
#: Intervals that are answered from raw points.
RAW_INTERVALS = ("1m", "5m")
#: Buckets below an hour, in microseconds. Zones differ by whole multiples of these, so that their grid is the same in all.
SHORT_STEPS = {"1m": 60_000_000, "5m": 300_000_000}
FORECAST_STEPS = {
    "1m": timedelta(minutes=1), "5m": timedelta(minutes=5), "15m": timedelta(minutes=15), "30m": timedelta(minutes=30),
    "1h": timedelta(hours=1), "4h": timedelta(hours=4), "1d": timedelta(days=1), "1w": timedelta(weeks=1),
}
CHUNK_STEPS = {
    "5m": timedelta(minutes=5), "15m": timedelta(minutes=15), "30m": timedelta(minutes=30), "1h": timedelta(hours=1),
    "6h": timedelta(hours=6), "12h": timedelta(hours=12), "1d": timedelta(days=1),
}


def bucket(time: Column, level: str, tz: str = "UTC") -> Column:
    """Start of the wall-clock bucket, as an instant. A repeated hour of a fall-back day is one bucket."""
    if level in SHORT_STEPS:
        at = F.unix_micros(time)
        return F.timestamp_micros(at - F.pmod(at, F.lit(SHORT_STEPS[level])))
    unit = UNITS[level]
    return F.date_trunc(unit, time) if tz == "UTC" else F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(time, tz)), tz)


def local_date(time: Column, tz: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(time, tz))


def partition_column(level: str) -> str:
    """What a rollup of a level is partitioned by: one partition is what one recomputation replaces."""
    return {"raw": "local_date", "1h": "local_date", "1d": "local_month", "1M": "local_year", "1y": "local_year"}[level]


def partition_value(time: Column, level: str, tz: str = "UTC") -> Column:
    local = F.from_utc_timestamp(time, tz)
    return {"local_date": F.to_date(local), "local_month": F.date_format(local, "yyyy-MM"), "local_year": F.year(local)}[partition_column(level)]


def forecast_step(name: str | None) -> timedelta:
    return FORECAST_STEPS.get(name or "", timedelta(hours=1))


def rendered(time: Column, tz: str) -> Column:
    """A time as its zone shows it, to the second, with the zone's offset."""
    local = F.from_utc_timestamp(time, tz)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(time)) / 60).cast("int")
    sign = F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+"))
    offset = F.concat(sign, F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(minutes == 0, F.lit("Z")).otherwise(offset))
