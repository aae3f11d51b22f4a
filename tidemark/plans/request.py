"""Requests and what makes them valid."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from tidemark.functions.calendar import CHUNK_STEPS, LEVEL_OF_INTERVAL, RAW_INTERVALS
from tidemark.operators.downsample import MODES
from tidemark.operators.rollup import METRICS

INTERVALS = (*RAW_INTERVALS, *LEVEL_OF_INTERVAL)
DAY = timedelta(days=1)
#: The longest range for each interval; intervals that aren't named have no bound.
QUERY_RANGE = {"1m": 7 * DAY, "5m": 7 * DAY, "1h": 7 * DAY, "1d": 90 * DAY, "1mo": 3 * 365 * DAY}
STREAM_RANGE = {"": 30 * DAY, "1m": 30 * DAY, "5m": 30 * DAY, "1h": 90 * DAY, "1d": 365 * DAY, "1mo": 3650 * DAY}
LEAST_CHUNK, MOST_CHUNK = 10, 10_000
FORMATS = ("csv", "json")
_RFC3339 = re.compile(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")


class RequestError(ValueError):
    def __init__(self, message: str, code: str = "INVALID_REQUEST"):
        super().__init__(f"{code}: {message}")
        self.code = code


def moment(text: str, name: str) -> datetime:
    if not _RFC3339.match(text):
        raise RequestError(f"{name}: expected a time like 2024-01-31T00:00:00Z")
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


@dataclass
class QueryRequest:
    database: str
    collection: str
    ids: list[str]
    start_time: str
    end_time: str
    fields: list[str] = field(default_factory=list)
    limit: int = 0
    interval: str = ""
    aggregation: str = "sum"
    downsampling: str = "none"
    downsampling_threshold: int = 0
    anomaly_detection: str = ""
    anomaly_threshold: float = 3.0
    anomaly_field: str = ""

    ranges = QUERY_RANGE

    def defaults(self):
        """The same request with what it leaves open filled in: sum, no downsampling, 3 deviations, and 1000 points where the limit is negative."""
        return replace(self, aggregation=self.aggregation or "sum", downsampling=self.downsampling or "none", anomaly_threshold=self.anomaly_threshold if self.anomaly_threshold > 0 else 3.0, limit=1000 if self.limit < 0 else self.limit, downsampling_threshold=max(0, self.downsampling_threshold))

    @property
    def zone(self) -> str:
        """The offset that the request's start is given in; results show their times in it."""
        text = self.start_time[-6:]
        return text if text[:1] in "+-" and text[3:4] == ":" else "UTC"

    def validate(self) -> QueryRequest:
        if not self.database or not self.collection:
            raise RequestError("name a database and a collection")
        if not self.ids:
            raise RequestError("ids: name at least one device")
        if not self.start_time or not self.end_time:
            raise RequestError("give both start_time and end_time")
        self.start, self.end = moment(self.start_time, "start_time"), moment(self.end_time, "end_time")
        if self.end < self.start:
            raise RequestError("end_time lies before start_time")
        if self.limit < 0:
            raise RequestError("limit: expected 0 or more")
        if self.interval and self.interval not in INTERVALS:
            raise RequestError(f"interval: expected one of {', '.join(INTERVALS)}")
        bound = self.ranges.get(self.interval)
        if bound and self.end - self.start > bound:
            raise RequestError(f"interval {self.interval or 'none'} allows {bound.days} days at most")
        if self.aggregation not in METRICS:
            raise RequestError(f"aggregation: expected one of {', '.join(METRICS)}")
        if self.downsampling not in MODES:
            raise RequestError(f"downsampling: expected one of {', '.join(MODES)}")
        if self.downsampling != "none" and self.downsampling_threshold < 0:
            raise RequestError("downsampling_threshold: expected 0 or more")
        return self

    @property
    def level(self) -> str | None:
        """The rollup that answers; none: raw points."""
        return LEVEL_OF_INTERVAL.get(self.interval)


@dataclass
class StreamRequest(QueryRequest):
    chunk_size: int = 0
    chunk_interval: str = ""

    ranges = STREAM_RANGE

    def validate(self) -> StreamRequest:
        super().validate()
        if self.chunk_size > 0 and self.chunk_interval:
            raise RequestError("chunk_size, chunk_interval: give one of them")
        if self.chunk_size > 0 and not LEAST_CHUNK <= self.chunk_size <= MOST_CHUNK:
            raise RequestError(f"chunk_size: expected {LEAST_CHUNK} to {MOST_CHUNK}")
        if self.chunk_interval and self.chunk_interval not in CHUNK_STEPS:
            raise RequestError(f"chunk_interval: expected one of {', '.join(CHUNK_STEPS)}")
        if self.limit > 0:
            raise RequestError("limit: a stream has none")
        return self


@dataclass
class ExportRequest(QueryRequest):
    format: str = "csv"

    ranges = {}

    def validate(self) -> ExportRequest:
        super().validate()
        if self.format not in FORMATS:
            raise RequestError(f"format: expected one of {', '.join(FORMATS)}")
        return self


@dataclass
class ForecastRequest:
    database: str
    collection: str
    ids: list[str]
    start_time: str
    end_time: str
    field: str = ""
    algorithm: str = "auto"
    horizon: int = 24
    interval: str = "1h"
    params: dict = dataclasses.field(default_factory=dict)
