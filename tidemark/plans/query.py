"""From a request to one lazy DataFrame: scan, merge, limit, anomalies, downsampling, output zone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import anomaly, chunks, downsample, forecast, merge, rollup
from tidemark.operators.profile import SERIES, indexed
from tidemark.plans.request import ExportRequest, ForecastRequest, QueryRequest, RequestError, StreamRequest
from tidemark.sources import points as P


@dataclass
class Store:
    """Tables of a root folder: ``<db>/<collection>/raw`` and ``agg_<level>``, with a zone for all dates."""

    spark: SparkSession
    root: str
    tz: str = "UTC"

    def path(self, database: str, collection: str, level: str = "raw") -> str:
        return f"{self.root}/{database}/{collection}/{'raw' if level == 'raw' else f'agg_{level}'}"

    def raw(self, r) -> DataFrame:
        """The points of a request. They are cut to its range first, where the range can choose partitions; the last write of a moment is the same before and after."""
        try:
            stored = P.read_points(self.spark, self.path(r.database, r.collection))
            return merge.latest(P.scan(stored, r.ids, r.start, r.end, tz=self.tz))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise RequestError(f"{r.database}/{r.collection}", "COLLECTION_NOT_FOUND") from e
            raise

    def rollups(self, r, level: str) -> DataFrame:
        return rollup.read(self.spark, self.path(r.database, r.collection, level))

    def query(self, r: QueryRequest) -> DataFrame:
        """A request's result: ``id, time`` and a column for each field, of its own type. Requested fields that no point has are null."""
        r = r.defaults()
        r.validate()
        return thinned(points(self, r), r.downsampling, r.downsampling_threshold)

    def stream(self, r: StreamRequest) -> Iterator[dict]:
        return chunks.events(self.chunks(r))

    def chunks(self, r: StreamRequest) -> DataFrame:
        """The result with ``chunk``; each chunk is downsampled by itself."""
        r = r.defaults()
        r.validate()
        x = points(self, r)
        x = chunks.by_interval(x, r.start, r.chunk_interval) if r.chunk_interval else chunks.by_size(x, r.chunk_size or 1000)
        return thinned(x, r.downsampling, r.downsampling_threshold, ("chunk",))

    def export(self, r: ExportRequest, path: str) -> None:
        """The result as CSV with a header or as JSON objects, with times in the request's own offset."""
        x = self.query(r)
        x = x.repartitionByRange("id", "time").sortWithinPartitions("id", "time").withColumn("time", calendar.rendered(F.col("time"), r.zone))
        writer = x.write.mode("overwrite")
        writer.option("header", True).option("nullValue", "").csv(path) if r.format == "csv" else writer.option("ignoreNullFields", "false").json(path)

    def present(self, r: QueryRequest) -> DataFrame:
        """One JSON object for each device: its times in the request's own offset, and an array for each field."""
        x = self.query(r)
        fields = P.fields_of(x)
        x = x.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("time", *fields))).alias("p"))
        arrays = F.struct(*[F.col("p").getField(f).alias(f) for f in fields])
        return x.select(F.to_json(F.struct("id", F.transform("p", lambda p: calendar.rendered(p["time"], r.zone)).alias("times"), arrays.alias("fields")), {"ignoreNullFields": "false"}).alias("value"))

    def write(self, database: str, collection: str, points: DataFrame) -> None:
        P.write_points(points, self.path(database, collection), self.tz)

    def rebuild(self, database: str, collection: str) -> None:
        """All rollups from the raw points, each level from the one below it."""
        long = P.to_long(merge.latest(P.read_points(self.spark, self.path(database, collection))))
        rollup.write(rollup.rollup(long, "1h", self.tz), self.path(database, collection, "1h"), "1h", self.tz)
        for level, lower in rollup.LOWER_LEVEL.items():
            below = rollup.read(self.spark, self.path(database, collection, lower))
            rollup.write(rollup.merge(below, level, self.tz), self.path(database, collection, level), level, self.tz)


def points(store: Store, r: QueryRequest) -> DataFrame:
    """Wide points that a request asks for, with all kinds of fields: raw ones, or a metric of the rollup of its interval. Its limit counts points."""
    if r.level is None:
        x = merge.limit_rows(store.raw(r), r.limit)
        have = P.fields_of(x)
        return x.select("id", "time", *[F.col(f) if f in have else F.lit(None).cast("double").alias(f) for f in r.fields or have])
    x = rollup.project(rollup.scan(store.rollups(r, r.level), r.ids, r.start, r.end, level=r.level, tz=store.tz), r.aggregation, r.fields or None)
    fields = r.fields or [f["field"] for f in x.select("field").distinct().orderBy("field").collect()]  # as many as a collection has
    return merge.limit_rows(wide(x, fields), r.limit)


def thinned(x: DataFrame, mode: str, threshold: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Wide points downsampled as queries do it: of each device (of each part that ``by`` names), the first numeric field that has
    values chooses the times, and all fields keep what they have there. A device without such a field stays whole.

    Without a threshold it follows from the number of points of all devices.
    """
    if mode == "none":
        return x
    numeric = sorted(P.fields_of(x.drop(*by), numeric=True))
    if not numeric:
        return x
    x = x.withColumn("_part", F.to_json(F.struct(*by, "id")))
    has = F.array(*[F.when(F.max(F.col(f).isNotNull()), F.lit(f)) for f in numeric])
    master = x.groupBy("_part").agg(F.get(F.array_compact(has), F.lit(0)).alias("_master")).where("_master is not null")
    x = x.join(master, "_part", "left")
    value = F.coalesce(*[F.when(F.col("_master") == f, F.col(f).cast("double")) for f in numeric])
    long = x.where("_master is not null").select(F.col("_part").alias("id"), F.col("_master").alias("field"), "time", value.alias("value"))
    long = indexed(long.where("value is not null"))
    if threshold <= 0:
        if by:  # a chunk's own number of points
            total = x.groupBy(*by).agg(F.count("*").alias("_total"))
            parts = x.select("_part", *by).distinct().join(total, list(by)).select(F.col("_part").alias("id"), downsample.threshold_for(F.col("_total")).alias("_threshold"))
            long, threshold = long.join(parts, "id"), F.col("_threshold")
        else:
            threshold = downsample.auto_threshold(x.count())
    chosen = downsample.reduce_series(long, mode, threshold).select(F.col("id").alias("_part"), "time").distinct()
    kept = x.where("_master is not null").join(chosen, ["_part", "time"], "left_semi")
    return kept.unionByName(x.where("_master is null")).drop("_part", "_master")


def series(store: Store, r: QueryRequest) -> DataFrame:
    """The numeric fields of what a request asks for, as long points."""
    return P.to_long(points(store, r))


def wide(long: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each device and time, a column for each field; what isn't there is null."""
    return long.groupBy("id", "time").pivot("field", fields).agg(F.first("value"))


def master_field(long: DataFrame) -> DataFrame:
    """The first numeric field by name of each device, with its points; its times stand for the device's."""
    return long.join(long.groupBy("id").agg(F.min("field").alias("field")), ["id", "field"])


def reduced(long: DataFrame, mode: str, threshold: int) -> DataFrame:
    """Downsampling as queries apply it: the master field's chosen times, and every field's own values there.

    With ``avg`` these are the middle samples, and not means.
    """
    if mode == "none":
        return long
    chosen = downsample.downsample(master_field(long), mode, threshold)
    return long.join(chosen.select("id", "time").distinct(), ["id", "time"], "left_semi")


def query(store: Store, r: QueryRequest, second_precision: bool = False) -> DataFrame:
    """The numeric fields of a result as long points: ``id, time, field, value``. ``Store.query`` has all fields."""
    r.validate()
    long = series(store, r)
    threshold = r.downsampling_threshold
    if r.downsampling != "none" and threshold == 0:
        threshold = downsample.auto_threshold(long.select("id", "time").distinct().count())
    out = reduced(long, r.downsampling, threshold).select("id", "time", "field", "value")
    return out.withColumn("time", F.date_trunc("second", "time")) if second_precision else out


def anomalies(store: Store, r: QueryRequest) -> DataFrame:
    """Anomalies of what a query finds, before any downsampling."""
    r.validate()
    long = series(store, r)
    if r.anomaly_field:
        long = long.where(F.col("field") == r.anomaly_field)
    return anomaly.detect(long, r.anomaly_detection, anomaly.Config(threshold=r.anomaly_threshold or 3.0))


def presented(long: DataFrame, tz: str = "UTC") -> DataFrame:
    """One JSON object for each device: its times, as its zone shows them, and an array for each field."""
    rows = long.groupBy("id", "time").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("v"))
    names = long.groupBy("id").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    x = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("time", "v"))).alias("p")).join(names, "id")
    times = F.transform("p", lambda p: calendar.rendered(p["time"], tz))
    arrays = F.map_from_arrays("fields", F.transform("fields", lambda f: F.transform("p", lambda p: F.try_element_at(F.map_from_entries(p["v"]), f))))
    return x.select(F.to_json(F.struct("id", times.alias("times"), arrays.alias("fields"))).alias("value"))


def stream(store: Store, r: StreamRequest) -> Iterator[dict]:
    """A query's result as events; chunks are downsampled each by itself."""
    return chunks.events(chunked(store, r))


def chunked(store: Store, r: StreamRequest) -> DataFrame:
    r.validate()
    long = series(store, r)
    if r.chunk_interval:
        x = chunks.by_interval(long, r.start, r.chunk_interval)
    else:
        x = chunks.by_size(long, r.chunk_size or 1000)
    if r.downsampling == "none":
        return x.select("chunk", "id", "time", "field", "value")
    own = x.withColumn("id", F.concat_ws("\x1f", F.col("chunk").cast("string"), "id"))
    y = reduced(own, r.downsampling, r.downsampling_threshold)
    return y.select(F.substring_index("id", "\x1f", 1).cast("long").alias("chunk"), F.substring_index("id", "\x1f", -1).alias("id"), "time", "field", "value")


def predict(store: Store, r: ForecastRequest, models: bool = False) -> DataFrame:
    q = QueryRequest(r.database, r.collection, r.ids, r.start_time, r.end_time, [r.field] if r.field else []).validate()
    if r.algorithm not in forecast.FORECASTERS:
        raise RequestError(r.algorithm, "INVALID_METHOD")
    long = series(store, q)
    long = long if r.field else master_field(long)
    unknown = set(r.params) - {"window", "alpha", "beta", "gamma", "period", "confidence"}
    if unknown:
        raise RequestError(f"params: unknown {', '.join(sorted(unknown))}")
    config = forecast.Config(horizon=r.horizon, step=calendar.forecast_step(r.interval), **r.params)
    return forecast.models(long, r.algorithm, config) if models else forecast.forecast(long, r.algorithm, config)


def export(store: Store, r: ExportRequest, path: str) -> None:
    """Writes a query's result, a column for each field, as CSV with a header or as JSON objects."""
    r.validate()
    long = query(store, r)
    fields = r.fields or [x["field"] for x in long.select("field").distinct().orderBy("field").collect()]
    x = wide(long, fields).orderBy("id", "time").withColumn("time", calendar.rendered(F.col("time"), store.tz))
    writer = x.write.mode("overwrite")
    writer.option("header", True).option("nullValue", "").csv(path) if r.format == "csv" else writer.option("ignoreNullFields", "false").json(path)


__all__ = ["Store", "query", "anomalies", "predict", "stream", "chunked", "export", "presented", "reduced", "series", "wide", "master_field", "SERIES", "indexed"]
