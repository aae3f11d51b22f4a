"""The queries of the engine over the driver's tables. Times come out in microseconds, derived doubles to six places."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import anomaly, chunks, downsample, forecast, maintain, merge, profile, resample, rollup
from tidemark.plans import oracle
from tidemark.plans.query import Store, master_field, reduced
from tidemark.plans.request import ExportRequest, QueryRequest, StreamRequest
from tidemark.sources import points as P
from tidemark.sources.catalog import Catalog

START, END = "2024-01-05 00:00:00", "2024-01-12 00:00:00"


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_user(spark: SparkSession, sf: str, start=None, end=None) -> DataFrame:
    return P.to_points(P.in_range(_read(spark, sf, "events"), "ts", start, end), "user_id", "ts", ["value"], "ts", "event_id")


def by_type(spark: SparkSession, sf: str) -> DataFrame:
    return P.to_points(_read(spark, sf, "events"), "event_type", "ts", ["value"], "ts", "event_id")


def rewritten(spark: SparkSession, sf: str) -> DataFrame:
    """Points of which every seventh was written again an hour later, with another value."""
    x = by_user(spark, sf)
    again = x.where("seq % 7 = 0").withColumns({"value": F.col("value") + 1, "inserted_at": F.col("inserted_at") + F.expr("INTERVAL 1 HOUR")})
    return x.unionByName(again)


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Points with nulls and NaN."""
    return by_user(spark, sf).withColumn("value", F.when(F.col("seq") % 10 == 0, None).when(F.col("seq") % 31 == 0, float("nan")).otherwise(F.col("value")))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return P.to_points(_read(spark, sf, "orders"), "o_orderpriority", "o_orderdate", {"price": "o_totalprice"}, "o_orderdate", "o_orderkey")


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    x = _read(spark, sf, "lineitem")
    return P.to_points(x, "l_suppkey", "l_shipdate", {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}, "l_shipdate", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def us(c: str) -> Column:
    return F.unix_micros(c).alias(f"{c}_us")


def r6(c: str, name: str | None = None) -> Column:
    return F.round(F.col(c), 6).alias(name or c)


def _rolled(x: DataFrame, places: int = 6) -> DataFrame:
    """Means of cents over many powers of two end in fives far back, so such queries ask for more places."""
    return x.select("id", "field", us("bucket"), "count", r6("sum"), F.round("avg", places).alias("avg"), "min", "max", us("min_time"), us("max_time"))


def _points(x: DataFrame, *more: str) -> DataFrame:
    return x.select("id", us("time"), *more)


def _found(x: DataFrame) -> DataFrame:
    return x.select("id", us("time"), "value", r6("score"), "type", "algorithm", r6("expected_min"), r6("expected_max"))


def _ahead(x: DataFrame) -> DataFrame:
    return x.select("id", "h", us("time"), r6("value"), r6("lower"), r6("upper"), "algorithm")


def q_scan_range(s, d):
    return _points(P.scan(by_user(s, d, START, END), start=START, end=END), "value")


def q_scan_devices(s, d):
    return _points(P.scan(by_user(s, d, START, END), ["1", "3", "7"], START, END), "value")


def q_project_fields(s, d):
    return _points(P.scan(shipments(s, d), ["1", "2"], fields=["quantity", "absent"]), "seq", "quantity", "absent")


def q_predicate_filter(s, d):
    x = shipments(s, d)
    return _points(x.where(P.condition("quantity", ">=", 49.0) & P.condition("discount", "<", 0.02) & P.condition("price", "IS_NOT_NULL")), "seq", "quantity", "discount")


def q_gap_fill(s, d):
    x = resample.fill_gaps(P.to_long(by_user(s, d)), "1h", carry=True)
    return x.select("id", us("bucket"), "count", r6("value"))


def q_gap_fill_5m(s, d):
    x = resample.fill_gaps(P.to_long(by_type(s, d)), "5m")
    return x.select("id", us("bucket"), "count", r6("value"))


def q_device_list(s, d):
    return P.devices(by_user(s, d))


def q_unpivot_long(s, d):
    return P.to_long(shipments(s, d), ["quantity", "discount"]).groupBy("id", "field").agg(F.count("*").alias("points"), F.round(F.sum("value"), 4).alias("total"))


def q_dedup_lww(s, d):
    return _points(merge.latest(rewritten(s, d)), "value", "seq")


def q_merge_tiers(s, d):
    x = rewritten(s, d)
    return _points(merge.merge_tiers(x.where(F.col("time") < END), x.where(F.col("time") >= START)), "value", "seq")


def q_merge_overlay(s, d):
    x = by_user(s, d)
    a = x.select("id", "time", "inserted_at", "seq", F.col("value").alias("a"), F.lit(None).cast("double").alias("b"))
    b = x.where("seq % 3 = 0").select("id", "time", (F.col("inserted_at") + F.expr("INTERVAL 1 HOUR")).alias("inserted_at"), "seq", F.when(F.col("seq") % 2 == 0, F.col("value") * 2).alias("a"), F.col("value").alias("b"))
    return _points(merge.overlay(a.unionByName(b)), "a", "b")


def q_limit_global(s, d):
    return _points(merge.limit_rows(by_user(s, d), 100), "value", "seq")


def q_rollup_1h(s, d):
    return _rolled(rollup.rollup(P.to_long(by_user(s, d)), "1h"))


def q_rollup_1d(s, d):
    return _rolled(rollup.rollup(P.to_long(by_user(s, d)), "1d"))


def q_rollup_1mo(s, d):
    return _rolled(rollup.rollup(P.to_long(orders(s, d)), "1M"), 8)


def q_rollup_1y(s, d):
    return _rolled(rollup.rollup(P.to_long(shipments(s, d)), "1y"), 8)


def q_rollup_1d_tokyo(s, d):
    return _rolled(rollup.rollup(P.to_long(by_user(s, d)), "1d", "Asia/Tokyo"))


def q_rollup_1h_gaps(s, d):
    return _rolled(rollup.rollup(P.to_long(gappy(s, d)), "1h"))


def q_rollup_cascade_1d(s, d):
    return _rolled(rollup.merge(rollup.rollup(P.to_long(by_user(s, d)), "1h"), "1d"))


def q_rollup_cascade_1y(s, d):
    x = rollup.rollup(P.to_long(orders(s, d)), "1h")
    return _rolled(rollup.merge(rollup.merge(rollup.merge(x, "1d"), "1M"), "1y"))


def q_rollup_scan_metric(s, d):
    x = rollup.scan(rollup.rollup(P.to_long(by_user(s, d)), "1h"), ["1", "2", "3"], START, END)
    return _points(rollup.project(x, "max_time"), "value")


def q_variance_rollup(s, d):
    return rollup.variance(rollup.rollup(P.to_long(by_user(s, d)), "1d")).select("id", us("bucket"), "count", r6("variance"))


def q_stats_profile(s, d):
    return profile.moments(P.to_long(by_type(s, d))).select("id", "n", *[r6(c) for c in ("mean", "stddev_samp", "stddev_pop", "skewness", "kurtosis")], "min", "max")


def q_iqr_bounds(s, d):
    return profile.quartiles(P.to_long(by_user(s, d))).select("id", r6("q1"), r6("median"), r6("q3"), r6("iqr"))


def q_mad(s, d):
    return profile.mad(P.to_long(by_user(s, d))).select("id", r6("median"), r6("mad"))


def q_trend_fit(s, d):
    return profile.trend(profile.indexed(P.to_long(by_type(s, d)))).select("id", "n", r6("slope"), r6("intercept"), r6("r2"), r6("r"), r6("strength"))


def q_autocorrelation(s, d):
    return profile.autocorrelation(profile.indexed(P.to_long(by_type(s, d))), 24).select("id", "n", r6("autocorrelation"))


def q_acf(s, d):
    return profile.acf(profile.indexed(P.to_long(by_type(s, d))), 3).select("id", "lag", r6("acf"))


def q_moving_average(s, d):
    return _points(profile.moving_average(profile.indexed(P.to_long(by_type(s, d))), 5, 5), "i", r6("moving_average"))


def q_trailing_average(s, d):
    return _points(profile.moving_average(profile.indexed(P.to_long(by_type(s, d))), 6), "i", r6("moving_average"))


def q_ema(s, d):
    return profile.ema(profile.indexed(P.to_long(by_user(s, d))), 0.3).select("id", "i", r6("ema"))


def q_difference(s, d):
    return profile.difference(profile.indexed(P.to_long(by_type(s, d))), 2).select("id", "i", r6("value"))


def _anomalies(algorithm: str, config: anomaly.Config = anomaly.Config()):
    return lambda s, d: _found(anomaly.detect(P.to_long(by_type(s, d)), algorithm, config))


q_anomaly_zscore = _anomalies("zscore", anomaly.Config(threshold=1.5))
q_anomaly_iqr = _anomalies("iqr")
q_anomaly_moving_avg = _anomalies("moving_avg")
q_anomaly_auto = _anomalies("auto", anomaly.Config(threshold=1.6))


def q_anomaly_flatline(s, d):
    x = by_type(s, d).withColumn("value", F.when(F.col("id").isin("click", "view"), 0.1).otherwise(F.col("value")))
    return _found(anomaly.detect(P.to_long(x), "zscore", anomaly.Config(threshold=1.6)))


def _sampled(mode: str, threshold: int, exact: bool = False):
    return lambda s, d: _points(downsample.downsample(P.to_long(by_type(s, d)), mode, threshold, exact), r6("value"))


q_downsample_minmax = _sampled("minmax", 98)
q_downsample_minmax_exact = _sampled("minmax", 98, True)
q_downsample_avg = _sampled("avg", 97)
q_downsample_m4 = _sampled("m4", 100)
q_downsample_lttb = _sampled("lttb", 120)
q_downsample_auto = _sampled("auto", 150)


def q_spikiness(s, d):
    return downsample.choose(profile.indexed(P.to_long(by_type(s, d)))).select("id", "n", r6("spikiness"), "mode")


def q_downsample_query(s, d):
    x = P.to_long(shipments(s, d).withColumn("time", F.timestamp_micros(F.unix_micros("time") + F.col("seq"))))
    return _points(reduced(x, "minmax", 20), "field", "value")


def q_time_aligned_pick(s, d):
    x = by_user(s, d)
    return _points(merge.at_times_of(x, x.where("seq % 11 = 0")), "value")


def q_master_field(s, d):
    return master_field(P.to_long(shipments(s, d))).groupBy("id", "field").agg(F.count("*").alias("points"))


def _forecast(method: str):
    return lambda s, d: _ahead(forecast.forecast(P.to_long(by_type(s, d)), method))


q_forecast_sma = _forecast("sma")
q_forecast_linear = _forecast("linear")
q_forecast_exponential = _forecast("exponential")
q_forecast_holt_winters = _forecast("holt_winters")
q_forecast_arima = _forecast("arima")
q_forecast_prophet = _forecast("prophet")
q_forecast_auto = _forecast("auto")


def q_forecast_accuracy(s, d):
    x = P.to_long(by_type(s, d))
    return forecast.models(x, "sma").unionByName(forecast.models(x, "linear")).select("id", "algorithm", r6("mape"), r6("mae"), r6("rmse"), "data_points")


def q_chunk_by_size(s, d):
    return _points(chunks.by_size(by_user(s, d), 500), "seq", "chunk")


def q_chunk_by_devices(s, d):
    return chunks.by_devices(by_user(s, d), 500).groupBy("chunk", "id").agg(F.count("*").alias("points"))


def q_chunk_by_interval(s, d):
    return chunks.by_interval(P.scan(by_user(s, d, START, END), start=START, end=END), START, "6h").groupBy("chunk").agg(F.count("*").alias("points"), F.min(F.unix_micros("time")).alias("first_us"))


def q_group_routing(s, d):
    return P.devices(by_user(s, d)).select("id", hashing.fnv1a32(F.concat_ws(":", F.lit("db"), F.lit("events"), "id")).alias("hash"), hashing.group_id("db", "events", F.col("id")).alias("group_id"))


def q_checksum(s, d):
    return maintain.checksum(by_user(s, d))


def q_checksum_light(s, d):
    return maintain.light_checksum(by_user(s, d))


def q_last_timestamp(s, d):
    return maintain.last_timestamp(by_user(s, d)).select(us("last_time"))


def q_first_data_date(s, d):
    return maintain.first_data_date(by_user(s, d)).select(F.col("first_date").cast("string").alias("first_date"))


def q_point_count(s, d):
    return by_user(s, d).agg(F.count("*").alias("points"), F.countDistinct("id").alias("devices"))


def q_replica_repair(s, d):
    x = rewritten(s, d)
    return _points(maintain.repair_rows(by_user(s, d).where("seq % 5 <> 0"), x), "value", "seq")


def q_replica_compare(s, d):
    group = lambda x: x.withColumn("group_id", F.pmod(F.col("id").cast("int"), F.lit(8)))
    return maintain.compare(group(by_user(s, d)), group(by_user(s, d).where("seq % 97 <> 0 or id = '1'"))).select("group_id", "count_mine", "count_theirs")


def _scratch(s: SparkSession) -> str:
    """A new folder that all executors share; one of this machine only where Spark runs on this machine alone."""
    root = s.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="store-")
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


#: A request names its devices.
ASKED = [str(k) for k in range(1, 21)]


def stored(s: SparkSession, d: str, device: str = "user_id") -> Store:
    """A store of all events with three fields of different kinds, and a number twice as large."""
    x = _read(s, d, "events")
    fields = {"value": F.col("value"), "twice": 2 * F.col("value"), "kind": F.col("event_type"), "large": F.col("value") > 50}
    store = Store(s, _scratch(s))
    store.write("db", "events", P.to_points(x, device, "ts", fields, "ts", "event_id"))
    return store


def _asked(kind=QueryRequest, ids=None, start="2020-01-01T00:00:00Z", end="2030-01-01T00:00:00Z", **more):
    return kind("db", "events", ids or ASKED, start, end, **more)


def q_query_mixed_fields(s, d):
    x = stored(s, d).query(_asked(fields=["kind", "value", "large", "absent"], limit=400))
    return _points(x, "kind", "value", "large", "absent")


def q_query_limit_rollup(s, d):
    store = stored(s, d)
    store.rebuild("db", "events")
    x = store.query(_asked(start="2024-01-05T00:00:00Z", end="2024-01-12T00:00:00Z", interval="1h", aggregation="max", limit=25))
    return _points(x, "twice", "value")


def _auto_threshold(mode: str):
    def run(s, d):
        kinds = [r[0] for r in _read(s, d, "events").select("event_type").distinct().collect()]
        return _points(stored(s, d, "event_type").query(_asked(ids=kinds, fields=["value"], downsampling=mode)), "value")

    return run


q_query_auto_threshold_minmax = _auto_threshold("minmax")
q_query_auto_threshold_m4 = _auto_threshold("m4")
q_query_auto_threshold_avg = _auto_threshold("avg")


def q_chunk_points(s, d):
    x = stored(s, d).chunks(_asked(StreamRequest, start="2024-01-01T00:00:00Z", end="2024-01-30T00:00:00Z", chunk_size=50))
    return _points(x, "chunk", "kind", "value", "twice", "large")


def q_project_fields_whole(s, d):
    """The projection over all suppliers."""
    return _points(P.scan(shipments(s, d), fields=["quantity", "absent"]), "seq", "quantity", "absent")


def q_chunk_by_interval_whole(s, d):
    """Chunks of the table's whole span."""
    return chunks.by_interval(by_user(s, d), START, "6h").groupBy("chunk").agg(F.count("*").alias("points"), F.min(F.unix_micros("time")).alias("first_us"))


def q_rollup_metric_whole(s, d):
    """A metric of the rollups of all devices and days."""
    return _points(rollup.project(rollup.rollup(P.to_long(by_user(s, d)), "1h"), "max_time"), "value")


def _all_levels(store: Store) -> DataFrame:
    """What a store keeps of all levels."""
    level = lambda k: _rolled(rollup.read(store.spark, store.path("db", "events", k)), 8).withColumn("level", F.lit(k))
    return reduce(DataFrame.unionByName, map(level, ("1h", "1d", "1M", "1y")))


def q_stored_rollups(s, d):
    store = stored(s, d)
    store.rebuild("db", "events")
    return _all_levels(store)


def q_compaction(s, d):
    """Points that two writes left, with second writes of the same moments, after compaction."""
    store, x = Store(s, _scratch(s)), rewritten(s, d)
    for part in (0, 1):
        store.write("db", "events", x.where(F.col("seq") % 2 == part))
    maintain.compact(s, store.path("db", "events"), f"{store.root}/_staging", min_files=0)
    return _points(P.read_points(s, store.path("db", "events")), "value", "seq")


def q_compaction_rollup(s, d):
    store = stored(s, d)
    store.rebuild("db", "events")
    path = store.path("db", "events", "1h")
    maintain.compact(s, path, f"{store.root}/_staging", min_files=0, keys=("id", "field", "bucket"))
    return _rolled(rollup.read(s, path), 8)


def _dates(s: SparkSession, store: Store) -> DataFrame:
    return P.partitions(P.read_points(s, store.path("db", "events"))).select(F.col("local_date").cast("string").alias("local_date"), "rows", (F.col("files") > 0).alias("has_files"))


def q_partition_stats(s, d):
    return _dates(s, stored(s, d))


def q_retention(s, d):
    store = stored(s, d)
    maintain.retain(s, store.path("db", "events"), "2024-01-10 00:00:00")
    return _dates(s, store)


def _exported(kind: str):
    """An export, read back."""

    def run(s, d):
        store = stored(s, d)
        path = f"{store.root}/export"
        store.export(_asked(ExportRequest, format=kind), path)
        reader = s.read.schema("id string, time string, value double, twice double, kind string, large boolean")
        return reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)

    return run


q_export_csv = _exported("csv")
q_export_json = _exported("json")


def q_present(s, d):
    """Results as JSON objects, read back."""
    x = stored(s, d).present(_asked(fields=["value", "kind"]))
    x = x.select(F.from_json("value", "id string, times array<string>, fields struct<value: array<double>, kind: array<string>>").alias("o")).select("o.*")
    total = F.aggregate("fields.value", F.lit(0.0), lambda a, v: a + v)
    return x.select("id", F.size("times").cast("long").alias("points"), F.md5(F.array_join("times", ",")).alias("times_md5"), F.md5(F.array_join("fields.kind", ",")).alias("kinds_md5"), F.round(total, 4).alias("total"))


def q_json_points(s, d):
    """JSON points, of which some have a time that can't be read."""
    time = F.when(F.col("event_id") % 13 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    lines = _read(s, d, "events").select(F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), time.alias("time"), "value", F.col("event_type").alias("kind"))).alias("value"))
    return _points(P.parse_json(lines, {"value": "double", "kind": "string"}), "value", "kind")


def q_catalog_devices(s, d):
    catalog = Catalog(s, _scratch(s))
    catalog.create_database("db")
    catalog.create_collection("db", "events", {"time": "timestamp", "id": "string"})
    catalog.track("db", "events", by_user(s, d))
    return catalog.devices("db", "events")


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    x = s.readStream.schema(_read(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    return P.to_points(x, "user_id", "ts", ["value"], "ts", "event_id")


def _appended(x: DataFrame, root: str) -> DataFrame:
    """What a stream has appended once all of its source is read."""
    x.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    return x.sparkSession.read.parquet(f"{root}/out")


def q_stream_windows(s, d):
    from tidemark.streaming import ingest

    x = _appended(ingest.windowed(_event_stream(s, d), "value", "6 hours"), _scratch(s))
    return x.select("id", us("bucket"), "count", r6("sum"), "min", "max")


def q_stream_sessions(s, d):
    from tidemark.streaming import ingest

    x = _appended(ingest.sessions(_event_stream(s, d), "value", "12 hours"), _scratch(s))
    return x.select("id", us("start"), us("end"), "count", r6("sum"))


def q_stream_rollups(s, d):
    """All levels that a stream keeps."""
    from tidemark.streaming import ingest

    store = Store(s, _scratch(s))
    ingest.ingest(store, "db", "events", _event_stream(s, d), f"{store.root}/_checkpoint").awaitTermination()
    return _all_levels(store)


def q_stream_rollup_1h(s, d):
    from tidemark.streaming import ingest

    store = Store(s, _scratch(s))
    ingest.ingest(store, "db", "events", _event_stream(s, d), f"{store.root}/_checkpoint").awaitTermination()
    return _rolled(rollup.read(s, store.path("db", "events", "1h")))


def queries() -> dict:
    return {k[2:]: f for k, f in globals().items() if k.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
