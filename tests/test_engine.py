"""Operators on small made-up series, beyond what the catalogue covers."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar, hashing
from tidemark.operators import anomaly, chunks, downsample, forecast, maintain, merge, profile, rollup
from tidemark.plans import query as Q
from tidemark.plans.exports import Exports
from tidemark.plans.request import ExportRequest, ForecastRequest, QueryRequest, RequestError, StreamRequest
from tidemark.sources import points as P
from tidemark.sources.catalog import Catalog, CatalogError
from tidemark.streaming import ingest

T0 = dt.datetime(2024, 5, 15, 10)


def series(spark, values, step=dt.timedelta(minutes=1), id="d", field="v", start=T0):
    rows = [(id, start + k * step, start + k * step, k, field, None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "id string, time timestamp, inserted_at timestamp, seq long, field string, value double").where("value is not null")


def test_rollup_of_sparse_fields(spark):
    rows = [("dev1", T0.replace(minute=30), 25.0, 60.0), ("dev1", T0.replace(minute=35), 26.0, 62.0), ("dev2", T0.replace(minute=30), 22.0, None)]
    df = P.to_points(spark.createDataFrame(rows, "id string, time timestamp, temperature double, humidity double"), "id", "time", ["temperature", "humidity"])
    got = {(r.id, r.field): r for r in rollup.rollup(P.to_long(df), "1h").collect()}
    assert set(got) == {("dev1", "temperature"), ("dev1", "humidity"), ("dev2", "temperature")}
    assert (got["dev1", "temperature"]["count"], got["dev1", "temperature"].avg, got["dev1", "humidity"].max) == (2, 25.5, 62.0)


def test_rollup_ties_take_the_earliest_time(spark):
    r = rollup.rollup(series(spark, [3, 1, 3, 1, float("nan"), float("inf")]), "1h").first()
    assert r.min_time == T0 + dt.timedelta(minutes=1) and r.max_time == T0 and r["count"] == 4


@pytest.mark.parametrize("tz", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_cascade_equals_direct(spark, tz):
    rng = np.random.default_rng(1)
    x = series(spark, rng.integers(0, 9, 600), dt.timedelta(hours=7), start=dt.datetime(2024, 1, 1, 3))
    direct = rollup.rollup(x, "1M", tz)
    up = rollup.merge(rollup.merge(rollup.rollup(x, "1h", tz), "1d", tz), "1M", tz)
    cols = sorted(direct.columns)
    assert sorted(map(tuple, direct.select(cols).collect())) == sorted(map(tuple, up.select(cols).collect()))


def test_daylight_saving_hours_fold(spark):
    times = spark.createDataFrame([(dt.datetime(2024, 11, 3, 5, 30),), (dt.datetime(2024, 11, 3, 6, 30),)], "t timestamp")
    assert times.select(calendar.bucket(F.col("t"), "1h", "America/New_York").alias("b")).distinct().count() == 1


def test_tokyo_midnight_opens_the_day(spark):
    x = series(spark, [1, 2], dt.timedelta(microseconds=1), start=dt.datetime(2024, 1, 1, 14, 59, 59, 999999))
    assert {r.bucket for r in rollup.rollup(x, "1d", "Asia/Tokyo").collect()} == {dt.datetime(2023, 12, 31, 15), dt.datetime(2024, 1, 1, 15)}


def test_variance_of_merged_rollups(spark):
    v = rollup.variance(rollup.merge(rollup.rollup(series(spark, range(100)), "1h"), "1d")).first()
    assert math.isclose(v.variance, np.var(np.arange(100)))


def test_latest_is_idempotent(spark):
    x = series(spark, [1, 2, 3]).unionByName(series(spark, [9, 8]).withColumn("seq", F.col("seq") + 10))
    once = merge.latest(x)
    assert sorted(r.value for r in once.collect()) == [3, 8, 9]
    assert sorted(map(tuple, merge.latest(once).collect())) == sorted(map(tuple, once.collect()))


def test_limit(spark):
    x = series(spark, [1, 2, 3], id="a").unionByName(series(spark, [4, 5], id="b")).unionByName(series(spark, [6], id="c"))
    assert sorted(r.value for r in merge.limit_rows(x, 4).collect()) == [1, 2, 3, 4]
    assert merge.limit_rows(x, 0).count() == 6 and merge.limit_rows(x, -1).count() == 6


def test_fnv_vectors(spark):
    got = spark.createDataFrame([("",), ("a",), ("foobar",)], "s string").select("s", hashing.fnv1a32(F.col("s")).alias("h"))
    assert dict(got.collect()) == {"": 0x811C9DC5, "a": 0xE40C292C, "foobar": 0xBF9CF968}


def test_minmax_keeps_extremes(spark):
    v = [100 if i % 10 == 5 else 0 if i % 10 == 0 else 50 for i in range(100)]
    got = [r.value for r in downsample.downsample(series(spark, v), "minmax", 20).collect()]
    assert max(got) == 100 and min(got) == 0 and len(got) <= 20


def test_averages_of_a_ramp(spark):
    got = downsample.downsample(series(spark, range(100)), "avg", 10).orderBy("time").collect()
    assert len(got) == 10 and got[0].value == 4.5


@pytest.mark.parametrize("n,buckets", [(101, 49), (115, 7)])
def test_double_cuts_drop_the_last_point(spark, n, buckets):
    x = spark.range(n).select(F.col("id").alias("i"), F.lit(n).cast("long").alias("n"))
    b = lambda exact: [r[0] for r in x.orderBy("i").select(downsample.bucket_of(F.col("i"), F.col("n"), F.lit(buckets).cast("long"), exact)).collect()]
    want = [next((k for k in range(buckets) if int(k * (n / buckets)) <= i < int((k + 1) * (n / buckets))), None) for i in range(n)]
    assert b(False) == want and want[-1] is None
    assert None not in b(True)


def lttb_model(y, t):
    n, keep, a = len(y), [0], 0
    bs = (n - 2) / (t - 2)
    for i in range(t - 2):
        lo, hi = int(i * bs) + 1, int((i + 1) * bs) + 1
        nxt = range(int((i + 1) * bs) + 1, min(int((i + 2) * bs) + 1, n))
        mx, my = sum(nxt) / len(nxt), sum(y[j] for j in nxt) / len(nxt)
        best, arg = -1.0, lo
        for j in range(lo, hi):
            area = abs((a - mx) * (y[j] - y[a]) - (a - j) * (my - y[a])) / 2
            if area > best:
                best, arg = area, j
        keep.append(arg)
        a = arg
    return [*keep, n - 1]


def test_lttb_against_a_plain_model():
    rng = np.random.default_rng(3)
    for n, t in ((101, 100), (500, 100), (999, 250)):
        y = rng.normal(size=n)
        assert downsample.lttb_indexes(y, t).tolist() == lttb_model(y.tolist(), t)
    assert len(downsample.lttb_indexes(rng.normal(size=300), 5)) == 100


def test_small_series_stay_whole(spark):
    for mode in ("minmax", "avg", "m4", "lttb", "auto"):
        assert downsample.downsample(series(spark, range(9)), mode, 10).count() == 9


@pytest.mark.parametrize("total,kept", [(500, 500), (1000, 1000), (5000, 1000), (50_000, 2000), (200_000, 5000), (102_000, 5000)])
def test_auto_threshold(total, kept):
    assert downsample.auto_threshold(total) == kept


def test_spike(spark):
    got = anomaly.detect(series(spark, [10] * 6 + [100] + [10] * 3), "zscore", anomaly.Config(threshold=2.0)).collect()
    assert [(r.time, r.type) for r in got] == [(T0 + dt.timedelta(minutes=6), "spike")]


def test_times_hold_over_nulls(spark):
    v = [10, None, 10, 10, None, 10, 10, 10, 10, 100, 10, 10, 10]
    got = anomaly.detect(series(spark, v), "zscore", anomaly.Config(threshold=2.0)).collect()
    assert [r.time for r in got] == [T0 + dt.timedelta(minutes=9)]


def test_constant_neighbours_are_no_anomalies(spark):
    assert anomaly.detect(series(spark, [0.1] * 20), "moving_avg").count() == 0
    flat = anomaly.detect(series(spark, [0.1] * 20), "zscore").collect()
    assert len(flat) == 20 and {r.type for r in flat} == {"flatline"}


def test_small_series_have_no_anomalies(spark):
    for a in ("zscore", "iqr", "moving_avg", "auto", "no such"):
        assert anomaly.detect(series(spark, [1, 1, 1, 1, 99, 1, 1, 1, 1]), a).count() == 0


def test_local_average_with_wide_windows(spark):
    v = [float(k % 5) for k in range(14)]
    v[7] = 40.0
    got = anomaly.detect(series(spark, v), "moving_avg", anomaly.Config(window=20, threshold=3.0)).collect()
    w = 7  # half of 14 points
    for r in got:
        i = int((r.time - T0).total_seconds() // 60)
        near = [v[j] for j in range(max(0, i - w // 2), min(14, i + w // 2 + 1)) if j != i]
        assert math.isclose(r.score, abs(v[i] - np.mean(near)) / np.std(near))
    assert any(r.value == 40 for r in got)


def test_fences(spark):
    got = anomaly.detect(series(spark, [*range(20), 100, -100]), "iqr").collect()
    assert {(r.value, r.type) for r in got} == {(100.0, "spike"), (-100.0, "drop")}


def seasonal(n, p=24):
    return [50 + 0.1 * i + 10 * math.sin(2 * math.pi * (i % p) / p) for i in range(n)]


@pytest.mark.parametrize("method", ["sma", "exponential", "linear", "holt_winters", "arima", "prophet", "auto"])
def test_forecasts_have_bands(spark, method):
    got = forecast.forecast(series(spark, seasonal(168), dt.timedelta(hours=1)), method).orderBy("h").collect()
    assert [r.h for r in got] == list(range(1, 25))
    assert all(r.lower <= r.value <= r.upper for r in got)
    assert got[0].time == T0 + dt.timedelta(hours=168)


def test_line_goes_on(spark):
    got = forecast.forecast(series(spark, [2 * k + 5 for k in range(30)]), "linear").orderBy("h").collect()
    assert math.isclose(got[0].value, 65) and math.isclose(got[23].value, 111)


def test_automatic_choice(spark):
    hours = dt.timedelta(hours=1)
    label = lambda v: forecast.forecast(series(spark, v, hours), "auto").first().algorithm
    assert label(seasonal(168)) == "holt_winters (auto-selected)"
    assert label([3.0 * k for k in range(40)]) == "linear (auto-selected)"
    assert label([5.0, 1.0] * 15) == "exponential (auto-selected)"
    assert forecast.forecast(series(spark, [1.0] * 9), "auto").count() == 0


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="INVALID_METHOD"):
        forecast.forecast(series(spark, [1.0]), "ml")


def test_smoothing_models_agree(spark):
    x = [float(v) for v in np.random.default_rng(5).normal(10, 2, 50)]
    c = forecast.Config()
    value, band, fitted = forecast.smooth(np.array(x), c)
    got = forecast.forecast(series(spark, x), "exponential", c).orderBy("h").collect()
    assert math.isclose(got[3].value, value[3]) and math.isclose(got[3].upper, value[3] + 1.96 * band[3])
    for m in ("sma", "linear", "exponential", "holt_winters", "arima", "prophet"):
        r = forecast.models(series(spark, x), m, c).first()
        assert r.data_points == 50 and r.rmse > 0
    assert math.isclose(forecast.models(series(spark, x), "exponential", c).first().rmse, float(np.sqrt(np.mean((np.array(x) - fitted) ** 2))))


def test_holt_winters_follows_the_seasons():
    x = np.array(seasonal(240))
    value, _, _, name = forecast.holt_winters(x, forecast.Config())
    assert name == "holt_winters" and np.abs(value - np.array(seasonal(264))[240:]).mean() < 6
    assert forecast.holt_winters(x[:20], forecast.Config())[3] == "exponential"


def test_arima_of_a_ramp():
    value, _, _, _ = forecast.arima(np.arange(50.0), forecast.Config())
    assert value.shape == (24,) and np.isfinite(value).all()


def test_chunks(spark):
    x = series(spark, range(25), id="a").unionByName(series(spark, range(5), id="b"))
    by = lambda df: {r.chunk: r.n for r in df.groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    assert by(chunks.by_size(x, 10)) == {0: 10, 1: 10, 2: 10}
    assert by(chunks.by_devices(x, 10)) == {0: 25, 2: 5}
    assert sum(by(chunks.by_interval(x, T0, "5m")).values()) == 30
    got = list(chunks.events(chunks.by_size(x, 10)))
    assert [e["event"] for e in got] == ["start", "chunk", "chunk", "chunk", "end", "done"]


def test_validation():
    ok = dict(database="d", collection="c", ids=["x"], start_time="2024-01-01T00:00:00Z", end_time="2024-01-02T00:00:00Z")
    assert QueryRequest(**ok, interval="1mo").validate().level == "1M"
    week = ok | {"end_time": "2024-01-09T00:00:00Z"}
    bad = [
        QueryRequest(**ok | {"ids": []}), QueryRequest(**ok | {"start_time": "yesterday"}), QueryRequest(**ok | {"end_time": "2023-01-01T00:00:00Z"}), QueryRequest(**ok, limit=-1), QueryRequest(**week, interval="1h"),
        QueryRequest(**ok, interval="2h"), QueryRequest(**ok, aggregation="median"), QueryRequest(**ok, downsampling="x"), QueryRequest(**ok, downsampling="m4", downsampling_threshold=-1),
        StreamRequest(**ok, chunk_size=5), StreamRequest(**ok, chunk_size=20_000), StreamRequest(**ok, chunk_size=50, chunk_interval="1h"), StreamRequest(**ok, chunk_interval="2h"), StreamRequest(**ok, limit=5),
        StreamRequest(**ok | {"end_time": "2024-03-01T00:00:00Z"}), ExportRequest(**ok, format="xml"), QueryRequest(**ok | {"database": ""}),
    ]
    for r in bad:
        with pytest.raises(RequestError):
            r.validate()
    StreamRequest(**week, interval="1h", chunk_size=100).validate()
    ExportRequest(**ok | {"end_time": "2034-01-01T00:00:00Z"}, format="json").validate()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    s = Q.Store(spark, root, "Asia/Tokyo")
    rows = [(f"d{k % 3}", T0 + dt.timedelta(minutes=10 * k), float(k % 17), float(k), "on") for k in range(400)]
    df = spark.createDataFrame(rows, "id string, time timestamp, temp double, power double, state string")
    s.write("db", "c", P.to_points(df, "id", "time", ["temp", "power", "state"]))
    s.rebuild("db", "c")
    return s


REQ = dict(database="db", collection="c", ids=["d0", "d1"], start_time="2024-05-15T00:00:00Z", end_time="2024-05-17T23:59:59Z")


def test_query_paths(store):
    raw = Q.query(store, QueryRequest(**REQ))
    assert {r.field for r in raw.select("field").distinct().collect()} == {"temp", "power"}
    hours = Q.query(store, QueryRequest(**REQ, interval="1h", aggregation="count", fields=["temp"]))
    assert hours.agg(F.sum("value")).first()[0] == raw.where("field = 'temp'").count()
    assert Q.query(store, QueryRequest(**REQ, limit=7)).select("id", "time").distinct().count() == 7
    few = Q.query(store, QueryRequest(**REQ, downsampling="minmax", downsampling_threshold=10))
    assert few.groupBy("id", "field").count().agg(F.max("count")).first()[0] <= 10
    assert Q.anomalies(store, QueryRequest(**REQ, anomaly_detection="auto")).columns == list(anomaly.OUT)
    shown = [json.loads(r[0]) for r in Q.presented(raw, "Asia/Tokyo").collect()]
    assert {o["id"] for o in shown} == {"d0", "d1"} and all(len(o["times"]) == len(o["fields"]["temp"]) for o in shown)
    assert shown[0]["times"][0].endswith("+09:00")
    with pytest.raises(RequestError, match="COLLECTION_NOT_FOUND"):
        Q.query(store, QueryRequest(**REQ | {"collection": "none"}))


def test_range_prunes_partitions(store):
    x = P.scan(P.read_points(store.spark, store.path("db", "c")), start="2024-05-16 00:00:00", end="2024-05-16 12:00:00", tz="Asia/Tokyo")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "local_date" in plan.split("PartitionFilters")[1].split("]")[0]


def test_stream_forecast_export(store, tmp_path):
    got = list(Q.stream(store, StreamRequest(**REQ, chunk_size=100)))
    assert got[0]["event"] == "start" and got[-2]["event"] == "end"
    small = Q.chunked(store, StreamRequest(**REQ, chunk_interval="6h", downsampling="minmax", downsampling_threshold=4))
    assert small.groupBy("chunk", "id", "field").count().agg(F.max("count")).first()[0] <= 4
    assert Q.predict(store, ForecastRequest("db", "c", ["d0"], REQ["start_time"], REQ["end_time"], horizon=5, algorithm="linear", interval="4h")).count() == 5
    exports = Exports()
    task = exports.submit(lambda: Q.export(store, ExportRequest(**REQ, format="csv"), str(tmp_path / "out")), str(tmp_path / "out"))
    assert exports.wait(task).status == "completed"
    back = store.spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["id", "time", "power", "temp"]
    Q.export(store, ExportRequest(**REQ, format="json", fields=["temp"]), str(tmp_path / "js"))
    assert store.spark.read.json(str(tmp_path / "js")).count() == back.count()
    failing = exports.submit(lambda: 1 / 0, "x")
    assert exports.wait(failing).status == "failed"
    exports.expiry = -1
    assert exports.status(task).status == "expired"


def test_stream_equals_batch(spark, tmp_path):
    fields, src = {"temp": "double"}, tmp_path / "in"
    src.mkdir()
    rng = np.random.default_rng(2)
    points = [{"id": f"d{k % 2}", "time": (T0 + dt.timedelta(hours=k)).isoformat() + "Z", "temp": float(rng.integers(0, 50))} for k in range(120)]
    late = [points[5] | {"temp": 99.0}]
    store = Q.Store(spark, str(tmp_path / "store"))
    for k, part in enumerate((points[60:], points[:60], late)):  # out of order; the last rewrites an old point
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        ingest.ingest(store, "db", "c", ingest.from_files(spark, str(src), fields), str(tmp_path / "check")).awaitTermination()
    final = {(p["id"], p["time"]): p for p in points} | {(p["id"], p["time"]): p for p in late}
    df = spark.createDataFrame([(p["id"], p["time"], p["temp"]) for p in final.values()], "id string, time string, temp double").withColumn("time", F.to_timestamp("time"))
    long = P.to_long(P.to_points(df, "id", "time", ["temp"]))
    for level in ("1h", "1d", "1M", "1y"):
        want = rollup.rollup(long, level)
        cols = sorted(want.columns)
        got = rollup.read(spark, store.path("db", "c", level)).select(cols)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(cols).collect())), level


def test_windowed_streams(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"id": "d", "time": f"2024-01-01T0{h}:00:00Z", "v": h}) for h in range(9)))
    src = ingest.from_files(spark, str(tmp_path), {"v": "double"})
    for name, df in (("w", ingest.windowed(src, "v")), ("s", ingest.sessions(src, "v"))):
        q = df.writeStream.format("memory").queryName(f"mem_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"mem_{name}").count() >= 6


def test_upkeep(spark, tmp_path):
    path, x = str(tmp_path / "t"), P.to_points(series(spark, range(10), dt.timedelta(hours=12)), "id", "time", {"v": "value"}, "inserted_at", "seq")
    for _ in range(6):
        P.write_points(x, path)
    crowded = maintain.compact(spark, path, str(tmp_path / "stage"), dry_run=True)
    assert len(crowded) == 5
    before = maintain.checksum(merge.latest(P.read_points(spark, path)).select(*x.columns)).first()
    maintain.compact(spark, path, str(tmp_path / "stage"))
    after = P.read_points(spark, path).select(*x.columns)
    assert after.count() == 10 and maintain.checksum(after).first() == before
    assert maintain.retain(spark, path, "2024-05-17 00:00:00") == ["local_date=2024-05-15", "local_date=2024-05-16"]
    assert maintain.checksum(x.where("false")).first().checksum == "empty"
    assert maintain.light_checksum(x.where("false")).first().checksum == "empty"
    assert P.partitions(P.read_points(spark, path)).count() == 3


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    assert c.list() == []
    c.create_database("db", "a plant")
    c.create_collection("db", "m", {"time": "timestamp", "id": "string", "v": "number"})
    with pytest.raises(CatalogError):
        c.create_database("db")
    for name in ("bad name", "system", "x" * 65):
        with pytest.raises(CatalogError, match="INVALID_NAME"):
            c.create_collection("db", name, {})
    x = P.to_points(series(spark, [1.0]), "id", "time", {"v": "value"})
    assert c.track("db", "m", x).first_data_date == "2024-05-15"
    assert c.collection("db", "m").inferred == {"v": "float"}
    c.track("db", "m", x.withColumn("id", F.lit("later")))
    c.track("db", "m", x.withColumn("id", F.lit(None).cast("string")))
    assert sorted(r.id for r in c.devices("db", "m").collect()) == sorted([x.first().id, "later"])
    c.drop_collection("db", "m")
    c.drop_database("db")
    assert c.list() == []


def test_json_batches(spark):
    df = P.read_json_batch(spark, [{"id": "a", "time": "2024-01-01T00:00:00+09:00", "v": 1, "s": "x", "o": {"k": 1}}, {"id": "b", "time": "2024-01-01T00:00:00Z", "v": None}])
    assert P.inferred_types(df) == {"v": "float", "s": "string", "o": "string"}
    assert df.where("id = 'a'").first().time == dt.datetime(2023, 12, 31, 15)
    with pytest.raises(ValueError):
        P.read_json_batch(spark, [{"id": "a"}])


def test_overlay_keeps_last_values(spark):
    rows = [("d", T0, T0, 1, 20.0, None), ("d", T0, T0, 2, None, 7.0), ("d", T0, T0 + dt.timedelta(1), 0, 25.0, None)]
    r = merge.overlay(spark.createDataFrame(rows, "id string, time timestamp, inserted_at timestamp, seq long, a double, b double")).first()
    assert (r.a, r.b) == (25.0, 7.0)


def test_profile(spark):
    x = profile.indexed(series(spark, seasonal(100)))
    v = np.array(seasonal(100))
    d = v - v.mean()
    assert math.isclose(profile.autocorrelation(x, 24).first().autocorrelation, (d[24:] * d[:-24]).sum() / (d[24:] ** 2).sum())
    assert {r.lag: round(r.acf, 9) for r in profile.acf(x, 2).collect()} == {k: round((d[k:] * d[:-k]).sum() / (d * d).sum(), 9) for k in (1, 2)}
    assert profile.difference(x, 2).count() == 98


def test_range_reaches_the_files(spark, sf):
    from tidemark.plans import catalogue

    plan = catalogue.queries()["scan_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema")[1]


def test_predicates_gaps_and_dumps(spark, tmp_path):
    from tidemark.operators import resample

    x = series(spark, [1.0, 5.0, 3.0], dt.timedelta(hours=2))
    assert [r.value for r in x.where(P.condition("value", ">", 2) & P.condition("value", "!=", 5)).collect()] == [3.0]
    assert x.where(P.condition("value", "IS_NULL")).count() == 0
    with pytest.raises(ValueError):
        P.condition("value", "LIKE", "x")
    got = resample.fill_gaps(x).orderBy("bucket").collect()
    assert [r.value for r in got] == [1.0, None, 5.0, None, 3.0] and [r["count"] for r in got] == [1, 0, 1, 0, 1]
    short = resample.fill_gaps(series(spark, [1.0, 2.0, 4.0], dt.timedelta(minutes=7)), "5m").orderBy("bucket").collect()
    assert [r.value for r in short] == [1.0, 2.0, 4.0]
    whole = resample.fill_gaps(x, "1m", tz="Asia/Kolkata").orderBy("bucket").collect()  # 5.5 hours off, two days in that zone
    assert len(whole) == 241 and [(k, r.value) for k, r in enumerate(whole) if r["count"]] == [(0, 1.0), (120, 5.0), (240, 3.0)]
    days = resample.fill_gaps(series(spark, [1.0, 5.0], dt.timedelta(days=3)), "5m")
    assert days.count() == 3 * 288 + 1 and days.select("bucket").distinct().count() == 865
    assert [r.value for r in resample.fill_gaps(x, carry=True).orderBy("bucket").collect()] == [1.0, 1.0, 5.0, 5.0, 3.0]
    points = P.to_points(x, "id", "time", {"v": "value"})
    P.write_points(points, str(tmp_path / "t"), bloom=True)
    P.dump_csv(spark, str(tmp_path / "t"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    assert P.recent(points, 1).count() == 0
