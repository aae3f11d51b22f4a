"""The store's own queries: all kinds of fields, limits and chunks in points, thresholds that follow from the data."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rollup
from tidemark.plans.query import Store
from tidemark.plans.request import ExportRequest, ForecastRequest, QueryRequest, RequestError, StreamRequest
from tidemark.plans import query as Q
from tidemark.sources import points as P
from tidemark.streaming import ingest

T0 = dt.datetime(2024, 5, 15)
REQ = dict(database="db", collection="c", ids=["a", "b", "s"], start_time="2024-05-15T00:00:00+09:00", end_time="2024-05-20T00:00:00Z")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("s")))
    rows = [("ab"[k % 2], T0 + dt.timedelta(minutes=k), float(k % 37), k % 3 == 0, f"s{k % 5}") for k in range(3000)]
    rows += [("s", T0 + dt.timedelta(minutes=k), None, True, "only text") for k in range(40)]
    df = spark.createDataFrame(rows, "id string, time timestamp, v double, ok boolean, state string").withColumns({"w": F.col("v") * 2, "x": F.col("v") + 1})
    s.write("db", "c", P.to_points(df, "id", "time", ["v", "w", "x", "ok", "state"]))
    s.rebuild("db", "c")
    return s


def test_all_kinds_of_fields(store):
    x = store.query(QueryRequest(**REQ, fields=["state", "ok", "v", "none"]))
    assert x.columns == ["id", "time", "state", "ok", "v", "none"] and dict(x.dtypes)["ok"] == "boolean"
    assert x.count() == 3040 and x.where("none is not null").count() == 0
    assert store.query(QueryRequest(**REQ)).columns == ["id", "time", "v", "w", "x", "ok", "state"]


@pytest.mark.parametrize("mode,kept", [("minmax", 1000), ("avg", 1000), ("m4", 1000), ("lttb", 1000), ("auto", 1000)])
def test_threshold_follows_from_the_points(store, mode, kept):
    x = store.query(QueryRequest(**REQ, downsampling=mode)).groupBy("id").count().collect()
    got = {r.id: r["count"] for r in x}
    assert 0.4 * kept <= got["a"] <= kept and 0.4 * kept <= got["b"] <= kept and got["s"] == 40


def test_limit_counts_points(store):
    assert store.query(QueryRequest(**REQ, interval="1h", limit=10)).count() == 10
    rows = store.query(QueryRequest(**REQ, interval="1h", limit=10, fields=["v", "state"])).collect()
    assert len(rows) == 10 and all(r.state is None and r.v is not None for r in rows)
    assert store.query(QueryRequest(**REQ, limit=-1)).count() == 1000
    assert store.query(QueryRequest(**REQ, aggregation="", downsampling="", interval="1h")).count() > 0


def test_chunks_hold_points(store):
    n = {r.chunk: r["count"] for r in store.chunks(StreamRequest(**REQ, chunk_size=100)).groupBy("chunk").count().collect()}
    assert n == {**{k: 100 for k in range(30)}, 30: 40}
    x = store.chunks(StreamRequest(**REQ, chunk_size=2000, downsampling="minmax"))
    by = {(r.chunk, r.id): r["count"] for r in x.groupBy("chunk", "id").count().collect()}
    assert by[0, "a"] <= 1000 and by[0, "b"] == 500 and by[1, "s"] == 40
    events = list(store.stream(StreamRequest(**REQ, chunk_interval="1d")))
    assert events[0]["event"] == "start" and "state" in events[1]["rows"][0]


def test_shown_and_exported_in_the_requests_offset(store, tmp_path):
    shown = {o["id"]: o for o in (json.loads(r[0]) for r in store.present(QueryRequest(**REQ)).collect())}
    assert shown["a"]["times"][0] == "2024-05-15T09:00:00+09:00" and shown["s"]["fields"]["v"] == [None] * 40
    assert shown["s"]["fields"]["state"][0] == "only text" and len(shown["b"]["fields"]["ok"]) == 1500
    store.export(ExportRequest(**REQ, format="json"), str(tmp_path / "j"))
    back = store.spark.read.json(str(tmp_path / "j"))
    assert set(back.columns) == {"id", "time", "v", "w", "x", "ok", "state"} and back.count() == 3040


def test_stored_rollups_prune_partitions(store):
    x = rollup.scan(rollup.read(store.spark, store.path("db", "c", "1h")), ["a"], "2024-05-16 00:00:00", "2024-05-16 05:00:00", level="1h")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "local_date" in plan.split("PartitionFilters")[1].split("]")[0] and x.count() == 18
    for level, n in (("1d", 3), ("1M", 3), ("1y", 3)):
        y = rollup.scan(rollup.read(store.spark, store.path("db", "c", level)), ["a"], "2024-01-01 00:00:00", "2024-05-15 00:00:00", level=level)
        assert y.count() == n, level


def test_forecast_parameters_and_automatic_models(store):
    ask = lambda **more: ForecastRequest("db", "c", ["a"], REQ["start_time"], REQ["end_time"], field="v", **more)
    flat = Q.predict(store, ask(algorithm="sma", params={"window": 1})).first()
    assert flat.value == store.query(QueryRequest(**REQ | {"ids": ["a"]})).orderBy(F.desc("time")).first().v
    assert Q.predict(store, ask(algorithm="auto"), models=True).first().algorithm.endswith("(auto-selected)")
    with pytest.raises(RequestError):
        Q.predict(store, ask(params={"depth": 1}))


def test_bad_messages_are_set_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = json.dumps({"id": "d", "time": "2024-01-01T00:00:00Z", "v": 1.0})
    (tmp_path / "in" / "a.json").write_text("\n".join([good, "no json", json.dumps({"id": "d", "time": "soon", "v": 2.0}), json.dumps({"time": "2024-01-01T00:00:00Z"})]))
    s = Store(spark, str(tmp_path / "store"))
    ingest.ingest(s, "db", "c", ingest.from_files(spark, str(tmp_path / "in"), {"v": "double"}), str(tmp_path / "check")).awaitTermination()
    assert P.read_points(spark, s.path("db", "c")).count() == 1
    assert spark.read.json(s.path("db", "c") + "_rejected").count() == 3
