"""Figures of streams, against a stream of known rows."""

import time

from tidemark.streaming.metrics import Metrics


def test_metrics_count_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("a\nb\n")
    m = Metrics()
    spark.streams.addListener(m)
    try:
        rows = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        query = rows.writeStream.foreachBatch(lambda df, n: df.count()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        until = time.monotonic() + 20  # events come a moment later
        while time.monotonic() < until and m.snapshot().get(query.id, {}).get("running", True):
            time.sleep(0.1)
        figures = m.snapshot()[query.id]
        assert not figures["running"] and figures["error"] is None
        assert figures["rows"] == 6 and figures["batches"] >= 3 and figures["milliseconds"] > 0
    finally:
        spark.streams.removeListener(m)


def test_a_snapshot_is_a_copy():
    m = Metrics()
    m._of("x")
    m.snapshot()["x"]["rows"] = 5
    assert m.snapshot()["x"]["rows"] == 0
