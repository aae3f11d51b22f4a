"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is run once to compile and warm the file cache, then timed ($BENCH_RUNS times, the median counts)
into a sink that reads every row.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE), os.environ.get("PYTHONPATH", "")])

HEADLINE = [
    "scan_range", "scan_devices", "dedup_lww", "merge_overlay", "limit_global", "rollup_1h", "rollup_1d", "rollup_1d_tokyo", "rollup_1mo", "rollup_1y",
    "rollup_cascade_1d", "stats_profile", "iqr_bounds", "anomaly_zscore", "anomaly_iqr", "anomaly_moving_avg", "anomaly_auto", "downsample_minmax", "downsample_avg", "downsample_m4",
    "downsample_lttb", "downsample_auto", "forecast_sma", "forecast_linear", "forecast_exponential", "forecast_holt_winters", "forecast_arima", "forecast_prophet", "chunk_by_size", "checksum_light",
]


def main() -> None:
    from tidemark.plans import catalogue
    from tidemark.session import session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    more = {"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = session(f"local[{cpus}]", **more)
    spark.sparkContext.setLogLevel("ERROR")
    times, queries = {}, catalogue.queries()
    for name in HEADLINE:
        took = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
