"""Visual downsampling of series: MinMax, averages, M4, LTTB, and the automatic choice.

All work on numbered series (``profile.indexed``). A series of no more points than the threshold stays as
it is. Buckets are cut at ``int(k * (n / buckets))`` in double arithmetic, which for some sizes leaves the
very last point out; ``exact=True`` cuts at whole fractions instead and never does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import SERIES, indexed

MODES = ("none", "auto", "lttb", "minmax", "avg", "m4")
DEFAULT_THRESHOLD = 1000
LEAST_LTTB = 100
BUCKETS = {"minmax": 2, "m4": 4, "avg": 1}
OUT = ("id", "field", "time", "value")


def bucket_of(i: Column, n: Column, buckets: Column, exact: bool = False) -> Column:
    """The bucket of point i of n; null where the cut in doubles leaves it out."""
    if exact:
        return F.floor(((i + 1) * buckets - 1) / n).cast("long")
    size = n.cast("double") / buckets.cast("double")
    guess = F.floor(i / size).cast("long")
    start = lambda k: F.floor(k.cast("double") * size).cast("long")
    holds = lambda k: (k >= 0) & (k < buckets) & (start(k) <= i) & (i < start(k + 1))
    return F.coalesce(*[F.when(holds(guess + d), guess + d) for d in (0, -1, 1)])


def _split(series: DataFrame, threshold: Column) -> tuple[Column, Column]:
    least = F.greatest(threshold, F.lit(2)).cast("long")
    return least, F.col("n") <= least


def _bucketed(series: DataFrame, mode: str, threshold: Column, exact: bool) -> tuple[DataFrame, Column]:
    least, whole = _split(series, threshold)
    buckets = F.greatest(F.lit(1), F.floor(least / BUCKETS[mode])).cast("long")
    return series.withColumn("b", F.when(~whole, bucket_of(F.col("i"), F.col("n"), buckets, exact))), whole


def extremes(series: DataFrame, mode: str | Column, threshold: int | Column, exact: bool = False) -> DataFrame:
    """MinMax keeps each bucket's least and greatest point, M4 its first and last too; of equal ones the first.

    The mode may be a column, so that series of both modes go in one pass.
    """
    is_m4 = F.lit(mode == "m4") if isinstance(mode, str) else mode == "m4"
    least, whole = _split(series, _column(threshold))
    per = F.when(is_m4, BUCKETS["m4"]).otherwise(BUCKETS["minmax"])
    buckets = F.greatest(F.lit(1), F.floor(least / per)).cast("long")
    x = series.withColumns({"_whole": whole, "b": F.when(~whole, bucket_of(F.col("i"), F.col("n"), buckets, exact)), "_m4": is_m4})
    w = Window.partitionBy(*SERIES, "b")
    low = F.min(F.struct("value", "i")).over(w)["i"]
    high = F.min(F.struct((-F.col("value")).alias("v"), "i")).over(w)["i"]
    keep = (F.col("i") == low) | (F.col("i") == high) | (F.col("_m4") & ((F.col("i") == F.min("i").over(w)) | (F.col("i") == F.max("i").over(w))))
    return x.withColumn("_keep", F.col("_whole") | (F.col("b").isNotNull() & keep)).where("_keep").select(*OUT)


def averages(series: DataFrame, threshold: int | Column, exact: bool = False) -> DataFrame:
    """Each bucket's mean, at the time of its middle point."""
    x, whole = _bucketed(series, "avg", _column(threshold), exact)
    x = x.withColumn("b", F.when(whole, F.col("i")).otherwise(F.col("b"))).where("b is not null")
    middle = F.floor(F.count("*").over(Window.partitionBy(*SERIES, "b")) / 2) + F.min("i").over(Window.partitionBy(*SERIES, "b"))
    x = x.withColumn("_middle", F.col("i") == middle)  # a bucket's points are neighbours
    return x.groupBy(*SERIES, "b").agg(F.avg("value").alias("value"), F.max(F.when(F.col("_middle"), F.col("time"))).alias("time")).select(*SERIES, "time", "value")


def lttb_indexes(y: np.ndarray, threshold: int) -> np.ndarray:
    """Largest-triangle-three-buckets: which points stay. Each bucket keeps the point that spans the largest triangle
    with the point kept before and the mean of the next bucket; x is the index."""
    n = len(y)
    threshold = max(threshold, 2, LEAST_LTTB)
    if n <= threshold:
        return np.arange(n)
    width = (n - 2) / (threshold - 2)
    edges = (np.arange(threshold) * width).astype(np.int64) + 1
    sums = np.concatenate(([0.0], np.cumsum(y)))
    kept, a = [0], 0
    for k in range(threshold - 2):
        lo, hi = edges[k], edges[k + 1]
        nlo, nhi = hi, min(int((k + 2) * width) + 1, n)
        mean_x, mean_y = (nlo + nhi - 1) / 2, (sums[nhi] - sums[nlo]) / (nhi - nlo)
        j = np.arange(lo, hi)
        area = np.abs((a - mean_x) * (y[lo:hi] - y[a]) - (a - j) * (mean_y - y[a]))
        a = int(lo + np.argmax(area))
        kept.append(a)
    return np.array([*kept, n - 1])


def lttb(series: DataFrame, threshold: int | Column) -> DataFrame:
    """Sequential along each series, so each is one task's; series that stay whole never leave the JVM."""
    x = series.withColumn("_t", F.greatest(_column(threshold), F.lit(2)).cast("long"))
    small = F.col("n") <= F.greatest(F.col("_t"), F.lit(LEAST_LTTB))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pdf.iloc[lttb_indexes(pdf["value"].to_numpy(), int(pdf["_t"].iloc[0]))][list(OUT)]

    large = x.where(~small).select(*SERIES, "i", "time", "value", "_t").groupBy(*SERIES).applyInPandas(run, "id string, field string, time timestamp, value double")
    return x.where(small).select(*OUT).unionByName(large)


def _column(threshold: int | Column) -> Column:
    return F.lit(threshold) if isinstance(threshold, int) else threshold


def with_mode(series: DataFrame) -> DataFrame:
    """Numbered series with ``mode``. The figures are windows over the partitioning that the numbers come from, so nothing is read or dealt twice."""
    w = Window.partitionBy(*SERIES)
    x = series.withColumns({"_m": F.avg("value").over(w), "_s": F.stddev_pop("value").over(w), "_d": F.col("value") - F.lag("value").over(w.orderBy("i"))})
    share = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(w)
    out = share(F.abs(F.col("value") - F.col("_m")) > 2 * F.col("_s")) / F.col("n")
    steps = share(F.abs("_d") > F.col("_s")) / F.nullif(F.col("n") - 1, F.lit(0))
    s = F.when((F.col("n") < 10) | (F.col("_s") == 0), F.lit(0.0)).otherwise(F.least((out + 1.5 * steps) / 2.5, F.lit(1.0)))
    return x.withColumn("_spiky", s).withColumn("mode", _mode(F.col("_spiky"), F.col("n"))).drop("_m", "_s", "_d", "_spiky")


def _mode(spiky: Column, n: Column) -> Column:
    return F.when(spiky > 0.2, "minmax").when(n > 100_000, "avg").when(spiky > 0.1, "m4").otherwise("lttb")


def spikiness(series: DataFrame) -> DataFrame:
    """A row for each series: how often values stand out by two deviations, and steps by one."""
    w = Window.partitionBy(*SERIES)
    x = series.select(*SERIES, "n", "value", F.avg("value").over(w).alias("m"), F.stddev_pop("value").over(w).alias("s"), (F.col("value") - F.lag("value").over(w.orderBy("i"))).alias("d"))
    share = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = share(F.abs(F.col("value") - F.col("m")) > 2 * F.col("s")) / F.first("n")
    steps = share(F.abs("d") > F.col("s")) / F.nullif(F.first("n") - 1, F.lit(0))
    score = F.when((F.first("n") < 10) | (F.first("s") == 0), F.lit(0.0)).otherwise(F.least((out + 1.5 * steps) / 2.5, F.lit(1.0)))
    return x.groupBy(*SERIES).agg(F.first("n").alias("n"), score.alias("spikiness"))


def choose(series: DataFrame) -> DataFrame:
    """The mode that suits each series: ``id, field, n, spikiness, mode``."""
    return spikiness(series).withColumn("mode", _mode(F.col("spikiness"), F.col("n")))


def threshold_for(total: Column) -> Column:
    """The same as ``auto_threshold`` for a column of numbers of points."""
    return F.when(total <= 1000, total).when(total <= 10_000, 1000).when(total <= 100_000, 2000).otherwise(F.least(F.floor(total / 20), F.lit(5000))).cast("long")


def auto_threshold(total: int) -> int:
    """Points to keep for a number of points over all devices."""
    if total <= 1000:
        return total
    return 1000 if total <= 10_000 else 2000 if total <= 100_000 else min(total // 20, 5000)


def downsample(long: DataFrame, mode: str = "auto", threshold: int = 0, exact: bool = False) -> DataFrame:
    """``id, field, time, value``, each series by itself."""
    if mode not in MODES:
        raise ValueError(f"INVALID_REQUEST: downsampling must be one of {', '.join(MODES)}")
    return reduce_series(indexed(long), mode, DEFAULT_THRESHOLD if mode == "auto" and threshold <= 0 else threshold, exact)


def reduce_series(series: DataFrame, mode: str, threshold: int | Column, exact: bool = False) -> DataFrame:
    """The same for numbered series; the threshold may be a column of theirs."""
    if mode == "none":
        return series.select(*OUT)
    if mode in ("minmax", "m4"):
        return extremes(series, mode, threshold, exact)
    if mode == "avg":
        return averages(series, threshold, exact)
    if mode == "lttb":
        return lttb(series, threshold)
    series = with_mode(series)
    pick = lambda *m: series.where(F.col("mode").isin(*m))
    return extremes(pick("minmax", "m4"), F.col("mode"), threshold, exact).unionByName(averages(pick("avg"), threshold, exact)).unionByName(lttb(pick("lttb"), threshold))


DOWNSAMPLERS = {m: (lambda long, threshold=0, exact=False, m=m: downsample(long, m, threshold, exact)) for m in MODES}
