"""Anomalies along series: z-score, quartile fences, local averages, and the automatic choice.

Each detector gives ``id, field, time, value, score, type, algorithm, expected_min, expected_max``.
Series shorter than ``min_points`` have none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import SERIES, indexed, quartiles

OUT = ("id", "field", "time", "value", "score", "type", "algorithm", "expected_min", "expected_max")


@dataclass(frozen=True)
class Config:
    threshold: float = 3.0
    window: int = 10
    min_points: int = 10


def _found(x: DataFrame, score: Column, kind: Column, algorithm: str, low: Column, high: Column) -> DataFrame:
    return x.select("id", "field", "time", "value", score.alias("score"), kind.alias("type"), F.lit(algorithm).alias("algorithm"), low.alias("expected_min"), high.alias("expected_max"))


def _long_enough(series: DataFrame, config: Config) -> DataFrame:
    return series.where(F.col("n") >= config.min_points)


def zscore(series: DataFrame, config: Config = Config()) -> DataFrame:
    """Values more than ``threshold`` population deviations off the mean; a series without any variation is all flatline."""
    w = Window.partitionBy(*SERIES)
    x = _long_enough(series, config).withColumns({"m": F.avg("value").over(w), "s": F.stddev_pop("value").over(w), "flat": F.min("value").over(w) == F.max("value").over(w)})
    z = (F.col("value") - F.col("m")) / F.when(F.col("s") > 0, F.col("s"))
    x = x.withColumn("z", z).where(F.col("flat") | (F.abs("z") > config.threshold))
    flat, none = F.col("flat"), F.lit(None).cast("double")
    kind = F.when(flat, "flatline").when(F.col("z") > 0, "spike").otherwise("drop")
    return _found(x, F.when(flat, 1.0).otherwise(F.abs("z")), kind, "zscore", F.when(flat, none).otherwise(F.col("m") - config.threshold * F.col("s")), F.when(flat, none).otherwise(F.col("m") + config.threshold * F.col("s")))


def iqr(series: DataFrame, config: Config = Config()) -> DataFrame:
    """Values outside the quartiles by more than a multiple of their distance: the threshold if below 3, else 1.5."""
    k = config.threshold if config.threshold < 3 else 1.5
    x = _long_enough(series, config)
    x = x.join(quartiles(x), list(SERIES)).withColumns({"low": F.col("q1") - k * F.col("iqr"), "high": F.col("q3") + k * F.col("iqr")})
    above, below = F.col("value") > F.col("high"), F.col("value") < F.col("low")
    off = F.when(above, F.col("value") - F.col("high")).otherwise(F.col("low") - F.col("value"))
    x = x.where(above | below)
    return _found(x, F.when(F.col("iqr") > 0, off / F.col("iqr")).otherwise(1.0), F.when(above, "spike").otherwise("drop"), "iqr", F.col("low"), F.col("high"))


def local_average(series: DataFrame, config: Config = Config()) -> DataFrame:
    """Values off the mean of their neighbours by more than ``threshold`` of the neighbours' deviations.

    The neighbours' mean and deviation come from one pass after the other over the same list, in order, so that
    equal neighbours of any value give figures that agree with each other.
    """
    x = _neighbours(_long_enough(series, config), config)
    off = F.abs(F.col("value") - F.col("m"))
    d = F.when(F.col("s") > 0, off / F.col("s")).when(off != 0, config.threshold + 1).otherwise(0.0)
    reach, kind = config.threshold * F.col("s"), F.when(F.col("value") > F.col("m"), "spike").otherwise("drop")
    return _kept(x, d > config.threshold, d, kind, F.lit("moving_avg"), F.col("m") - reach, F.col("m") + reach)


def _kept(x: DataFrame, hit: Column, score: Column, kind: Column, algorithm: Column, low: Column, high: Column) -> DataFrame:
    """The rows that are hit. A generator chooses them: a filter would be pushed below its columns and compute each of them again, many times over."""
    made = F.struct(score.alias("score"), kind.alias("type"), algorithm.alias("algorithm"), low.alias("expected_min"), high.alias("expected_max"), hit.alias("hit"))
    return x.select("id", "field", "time", "value", F.inline(F.filter(F.array(made), lambda r: r["hit"]))).select(*OUT)


def _neighbours(x: DataFrame, config: Config) -> DataFrame:
    """Adds mean ``m`` and deviation ``s`` of each value's neighbours."""
    w, window = Window.partitionBy(*SERIES).orderBy("i"), config.window if config.window > 0 else 10
    most = max(window, 3) // 2
    half = F.floor(F.greatest(F.when(F.col("n") < window, F.floor(F.col("n") / 2)).otherwise(window), F.lit(3)) / 2).cast("int")
    before = F.collect_list("value").over(w.rowsBetween(-most, -1))
    after = F.collect_list("value").over(w.rowsBetween(1, most))
    x = x.withColumns({"_b": before, "_a": after, "_h": half})
    x = x.withColumn("near", F.concat(F.slice("_b", F.greatest(F.size("_b") - F.col("_h") + 1, F.lit(1)), F.col("_h")), F.slice("_a", F.lit(1), F.col("_h"))))
    x = x.withColumn("m", F.aggregate("near", F.lit(0.0), lambda a, v: a + v) / F.size("near"))
    return x.withColumn("s", F.sqrt(F.aggregate("near", F.struct(F.lit(0.0).alias("q"), F.col("m").alias("m")), lambda a, v: F.struct((a["q"] + (v - a["m"]) * (v - a["m"])).alias("q"), a["m"].alias("m")))["q"] / F.size("near")))


def _figures(x: DataFrame) -> DataFrame:
    """Numbered series with ``choice``, the detector that suits each, and with the figures of its series that this and the detectors take."""
    v, i = F.col("value"), F.col("i").cast("double")
    figures = x.groupBy(*SERIES).agg(
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), (F.min(v) == F.max(v)).alias("flat"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"), F.coalesce(F.when(F.var_pop(v) > 0, F.regr_r2(v, i)), F.lit(0.0)).alias("r2"),
    )
    x = x.join(figures, list(SERIES)).withColumns({"q1": F.col("q")[0], "q3": F.col("q")[1], "iqr": F.col("q")[1] - F.col("q")[0]})
    out = (v < F.col("q1") - 1.5 * F.col("iqr")) | (v > F.col("q3") + 1.5 * F.col("iqr"))
    outliers = 100 * F.sum(out.cast("int")).over(Window.partitionBy(*SERIES)) / F.col("n")
    normal = (F.col("n") >= 10) & (F.abs("skew") < 1) & (F.abs("kurt") < 2)
    return x.withColumn("choice", F.when(outliers > 5, "iqr").when(F.col("r2") > 0.3, "moving_avg").when(normal, "zscore").otherwise("iqr"))


def choose(series: DataFrame) -> DataFrame:
    """The detector that suits each series: ``id, field, choice``."""
    return _figures(series).groupBy(*SERIES).agg(F.first("choice").alias("choice"))


def auto(series: DataFrame, config: Config = Config()) -> DataFrame:
    """Each series under the detector that suits it; ``algorithm`` names that. All go in one pass, in which a row takes its own series' bounds."""
    x = _neighbours(_figures(_long_enough(series, config)), config)
    v, t, flat, none = F.col("value"), config.threshold, F.col("flat"), F.lit(None).cast("double")
    k = t if t < 3 else 1.5
    low, high = F.col("q1") - k * F.col("iqr"), F.col("q3") + k * F.col("iqr")
    x = x.withColumns({"low": low, "high": high, "z": (v - F.col("mean")) / F.when(F.col("deviation") > 0, F.col("deviation"))})
    off = F.when(v > F.col("high"), v - F.col("high")).otherwise(F.col("low") - v)
    d = F.when(F.col("s") > 0, F.abs(v - F.col("m")) / F.col("s")).when(v != F.col("m"), t + 1).otherwise(0.0)
    by = lambda z, fence, local: F.when(F.col("choice") == "zscore", z).when(F.col("choice") == "iqr", fence).otherwise(local)
    side = lambda above: F.when(above, "spike").otherwise("drop")
    return _kept(
        x,
        by(flat | (F.abs("z") > t), (v > F.col("high")) | (v < F.col("low")), d > t),
        by(F.when(flat, 1.0).otherwise(F.abs("z")), F.when(F.col("iqr") > 0, off / F.col("iqr")).otherwise(1.0), d),
        by(F.when(flat, "flatline").otherwise(side(F.col("z") > 0)), side(v > F.col("high")), side(v > F.col("m"))),
        F.col("choice"),
        by(F.when(flat, none).otherwise(F.col("mean") - t * F.col("deviation")), F.col("low"), F.col("m") - t * F.col("s")),
        by(F.when(flat, none).otherwise(F.col("mean") + t * F.col("deviation")), F.col("high"), F.col("m") + t * F.col("s")),
    )


DETECTORS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {"zscore": zscore, "iqr": iqr, "moving_avg": local_average, "auto": auto}


def detect(long: DataFrame, algorithm: str, config: Config = Config()) -> DataFrame:
    """Anomalies of long points. An unknown algorithm finds none, as a query goes on without it."""
    series = indexed(long)
    if algorithm not in DETECTORS:
        return zscore(series, config).where(F.lit(False))
    return DETECTORS[algorithm](series, config)
