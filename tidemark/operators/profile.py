"""Statistics of series: moments, quartiles, trends, autocorrelation, accuracy of a fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("id", "field")


def indexed(long: DataFrame) -> DataFrame:
    """Numbers the values of each series by time from 0 (``i``) and tells their number (``n``). NaN doesn't count.

    Everything that works along a series partitions by it in the same way, so one shuffle serves all.
    """
    tie = [c for c in ("seq",) if c in long.columns]
    w = Window.partitionBy(*SERIES)
    x = long.where("value is not null and not isnan(value)")
    return x.select(*SERIES, "time", *tie, "value", (F.row_number().over(w.orderBy("time", *tie)) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n"))


def moments(long: DataFrame) -> DataFrame:
    v = F.col("value")
    return long.groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev_samp"), F.stddev_pop(v).alias("stddev_pop"),
        F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def quartiles(long: DataFrame) -> DataFrame:
    """First and third quartile by linear interpolation, and what lies between."""
    x = long.groupBy(*SERIES).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return x.select(*SERIES, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def mad(long: DataFrame) -> DataFrame:
    """Median of the distances from the median."""
    centre = long.groupBy(*SERIES).agg(F.percentile("value", 0.5).alias("median"))
    return long.join(centre, list(SERIES)).groupBy(*SERIES, "median").agg(F.percentile(F.abs(F.col("value") - F.col("median")), 0.5).alias("mad"))


def trend(series: DataFrame) -> DataFrame:
    """Least-squares line along the index, its R squared, and the correlation with the index."""
    i, v = F.col("i").cast("double"), F.col("value")
    x = series.groupBy(*SERIES).agg(F.count("*").alias("n"), F.regr_slope(v, i).alias("slope"), F.regr_intercept(v, i).alias("intercept"), F.coalesce(F.when(F.var_pop(v) > 0, F.regr_r2(v, i)), F.lit(0.0)).alias("r2"), F.corr(v, i).alias("r"))
    return x.withColumn("strength", F.when(F.col("slope") > 0, F.col("r2")).otherwise(-F.col("r2")))


def autocorrelation(series: DataFrame, lag: int) -> DataFrame:
    """Correlation with the value ``lag`` earlier; both sums run over the values that have one."""
    w = Window.partitionBy(*SERIES)
    d = F.col("value") - F.avg("value").over(w)
    x = series.select(*SERIES, "i", "n", d.alias("d")).withColumn("e", F.lag("d", lag).over(w.orderBy("i")))
    has = F.col("i") >= lag
    top, base = F.sum(F.when(has, F.col("d") * F.col("e"))), F.sum(F.when(has, F.col("d") * F.col("d")))
    return x.groupBy(*SERIES).agg(F.first("n").alias("n"), F.when(base > 0, top / base).otherwise(0.0).alias("autocorrelation"))


def acf(series: DataFrame, lags: int) -> DataFrame:
    """Autocorrelations 1 to ``lags`` over the sum of all squares; a row for each lag."""
    w = Window.partitionBy(*SERIES)
    x = series.select(*SERIES, "i", (F.col("value") - F.avg("value").over(w)).alias("d"))
    lagged = x.select(*SERIES, "d", *[F.lag("d", k).over(w.orderBy("i")).alias(f"d{k}") for k in range(1, lags + 1)])
    sums = lagged.groupBy(*SERIES).agg(F.sum(F.col("d") * F.col("d")).alias("s"), *[F.coalesce(F.sum(F.col("d") * F.col(f"d{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, lags + 1)])
    return sums.select(*SERIES, *[F.when(F.col("s") > 0, F.col(f"s{k}") / F.col("s")).otherwise(0.0).alias(str(k)) for k in range(1, lags + 1)]).unpivot(list(SERIES), [str(k) for k in range(1, lags + 1)], "lag", "acf").withColumn("lag", F.col("lag").cast("int"))


def accuracy(fits: DataFrame, actual: str = "value", fitted: str = "fitted", by: tuple[str, ...] = SERIES) -> DataFrame:
    """MAPE in percent (zero actuals don't count), MAE and RMSE."""
    e = F.col(actual) - F.col(fitted)
    return fits.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(F.col(actual) != 0, F.abs(e / F.col(actual)))) * 100, F.lit(0.0)).alias("mape"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
    )


def moving_average(series: DataFrame, before: int, after: int = 0) -> DataFrame:
    """Mean of each value with its neighbours, as far as there are any."""
    return series.withColumn("moving_average", F.avg("value").over(Window.partitionBy(*SERIES).orderBy("i").rowsBetween(-before, after)))


def ema(series: DataFrame, alpha: float) -> DataFrame:
    """Exponential moving average along each series, from its first value on; a row for each value."""

    def run(pdf):
        pdf = pdf.sort_values("i")
        return pdf.assign(ema=pdf["value"].ewm(alpha=alpha, adjust=False).mean())[["id", "field", "i", "time", "value", "ema"]]

    return series.select(*SERIES, "i", "time", "value").groupBy(*SERIES).applyInPandas(run, "id string, field string, i long, time timestamp, value double, ema double")


def difference(series: DataFrame, times: int = 1) -> DataFrame:
    """First differences, taken that many times; a series gets shorter by one each time."""
    w = Window.partitionBy(*SERIES).orderBy("i")
    for _ in range(times):
        series = series.withColumn("value", F.col("value") - F.lag("value").over(w)).where("value is not null")
    return series
