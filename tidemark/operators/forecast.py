"""Forecasts of series: moving average, exponential smoothing, line, Holt-Winters, ARIMA(2,1,2), a trend with
Fourier seasons, and the automatic choice.

``forecast`` gives ``id, field, h, time, value, lower, upper, algorithm``; ``models`` gives each fit's accuracy.
The first three are JVM expressions. The others run along a series, one series a task at a time, in pandas.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import SERIES, accuracy, autocorrelation, indexed, trend

PREDICTION = "id string, field string, h int, time timestamp, value double, lower double, upper double, algorithm string"
MODEL = "id string, field string, algorithm string, mape double, mae double, rmse double, data_points long"


@dataclass(frozen=True)
class Config:
    horizon: int = 24
    window: int = 7
    alpha: float = 0.3
    beta: float = 0.1
    gamma: float = 0.1
    period: int = 24
    confidence: float = 0.95
    min_points: int = 10
    step: timedelta = timedelta(hours=1)

    @property
    def z(self) -> float:
        c = self.confidence
        return 2.576 if c >= 0.99 else 1.96 if c >= 0.95 else 1.645 if c >= 0.90 else 1.96


def _ahead(last: DataFrame, value: Column, half_band: Column, config: Config, algorithm: str) -> DataFrame:
    """A row for each step ahead of a row with ``last_time``; value and half_band may use ``h``."""
    x = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(config.horizon))))
    time = F.timestamp_micros(F.unix_micros("last_time") + F.col("h").cast("long") * int(config.step.total_seconds() * 1_000_000))
    x = x.select(*SERIES, F.col("h").cast("int").alias("h"), time.alias("time"), value.alias("value"), half_band.alias("_b"))
    return x.select(*SERIES, "h", "time", "value", (F.col("value") - config.z * F.col("_b")).alias("lower"), (F.col("value") + config.z * F.col("_b")).alias("upper"), F.lit(algorithm).alias("algorithm"))


def _model(fits: DataFrame, algorithm: str) -> DataFrame:
    n = fits.groupBy(*SERIES).agg(F.count("*").alias("data_points"))
    return accuracy(fits).join(n, list(SERIES)).select(*SERIES, F.lit(algorithm).alias("algorithm"), "mape", "mae", "rmse", "data_points")


def sma_fit(series: DataFrame, config: Config) -> DataFrame:
    w = Window.partitionBy(*SERIES).orderBy("i").rowsBetween(-(config.window - 1), 0)
    return series.withColumn("fitted", F.avg("value").over(w))


def sma(series: DataFrame, config: Config = Config()) -> DataFrame:
    """The mean of the last values, as far ahead as asked; the band has one width."""
    e = F.col("value") - F.col("fitted")
    x = sma_fit(series, config).groupBy(*SERIES).agg(F.max("time").alias("last_time"), F.max_by("fitted", "i").alias("v"), F.sqrt(F.sum(e * e) / (F.count("*") - 1)).alias("se"))
    return _ahead(x, F.col("v"), F.col("se"), config, "sma")


def _smoothed(series: DataFrame, config: Config) -> DataFrame:
    """Last value of the smoothing, and the squared errors on the way there, in one pass along each series."""
    a = config.alpha
    x = series.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("s"), F.max("time").alias("last_time"))
    first = F.struct(F.col("s")[0]["value"].alias("f"), F.lit(0.0).alias("sse"), F.col("s")[0]["value"].alias("next"), F.lit(0.0).alias("ae"), F.lit(0.0).alias("ape"), F.lit(0).alias("m"))

    def step(acc: Column, p: Column) -> Column:
        e = p["value"] - acc["next"]
        some = p["value"] != 0
        return F.struct(
            acc["next"].alias("f"), (acc["sse"] + e * e).alias("sse"), (a * p["value"] + (1 - a) * acc["next"]).alias("next"), (acc["ae"] + F.abs(e)).alias("ae"),
            (acc["ape"] + F.when(some, F.abs(e / p["value"])).otherwise(0.0)).alias("ape"), (acc["m"] + some.cast("int")).alias("m"),
        )

    return x.withColumn("r", F.aggregate("s", first, step)).withColumn("n", F.size("s"))


def exponential(series: DataFrame, config: Config = Config()) -> DataFrame:
    """Simple exponential smoothing; the band widens with the root of the distance."""
    x = _smoothed(series, config).withColumn("se", F.sqrt(F.col("r.sse") / (F.col("n") - 1)))
    return _ahead(x, F.col("r.next"), F.col("se") * F.sqrt("h"), config, "exponential")


def _line(series: DataFrame) -> DataFrame:
    i, v = F.col("i").cast("double"), F.col("value")
    return series.groupBy(*SERIES).agg(F.count("*").alias("n"), F.regr_slope(v, i).alias("b"), F.regr_intercept(v, i).alias("a"), F.avg(i).alias("mean_i"), F.regr_sxx(v, i).alias("sxx"), F.max("time").alias("last_time"))


def linear(series: DataFrame, config: Config = Config()) -> DataFrame:
    """A least-squares line along the index, with the band of a prediction."""
    fits = _line(series)
    e = F.col("value") - (F.col("a") + F.col("b") * F.col("i"))
    sse = series.join(fits.select(*SERIES, "a", "b"), list(SERIES)).groupBy(*SERIES).agg(F.sum(e * e).alias("sse"))
    x = fits.join(sse, list(SERIES)).withColumn("se", F.when(F.col("n") > 2, F.sqrt(F.col("sse") / (F.col("n") - 2))).otherwise(0.0))
    at = F.col("n") + F.col("h") - 1
    band = F.col("se") * F.sqrt(1 + 1 / F.col("n") + (at - F.col("mean_i")) * (at - F.col("mean_i")) / F.col("sxx"))
    return _ahead(x, F.col("a") + F.col("b") * at, band, config, "linear")


# Sequential methods: each takes the values (and times in seconds) and gives predictions, half bands without z, and fits.


def smooth(x: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = np.empty(len(x))
    f[0] = x[0]
    for i in range(1, len(x)):
        f[i] = config.alpha * x[i - 1] + (1 - config.alpha) * f[i - 1]
    ahead = config.alpha * x[-1] + (1 - config.alpha) * f[-1]
    h = np.arange(1, config.horizon + 1)
    return np.full(config.horizon, ahead), _spread(x - f) * np.sqrt(h), f


def _spread(e: np.ndarray) -> float:
    return float(np.sqrt((e * e).sum() / (len(e) - 1)))


def holt_winters(x: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Additive trend and multiplicative seasons; under two periods of data plain smoothing."""
    n = len(x)
    a, b, g = (p if 0 < p <= 1 else d for p, d in ((config.alpha, 0.3), (config.beta, 0.1), (config.gamma, 0.1)))
    p = config.period if 0 < config.period <= n // 2 else 24
    if n < 2 * p:
        return *smooth(x, config), "exponential"
    level = x[:p].cumsum()[-1] / p  # summed in order: noisy series carry the last bit of this on to their forecasts
    slope = (x[p] - x[0]) / p
    season = np.ones(n)
    season[:p] = x[:p] / level if level else 1.0
    fitted = np.empty(n)
    fitted[0] = level * season[0]
    for i in range(1, n):
        s = season[i - p] if i >= p else season[i]
        s = s if s else 1.0
        before = level
        fitted[i] = (level + slope) * s
        level = a * x[i] / s + (1 - a) * (level + slope)
        slope = b * (level - before) + (1 - b) * slope
        season[i] = g * x[i] / level + (1 - g) * s if level else s
    k = np.arange(config.horizon)
    s = season[n - p + (n + k) % p]
    return np.where(s == 0, 1.0, s) * (level + (k + 1) * slope), _spread(x - fitted) * np.sqrt(k + 1), fitted, "holt_winters"


def _acf(y: np.ndarray, lags: int) -> np.ndarray:
    d = y - y.mean()
    total = (d * d).sum()
    return np.array([(d[k:] * d[: len(d) - k]).sum() / total if total else 0.0 for k in range(1, lags + 1)])


def _yule_walker(r: np.ndarray) -> np.ndarray:
    """Autoregressive weights of autocorrelations by Levinson's recursion."""
    phi, v = np.zeros(len(r)), 1.0
    for k in range(len(r)):
        if v == 0:
            break
        last = (r[k] - (phi[:k] * r[:k][::-1]).sum()) / v
        phi[:k], phi[k] = phi[:k] - last * phi[:k][::-1], last
        v *= 1 - last * last
    return phi


def arima(x: np.ndarray, config: Config, p: int = 2, q: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """ARIMA(p, 1, q): weights of the differences by Yule-Walker; half the residuals' autocorrelations as moving-average weights."""
    y = np.diff(x)
    m = len(y)
    if m < p + q + 1:
        raise ValueError("the series is too short")
    phi = _yule_walker(_acf(y, p))
    plain = np.zeros(m)
    for t in range(p, m):
        plain[t] = y[t] - (phi * y[t - p : t][::-1]).sum()
    theta = 0.5 * _acf(plain[p:], q)
    start, fit, eps = max(p, q), np.zeros(m), np.zeros(m)
    for t in range(start, m):
        fit[t] = (phi * y[t - p : t][::-1]).sum() + (theta * eps[t - q : t][::-1]).sum()
        eps[t] = y[t] - fit[t]
    residual = y - fit
    some = residual[residual != 0]
    se = float(some.std()) if len(some) else 1.0
    ys, es, steps = list(y), list(eps), []
    for _ in range(config.horizon):
        nxt = float((phi * np.array(ys[-p:][::-1])).sum() + (theta * np.array(es[-q:][::-1])).sum())
        ys.append(nxt)
        es.append(0.0)
        steps.append(nxt)
    return x[-1] + np.cumsum(steps), se * np.sqrt(np.arange(1, config.horizon + 1)), np.concatenate(([x[0]], x[:-1] + fit)), "arima"


SEASONS = ((365.25 * 86400, 10), (7 * 86400, 3), (86400, 4))


def seasonal_trend(x: np.ndarray, seconds: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """A line with slope changes plus Fourier seasons, each harmonic fitted to the same detrended values."""
    n = len(x)
    low, scale = x.min(), (x.max() - x.min()) or 1.0
    t0, span = seconds[0], (seconds[-1] - seconds[0]) or 1.0
    u, y = (seconds - t0) / span, (x - low) / scale
    du = u - u.mean()
    sxx = (du * du).sum()
    k = (du * (y - y.mean())).sum() / sxx if sxx else 0.0
    m = y.mean() - k * u.mean()
    points, bends = np.zeros(0), np.zeros(0)
    if n > 25:
        r = y - (k * u + m)
        w = max(3, n // 20)
        at = np.arange(w, int(0.8 * n) - w)
        if len(at):
            c = np.concatenate(([0.0], np.cumsum(r)))
            score = np.abs((c[at + w] - c[at]) / w - (c[at] - c[at - w]) / w)
            best = np.sort(at[np.argsort(-score, kind="stable")[:25]])
            gap = u[best + 1] - u[best - 1]
            slope = np.divide(y[best + 1] - y[best - 1], gap, out=np.full(len(best), k), where=gap != 0)
            points, bends = u[best], (slope - k) * 0.05
    line = lambda v: k * v + m + (np.maximum(0, v[:, None] - points[None]) * bends[None]).sum(1)
    d = y - line(u)
    waves = []
    for period, order in SEASONS:
        for j in range(1, order + 1):
            f = 2 * np.pi * j / period
            s, c = np.sin(f * seconds), np.cos(f * seconds)
            ss, cc = (s * s).sum(), (c * c).sum()
            waves.append((f, (d * s).sum() / ss if ss else 0.0, (d * c).sum() / cc if cc else 0.0))
    at = lambda sec: (line((sec - t0) / span) + sum(a * np.sin(f * sec) + b * np.cos(f * sec) for f, a, b in waves)) * scale + low
    fitted = at(seconds)
    sigma = float((x - fitted).std()) or 1.0
    return at(ahead), sigma * np.sqrt(np.arange(1, len(ahead) + 1)), fitted, "prophet"


def _fit(pdf: pd.DataFrame, method: str, config: Config) -> tuple:
    x = pdf["value"].to_numpy(dtype=float)
    if method == "holt_winters":
        return holt_winters(x, config)
    if method == "arima":
        return arima(x, config)
    seconds = pdf["time"].astype("int64").to_numpy() / 1e9 if str(pdf["time"].dtype).endswith("[ns]") else pdf["time"].astype("datetime64[ns]").astype("int64").to_numpy() / 1e9
    ahead = seconds[-1] + np.arange(1, config.horizon + 1) * config.step.total_seconds()
    return seasonal_trend(x, seconds, ahead)


def _along(method: str, models: bool = False):
    def run(series: DataFrame, config: Config = Config()) -> DataFrame:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("i")
            value, band, fitted, name = _fit(pdf, method, config)
            key = {"id": pdf["id"].iloc[0], "field": pdf["field"].iloc[0]}
            if models:
                x = pdf["value"].to_numpy(dtype=float)
                skip = 1 if method == "arima" else 0
                e, base = (x - fitted)[skip:], x[skip:]
                some = base != 0
                return pd.DataFrame([key | {"algorithm": name, "mape": float(np.abs(e[some] / base[some]).mean() * 100) if some.any() else 0.0, "mae": float(np.abs(e).mean()), "rmse": float(np.sqrt((e * e).mean())), "data_points": len(x)}])
            h = np.arange(1, config.horizon + 1)
            return pd.DataFrame(key | {"h": h.astype("int32"), "time": pdf["time"].iloc[-1] + h * config.step, "value": value, "lower": value - config.z * band, "upper": value + config.z * band, "algorithm": name})

        return series.select(*SERIES, "i", "time", "value").groupBy(*SERIES).applyInPandas(one, MODEL if models else PREDICTION)

    return run


def choose(series: DataFrame, config: Config = Config()) -> DataFrame:
    """The method that suits each series: seasons first, then a trend, then smoothing."""
    p = config.period
    t = trend(series).select(*SERIES, "n", "r")
    s = autocorrelation(series, p).select(*SERIES, "autocorrelation")
    choice = F.when((p > 1) & (F.col("n") >= 2 * p) & (F.col("autocorrelation") > 0.5), "holt_winters").when((F.col("n") >= 5) & (F.abs("r") > 0.5), "linear").when(F.col("n") >= 20, "exponential").otherwise("sma")
    return t.join(s, list(SERIES)).select(*SERIES, choice.alias("choice"))


def auto(series: DataFrame, config: Config = Config()) -> DataFrame:
    x = series.join(choose(series, config), list(SERIES))
    pick = lambda c: x.where(F.col("choice") == c).drop("choice")
    out = [FORECASTERS[m](pick(m), config) for m in ("holt_winters", "linear", "exponential", "sma")]
    made = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    return made.withColumn("algorithm", F.concat("algorithm", F.lit(" (auto-selected)")))


FORECASTERS = {"sma": sma, "exponential": exponential, "linear": linear, "holt_winters": _along("holt_winters"), "arima": _along("arima"), "prophet": _along("prophet"), "auto": auto}


def forecast(long: DataFrame, method: str = "auto", config: Config = Config()) -> DataFrame:
    if method not in FORECASTERS:
        raise ValueError(f"INVALID_METHOD: {method} is not one of {', '.join(FORECASTERS)}")
    return FORECASTERS[method](indexed(long).where(F.col("n") >= config.min_points), config)


def models(long: DataFrame, method: str, config: Config = Config()) -> DataFrame:
    """Accuracy of each series' fit under a method; ``auto``: under the one that suits it."""
    if method not in FORECASTERS:
        raise ValueError(f"INVALID_METHOD: {method}")
    series = indexed(long).where(F.col("n") >= config.min_points)
    if method != "auto":
        return _models(series, method, config)
    x = series.join(choose(series, config), list(SERIES))
    out = [_models(x.where(F.col("choice") == m).drop("choice"), m, config) for m in ("holt_winters", "linear", "exponential", "sma")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).withColumn("algorithm", F.concat("algorithm", F.lit(" (auto-selected)")))


def _models(series: DataFrame, method: str, config: Config) -> DataFrame:
    if method == "sma":
        return _model(sma_fit(series, config), "sma")
    if method == "linear":
        fits = _line(series).select(*SERIES, "a", "b")
        return _model(series.join(fits, list(SERIES)).withColumn("fitted", F.col("a") + F.col("b") * F.col("i")), "linear")
    if method == "exponential":
        r = _smoothed(series, config)
        mape = F.when(F.col("r.m") > 0, 100 * F.col("r.ape") / F.col("r.m")).otherwise(0.0)
        return r.select(*SERIES, F.lit("exponential").alias("algorithm"), mape.alias("mape"), (F.col("r.ae") / F.col("n")).alias("mae"), F.sqrt(F.col("r.sse") / F.col("n")).alias("rmse"), F.col("n").cast("long").alias("data_points"))
    return _along(method, models=True)(series, config)
