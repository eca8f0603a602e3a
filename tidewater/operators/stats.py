"""Autocorrelation and stationarity tests.

Autocorrelations are joins of positions. The tests fit small regressions on one symbol's
narrow series in one task; tables of critical values are of MacKinnon (1994, 2010) and of
Kwiatkowski, Phillips, Schmidt and Shin (1992).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..series import BARS, SeriesSpec, position

# Critical values by sample size (constant and powers of 1/T) for 1, 5 and 10 %; p-value polynomials below and above -1.61.
ADF_CRITICAL = {1: (-3.43035, -6.5393, -16.786, -79.433), 5: (-2.86154, -2.8903, -4.234, -40.04), 10: (-2.56677, -1.5384, -2.809, 0.0)}
ADF_LOW, ADF_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def acf(df: DataFrame, lags: int, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, lag, acf, low, high) for lags 0 to lags, with Bartlett's 95 % band. Nulls are left out."""
    known = df.where(F.col(column).isNotNull()).select(spec.symbol, *spec.order, F.col(column).cast("double").alias("_x"))
    centred = known.withColumn("_x", F.col("_x") - F.avg("_x").over(spec.whole()))
    w = spec.window()
    ahead = centred.select(spec.symbol, "_x", *(F.lag("_x", k).over(w).alias(f"_{k}") for k in range(1, lags + 1)))
    sums = ahead.groupBy(spec.symbol).agg(F.count("*").alias("n"), F.sum(F.col("_x") ** 2).alias("_0"), *(F.sum(F.col("_x") * F.col(f"_{k}")).alias(f"_{k}") for k in range(1, lags + 1)))
    scale = F.nullif("_0", F.lit(0.0))
    return banded(sums.select(spec.symbol, "n", F.posexplode(F.array(*(F.col(f"_{k}") / scale for k in range(lags + 1)))).alias("lag", "acf")), spec)


def banded(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(symbol, lag, acf, low, high) of (symbol, n, lag, acf): with Bartlett's 95 % band; rows without a value go."""
    before = Window.partitionBy(spec.symbol).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") ** 2)).over(before), F.lit(0.0))
    spread = F.when(F.col("lag") == 0, 0.0).otherwise(1.959963984540054 * F.sqrt((1 + 2 * earlier) / F.col("n")))
    return rows.withColumn("_s", spread).where("acf is not null").select(spec.symbol, "lag", "acf", (F.col("acf") - F.col("_s")).alias("low"), (F.col("acf") + F.col("_s")).alias("high"))


def durbin_levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations r[0] = 1, r[1], ..."""
    out, phi = [1.0], np.empty(0)
    for k in range(1, len(r)):
        last = (r[k] - phi @ r[1:k][::-1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
        phi = np.append(phi - last * phi[::-1], last)
        out.append(last)
    return np.array(out)


def pacf(df: DataFrame, lags: int, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, lag, pacf, low, high): Yule-Walker on acf's few rows; band of 1.96 / sqrt(n)."""
    counted = df.where(F.col(column).isNotNull()).groupBy(spec.symbol).agg(F.count("*").alias("n"))
    return partial(acf(df, lags, column, spec).join(counted, spec.symbol), spec)


def partial(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(symbol, lag, pacf, low, high) of (symbol, n, lag, acf)."""
    kind = dict(rows.dtypes)[spec.symbol]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("lag")
        value = durbin_levinson(group["acf"].to_numpy())
        spread = np.where(group["lag"] == 0, 0.0, 1.959963984540054 / math.sqrt(group["n"].iloc[0]))
        return pd.DataFrame({spec.symbol: group[spec.symbol], "lag": group["lag"], "pacf": value, "low": value - spread, "high": value + spread})

    return rows.groupBy(spec.symbol).applyInPandas(run, f"{spec.symbol} {kind}, lag int, pacf double, low double, high double")


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    return beta, np.linalg.pinv(x.T @ x), float(rest @ rest)


def adf_statistic(x: np.ndarray, max_lag: int | None = None) -> tuple[float, float, int, int]:
    """(statistic, p, lags, observations) of the augmented Dickey-Fuller test with a constant; lags by AIC on a common sample."""
    x = x - x.mean()  # with a constant the test is the same, and far levels lose no digits
    d = np.diff(x)
    most = min(math.ceil(12 * (len(x) / 100) ** 0.25) if max_lag is None else max_lag, len(x) // 2 - 2)

    def design(lags: int, start: int):
        cols = [x[start:-1], *(d[start - i : len(d) - i] for i in range(1, lags + 1)), np.ones(len(d) - start)]
        return np.column_stack(cols), d[start:]

    def aic(lags: int) -> float:
        a, b = design(lags, most)
        return len(b) * math.log(max(_ols(a, b)[2], 1e-300) / len(b)) + 2 * a.shape[1]

    lags = min(range(most + 1), key=aic)
    a, b = design(lags, lags)
    beta, inverse, loss = _ols(a, b)
    t = float(beta[0] / math.sqrt(max(loss, 1e-300) / (len(b) - a.shape[1]) * inverse[0, 0]))
    return t, adf_p_value(t), lags, len(b)


def adf_p_value(t: float) -> float:
    z = sum(c * t**i for i, c in enumerate(ADF_LOW if t <= -1.61 else ADF_HIGH))
    return 0.0 if t < -18.83 else 1.0 if t > 2.74 else 0.5 * math.erfc(-z / math.sqrt(2))


#: The numbers of a test's result.
result_columns = {"statistic": "double", "p_value": "double", "lags": "long", "n": "long", "crit_1": "double", "crit_5": "double", "crit_10": "double", "stationary": "boolean"}


def adf_columns(t: float, lags: int, n: int) -> dict:
    p = adf_p_value(t)
    return {"statistic": t, "p_value": p, "lags": lags, "n": n, "stationary": p <= 0.05} | {f"crit_{k}": sum(c / n**i for i, c in enumerate(v)) for k, v in ADF_CRITICAL.items()}


def kpss_lags(products: DataFrame, symbol: str) -> DataFrame:
    """(symbol, lags): the automatic number of lags, from (symbol, n, k, xx) of the products at lags up to n^(2/9)."""
    few = products.where(F.col("k") <= F.floor(F.col("n").cast("double") ** (2 / 9)))
    part = F.when(F.col("k") == 0, F.col("xx") / F.col("n")).otherwise(F.col("xx") / (F.col("n") / 2))
    sums = few.groupBy(symbol, "n").agg(F.sum(part).alias("s0"), F.sum(F.col("k") * part).alias("s1"))
    wanted = F.floor(1.1447 * ((F.col("s1") / F.nullif("s0", F.lit(0.0))) ** 2) ** (1 / 3) * F.col("n").cast("double") ** (1 / 3))
    return sums.select(symbol, F.least(F.coalesce(wanted, F.lit(0)), F.col("n") - 1).cast("int").alias("lags"))


def kpss_statistic(x: np.ndarray) -> tuple[float, float, int, int]:
    """(statistic, p clipped to 0.01 .. 0.10, lags, n) of the KPSS test for level stationarity; automatic lags."""
    n, e = len(x), x - x.mean()
    s0, s1 = e @ e / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        p = e[i:] @ e[: n - i] / (n / 2)
        s0, s1 = s0 + p, s1 + i * p
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    variance = (e @ e + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[: n - i]) for i in range(1, lags + 1))) / n
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / variance)
    return stat, float(np.interp(stat, [c for c, _ in KPSS_CRITICAL], [p for _, p in KPSS_CRITICAL])), lags, n


def stationarity(df: DataFrame, test: str, column: str = "close", least: int = 20, max_lag: int | None = None, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, test, series, statistic, p_value, lags, n, crit_1, crit_5, crit_10, stationary) by test 'adf' or 'kpss'.

    stationary: for adf p <= 0.05, for kpss p >= 0.05. max_lag bounds the lags of adf. Symbols of fewer than least known
    values, and constant ones, give nulls.
    """
    if test not in ("adf", "kpss"):
        raise ValueError(f"no test {test!r}")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values(spec.order)[column].dropna().to_numpy(dtype="float64")
        row = {spec.symbol: group[spec.symbol].iloc[0], "test": test, "series": column, "statistic": None, "p_value": None, "lags": None, "n": len(x), "crit_1": None, "crit_5": None, "crit_10": None, "stationary": None}
        if len(x) >= least and x.min() < x.max():
            if test == "adf":
                t, _, lags, n = adf_statistic(x, max_lag)
                row |= adf_columns(t, lags, n)
            else:
                stat, p, lags, n = kpss_statistic(x)
                row |= {"statistic": stat, "p_value": p, "lags": lags, "n": n, "stationary": p >= 0.05, "crit_1": 0.739, "crit_5": 0.463, "crit_10": 0.347}
        return pd.DataFrame([row])

    kind = dict(df.dtypes)[spec.symbol]
    ddl = f"{spec.symbol} {kind}, test string, series string, statistic double, p_value double, lags long, n long, crit_1 double, crit_5 double, crit_10 double, stationary boolean"
    return df.select(spec.symbol, *spec.order, column).groupBy(spec.symbol).applyInPandas(run, ddl)


def fractional_weights(d: float, window: int) -> list[float]:
    weights = [1.0]
    for k in range(1, window):
        weights.append(-weights[-1] * (d - k + 1) / k)
    return weights


def fractional_difference(df: DataFrame, d: float, window: int = 20, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """fracdiff: binomial weights of order d over the last window rows; null until there are as many known."""
    weights = fractional_weights(d, window)
    w = spec.window()
    terms = [F.lag(column, k).over(w) * F.lit(c) for k, c in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn("fracdiff", total)


def least_stationary_order(df: DataFrame, orders: list[float], window: int = 20, column: str = "close", max_lag: int | None = None, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, d): the smallest of orders at which the ADF test calls the fractional difference stationary; null if none."""
    results = None
    for d in orders:
        part = stationarity(fractional_difference(df, d, window, column, spec), "adf", "fracdiff", max_lag=max_lag, spec=spec).select(spec.symbol, F.when(F.col("stationary"), F.lit(float(d))).alias("d"))
        results = part if results is None else results.unionByName(part)
    return results.groupBy(spec.symbol).agg(F.min("d").alias("d"))


__all__ = ["acf", "adf_statistic", "durbin_levinson", "fractional_difference", "fractional_weights", "kpss_statistic", "least_stationary_order", "pacf", "position", "stationarity"]
