"""The likelihood and the fit in chunks against the one-task forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import arima, forecast
from tidewater.series import SeriesSpec

SPEC = SeriesSpec()


def simulated(n, phi, theta, mean, seed):
    e = np.random.default_rng(seed).normal(size=n + 50)
    x = np.zeros(n + 50)
    for t in range(1, n + 50):
        x[t] = phi * x[t - 1] + e[t] + theta * e[t - 1]
    return mean + x[50:]


def table(spark, **series):
    parts = [pd.DataFrame({"symbol": s, "time": pd.date_range("2024-01-01", periods=len(x), freq="h"), "close_diff": x}) for s, x in series.items()]
    return spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1)).withColumn("time", F.col("time").cast("timestamp_ntz"))


def test_elements_compose_to_the_likelihood():
    y = simulated(700, 0.6, -0.4, 5.0, 1)
    params = np.array([[5.0, 0.6, -0.4], [4.0, -0.3, 0.9], [5.5, 0.99, 0.0], [5.0, 0.2, -0.99]])
    r = arima.weights(params[:, 1], params[:, 2])
    for cuts in ([0, 700], [0, 1, 300, 301, 700]):
        for lane in (7, 64, 1024):
            whole = None
            for a, b in zip(cuts, cuts[1:]):
                part = arima.element(y[a:b], a, params, r, lane)
                whole = part if whole is None else arima.compose(whole, part)
            for j, p in enumerate(params):
                ll, variance, e, weight = forecast.arma_likelihood(y, p)
                assert abs(whole[4][j] / 700 - variance) < 1e-9 * variance
                assert abs(-0.5 * (700 * (np.log(2 * np.pi * variance) + 1) + arima.log_variances(700, r)[j]) - ll) < 1e-7
                assert abs(whole[1][j] - (p[1] * (y[-1] - p[0]) + weight * e)) < 1e-8


@pytest.mark.parametrize("chunk", [97, 100_000])
def test_fit_and_forecast(spark, chunk):
    series = {"a": simulated(600, 0.7, 0.3, 2.0, 2), "b": simulated(450, -0.5, 0.2, -1e4, 3), "noise": simulated(300, 0.0, 0.0, 0.0, 4), "flat": np.full(60, 3.0), "short": simulated(15, 0.5, 0.1, 0.0, 5)}
    df = table(spark, **series).withColumn("close_diff", F.when(~((F.col("symbol") == "b") & (F.hour("time") == 3)), F.col("close_diff")))
    bucket = F.date_trunc("day", "time")
    got = arima.arima(df, "close_diff", bucket, chunk_rows=chunk).toPandas().sort_values(["symbol", "time"])
    want = forecast.arima(df).toPandas().sort_values(["symbol", "time"])
    assert list(got.columns) == list(want.columns) and got["symbol"].tolist() == want["symbol"].tolist() and (got["time"] == want["time"].values).all()
    steady = ["a", "b"]  # noise has no single best phi and theta
    for c in ("truth", "predicted", "low", "high"):
        pick = lambda x: x.loc[x["symbol"].isin(steady), c]
        assert np.allclose(pick(got), pick(want), atol=2e-3), c
    one = forecast.arima_summary(df).toPandas().set_index(["symbol", "term"]).sort_index()
    many = arima.arima_summary(df, "close_diff", bucket, chunk_rows=chunk).toPandas().set_index(["symbol", "term"]).sort_index()
    assert list(one.index) == list(many.index) and set(many.index.get_level_values(0)) == {"a", "b", "noise"}
    assert np.allclose(one.loc[steady, "log_likelihood"], many.loc[steady, "log_likelihood"], atol=1e-4) and np.allclose(one.loc[steady, "bic"], many.loc[steady, "bic"], atol=1e-3)
    assert abs(one.loc["noise", "log_likelihood"].iloc[0] - many.loc["noise", "log_likelihood"].iloc[0]) < 2
    assert np.allclose(one.loc[steady, "estimate"], many.loc[steady, "estimate"], rtol=1e-3, atol=1e-3) and np.allclose(one.loc[steady, "std_error"], many.loc[steady, "std_error"], rtol=0.02)
