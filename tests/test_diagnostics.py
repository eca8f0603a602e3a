"""Diagnostics of residuals against numpy and the standard library."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import diagnostics

RNG = np.random.default_rng(7)
SERIES = {"normal": RNG.normal(size=400), "skewed": RNG.exponential(size=301), "linked": np.convolve(RNG.normal(size=260), [1, 0.8, 0.3])[:260], "flat": np.full(30, 2.0), "two": np.array([1.0, 2.0])}


@pytest.fixture(scope="module")
def df(spark):
    parts = [pd.DataFrame({"symbol": s, "time": pd.date_range("2024-01-01", periods=len(x), freq="h"), "residual": x}) for s, x in SERIES.items()]
    rows = spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1)).withColumn("time", F.col("time").cast("timestamp_ntz"))
    return rows.unionByName(rows.where("symbol = 'normal'").limit(3).withColumns({"residual": F.lit(None).cast("double"), "time": F.col("time") + F.expr("interval 90 days")}))


def test_normal_quantiles(spark):
    ps = [1e-12, 0.001, 0.02, 0.0243, 0.3, 0.5, 0.77, 0.9757, 0.99, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(diagnostics.normal_quantile(F.col("p"))).collect()]
    assert np.allclose(got, [statistics.NormalDist().inv_cdf(p) for p in ps], atol=1e-8)


@pytest.mark.parametrize("chunk", [12, 70, 10_000])
def test_tests(df, chunk):
    got = {r["symbol"]: r for r in diagnostics.residual_tests(df, "residual", F.date_trunc("day", "time"), 10, chunk_rows=chunk).collect()}
    for s in ("normal", "skewed", "linked"):
        x, r = SERIES[s], got[s]
        n, e = len(x), x - x.mean()
        rho = [e[k:] @ e[: n - k] / (e @ e) for k in range(1, 11)]
        q = n * (n + 2) * sum(c * c / (n - k - 1) for k, c in enumerate(rho))
        skew, kurtosis = (e**3).mean() / (e**2).mean() ** 1.5, (e**4).mean() / (e**2).mean() ** 2
        jb, h = n / 6 * (skew**2 + (kurtosis - 3) ** 2 / 4), round(n / 3)
        want = (n, q, math.exp(-q / 2) * sum((q / 2) ** i / math.factorial(i) for i in range(5)), skew, kurtosis, jb, math.exp(-jb / 2), (x[-h:] ** 2).sum() / (x[:h] ** 2).sum())
        assert np.allclose(list(r)[1:], want, rtol=1e-8)
    assert got["linked"]["ljung_box_p"] < 1e-6 < 0.01 < got["normal"]["ljung_box_p"] and got["skewed"]["jarque_bera_p"] < 1e-6
    assert all(v is None for s in ("flat", "two") for v in list(got[s])[2:])
    with pytest.raises(ValueError):
        diagnostics.chi_square_tail(F.lit(1.0), 3)


def test_quantile_pairs(df):
    rows = diagnostics.quantile_pairs(df, "residual").toPandas().sort_values(["symbol", "rank"])
    assert set(rows["symbol"]) == {"normal", "skewed", "linked", "two"}
    for s, g in rows.groupby("symbol"):
        x = np.sort(SERIES[s])
        assert g["rank"].tolist() == list(range(1, len(x) + 1)) and np.allclose(g["sample"], (x - x.mean()) / x.std(ddof=1))
        assert np.allclose(g["theoretical"], [statistics.NormalDist().inv_cdf(i / (len(x) + 1)) for i in g["rank"]], atol=1e-8)
