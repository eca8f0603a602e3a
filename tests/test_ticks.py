"""Operators over chunks against their one-task forms, for several sizes of chunk."""

import inspect
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_series import N, column, near, series

from tidewater.operators import clean, features, stats, ticks
from tidewater.series import SeriesSpec, chunked



@pytest.fixture
def day(spark):
    return F.date_trunc("day", "time")



def gappy(seed, n, share=0.4):
    rng = random.Random(seed)
    values = [None if rng.random() < share else round(rng.uniform(1, 9), 3) for _ in range(n)]
    for a, b in ((0, 9), (30, 52), (n - 13, n)):  # gaps at both ends, and one longer than chunks
        values[a:b] = [None] * len(values[a:b])
    return values


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_fills_and_medians(spark, day, chunk):
    df = series(spark, gappy(1, 90)).unionByName(series(spark, gappy(2, 41), "b")).unionByName(series(spark, [N] * 5, "none")).withColumn("other", F.lit("kept"))
    near(column(ticks.ffill(df, ["close"], day, chunk_rows=chunk), "close"), column(clean.ffill(df, ["close"]), "close"))
    near(column(ticks.bfill(df, ["close"], day, chunk_rows=chunk), "close"), column(clean.bfill(df, ["close"]), "close"))
    for window in (1, 4, 5) if chunk >= 7 else (5,):
        got = ticks.rolling_median(df, window, "close", day, chunk_rows=chunk)
        near(column(got, "rolling_median"), column(df.withColumn("m", clean.rolling_median("close", window)), "m"))
    filled = ticks.impute(df, ["close"], day, chunk_rows=chunk)
    near(column(filled, "close"), column(clean.impute(df, ["close"]), "close"))
    assert filled.columns == df.columns and filled.where("other = 'kept'").count() == df.count()
    assert ticks.impute(df.limit(0), ["close"], day).count() == 0


def test_a_window_beyond_a_chunk_is_an_error(spark, day):
    with pytest.raises(ValueError):
        ticks.rolling_median(series(spark, [1.0, 2.0]), 9, "close", day, chunk_rows=3)


def walks(spark):
    rng = random.Random(9)

    def walk(n, pull, start=100.0):
        out = [start]
        for _ in range(n - 1):
            out.append(out[-1] + pull * (start - out[-1]) + rng.gauss(0, 1) + 0.3 * math.sin(len(out)))
        return out

    kinds = {"walk": walk(260, 0.0), "mean": walk(180, 0.4), "gap": [None if rng.random() < 0.3 else v for v in walk(150, 0.05, 1e6)], "flat": [2.0] * 40, "short": walk(9, 0.1), "none": [None] * 4}
    df = None
    for name, values in kinds.items():
        part = series(spark, values, name)
        df = part if df is None else df.unionByName(part)
    return df


@pytest.mark.parametrize("chunk", [31, 10_000])
@pytest.mark.parametrize("test, max_lag", [("adf", None), ("adf", 0), ("adf", 3), ("kpss", None)])
def test_stationarity_from_sums(spark, day, chunk, test, max_lag):
    df = walks(spark)
    if test == "adf":
        got = ticks.adf(df, "close", day, max_lag=max_lag, chunk_rows=chunk)
    else:
        got = ticks.kpss(df, "close", day, chunk_rows=chunk)
    want = {r["symbol"]: r for r in stats.stationarity(df, test, max_lag=max_lag).collect()}
    rows = {r["symbol"]: r for r in got.collect()}
    assert set(rows) == set(want) - {"none"}
    assert got.columns == stats.stationarity(df, test).columns
    for symbol, r in rows.items():
        for name, w in want[symbol].asDict().items():
            assert r[name] == w or abs(r[name] - w) < 1e-6 * max(1, abs(w)), (symbol, name, r[name], w)


def test_long_walk_from_sums(spark):
    """Many lags, a level far from zero: the sums keep their digits."""
    rng = np.random.default_rng(2)
    x = 1e5 + np.cumsum(rng.normal(size=6000) + 0.5 * np.roll(rng.normal(size=6000), 3))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "a", "time": pd.date_range("2024-01-01", periods=6000, freq="min"), "close": x})).withColumn("time", F.col("time").cast("timestamp_ntz"))
    got, want = ticks.adf(df, "close", F.date_trunc("hour", "time"), chunk_rows=500).first(), stats.adf_statistic(x)
    assert got["lags"] == want[2] and abs(got["statistic"] - want[0]) < 1e-6
    got, want = ticks.kpss(df, "close", F.date_trunc("hour", "time"), chunk_rows=500).first(), stats.kpss_statistic(x)
    assert got["lags"] == want[2] and abs(got["statistic"] - want[0]) < 1e-6


@pytest.mark.parametrize("chunk", [3, 7, 1000])
@pytest.mark.parametrize("span", [1, 5, 40])
def test_means_with_gaps(spark, day, chunk, span):
    df = series(spark, gappy(3, 90)).unionByName(series(spark, gappy(4, 41, 0.1), "b")).unionByName(series(spark, [N] * 8, "none"))
    clear = lambda v: [None if x is None or math.isnan(x) else x for x in v]
    near(clear(column(features.ema_in_chunks(df, span, "close", day, SeriesSpec(), chunk), f"ema_{span}")), clear(column(features.ema(df, [span]), f"ema_{span}")))


@pytest.mark.parametrize("chunk", [5, 1000])
def test_correlations_and_trends(spark, day, chunk):
    df = series(spark, gappy(5, 90, 0.2)).unionByName(series(spark, gappy(6, 61, 0.0), "b")).unionByName(series(spark, [2.0] * 9, "flat"))
    rows = lambda made, *names: sorted(tuple(r[c] if c == "symbol" else float(r[c]) for c in ("symbol", "lag", *names)) for r in made.collect())
    for got, want, name in ((ticks.acf(df, 6, "close", day, chunk_rows=chunk), stats.acf(df, 6), "acf"), (ticks.pacf(df, 6, "close", day, chunk_rows=chunk), stats.pacf(df, 6), "pacf")):
        a, b = rows(got, name, "low", "high"), rows(want, name, "low", "high")
        assert got.columns == want.columns and [r[:2] for r in a] == [r[:2] for r in b] and len(a) == 14
        assert np.allclose([r[2:] for r in a], [r[2:] for r in b], atol=1e-9)
    near(column(ticks.detrend(df, "close", day), "close_detrend"), column(features.detrend(df), "close_detrend"))


def long_series(spark, n=450_000):
    """One symbol, more ticks than a worker should hold, every seventh unknown."""
    known = F.when(F.col("id") % 7 != 0, ((F.col("id") * 7919) % 1009).cast("double"))
    return spark.range(n).select(F.lit("a").alias("symbol"), F.timestamp_seconds(F.col("id") * 5 + 1_700_000_000).alias("time"), known.alias("close"))


def test_a_worker_holds_a_bounded_chunk(spark):
    """By default no group of a long series is larger than 250 000 rows and its halo, and the ADF test is as over one chunk."""
    hour = F.date_trunc("hour", "time")
    chunks = {inspect.signature(f).parameters["chunk_rows"].default for f in (ticks.adf, ticks.kpss, ticks.rolling_median, ticks.impute, ticks.lagged_sums, features.ema_in_chunks)}
    df = long_series(spark)
    for rows in chunks:
        sizes = [r["count"] for r in chunked(df, SeriesSpec(), hour, rows, 10, 10).groupBy("_at").count().collect()]
        assert max(sizes) <= 250_020 and 450_000 <= sum(sizes) <= 450_000 + 20 * (len(sizes) - 1)
    got, want = ticks.adf(df, "close", hour).first(), ticks.adf(df, "close", hour, chunk_rows=1_000_000).first()
    assert (got["lags"], got["n"]) == (want["lags"], want["n"]) and abs(got["statistic"] - want["statistic"]) < 1e-6 * abs(want["statistic"])


def test_medians_across_bounded_chunks(spark):
    """With default chunks, of which a long series has several: no group is larger than 250 000 rows and its halo, and the medians are those of one chunk."""
    hour, df = F.date_trunc("hour", "time"), long_series(spark)
    got = ticks.rolling_median(df, 21, "close", hour)
    want = ticks.rolling_median(df, 21, "close", hour, chunk_rows=1_000_000)
    assert got.count() == 450_000 and got.exceptAll(want).count() == 0
    rows = inspect.signature(ticks.rolling_median).parameters["chunk_rows"].default
    assert chunked(df, SeriesSpec(), hour, rows, 10, 10).groupBy("_at").count().agg(F.max("count")).first()[0] <= 250_020
