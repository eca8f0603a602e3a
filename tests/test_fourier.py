"""Transforms and convolutions in blocks against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import fourier, spectral, stats
from tidewater.series import SeriesSpec

TICKS = SeriesSpec(tiebreak=("i",))


def table(spark, **series):
    parts = [pd.DataFrame({"symbol": s, "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(x)) // 3, "min"), "i": np.arange(len(x)), "close": x}) for s, x in series.items()]
    return spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1)).withColumn("time", F.col("time").cast("timestamp_ntz"))


def bins(df, *names):
    rows = df.toPandas().sort_values(["symbol", "k"])
    return {s: g[list(names)].to_numpy() for s, g in rows.groupby("symbol")}


@pytest.mark.parametrize("block, most", [(64, 1 << 22), (50, 40), (7, 32), (1 << 20, 1 << 22)])
def test_transform_is_numpys(spark, block, most):
    """Lengths with good divisors, primes (beyond most: by a chirp), one and two values, gaps."""
    rng = np.random.default_rng(1)
    made = {"a": rng.normal(size=360), "prime": 50 + rng.normal(size=211), "one": np.array([3.0]), "two": np.array([1.0, 5.0]), "odd": rng.normal(size=189)}
    df = table(spark, **made)
    gap = df.withColumn("close", F.when(~((F.col("symbol") == "odd") & (F.col("i") % 5 == 0)), F.col("close")))
    made["odd"] = made["odd"][np.arange(189) % 5 != 0]
    got = bins(fourier.rfft(gap, "close", F.date_trunc("hour", "time"), TICKS, block, most), "re", "im", "freq")
    whole = bins(fourier.fft_table(gap, "close", F.date_trunc("hour", "time"), TICKS, block, most), "re", "im")
    assert set(got) == set(made)
    for s, x in made.items():
        want = np.fft.rfft(x)
        assert np.allclose(got[s][:, 0] + 1j * got[s][:, 1], want, atol=1e-8) and np.allclose(got[s][:, 2], np.arange(len(want)) / len(x))
        assert np.allclose(whole[s][:, 0] + 1j * whole[s][:, 1], np.fft.fft(x), atol=1e-8)


@pytest.mark.parametrize("n, most", [(100_000, 1 << 22), (99_991, 1 << 15)])
def test_long_series(spark, n, most):
    """A hundred thousand ticks, and a prime number of them that no task holds: to 1e-6 of numpy, at a level of 100."""
    x = 100 + np.random.default_rng(2).normal(size=n)
    got = fourier.rfft(table(spark, a=x), "close", F.date_trunc("hour", "time"), TICKS, 1 << 14, most).orderBy("k").toPandas()
    want = np.fft.rfft(x)
    assert np.abs(got["re"] + 1j * got["im"] - want).max() < 1e-6 and got["k"].tolist() == list(range(len(want)))


def test_shapes():
    assert fourier.shape(12) == (3, 4) and fourier.shape(97, 100) == (1, 97) and fourier.shape(97, 50) is None and fourier.shape(10_000, 100) == (100, 100) and fourier.shape(10_100, 100) is None


@pytest.mark.parametrize("d", [0.4, 0.0, 1.0, 1.7, -0.3])
def test_all_weights_of_fractional_differencing(spark, d):
    rng = np.random.default_rng(3)
    made = {"a": 1000 + np.cumsum(rng.normal(size=700)), "b": rng.normal(size=33), "one": np.array([2.0])}
    df = table(spark, **made)
    got = fourier.fractional_difference(df, d, "close", F.date_trunc("hour", "time"), TICKS, 128).toPandas().sort_values(["symbol", "i"])
    for s, x in made.items():
        weights = np.array(stats.fractional_weights(d, len(x)))
        assert np.allclose(got[got["symbol"] == s]["fracdiff"], np.convolve(x, weights)[: len(x)], atol=1e-6)
    short = stats.fractional_difference(df.where("symbol = 'b'"), d, 33, spec=TICKS).where("i = 32").first()["fracdiff"]
    assert abs(short - got[got["symbol"] == "b"]["fracdiff"].iloc[-1]) < 1e-6


def test_weights_far_back(spark):
    want = stats.fractional_weights(0.4, 200_001)
    ks = [0, 1, 5, 64, 65, 66, 1000, 200_000]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in ks], "k long").select(fourier.binomial_weight(F.col("k"), 0.4)).collect()]
    assert all(abs(g / want[k] - 1) < 1e-9 for g, k in zip(got, ks))


def test_spectra_agree(spark):
    df = table(spark, a=np.random.default_rng(4).normal(size=90))
    a = bins(fourier.rfft(df, "close", F.date_trunc("hour", "time"), TICKS), "k", "freq", "re", "im", "amplitude")["a"]
    b = bins(spectral.rfft(df, spec=TICKS), "k", "freq", "re", "im", "amplitude")["a"]
    assert np.allclose(a, b, atol=1e-9)
