"""Diagnostics of residuals: tests of what is left in them, and their quantiles against the normal distribution's.

All from sums and ranks: lagged products of chunks, moments, and positions counted over ranges of
values, so no task sorts or holds a symbol.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import shared_folder
from ..series import BARS, SeriesSpec, in_chunks, positioned
from ..sources.files import nan_to_null
from .ticks import CHUNK, lagged_sums

# Acklam's rational approximation of the normal quantile; its relative error is below 1.15e-9.
CENTRE_ABOVE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_ABOVE = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def normal_quantile(p: Column) -> Column:
    """The standard normal distribution's quantile of p, 0 < p < 1."""
    q = p - 0.5
    r = q * q
    centre = _polynomial(r, CENTRE_ABOVE) * q / _polynomial(r, CENTRE_BELOW)
    low = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _polynomial(low, TAIL_ABOVE) / _polynomial(low, TAIL_BELOW)
    return F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(centre)


def chi_square_tail(x: Column, freedom: int) -> Column:
    """The probability of a chi-square value above x, for an even number of degrees of freedom."""
    if freedom % 2:
        raise ValueError("degrees of freedom must be even")
    return F.exp(-x / 2) * sum(((x / 2) ** i / math.factorial(i) for i in range(1, freedom // 2)), F.lit(1.0))


def lagged_residuals(df: DataFrame, column: str, bucket: Column, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK) -> DataFrame:
    """residual: the error of the naive forecast, each value less the one before; null at a symbol's first row. For series of any length."""
    return in_chunks(df, spec, bucket, 1, lambda w: {"residual": F.col(column) - F.lag(column).over(w)}, chunk_rows)


def residual_tests(df: DataFrame, column: str, bucket: Column, lags: int = 10, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK) -> DataFrame:
    """(symbol, n, ljung_box, ljung_box_p, skew, kurtosis, jarque_bera, jarque_bera_p, heteroskedasticity) of each symbol's known residuals.

    ljung_box: no autocorrelation up to lags (an even number; as many degrees of freedom).
    kurtosis: 3 for a normal distribution. heteroskedasticity: squares of the last third over
    those of the first. A symbol of constant residuals, or of three or fewer, has null tests.
    """
    known = nan_to_null(df.select(spec.symbol, *spec.order, F.col(column).cast("double").alias("_r"))).where("_r is not null")
    base = known.groupBy(spec.symbol).agg(F.count("*").alias("n"), F.avg("_r").alias("_mean"), F.skewness("_r").alias("skew"), (F.kurtosis("_r") + 3).alias("kurtosis"), F.min("_r").alias("_low"), F.max("_r").alias("_high"))
    centred = known.join(base.select(spec.symbol, "_mean"), spec.symbol).withColumn("_x", F.col("_r") - F.col("_mean"))
    products = lagged_sums(centred.select(spec.symbol, *spec.order, "_x"), lags, bucket, spec, chunk_rows)
    sums = products.groupBy(spec.symbol).agg(F.max(F.when(F.col("k") == 0, F.col("xx"))).alias("_0"), F.collect_list(F.when(F.col("k") > 0, F.struct("k", "xx"))).alias("_k"))
    rho = F.aggregate("_k", F.lit(0.0), lambda s, v: s + F.when(F.col("n") > v["k"], (v["xx"] / F.nullif("_0", F.lit(0.0))) ** 2 / (F.col("n") - v["k"])).otherwise(0.0))
    third = F.round(F.col("n") / 3).cast("long")
    placed = positioned(known, spec, bucket).join(base.select(spec.symbol, "n"), spec.symbol)
    ends = placed.groupBy(spec.symbol).agg(F.sum(F.when(F.col("_pos") < third, F.col("_r") ** 2)).alias("_first"), F.sum(F.when(F.col("_pos") >= F.col("n") - third, F.col("_r") ** 2)).alias("_last"))
    tested = (F.col("n") > 3) & (F.col("_low") < F.col("_high"))
    rows = base.join(sums, spec.symbol).join(ends, spec.symbol)
    rows = rows.withColumn("ljung_box", F.when(tested, F.col("n") * (F.col("n") + 2) * rho)).withColumn("jarque_bera", F.when(tested, F.col("n") / 6 * (F.col("skew") ** 2 + (F.col("kurtosis") - 3) ** 2 / 4)))
    return rows.select(
        spec.symbol, "n", "ljung_box", chi_square_tail(F.col("ljung_box"), lags).alias("ljung_box_p"), F.when(tested, F.col("skew")).alias("skew"), F.when(tested, F.col("kurtosis")).alias("kurtosis"),
        "jarque_bera", chi_square_tail(F.col("jarque_bera"), 2).alias("jarque_bera_p"), F.when(tested, F.col("_last") / F.nullif("_first", F.lit(0.0))).alias("heteroskedasticity"),
    )


def quantile_pairs(df: DataFrame, column: str, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, rank, theoretical, sample): the known residuals, standardised, in their order from rank 1, against the normal quantiles of rank / (n + 1).

    Ranks are exact: values are dealt by ranges, numbered inside them and shifted by the ranges before. A constant symbol gives none.
    """
    known = nan_to_null(df.select(spec.symbol, F.col(column).cast("double").alias("_r"))).where("_r is not null")
    base = known.groupBy(spec.symbol).agg(F.count("*").alias("_n"), F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("_std")).where("_std > 0")
    shared_folder(df.sparkSession)
    dealt = known.repartitionByRange(spec.symbol, "_r").checkpoint(eager=True).withColumn("_part", F.spark_partition_id())
    ranked = positioned(dealt, SeriesSpec(spec.symbol, "_r"), F.col("_part")).join(base, spec.symbol)
    rank = (F.col("_pos") + 1).cast("long")
    return ranked.select(spec.symbol, rank.alias("rank"), normal_quantile(rank / (F.col("_n") + 1)).alias("theoretical"), ((F.col("_r") - F.col("_mean")) / F.col("_std")).alias("sample"))
