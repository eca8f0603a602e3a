"""The relations that plots are drawn from, where they aren't an operator's own result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import BARS, SeriesSpec, position
from . import features, forecast


def lines(df: DataFrame, columns: list[str], spec: SeriesSpec = BARS) -> DataFrame:
    """One or more columns over time: a price, a price and a social volume, a sentiment and a price."""
    return df.select(spec.symbol, *spec.order, *columns)


def transformed(df: DataFrame, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """A series with its difference, detrended rest and logarithm."""
    made = features.log(features.detrend(features.diff(df, column, spec), column, spec), column)
    return made.select(spec.symbol, *spec.order, column, f"{column}_diff", f"{column}_detrend", f"{column}_log")


def side_by_side(df: DataFrame, symbols: list[str], column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """(pos, a column for each symbol): series over row positions."""
    placed = df.where(F.col(spec.symbol).isin(symbols)).select(position(spec).cast("long").alias("pos"), spec.symbol, column)
    return placed.groupBy("pos").pivot(spec.symbol, symbols).agg(F.first(column))


def residuals(forecasts: DataFrame, spec: SeriesSpec = BARS) -> DataFrame:
    """Residuals and standardised residuals of forecasts with truth and predicted."""
    rest = forecasts.withColumn("residual", F.col("truth") - F.col("predicted"))
    spread = F.nullif(F.stddev_samp("residual").over(spec.whole()), F.lit(0.0))
    return rest.withColumn("standardised", (F.col("residual") - F.avg("residual").over(spec.whole())) / spread)


def with_band(df: DataFrame, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """Truth, forecast and band of the test rows beside the series."""
    return df.select(spec.symbol, spec.time, column).join(forecast.arima(df, column, spec=spec), [spec.symbol, spec.time], "left")
