"""Filling gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..series import BARS, SeriesSpec


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def last_known(column: str, spec: SeriesSpec) -> Column:
    return F.last(column, True).over(spec.window().rowsBetween(Window.unboundedPreceding, 0))


def next_known(column: str, spec: SeriesSpec) -> Column:
    """Over the reversed order: a frame that grows to the end would be walked anew for each row."""
    return F.last(column, True).over(spec.backwards().rowsBetween(Window.unboundedPreceding, 0))


def ffill(df: DataFrame, columns: list[str] | None = None, spec: SeriesSpec = BARS) -> DataFrame:
    """Each null becomes the last known value of its symbol; leading nulls stay."""
    own = {spec.symbol, *spec.order}
    return df.withColumns({c: last_known(c, spec) for c in (columns or [c for c in df.columns if c not in own])})


def bfill(df: DataFrame, columns: list[str] | None = None, spec: SeriesSpec = BARS) -> DataFrame:
    """Each null becomes the next known value of its symbol; trailing nulls stay."""
    own = {spec.symbol, *spec.order}
    return df.withColumns({c: next_known(c, spec) for c in (columns or [c for c in df.columns if c not in own])})


def centred_frame(spec: SeriesSpec, window: int):
    """Rows around each row: as many before as after, one more before if window is even."""
    return spec.window().rowsBetween(-(window // 2), (window - 1) // 2)


def rolling_median(column: str, window: int, spec: SeriesSpec = BARS) -> Column:
    return F.percentile(column, 0.5).over(centred_frame(spec, window))


def impute(df: DataFrame, columns: list[str] | None = None, window: int = 5, mode: str = "lookahead", spec: SeriesSpec = BARS) -> DataFrame:
    """Fill nulls of numeric columns.

    mode 'lookahead': the next known value, and for trailing nulls the median of the known
    values within the centred window of the column as it was. It looks ahead in time.
    mode 'causal': the last known value. What neither reaches stays null.
    """
    chosen = [c for c in (columns or numeric_columns(df)) if c != spec.symbol]
    if mode == "causal":
        return ffill(df, chosen, spec)
    if mode != "lookahead":
        raise ValueError(f"no mode {mode!r}")
    return df.withColumns({c: F.coalesce(F.col(c), next_known(c, spec), rolling_median(c, window, spec)) for c in chosen})
