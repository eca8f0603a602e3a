"""Splits, scaling and windows for supervised learning."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as X
from ..series import BARS, SeriesSpec, position
from . import clean, features
from .profile import drop_columns, select_present

# The columns of the two kinds of model input.
FINANCIAL = ["timestamp", "time", "open", "close", "high", "low", "market_cap", "day", "month", "year"]
SENTIMENT = [*FINANCIAL, "volume_24h", "social_contributors", "social_volume", "tweets", "Month_Category_Bearish", "Month_Category_Bullish", "Month_Category_Normal", "ROC_0", "ROC_1", "ROC_2"]


def with_date_parts(df: DataFrame, spec: SeriesSpec = BARS) -> DataFrame:
    return df.withColumns(X.date_parts(F.col(spec.time)))


def with_cyclic_weekday(df: DataFrame, spec: SeriesSpec = BARS) -> DataFrame:
    return df.withColumns(X.cyclic_weekday(F.col(spec.time)))


def simplify(df: DataFrame, columns: list[str] = FINANCIAL, spec: SeriesSpec = BARS) -> DataFrame:
    """The symbol and the named columns alone; raises where one is missing."""
    return df.select(spec.symbol, *columns)


def split3(df: DataFrame, train: float = 0.7, validation: float = 0.2, spec: SeriesSpec = BARS) -> DataFrame:
    """split: 'train', 'val' or 'test' by position; the ends are whole parts of n times a sum of doubles (0.7 + 0.2 is under 0.9)."""
    at, n = position(spec), F.count("*").over(spec.whole())
    part = F.when(at < F.floor(n * F.lit(train)), "train").when(at < F.floor(n * F.lit(train + validation)), "val").otherwise("test")
    return df.withColumn("split", part)


def split2(df: DataFrame, train: float = 0.8, spec: SeriesSpec = BARS) -> DataFrame:
    at, n = position(spec), F.count("*").over(spec.whole())
    return df.withColumn("split", F.when(at < F.floor(n * F.lit(train)), "train").otherwise("test"))


def halves(df: DataFrame, spec: SeriesSpec = BARS) -> DataFrame:
    """half 1 or 2; of an odd number the middle row is in the second."""
    at, n = position(spec), F.count("*").over(spec.whole())
    return df.withColumn("half", F.when(at < F.floor(n / 2), 1).otherwise(2))


def rolling_by_halves(df: DataFrame, rows: int = 12, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """Rolling mean and standard deviation that start anew in the second half of each symbol."""
    from pyspark.sql import Window

    frame = Window.partitionBy(spec.symbol, "half").orderBy(*spec.order).rowsBetween(1 - rows, 0)
    full = F.count(column).over(frame) == rows
    return halves(df, spec).withColumns({"rolling_mean": F.when(full, F.avg(column).over(frame)), "rolling_std": F.when(full, F.stddev_samp(column).over(frame))})


def scaled_columns(df: DataFrame, spec: SeriesSpec = BARS) -> list[str]:
    """The numbers and times of df but for those that are encodings already: the weekday's sine and cosine, and seasons."""
    kinds = (T.NumericType, T.TimestampType, T.TimestampNTZType)
    own = {spec.symbol, "split", "sin_date", "cos_date"}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in own and not f.name.startswith("Month_Category_")]


def standardise(df: DataFrame, columns: list[str] | None = None, spec: SeriesSpec = BARS) -> DataFrame:
    """z-scores by each symbol's train mean and standard deviation (n - 1), for all splits; null where it is zero. Needs split.

    columns: scaled_columns by default. Times are scaled as numbers, in microseconds. The
    statistics are one small row per symbol.
    """
    columns = scaled_columns(df, spec) if columns is None else columns
    value = {c: X.epoch_micros(F.col(c)) if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(c).cast("double") for c in columns}
    stats = df.where("split = 'train'").groupBy(spec.symbol).agg(*(f(value[c]).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    scaled = df.join(stats, spec.symbol, "left").withColumns({f"z_{c}": X.z_score(value[c], F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns})
    return scaled.drop(*(f"_{n}_{c}" for c in columns for n in "ms"))


def sequences(df: DataFrame, columns: list[str], label: str = "close", steps: int = 5, by_split: bool = False, spec: SeriesSpec = BARS) -> DataFrame:
    """A row for each window: pos (of the label), window (array of steps structs), label.

    The label is the row after the window; the last possible window isn't made, so n rows give
    max(0, n - steps - 1) windows. With by_split windows don't cross splits.
    """
    from pyspark.sql import Window

    keys = [spec.symbol, "split"] if by_split else [spec.symbol]
    w = Window.partitionBy(*keys).orderBy(*spec.order)
    made = df.select(*keys, *spec.order, F.col(label).alias("label"), F.collect_list(F.struct(*columns)).over(w.rowsBetween(-steps, -1)).alias("window"), (F.row_number().over(w) - 1).alias("pos"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    return made.where(f"pos >= {steps} and pos <= _n - 2").drop("_n")


def preprocess(df: DataFrame, threshold: float = 25.0, columns: list[str] | None = None, only: list[str] | None = None, fill: bool = True, keep: list[str] | None = None, spec: SeriesSpec = BARS) -> DataFrame:
    """Date parts, columns dropped, nulls imputed, seasons, binned and encoded rate of change, forward fill.

    columns: those to keep if the data shouldn't be asked (see drop_columns). only: the columns
    to go on with before any are dropped (as FINANCIAL; raises where one is missing). fill: whether
    to fill forward at the end. keep: the columns to give, as far as they are there (as SENTIMENT).
    """
    out = df.transform(with_date_parts, spec)
    if only is not None:
        out = simplify(out, only, spec)
    out = out.transform(functools.partial(drop_columns, threshold=threshold, columns=columns)).transform(clean.impute, spec=spec).transform(features.seasonality)
    out = out.transform(features.rate_of_change, "ema", 10, 20, spec=spec).transform(features.binary_encode, spec=spec).drop("roc", "roc_bin")
    out = clean.ffill(out, spec=spec) if fill else out
    return out if keep is None else select_present(out, [spec.symbol, *keep])
