"""Features over a symbol's ordered rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..series import BARS, CHUNK, SeriesSpec, in_chunks, position, positioned


def lag_features(df: DataFrame, lags: int, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """lag_1 ... lag_n; where there is none the symbol's first known value, 0 if all are null."""
    first = F.first(column, True).over(spec.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumns({f"lag_{k}": F.coalesce(F.lag(column, k).over(spec.window()), first, F.lit(0.0)) for k in range(1, lags + 1)})


def _whole_frame(value: Column, column: str, rows: int, window) -> Column:
    frame = window.rowsBetween(1 - rows, 0)
    return F.when(F.count(column).over(frame) == rows, value.over(frame))


def sma(df: DataFrame, windows: list[int], column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """sma_n: mean of the last n rows, null until n rows are known."""
    return df.withColumns({f"sma_{n}": _whole_frame(F.avg(column), column, n, spec.window()) for n in windows})


def rolling_std(df: DataFrame, rows: int, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    return df.withColumn(f"std_{rows}", _whole_frame(F.stddev_samp(column), column, rows, spec.window()))


def sma_in_chunks(df: DataFrame, rows: int, column: str, bucket: Column, spec: SeriesSpec, chunk_rows: int = CHUNK) -> DataFrame:
    """sma of one window for series too long for one task."""
    return in_chunks(df, spec, bucket, rows - 1, lambda w: {f"sma_{rows}": _whole_frame(F.avg(column), column, rows, w)}, chunk_rows)


def pct_change(column: str, periods: int = 1, spec: SeriesSpec = BARS) -> dict[str, Column]:
    """Two steps of columns: the padded series, and its relative change against periods rows before.

    Gaps are padded with the last known value first; over zero the change is infinite or NaN.
    """
    padded = F.last(column, True).over(spec.window().rowsBetween(Window.unboundedPreceding, 0))
    now, then = F.col("_padded"), F.lag("_padded", periods).over(spec.window())
    return {"_padded": padded, "pct_change": X.ratio(now - then, then)}


def with_pct_change(df: DataFrame, column: str = "close", periods: int = 1, name: str = "pct_change", spec: SeriesSpec = BARS) -> DataFrame:
    steps = pct_change(column, periods, spec)
    return df.withColumn("_padded", steps["_padded"]).withColumn(name, steps["pct_change"]).drop("_padded")


def diff(df: DataFrame, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    return df.withColumn(f"{column}_diff", F.col(column) - F.lag(column, 1).over(spec.window()))


def log(df: DataFrame, column: str = "close") -> DataFrame:
    """Natural logarithm; null at and below zero."""
    return df.withColumn(f"{column}_log", F.ln(column))


def detrend(df: DataFrame, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """Residual of a least-squares line over row positions."""
    placed = df.withColumn("_pos", position(spec).cast("double"))
    line = F.regr_intercept(column, "_pos").over(spec.whole()) + F.regr_slope(column, "_pos").over(spec.whole()) * F.col("_pos")
    return placed.withColumn(f"{column}_detrend", F.col(column) - line).drop("_pos")


def ema(df: DataFrame, spans: list[int], column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """ema_n: exponential mean with weight 2 / (n + 1), from the first known value on.

    Over a gap the last value is carried, and the gap's length lowers its weight against the
    next. A symbol's order and values alone go to one task, and are joined back by symbol and
    order where df has other columns; see ema_in_chunks for longer series.
    """
    names, keys = [f"ema_{n}" for n in spans], [spec.symbol, *spec.order]
    narrow = df.select(*keys, column)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields), *(f"{n} double" for n in names)])

    def run(group):
        group = group.sort_values(spec.order)
        for n, name in zip(spans, names, strict=True):
            group[name] = group[column].astype("float64").ewm(span=n, adjust=False).mean()
        return group

    made = narrow.groupBy(spec.symbol).applyInPandas(run, schema)
    return made if set(df.columns) == {*keys, column} else df.join(made.drop(column), keys, "left")


def ema_in_chunks(df: DataFrame, span: int, column: str, bucket: Column, spec: SeriesSpec, chunk_rows: int = CHUNK) -> DataFrame:
    """ema of one span for series of any length, gaps included.

    From a chunk's first known value on a step is y -> c y + b, so its known values are one affine map,
    and what a gap takes from the weight is known from its length. Maps of a symbol's
    chunks are composed in order (one small row for each), and each chunk starts from the value
    carried into it, and from how many rows ago it was known. Chunks of chunk_rows are the unit of work; no task
    holds a symbol. bucket must not fall as time rises, see series.positioned.
    """
    a = 2.0 / (span + 1)
    fade = 1 - a
    forgotten = 1 if fade <= 0 else int(-745 / np.log(fade)) + 1  # rows after which a weight is zero
    placed = positioned(df, spec, bucket)
    keyed = placed.withColumn("_chunk", F.floor(F.col("_pos") / chunk_rows)).drop("_pos")
    names = [f.name for f in df.schema.fields]
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    kind = dict(keyed.dtypes)[spec.symbol]

    def local(key, group):
        values = group.sort_values(spec.order)[column].to_numpy(dtype="float64")
        known = np.flatnonzero(~np.isnan(values))
        row = {spec.symbol: key[0], "_chunk": key[1], "_rows": len(values), "_lead": 0, "_tail": 0, "_first": np.nan, "_a": 1.0, "_b": 0.0}
        if len(known):
            weight = fade ** np.diff(known).astype(float)
            c, b = weight / (weight + a), a * values[known[1:]] / (weight + a)
            later = np.append(np.cumprod(c[::-1])[::-1], 1.0)
            row |= {"_lead": known[0], "_tail": len(values) - 1 - known[-1], "_first": values[known[0]], "_a": later[0], "_b": b @ later[1:]}
        return pd.DataFrame([row])

    maps = keyed.select(spec.symbol, *spec.order, column, "_chunk").groupBy(spec.symbol, "_chunk").applyInPandas(local, f"{spec.symbol} {kind}, _chunk long, _rows long, _lead long, _tail long, _first double, _a double, _b double")

    def carry(group):
        group = group.sort_values("_chunk")
        y, gap, carried = None, 0, []
        for rows, lead, tail, first, m, b in group[["_rows", "_lead", "_tail", "_first", "_a", "_b"]].itertuples(index=False):
            carried.append((y, gap))
            if first != first:
                gap += rows
                continue
            weight = fade ** float(gap + lead + 1)
            y = m * (first if y is None else (weight * y + a * first) / (weight + a)) + b
            gap = tail
        group["_carried"], group["_gap"] = zip(*carried, strict=True)
        return group[[spec.symbol, "_chunk", "_carried", "_gap"]]

    carried = maps.groupBy(spec.symbol).applyInPandas(carry, f"{spec.symbol} {kind}, _chunk long, _carried double, _gap long")

    def finish(group):
        group = group.sort_values(spec.order)
        before = [] if pd.isna(group["_carried"].iloc[0]) else [group["_carried"].iloc[0], *[np.nan] * min(forgotten, int(group["_gap"].iloc[0]))]
        values = np.concatenate([before, group[column].astype("float64")])
        group[f"ema_{span}"] = pd.Series(values).ewm(span=span, adjust=False).mean().to_numpy()[len(before) :]
        return group[[*names, f"ema_{span}"]]

    return keyed.join(carried, [spec.symbol, "_chunk"]).groupBy(spec.symbol, "_chunk").applyInPandas(finish, f"{plain}, ema_{span} double")


def seasonality(df: DataFrame, month: str = "month", categories: list[str] | None = None) -> DataFrame:
    """One 0/1 column for each season. categories: those to make; all three by default, so the schema doesn't hang on the data."""
    return df.withColumns(X.one_hot(X.season(F.col(month)), categories or sorted(X.SEASONS), "Month_Category"))


def rate_of_change(df: DataFrame, ma_type: str = "ema", ma_window: int = 50, roc_window: int = 20, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """roc, the per-cent change of a moving average over roc_window rows, and roc_bin."""
    if ma_type == "ema":
        smooth, name = ema(df, [ma_window], column, spec), f"ema_{ma_window}"
    elif ma_type == "ma":
        smooth, name = sma(df, [ma_window], column, spec), f"sma_{ma_window}"
    else:
        raise ValueError(f"no moving average {ma_type!r}")
    changed = with_pct_change(smooth, name, roc_window, "_change", spec)
    return changed.withColumn("roc", F.col("_change") * 100).withColumn("roc_bin", X.rate_bin(F.col("roc"))).drop("_change", name)


def binary_encode(df: DataFrame, column: str = "roc_bin", prefix: str = "ROC", mode: str = "fixed", spec: SeriesSpec = BARS) -> DataFrame:
    """Base-2 digits of a category's code, highest first.

    mode 'fixed': codes 1 to 7 in the order of the bins, Unknown first, alike for all symbols.
    mode 'appearance': codes in the order of a symbol's first rows.
    """
    if mode == "fixed":
        labels = [X.NO_BIN, *(b for b, _ in X.RATE_BINS), X.LOWEST_BIN]
        code = F.array_position(F.array(*map(F.lit, labels)), F.col(column)).cast("int")
        return df.withColumns(X.binary_digits(code, 3, prefix))
    if mode != "appearance":
        raise ValueError(f"no mode {mode!r}")
    placed = df.withColumn("_pos", position(spec))
    first = placed.withColumn("_first", F.min("_pos").over(Window.partitionBy(spec.symbol, column)))
    coded = first.withColumn("_code", F.dense_rank().over(Window.partitionBy(spec.symbol).orderBy("_first")))
    return coded.withColumns(X.binary_digits(F.col("_code"), 3, prefix)).drop("_pos", "_first", "_code")
