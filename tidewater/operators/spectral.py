"""Spectra. A symbol's series, narrow, goes to one task for the transform; the rest is DataFrames over bins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..series import BARS, SeriesSpec


def _ordered(group: pd.DataFrame, spec: SeriesSpec, column: str) -> np.ndarray:
    return group.sort_values(spec.order)[column].dropna().to_numpy(dtype="float64")


def rfft(df: DataFrame, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, k, freq, re, im, amplitude) of the n // 2 + 1 bins of a real series. Nulls are left out."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = _ordered(group, spec, column)
        f = np.fft.rfft(x) if len(x) else np.empty(0, dtype=complex)
        k = np.arange(len(f))
        return pd.DataFrame({spec.symbol: group[spec.symbol].iloc[0], "k": k, "freq": k / max(1, len(x)), "re": f.real, "im": f.imag, "amplitude": np.abs(f)})

    kind = dict(df.dtypes)[spec.symbol]
    return df.select(spec.symbol, *spec.order, column).groupBy(spec.symbol).applyInPandas(run, f"{spec.symbol} {kind}, k long, freq double, re double, im double, amplitude double")


def fft_table(df: DataFrame, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, k, re, im, absolute, angle) of all n bins: those above the middle are the lower ones' conjugates."""
    half = rfft(df, column, spec)
    counted = df.where(F.col(column).isNotNull()).groupBy(spec.symbol).agg(F.count("*").alias("_n"))
    both = half.join(counted, spec.symbol).select(spec.symbol, "_n", F.explode(F.array_compact(F.array(F.struct("k", "re", "im"), F.when((F.col("k") > 0) & (2 * F.col("k") < F.col("_n")), F.struct((F.col("_n") - F.col("k")).alias("k"), "re", (-F.col("im")).alias("im")))))).alias("b"))
    bins = both.select(spec.symbol, "b.*")
    return bins.select(spec.symbol, "k", "re", "im", F.hypot("re", "im").alias("absolute"), F.atan2("im", "re").alias("angle"))


def peaks(spectrum: DataFrame, value: str = "amplitude", spec: SeriesSpec = BARS) -> DataFrame:
    """Rows at strict local maxima of at least 0; a flat top counts at its middle (rounded down), the ends never."""
    w = Window.partitionBy(spec.symbol).orderBy("k")
    runs = spectrum.withColumn("_step", F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)).withColumn("_run", F.sum("_step").over(w)).withColumn("_at", F.row_number().over(w))
    tops = runs.groupBy(spec.symbol, "_run").agg(F.first(value).alias("_v"), F.min("_at").alias("_a"), F.max("_at").alias("_b"))
    r = Window.partitionBy(spec.symbol).orderBy("_run")
    tops = tops.withColumns({"_before": F.lag("_v").over(r), "_after": F.lead("_v").over(r)}).where("_v > _before and _v > _after and _v >= 0")
    tops = tops.select(F.col(spec.symbol).alias("_s"), F.floor((F.col("_a") + F.col("_b")) / 2).alias("_mid"))
    return runs.join(tops, (F.col(spec.symbol) == F.col("_s")) & (F.col("_at") == F.col("_mid"))).select(*spectrum.columns)


def with_period(found: DataFrame) -> DataFrame:
    return found.withColumn("period", F.when(F.col("freq") != 0, 1 / F.nullif("freq", F.lit(0.0))))


def band_peaks(spectrum: DataFrame, low: float = 1 / 252, high: float = 1 / 5, spec: SeriesSpec = BARS) -> DataFrame:
    """Peaks of the band alone: it is cut out first, so its edges differ from those of the whole."""
    return with_period(peaks(spectrum.where(F.col("freq").between(low, high)), spec=spec))


def monthly_cycles(found: DataFrame) -> DataFrame:
    """Peaks with a period that rounds, half to even, to 17 to 22."""
    return found.where(F.bround("period").between(17, 22))


def reconstruct(df: DataFrame, kept: list[int], column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """rec_k: the series of the first k and the last k of its n bins alone. Real part; rows with a null are left out."""
    base = df.select(spec.symbol, *spec.order, column).where(F.col(column).isNotNull())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(spec.order)
        f = np.fft.fft(group[column].to_numpy(dtype="float64"))
        for k in kept:
            low = f.copy()
            low[k : len(f) - k] = 0
            group[f"rec_{k}"] = np.fft.ifft(low).real
        return group

    return base.groupBy(spec.symbol).applyInPandas(run, ", ".join([fields, *(f"rec_{k} double" for k in kept)]))
