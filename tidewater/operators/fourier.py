"""Fourier transforms and convolutions of series too long for one task.

The four-step method: the n = n1 n2 values are a matrix, row by row; its columns are transformed,
turned by the roots of unity, and its rows are transformed. Each round deals whole columns or
rows to tasks in blocks of about BLOCK values, with one shuffle between. Where n has no such
divisors (a large prime, say) the transform is a convolution with a chirp of a power of two (Bluestein).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import BARS, SeriesSpec, positioned

BLOCK = 1 << 20  # values of a task
MOST = 1 << 22  # values of a column or a row

FEW = 64  # weights taken from their recursion, later ones from a series


def shape(n: int, most: int = MOST) -> tuple[int, int] | None:
    """(n1, n2) of n = n1 n2, as near to each other as can be; None if n2 would exceed most."""
    root = math.isqrt(n)
    if n <= most:
        low = 1
    elif root > most:
        return None
    else:
        low = -(-n // most)
    some = np.arange(root, low - 1, -1)
    good = some[n % some == 0] if len(some) else some
    return (int(good[0]), n // int(good[0])) if len(good) else None


def sized(sizes: DataFrame, keys: list[str], n: str, most: int, must: bool = False) -> DataFrame:
    """sizes with n1 and n2; where n has no shape null, or an error if it must have one."""

    @F.pandas_udf("n1 long, n2 long")
    def shapes(values: pd.Series) -> pd.DataFrame:
        known = {v: shape(int(v), most) or (None, None) for v in values.unique()}
        if must and (None, None) in known.values():
            raise ValueError(f"a series is longer than the square of {most} values")
        return pd.DataFrame([known[v] for v in values], columns=["n1", "n2"]).astype("Int64")

    return sizes.withColumn("_s", shapes(F.col(n).cast("long"))).select(*keys, n, "_s.n1", "_s.n2")


def four_step(rows: DataFrame, sizes: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, k, re, im), all n bins: the transform of rows (keys, pos, re, im); places without a row are zero. sizes: (keys, n1, n2)."""
    kinds = dict(rows.dtypes)
    named = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    placed = rows.join(sizes.select(*keys, "n1", "n2"), keys)
    columns = F.greatest(F.lit(1), F.floor(block / F.col("n1")))
    dealt = placed.select(*keys, "n1", "n2", F.floor(F.col("pos") / F.col("n2")).alias("j1"), (F.col("pos") % F.col("n2")).alias("j2"), "re", "im").withColumn("_block", F.floor(F.col("j2") / columns))

    def first(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n1, n2 = int(group["n1"].iloc[0]), int(group["n2"].iloc[0])
        width = max(1, block // n1)
        begin = int(key[-1]) * width
        width = min(width, n2 - begin)
        m = np.zeros((n1, width), dtype=complex)
        m[group["j1"], group["j2"] - begin] = group["re"].to_numpy() + 1j * group["im"].to_numpy()
        m = np.fft.fft(m, axis=0)
        k1, j2 = np.arange(n1)[:, None], np.arange(begin, begin + width)[None, :]
        m *= np.exp(-2j * np.pi * ((k1 * j2) % (n1 * n2)) / (n1 * n2))
        return pd.DataFrame({**dict(zip(keys, key[:-1], strict=True)), "n1": n1, "n2": n2, "k1": np.arange(n1), "begin": begin, "re": list(m.real), "im": list(m.imag)})

    turned = dealt.groupBy(*keys, "_block").applyInPandas(first, f"{named}, n1 long, n2 long, k1 long, begin long, re array<double>, im array<double>")
    lines = F.greatest(F.lit(1), F.floor(block / F.col("n2")))
    dealt = turned.withColumn("_block", F.floor(F.col("k1") / lines))

    def second(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n1, n2 = int(group["n1"].iloc[0]), int(group["n2"].iloc[0])
        k1 = np.unique(group["k1"])
        m = np.zeros((len(k1), n2), dtype=complex)
        for at, begin, re, im in zip(np.searchsorted(k1, group["k1"]), group["begin"], group["re"], group["im"], strict=True):
            m[at, begin : begin + len(re)] = np.asarray(re) + 1j * np.asarray(im)
        m = np.fft.fft(m, axis=1)
        k = (k1[:, None] + n1 * np.arange(n2)[None, :]).ravel()
        return pd.DataFrame({**dict(zip(keys, key[:-1], strict=True)), "k": k, "re": m.real.ravel(), "im": m.imag.ravel()})

    return dealt.groupBy(*keys, "_block").applyInPandas(second, f"{named}, k long, re double, im double")


def convolved(a: DataFrame, b: DataFrame, sizes: DataFrame, keys: list[str], block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(keys, pos, re, im): the cyclic convolution, of length n, of a and b (keys, pos, re, im). sizes: (keys, n), with a shape each."""
    both = a.withColumn("_of", F.lit(0)).unionByName(b.withColumn("_of", F.lit(1)))
    shaped = sized(sizes, keys, "n", most, must=True)
    two = shaped.withColumn("_of", F.explode(F.array(F.lit(0), F.lit(1))))
    bins = four_step(both, two, [*keys, "_of"], block)
    side = lambda c, of: F.sum(F.when(F.col("_of") == of, F.col(c))).alias(f"{c}{of}")
    met = bins.groupBy(*keys, "k").agg(side("re", 0), side("im", 0), side("re", 1), side("im", 1))
    # Back by the transform of the conjugate.
    product = met.select(*keys, F.col("k").alias("pos"), (F.col("re0") * F.col("re1") - F.col("im0") * F.col("im1")).alias("re"), (-F.col("re0") * F.col("im1") - F.col("im0") * F.col("re1")).alias("im"))
    back = four_step(product, shaped, keys, block).join(sizes, keys)
    return back.select(*keys, F.col("k").alias("pos"), (F.col("re") / F.col("n")).alias("re"), (-F.col("im") / F.col("n")).alias("im"))


def padded(n: Column) -> Column:
    """The least power of two of at least 2 n."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * n) - 1e-9)).cast("long")


def transform(rows: DataFrame, keys: list[str], block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(keys, k, re, im): the n bins of rows (keys, pos, re, im) with places 0 to n - 1."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    shaped = sized(counted, keys, "n", most)
    plain = four_step(rows, shaped.where("n1 is not null"), keys, block)
    rest = shaped.where("n1 is null").select(*keys, "n")
    if rest.isEmpty():
        return plain
    # x[j] w[j]* convolved with w, and turned by w*, where w[j] is e to the i pi j j / n.
    angle = F.lit(math.pi) * ((F.col("pos") * F.col("pos")) % (2 * F.col("n"))) / F.col("n")
    chirped = rows.join(rest, keys).withColumns({"_c": F.cos(angle), "_s": F.sin(angle), "_m": padded(F.col("n"))})
    turned = lambda: [(F.col("re") * F.col("_c") + F.col("im") * F.col("_s")).alias("re"), (F.col("im") * F.col("_c") - F.col("re") * F.col("_s")).alias("im")]
    a = chirped.select(*keys, "pos", *turned())
    both_ends = F.when(F.col("pos") > 0, F.array("pos", F.col("_m") - F.col("pos"))).otherwise(F.array("pos"))
    b = chirped.select(*keys, F.explode(both_ends).alias("pos"), F.col("_c").alias("re"), F.col("_s").alias("im"))
    c = convolved(a, b, rest.select(*keys, padded(F.col("n")).alias("n")), keys, block, most)
    again = c.join(rest, keys).where("pos < n").withColumns({"_c": F.cos(angle), "_s": F.sin(angle)})
    return plain.unionByName(again.select(*keys, F.col("pos").alias("k"), *turned()))


def _places(df: DataFrame, column: str, bucket: Column, spec: SeriesSpec) -> DataFrame:
    known = df.select(spec.symbol, *spec.order, F.col(column).cast("double").alias("re")).where("re is not null and not isnan(re)")
    return positioned(known, spec, bucket).select(spec.symbol, *spec.order, F.col("_pos").cast("long").alias("pos"), "re", F.lit(0.0).alias("im"))


def rfft(df: DataFrame, column: str, bucket: Column, spec: SeriesSpec = BARS, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(symbol, k, freq, re, im, amplitude) as spectral.rfft, of series of any length. Nulls are left out; bucket must not fall as time rises."""
    rows = _places(df, column, bucket, spec).drop(*spec.order)
    counted = rows.groupBy(spec.symbol).agg(F.count("*").alias("_n"))
    bins = transform(rows, [spec.symbol], block, most).join(counted, spec.symbol).where(F.col("k") <= F.floor(F.col("_n") / 2))
    return bins.select(spec.symbol, "k", (F.col("k") / F.col("_n")).alias("freq"), "re", "im", F.hypot("re", "im").alias("amplitude"))


def fft_table(df: DataFrame, column: str, bucket: Column, spec: SeriesSpec = BARS, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(symbol, k, re, im, absolute, angle) of all bins, as spectral.fft_table, of series of any length."""
    bins = transform(_places(df, column, bucket, spec).drop(*spec.order), [spec.symbol], block, most)
    return bins.select(spec.symbol, "k", "re", "im", F.hypot("re", "im").alias("absolute"), F.atan2("im", "re").alias("angle"))


def binomial_weight(k: Column, d: float) -> Column:
    """The weight of lag k of fractional differencing of order d: by its recursion first, then by the logarithm of gamma functions' quotient."""
    weights = [1.0]
    for i in range(1, FEW + 1):
        weights.append(weights[-1] * (i - 1 - d) / i)
    low, high = k.cast("double") - d, k.cast("double") + 1
    tail = lambda z: 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    log = lambda a, b: (a - 0.5) * F.log1p((a - b) / b) + (a - b) * F.ln(b) - (a - b) + tail(a) - tail(b)  # noqa: E731  ln gamma(a) - ln gamma(b)
    one = log(F.lit(FEW - d), F.lit(FEW + 1.0))
    far = F.lit(weights[-1]) * F.exp(log(low, high) - one)
    return F.when(k <= FEW, F.element_at(F.array(*map(F.lit, weights)), (F.least(k, F.lit(FEW)) + 1).cast("int"))).otherwise(far)


def fractional_difference(df: DataFrame, d: float, column: str, bucket: Column, spec: SeriesSpec = BARS, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(symbol, order ..., fracdiff): (1 - B)^d of the known values with the weights of all lags back to the first.

    One convolution by transforms, of n log n steps; stats.fractional_difference cuts the weights off at a window.
    """
    rows = _places(df, column, bucket, spec)
    values = rows.drop(*spec.order)
    sizes = values.groupBy(spec.symbol).agg(padded(F.count("*")).alias("n"))
    weights = values.withColumn("re", binomial_weight(F.col("pos"), d))
    made = convolved(values, weights, sizes, [spec.symbol], block, most).select(spec.symbol, "pos", F.col("re").alias("fracdiff"))
    return rows.join(made, [spec.symbol, "pos"]).select(spec.symbol, *spec.order, "fracdiff")
