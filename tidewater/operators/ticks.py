"""Operators over series too long for one task, such as ticks.

A series is cut into chunks of chunk_rows rows. What a row needs of its neighbours is sent along (a halo),
what it needs of all rows before is carried as one small row a chunk, and what a test needs of
the whole series is a sum of what chunks add. So no task holds a symbol, and each result is that
of the one-task form. bucket, a truncated time, must not fall as time rises, see series.positioned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import BARS, CHUNK, SeriesSpec, chunked, positioned
from ..sources.files import nan_to_null
from .stats import KPSS_CRITICAL, adf_columns, banded, kpss_lags, partial, result_columns


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def rolling_median(df: DataFrame, window: int, column: str, bucket: Column, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK, name: str = "rolling_median") -> DataFrame:
    """name: the median of the known values within the centred window (one more row before if it is even), null if none is known.

    Inside a chunk the window slides over a ranked list, so a row costs the logarithm of the window and not a sort.
    """
    copied = chunked(df, spec, bucket, chunk_rows, window // 2, (window - 1) // 2)
    names = [*df.columns, name]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_pos")
        group[name] = group[column].astype("float64").rolling(window, center=True, min_periods=1).median()
        return group.loc[group["_at"] == group["_chunk"], names]

    made = copied.groupBy(spec.symbol, "_at").applyInPandas(run, f"{_fields(df)}, {name} double")
    return made.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def _carried(placed: DataFrame, columns: list[str], spec: SeriesSpec, forward: bool) -> DataFrame:
    """(symbol, _chunk, column ...): of each chunk the last known value before it, or the first after it."""
    best = F.max_by if forward else F.min_by
    ends = placed.groupBy(spec.symbol, "_chunk").agg(*(best(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(c) for c in columns))
    order = F.col("_chunk") if forward else F.col("_chunk").desc()
    beyond = Window.partitionBy(spec.symbol).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(spec.symbol, "_chunk", *(F.last(c, True).over(beyond).alias(f"_{c}") for c in columns))


def _fill(placed: DataFrame, columns: list[str], spec: SeriesSpec, forward: bool, names: list[str]) -> DataFrame:
    order = F.col("_pos") if forward else F.col("_pos").desc()
    inside = Window.partitionBy(spec.symbol, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    near = placed.withColumns({f"_near_{c}": F.last(c, True).over(inside) for c in columns})
    joined = near.join(_carried(placed, columns, spec, forward), [spec.symbol, "_chunk"], "left")
    return joined.withColumns({n: F.coalesce(f"_near_{c}", f"_{c}") for n, c in zip(names, columns, strict=True)}).drop(*(f"_near_{c}" for c in columns), *(f"_{c}" for c in columns))


def _placed(df: DataFrame, bucket: Column, spec: SeriesSpec, chunk_rows: int) -> DataFrame:
    return positioned(df, spec, bucket).withColumn("_chunk", F.floor(F.col("_pos") / chunk_rows))


def ffill(df: DataFrame, columns: list[str], bucket: Column, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK) -> DataFrame:
    """Each null becomes the last known value of its symbol, however far back; leading nulls stay."""
    return _fill(_placed(df, bucket, spec, chunk_rows), columns, spec, True, columns).select(*df.columns)


def bfill(df: DataFrame, columns: list[str], bucket: Column, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK) -> DataFrame:
    """Each null becomes the next known value of its symbol, however far on; trailing nulls stay."""
    return _fill(_placed(df, bucket, spec, chunk_rows), columns, spec, False, columns).select(*df.columns)


def impute(df: DataFrame, columns: list[str], bucket: Column, window: int = 5, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK) -> DataFrame:
    """The next known value, and for trailing nulls the median of the known values within the centred window of the column as it was.

    One pass over the chunks, with a halo for the medians, for all columns; what is known beyond a chunk is joined to it.
    """
    copied = chunked(df, spec, bucket, chunk_rows, window // 2, (window - 1) // 2)
    near, median = [f"_near_{c}" for c in columns], [f"_median_{c}" for c in columns]
    names = [*df.columns, "_chunk", *near, *median]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_pos")
        for c, m in zip(columns, median, strict=True):
            group[m] = group[c].astype("float64").rolling(window, center=True, min_periods=1).median()
        own = group[group["_at"] == group["_chunk"]].copy()
        for c, n in zip(columns, near, strict=True):
            own[n] = own[c].astype("float64").bfill()
        return own[names]

    made = copied.groupBy(spec.symbol, "_at").applyInPandas(run, f"{_fields(df)}, _chunk long, {', '.join(f'`{c}` double' for c in near + median)}")
    carried = _carried(_placed(df.select(spec.symbol, *spec.order, *columns), bucket, spec, chunk_rows), columns, spec, False)
    joined = made.join(carried, [spec.symbol, "_chunk"], "left")
    return nan_to_null(joined.withColumns({c: F.coalesce(*(F.nanvl(F.col(x), F.lit(None).cast("double")) for x in (f"_near_{c}", f"_{c}", f"_median_{c}"))) for c in columns}).select(*df.columns))


# Stationarity tests from sums


def _known(df: DataFrame, column: str, spec: SeriesSpec) -> DataFrame:
    """(symbol, order ..., _x): the known values, less their symbol's mean, which leaves both tests as they are and their sums exact."""
    known = nan_to_null(df.select(spec.symbol, *spec.order, F.col(column).cast("double").alias("_x"))).where("_x is not null")
    means = known.groupBy(spec.symbol).agg(F.avg("_x").alias("_mean"))
    return known.join(means, spec.symbol).withColumn("_x", F.col("_x") - F.col("_mean")).drop("_mean")


def lagged_sums(known: DataFrame, most: int, bucket: Column, spec: SeriesSpec, chunk_rows: int = CHUNK) -> DataFrame:
    """(symbol, k, xx, dd, xd): sums over a series x and its steps d[s] = x[s + 1] - x[s] of x[s] x[s - k], d[s] d[s - k] and x[s] d[s - k], for k from 0 to most.

    A chunk adds the products whose later factor ends in it, so it needs most + 1 rows before it. In xd the last x is left out.
    """
    kind = dict(known.dtypes)[spec.symbol]
    copied = chunked(known, spec, bucket, max(chunk_rows, most + 1), most + 1).select(spec.symbol, "_at", "_chunk", "_pos", "_x")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_pos")
        x, f = group["_x"].to_numpy(), int((group["_at"] != group["_chunk"]).sum())
        d, n = np.diff(x), len(x)
        out = {"xx": [], "dd": [], "xd": []}
        for k in range(most + 1):
            a, b = max(f, k), max(f - 1, k)
            out["xx"].append(x[a:] @ x[a - k : n - k] if a < n else 0.0)
            out["dd"].append(d[b:] @ d[b - k : n - 1 - k] if b < n - 1 else 0.0)
            out["xd"].append(x[b : n - 1] @ d[b - k : n - 1 - k] if b < n - 1 else 0.0)
        return pd.DataFrame({spec.symbol: group[spec.symbol].iloc[0], "k": range(most + 1), **out})

    sums = copied.groupBy(spec.symbol, "_at").applyInPandas(run, f"{spec.symbol} {kind}, k int, xx double, dd double, xd double")
    return sums.groupBy(spec.symbol, "k").agg(*(F.sum(c).alias(c) for c in ("xx", "dd", "xd")))


def _autocorrelations(df: DataFrame, lags: int, column: str, bucket: Column, spec: SeriesSpec, chunk_rows: int) -> DataFrame:
    known = _known(df, column, spec)
    counted = known.groupBy(spec.symbol).agg(F.count("*").alias("n"))
    sums = lagged_sums(known, lags, bucket, spec, chunk_rows)
    whole = sums.where("k = 0").select(spec.symbol, F.nullif("xx", F.lit(0.0)).alias("_0"))
    return sums.join(whole, spec.symbol).join(counted, spec.symbol).select(spec.symbol, "n", F.col("k").alias("lag"), (F.col("xx") / F.col("_0")).alias("acf"))


def acf(df: DataFrame, lags: int, column: str, bucket: Column, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK) -> DataFrame:
    """(symbol, lag, acf, low, high) as stats.acf, from lagged sums of chunks."""
    return banded(_autocorrelations(df, lags, column, bucket, spec, chunk_rows), spec)


def pacf(df: DataFrame, lags: int, column: str, bucket: Column, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK) -> DataFrame:
    """(symbol, lag, pacf, low, high) as stats.pacf, from lagged sums of chunks."""
    return partial(_autocorrelations(df, lags, column, bucket, spec, chunk_rows).where("acf is not null"), spec)


def detrend(df: DataFrame, column: str, bucket: Column, spec: SeriesSpec = BARS) -> DataFrame:
    """df with the residual of a least-squares line over row positions, as features.detrend: the line is a sum over all rows, joined back by symbol."""
    placed = positioned(df, spec, bucket).withColumn("_pos", F.col("_pos").cast("double"))
    line = placed.groupBy(spec.symbol).agg(F.regr_intercept(column, "_pos").alias("_intercept"), F.regr_slope(column, "_pos").alias("_slope"))
    rest = F.col(column) - (F.col("_intercept") + F.col("_slope") * F.col("_pos"))
    return placed.join(line, spec.symbol).withColumn(f"{column}_detrend", rest).drop("_pos", "_intercept", "_slope")


def most_lags(n: Column, max_lag: int | None) -> Column:
    """How many lags the ADF test tries of a series of n values."""
    wanted = F.ceil(12 * (n / 100) ** 0.25) if max_lag is None else F.lit(max_lag)
    return F.least(wanted, F.floor(n / 2) - 2).cast("int")


def adf_from_sums(n: int, most: int, dd: np.ndarray, xd: np.ndarray, x_sum: float, xx: float, head: np.ndarray, tail: np.ndarray) -> tuple[float, int, int]:
    """(statistic, lags, observations) of stats.adf_statistic, from lagged sums over the series and its first and last most + 1 values.

    The regression of d[s] on a constant, x[s] and d[s - 1] ... d[s - p] over s from p on has moments that
    differ from the sums only at both ends; going one lag on in both factors drops one product and adds one.
    """
    m = n - 1  # steps
    dh, dt = np.diff(head), np.diff(tail)
    end = lambda i: dt[len(dt) - i]  # noqa: E731  d[m - i]

    def moments(p: int) -> np.ndarray:
        """Of (constant, x, d_1 ... d_p, d_0)."""
        g = np.zeros((p + 1, p + 1))  # d_i d_j
        for k in range(p + 1):
            g[k, 0] = dd[k] - dh[k:p] @ dh[: max(p - k, 0)]
            for i in range(k + 1, p + 1):
                j = i - k
                g[i, j] = g[i - 1, j - 1] + dh[p - i] * dh[p - j] - end(i) * end(j)
        g = np.tril(g) + np.tril(g, -1).T
        of_x = np.array([xd[i] - head[i:p] @ dh[: max(p - i, 0)] for i in range(p + 1)])
        of_one = np.array([tail[len(tail) - 1 - i] - head[p - i] for i in range(p + 1)])
        full = np.zeros((p + 3, p + 3))
        order = [*range(1, p + 1), 0]
        full[2:, 2:] = g[np.ix_(order, order)]
        full[0, 0], full[0, 1], full[1, 1] = m - p, x_sum - tail[-1] - head[:p].sum(), xx - tail[-1] ** 2 - head[:p] @ head[:p]
        full[0, 2:], full[1, 2:] = of_one[order], of_x[order]
        return np.triu(full) + np.triu(full, 1).T

    # The loss of all numbers of lags on one sample, from one triangular factor.
    g = moments(most)
    factor = _factor(g)
    squares = factor[-1, :-1] ** 2
    loss = g[-1, -1] - np.cumsum(squares)
    obs = m - most
    scores = [obs * math.log(max(loss[q + 1], 1e-300) / obs) + 2 * (q + 2) for q in range(most + 1)]
    lags = int(np.argmin(scores))
    g = moments(lags)
    inverse = np.linalg.pinv(g[:-1, :-1], hermitian=True)
    beta = inverse @ g[:-1, -1]
    rest, obs = g[-1, -1] - beta @ g[:-1, -1], m - lags
    return float(beta[1] / math.sqrt(max(rest, 1e-300) / (obs - lags - 2) * inverse[1, 1])), lags, obs


def _factor(g: np.ndarray) -> np.ndarray:
    """A lower triangular factor of g, where a column that others already give adds nothing."""
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    a, n = g / np.outer(scale, scale), len(g)
    out = np.zeros_like(a)
    for j in range(n):
        pivot = a[j, j] - out[j, :j] @ out[j, :j]
        if pivot > 1e-13:
            out[j:, j] = (a[j:, j] - out[j:, :j] @ out[j, :j]) / math.sqrt(pivot)
    return out * scale[:, None]


def adf(df: DataFrame, column: str, bucket: Column, least: int = 20, max_lag: int | None = None, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK) -> DataFrame:
    """The columns of stats.stationarity by the ADF test: lags by AIC, all regressions from one pass of lagged sums and one small solve a symbol."""
    known = _known(df, column, spec)
    ends = known.groupBy(spec.symbol).agg(F.count("*").alias("n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    ends = ends.withColumn("_most", most_lags(F.col("n"), max_lag))
    most = max(ends.agg(F.max("_most")).first()[0] or 0, 0)
    kind = dict(df.dtypes)[spec.symbol]
    sums = lagged_sums(known, most, bucket, spec, chunk_rows).groupBy(spec.symbol).agg(F.array_sort(F.collect_list(F.struct("k", "dd", "xd", "xx"))).alias("_sums"))
    placed = positioned(known, spec, bucket).join(ends.select(spec.symbol, "n", "_most"), spec.symbol)
    near = placed.where((F.col("_pos") <= F.col("_most")) | (F.col("_pos") >= F.col("n") - 1 - F.col("_most")))
    side = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("_pos", "_x")))), lambda v: v["_x"])
    few = near.groupBy(spec.symbol).agg(side(F.col("_pos") <= F.col("_most")).alias("_head"), side(F.col("_pos") >= F.col("n") - 1 - F.col("_most")).alias("_tail"))
    given = ends.join(sums, spec.symbol).join(few, spec.symbol)

    def solve(frames):
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                row = {spec.symbol: r[spec.symbol], "test": "adf", "series": column, **dict.fromkeys(result_columns), "n": r["n"]}
                if r["n"] >= least and r["_low"] < r["_high"]:
                    dd, xd = (np.array([s[c] for s in r["_sums"]]) for c in ("dd", "xd"))
                    t, lags, obs = adf_from_sums(int(r["n"]), int(r["_most"]), dd, xd, 0.0, r["_sums"][0]["xx"], np.array(r["_head"], dtype=float), np.array(r["_tail"], dtype=float))
                    row |= adf_columns(t, lags, obs)
                rows.append(row)
            yield pd.DataFrame(rows, columns=[spec.symbol, "test", "series", *result_columns])

    return given.mapInPandas(solve, f"{spec.symbol} {kind}, test string, series string, {', '.join(f'{c} {t}' for c, t in result_columns.items())}")


def kpss(df: DataFrame, column: str, bucket: Column, least: int = 20, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK) -> DataFrame:
    """The columns of stats.stationarity by the KPSS test: lagged products in chunks, and squares of partial sums from what each chunk adds.

    A chunk of m values before which the sum is p adds m p^2 + 2 p (sum of its partial sums) + (sum of their
    squares). Lags are found from the first n^(2/9) products; as many as the test then asks are summed once more.
    """
    known = _known(df, column, spec)
    base = known.groupBy(spec.symbol).agg(F.count("*").alias("n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    largest = base.agg(F.max("n")).first()[0] or 0
    first = lagged_sums(known, int(largest ** (2 / 9)), bucket, spec, chunk_rows).join(base.select(spec.symbol, "n"), spec.symbol)
    auto = kpss_lags(first, spec.symbol)
    most = auto.agg(F.max("lags")).first()[0] or 0
    products = lagged_sums(known, most, bucket, spec, chunk_rows).join(auto, spec.symbol).where("k <= lags")
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (F.col("lags") + 1)))
    variance = products.groupBy(spec.symbol, "lags").agg(F.sum(weight * F.col("xx")).alias("_v"))

    inside = Window.partitionBy(spec.symbol, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = _placed(known, bucket, spec, chunk_rows).withColumn("_s", F.sum("_x").over(inside))
    chunks = parts.groupBy(spec.symbol, "_chunk").agg(F.count("*").alias("m"), F.sum("_x").alias("total"), F.sum("_s").alias("one"), F.sum(F.col("_s") ** 2).alias("two"))
    before = Window.partitionBy(spec.symbol).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    p = F.coalesce(F.sum("total").over(before), F.lit(0.0))
    added = chunks.withColumn("p", p).select(spec.symbol, (F.col("m") * F.col("p") ** 2 + 2 * F.col("p") * F.col("one") + F.col("two")).alias("q"))
    squares = added.groupBy(spec.symbol).agg(F.sum("q").alias("_q"))

    rows = base.join(variance, spec.symbol).join(squares, spec.symbol)
    enough = (F.col("n") >= least) & (F.col("_low") < F.col("_high"))
    n = F.col("n").cast("double")
    stat = F.when(enough, F.col("_q") / n / F.nullif("_v", F.lit(0.0)))
    made = rows.select(spec.symbol, "n", "lags", stat.alias("statistic"))
    (a, _), *_, (z, _) = KPSS_CRITICAL
    steps = [(lo, hi, p0, p1) for (lo, p0), (hi, p1) in zip(KPSS_CRITICAL, KPSS_CRITICAL[1:], strict=False)]
    s = F.col("statistic")
    p_value = F.when(s <= a, KPSS_CRITICAL[0][1]).when(s >= z, KPSS_CRITICAL[-1][1])
    for lo, hi, p0, p1 in steps:
        p_value = p_value.when(s < hi, p0 + (s - lo) * ((p1 - p0) / (hi - lo)))
    known_stat = s.isNotNull()
    critical = {"crit_1": 0.739, "crit_5": 0.463, "crit_10": 0.347}
    out = made.withColumn("p_value", F.when(known_stat, p_value)).withColumns({"test": F.lit("kpss"), "series": F.lit(column), "lags": F.when(known_stat, F.col("lags").cast("long")), "stationary": F.when(known_stat, F.col("p_value") >= 0.05), **{k: F.when(known_stat, F.lit(v)) for k, v in critical.items()}})
    return out.select(spec.symbol, "test", "series", *result_columns)
