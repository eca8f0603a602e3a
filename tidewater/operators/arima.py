"""ARIMA(1,0,1) by exact maximum likelihood over series too long for one task.

The innovations recursion of ARMA(1,1) is linear in the forecast it carries: with weights that hang on
the place alone, a stretch of values turns the incoming forecast a into alpha a + beta and adds
A a^2 + B a + C to the weighted squares. Stretches compose, so each chunk gives a few numbers for
each parameter vector tried, and a symbol's chunks are composed in order. All vectors of a Newton step are
tried in one pass over the data, its line search in another.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import delete, shared_folder
from ..series import BARS, SeriesSpec, positioned
from ..sources.files import nan_to_null
from .ticks import CHUNK, lagged_sums

SETTLED = 8192  # places after which the innovations' variance no longer changes, for |theta| < 0.995
LEAST = 20  # values of a fit
ELEMENT = ["alpha", "beta", "a", "b", "c"]
HALVINGS = 20


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of a loop's rounds, written and read again: unlike a checkpoint's, a table's size is known anew, where Spark's estimate would grow with every join of a round before."""

    def __init__(self, spark):
        self.spark, self.path, self.count = spark, f"{shared_folder(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        df.write.parquet(f"{self.path}/{self.count}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.count}")

    def done(self) -> None:
        delete(self.spark, self.path)


def weights(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The innovations' relative variances at places 0 to SETTLED - 1, a column for each parameter vector; later ones are the last."""
    r = np.empty((SETTLED, len(phi)))
    r[0] = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    for t in range(1, SETTLED):
        r[t] = 1 + theta**2 - theta**2 / r[t - 1]
    return r


def compose(one, two):
    """The element of a stretch and the one after it: each (alpha, beta, A, B, C), of numbers or arrays."""
    a1, b1, p1, q1, s1 = one
    a2, b2, p2, q2, s2 = two
    return a2 * a1, a2 * b1 + b2, p1 + p2 * a1**2, q1 + 2 * p2 * a1 * b1 + q2 * a1, s1 + p2 * b1**2 + q2 * b1 + s2


def element(x: np.ndarray, start: int, params: np.ndarray, r: np.ndarray, lane: int = 1024) -> tuple[np.ndarray, ...]:
    """The element of values x from place start on for each row (mean, phi, theta) of params, the recursion running over all lanes of the stretch at once."""
    mu, phi, theta = params.T
    n = len(x)
    lanes, steps = -(-n // lane), min(lane, n)
    state = [np.ones((lanes, len(mu))), *(np.zeros((lanes, len(mu))) for _ in range(4))]
    begins = np.arange(lanes) * lane
    for i in range(steps):
        live = lanes if begins[-1] + i < n else lanes - 1
        alpha, beta, a, b, c = (v[:live] for v in state)
        now = r[np.minimum(start + begins[:live] + i, SETTLED - 1)]
        z = x[begins[:live] + i][:, None] - mu
        e, k = z - beta, theta / now
        a += alpha**2 / now
        b -= 2 * alpha * e / now
        c += e**2 / now
        beta[:] = phi * z + k * e
        alpha *= -k
    whole = tuple(v[0] for v in state)
    for j in range(1, lanes):
        whole = compose(whole, tuple(v[j] for v in state))
    return whole


def log_variances(n: int, r: np.ndarray) -> np.ndarray:
    """The sum of the logarithms of the first n variances."""
    return np.log(r[: min(n, SETTLED)]).sum(axis=0) + max(0, n - SETTLED) * np.log(r[-1])


def in_stretches(df: DataFrame, column: str, bucket: Column, train: float, spec: SeriesSpec, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """(placed, chunks): the known values with _pos and _n, and (symbol, n, chunk, start, x array) of those to fit on, the first train of them."""
    known = nan_to_null(df.select(spec.symbol, *spec.order, F.col(column).cast("double").alias("_x"))).where("_x is not null")
    counted = known.groupBy(spec.symbol).agg(F.count("*").alias("_n"))
    placed = _cut(positioned(known, spec, bucket).join(counted, spec.symbol))
    fitted = F.floor(F.col("_n") * F.lit(train)).cast("long")
    used = placed.where(F.col("_pos") < fitted).select(spec.symbol, fitted.alias("n"), F.floor(F.col("_pos") / chunk_rows).alias("chunk"), F.struct("_pos", "_x").alias("v"))
    chunks = used.groupBy(spec.symbol, "n", "chunk").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return placed, _cut(chunks.select(spec.symbol, "n", "chunk", (F.col("chunk") * chunk_rows).alias("start"), F.transform("v", lambda v: v["_x"]).alias("x")))


def likelihoods(chunks: DataFrame, tried: DataFrame, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, nth, n, likelihood, variance, ahead) of each parameter vector tried: (symbol, params array<array<double>>) of (mean, phi, theta).

    ahead: the first forecast after the last value, less the mean.
    """
    kind = dict(chunks.dtypes)[spec.symbol]
    columns = [spec.symbol, "n", "chunk", "nth", *ELEMENT, "logs"]

    def add(frames):
        for frame in frames:
            for symbol, n, chunk, start, x, params in frame[[spec.symbol, "n", "chunk", "start", "x", "params"]].itertuples(index=False):
                p = np.stack(params)
                r = weights(p[:, 1], p[:, 2])
                made = element(np.asarray(x, dtype=float), int(start), p, r)
                logs = log_variances(int(n), r) if chunk == 0 else np.zeros(len(p))
                yield pd.DataFrame(dict(zip(columns, (symbol, n, chunk, np.arange(len(p)), *made, logs), strict=True)))

    numbers = ", ".join(f"{c} double" for c in ELEMENT)
    parts = chunks.join(tried, spec.symbol).mapInPandas(add, f"{spec.symbol} {kind}, n long, chunk long, nth int, {numbers}, logs double")

    def finish(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        whole, n = None, int(group["n"].iloc[0])
        for row in group.sort_values("chunk")[ELEMENT].itertuples(index=False):
            whole = tuple(row) if whole is None else compose(whole, tuple(row))
        variance = max(whole[4] / n, 1e-300)  # the recursion begins at a forecast of the mean
        value = -0.5 * (n * (math.log(2 * math.pi * variance) + 1) + group["logs"].sum())
        return pd.DataFrame({spec.symbol: [key[0]], "nth": [key[1]], "n": [n], "likelihood": [value], "variance": [variance], "ahead": [whole[1]]})

    return parts.groupBy(spec.symbol, "nth").applyInPandas(finish, f"{spec.symbol} {kind}, nth int, n long, likelihood double, variance double, ahead double")


def moment_estimate(sums: DataFrame, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, mean, scale, phi, theta): of autocorrelations 1 and 2, each kept within 0.9. sums: (symbol, mean, xx array) of products at lags 0 to 2, and n."""
    rho = lambda k: F.get("xx", k) / F.nullif(F.get("xx", 0), F.lit(0.0))
    held = lambda c: F.greatest(F.lit(-0.9), F.least(F.lit(0.9), c))
    phi = held(F.coalesce(rho(2) / F.nullif(rho(1), F.lit(0.0)), F.lit(0.0)))
    some = sums.select(spec.symbol, "mean", F.sqrt(F.get("xx", 0) / F.col("n")).alias("scale"), rho(1).alias("_r"), phi.alias("phi"))
    # theta^2 (phi - r) + theta (1 + phi^2 - 2 phi r) + (phi - r) = 0, the root inside the unit circle
    a, b = F.col("phi") - F.col("_r"), 1 + F.col("phi") ** 2 - 2 * F.col("phi") * F.col("_r")
    root = -2 * a / (b + F.signum(b) * F.sqrt(F.greatest(F.lit(0.0), b**2 - 4 * a**2)))
    return some.select(spec.symbol, "mean", "scale", "phi", held(F.coalesce(root, F.lit(0.0))).alias("theta"))


BASIS = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def _around(p: np.ndarray, step: np.ndarray) -> np.ndarray:
    """p, and the points about it from which slopes and bends are taken."""
    e = np.diag(step)
    points = [p, *(p + s * e[i] for i in range(3) for s in (1, -1))]
    points += [p + s * e[i] + t * e[j] for i in range(3) for j in range(i) for s in (1, -1) for t in (1, -1)]
    return np.stack(points)


def _slopes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, bends) in units of the step, from the likelihoods of _around's points."""
    up, down = v[1:7:2], v[2:7:2]
    bend, at = np.diag(up - 2 * v[0] + down), 7
    for i in range(3):
        for j in range(i):
            bend[i, j] = bend[j, i] = (v[at] - v[at + 1] - v[at + 2] + v[at + 3]) / 4
            at += 4
    return (up - down) / 2, bend


STATE = "params array<array<double>>, center array<double>, step array<double>, done boolean, errors array<double>"


def fit(chunks: DataFrame, start: DataFrame, rounds: int = 20, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, params, center, errors ...): the most likely (mean, phi, theta) of each symbol, as center, and its standard errors.

    start: moment_estimate's rows. A round is two passes over the chunks for all symbols together;
    only whether any symbol still gains is asked by the driver.
    """
    kind = dict(start.dtypes)[spec.symbol]

    def begin(frames):
        for f in frames:
            rows = []
            for symbol, mean, scale, phi, theta in f[[spec.symbol, "mean", "scale", "phi", "theta"]].itertuples(index=False):
                p, step = np.array([mean, phi, theta]), np.array([1e-3 * max(scale, 1e-9), 1e-4, 1e-4])
                rows.append((symbol, list(_around(p, step)), p, step, False, np.zeros(3)))
            yield pd.DataFrame(rows, columns=[spec.symbol, "params", "center", "step", "done", "errors"])

    schema = f"{spec.symbol} {kind}, {STATE}"
    kept = Rounds(chunks.sparkSession)
    state = kept(start.mapInPandas(begin, schema))

    def change(make):
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("nth")
            first = group.iloc[0]
            step = np.asarray(first["step"])
            params, center, done, errors = make(np.stack(first["params"]), np.asarray(first["center"]), step, group["likelihood"].to_numpy())
            return pd.DataFrame([(key[0], list(params), center, step, done, errors)], columns=[spec.symbol, "params", "center", "step", "done", "errors"])

        return run

    def ahead(points, p, step, values):
        """Newton's move and its halves; where the likelihood isn't concave, directions are turned uphill."""
        gradient, bend = _slopes(values)
        sizes, directions = np.linalg.eigh(-bend)
        move = directions @ ((directions.T @ gradient) / np.maximum(np.abs(sizes), 1e-9)) * step
        errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(-bend)), 0.0)) * step
        trials = p + move * 0.5 ** np.arange(HALVINGS)[:, None]
        trials[:, 1:] = np.where(np.abs(trials[:, 1:]).max(axis=1, keepdims=True) < 0.995, trials[:, 1:], p[1:])
        return np.vstack([p, trials]), p, False, errors

    def pick(points, p, step, values):
        """The first that gains; nothing gained to speak of ends the search."""
        better = np.flatnonzero(values[1:] > values[0])
        best = points[better[0] + 1] if len(better) else p
        done = not len(better) or values[better[0] + 1] - values[0] < 1e-9 * max(1.0, abs(values[0]))
        return _around(best, step), best, bool(done), np.zeros(3)

    def tried(now: DataFrame, make) -> DataFrame:
        values = likelihoods(chunks, now.select(spec.symbol, "params"), spec).join(now, spec.symbol)
        return kept(values.groupBy(spec.symbol).applyInPandas(change(make), schema))

    finished = []
    for _ in range(rounds):
        finished.append(state.where("done"))
        state = state.where("not done")
        if state.isEmpty():
            break
        state = tried(tried(state, ahead), pick)
    else:
        finished.append(state)
    settled = finished[0]
    for part in finished[1:]:
        settled = settled.unionByName(part)
    found = _cut(tried(settled, ahead).select(spec.symbol, "center", "errors"))
    kept.done()
    return found


def fitted(df: DataFrame, column: str, bucket: Column, train: float = 0.8, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, chunks, fits): see in_stretches; fits: (symbol, n, mean, phi, theta, errors, likelihood, variance, ahead)."""
    placed, chunks = in_stretches(df, column, bucket, train, spec, chunk_rows)
    start = moments(placed, train, spec, bucket, chunk_rows)
    found = fit(chunks, moment_estimate(start, spec), spec=spec)
    told = likelihoods(chunks, found.select(spec.symbol, F.array("center").alias("params")), spec).drop("nth").join(found, spec.symbol)
    return placed, chunks, _cut(told.select(spec.symbol, "n", *(F.get("center", i).alias(c) for i, c in enumerate(("mean", "phi", "theta"))), "errors", "likelihood", "variance", "ahead"))


def moments(placed: DataFrame, train: float, spec: SeriesSpec, bucket: Column, chunk_rows: int) -> DataFrame:
    """(symbol, n, mean, xx array) over the values to fit on; series of fewer than LEAST values, and constant ones, are left out."""
    used = placed.where(F.col("_pos") < F.floor(F.col("_n") * F.lit(train)))
    base = used.groupBy(spec.symbol).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), F.min("_x").alias("_low"), F.max("_x").alias("_high")).where(f"n >= {LEAST} and _low < _high")
    centred = used.join(base.select(spec.symbol, "mean"), spec.symbol).select(spec.symbol, *spec.order, (F.col("_x") - F.col("mean")).alias("_x"))
    sums = lagged_sums(centred, 2, bucket, spec, chunk_rows).groupBy(spec.symbol).agg(F.array_sort(F.collect_list(F.struct("k", "xx"))).alias("s"))
    return base.join(sums, spec.symbol).select(spec.symbol, "n", "mean", F.transform("s", lambda v: v["xx"]).alias("xx"))


def arima(df: DataFrame, column: str, bucket: Column, train: float = 0.8, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK) -> DataFrame:
    """(symbol, order ..., truth, predicted, low, high, mean, phi, theta) of the rows after train, as forecast.arima, of series of any length."""
    placed, _, fits = fitted(df, column, bucket, train, spec, chunk_rows)
    rows = placed.where(F.col("_pos") >= F.floor(F.col("_n") * F.lit(train))).join(fits, spec.symbol)
    h = (F.col("_pos") - F.col("n")).cast("double")
    square = F.col("phi") ** 2
    grown = F.when(F.abs(1 - square) < 1e-12, h).otherwise((1 - F.pow(square, h)) / (1 - square))
    spread = 1.959963984540054 * F.sqrt(F.col("variance") * (1 + (F.col("phi") + F.col("theta")) ** 2 * grown))
    predicted = F.col("mean") + F.pow("phi", h) * F.col("ahead")
    return rows.select(spec.symbol, *spec.order, F.col("_x").alias("truth"), predicted.alias("predicted"), (predicted - spread).alias("low"), (predicted + spread).alias("high"), "mean", "phi", "theta")


def arima_summary(df: DataFrame, column: str, bucket: Column, train: float = 0.8, spec: SeriesSpec = BARS, chunk_rows: int = CHUNK) -> DataFrame:
    """(symbol, term, estimate, std_error, z, log_likelihood, aic, bic, n), as forecast.arima_summary, of series of any length."""
    fits = fitted(df, column, bucket, train, spec, chunk_rows)[2]
    terms = [F.struct(F.lit(c).alias("term"), F.col(c).alias("estimate"), F.get("errors", i).alias("std_error")) for i, c in enumerate(("mean", "phi", "theta"))]
    terms.append(F.struct(F.lit("sigma2").alias("term"), F.col("variance").alias("estimate"), (F.col("variance") * F.sqrt(2 / F.col("n"))).alias("std_error")))
    rows = fits.select(spec.symbol, F.explode(F.array(*terms)).alias("t"), "likelihood", "n")
    return rows.select(spec.symbol, "t.*", (F.col("t.estimate") / F.col("t.std_error")).alias("z"), F.col("likelihood").alias("log_likelihood"), (8 - 2 * F.col("likelihood")).alias("aic"), (4 * F.ln("n") - 2 * F.col("likelihood")).alias("bic"), "n")
