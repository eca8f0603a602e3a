"""Forecasters over windows, their scores, and the grid of symbols by models.

The linear model is fitted for each symbol from sums that tasks take over their own windows; its
coefficients are a table and predictions a join. Boosted trees, fitted by Spark's own library over
the windows of all symbols, stand for the models that learn bends, with early stopping on the
validation windows. Nothing of a symbol passes the driver.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import BARS, SeriesSpec
from . import prepare

SMALLEST = 2.220446049250313e-16  # truth nearer to zero counts as this in MAPE


def naive(df: DataFrame, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """predicted: the value before."""
    return df.withColumn("predicted", F.lag(column, 1).over(spec.window()))


def score(df: DataFrame, keys: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """MSE, RMSE, MAE and MAPE (a fraction) by keys, over rows where both are known."""
    error = F.col(truth) - F.col(predicted)
    known = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    sums = known.groupBy(*keys).agg(F.avg(error**2).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.avg(F.abs(error) / F.greatest(F.abs(truth), F.lit(SMALLEST))).alias("mape"))
    return sums.select(*keys, "mse", F.sqrt("mse").alias("rmse"), "mae", "mape")


def pivot_scores(scores: DataFrame, symbols: list[str], metric: str = "mae", spec: SeriesSpec = BARS) -> DataFrame:
    """A row for each model, a column for each symbol."""
    return scores.groupBy("model").pivot(spec.symbol, symbols).agg(F.first(metric))


def model_windows(df: DataFrame, columns: list[str], label: str = "close", steps: int = 5, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, time, split, x, y, raw, mean, std): standardised windows that don't cross splits.

    x: steps times the scaled columns and the weekday's sine and cosine, as array<float>; y: the
    scaled label; raw: the label itself. Windows with a missing value are left out.
    """
    scaled = prepare.standardise(prepare.with_cyclic_weekday(prepare.split3(df, spec=spec), spec), columns, spec)
    inputs = [*(f"z_{c}" for c in columns), "sin_date", "cos_date"]
    made = prepare.sequences(scaled.withColumn("_y", F.struct(F.col(f"z_{label}").alias("z"), F.col(label).alias("raw"))), inputs, "_y", steps, True, spec)
    flat = F.flatten(F.transform("window", lambda w: F.array(*(w[c].cast("float") for c in inputs))))
    rows = made.select(spec.symbol, *spec.order, "split", flat.alias("x"), F.col("label.z").alias("y"), F.col("label.raw").alias("raw"))
    return rows.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))


def fit_linear(windows: DataFrame, ridge: float = 1e-3, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, coefficients array<double>): least squares over each symbol's train windows, the intercept last.

    Each task adds up the normal equations of its windows; a symbol's few sums meet in one group,
    which solves them.
    """
    kind = dict(windows.dtypes)[spec.symbol]

    def add(frames):
        sums: dict = {}
        for frame in frames:
            for symbol, part in frame.groupby(spec.symbol):
                a = np.column_stack([np.stack(part["x"].to_numpy()).astype(np.float64), np.ones(len(part)), part["y"].to_numpy(dtype=np.float64)])
                sums[symbol] = a.T @ a + sums.get(symbol, 0.0)
        for symbol, v in sums.items():
            yield pd.DataFrame({spec.symbol: [symbol], "v": [v.ravel()]})

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        v = np.sum(np.stack(group["v"].to_numpy()), axis=0)
        g = v.reshape(math.isqrt(len(v)), -1)
        found = np.linalg.solve(g[:-1, :-1] + ridge * np.eye(len(g) - 1), g[:-1, -1])
        return pd.DataFrame({spec.symbol: group[spec.symbol].iloc[:1], "coefficients": [found]})

    train = windows.where("split = 'train'").select(spec.symbol, "x", "y")
    return train.mapInPandas(add, f"{spec.symbol} {kind}, v array<double>").groupBy(spec.symbol).applyInPandas(solve, f"{spec.symbol} {kind}, coefficients array<double>")


def predict_linear(windows: DataFrame, fitted: DataFrame, source: str | None = None, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, time, model, truth, predicted) of test windows. source: the symbol whose coefficients serve all (transfer); else each its own."""
    test = windows.where("split = 'test'")
    if source is None:
        test = test.join(fitted, spec.symbol)
    else:
        test = test.withColumn("coefficients", fitted.where(F.col(spec.symbol) == source).select("coefficients").scalar())
    products = F.zip_with("x", F.slice("coefficients", F.lit(1), F.size("x")), lambda a, b: a * b)
    predicted = F.aggregate(products, F.element_at("coefficients", -1), lambda s, v: s + v)
    return test.select(spec.symbol, spec.time, F.lit("linear").alias("model"), F.col("y").alias("truth"), predicted.alias("predicted"))


@dataclass
class Trees:
    """Boosted trees, (round, loss, val_loss) of their training, and its seconds."""

    model: object
    history: list[tuple[int, float, float | None]]
    seconds: float


def fit_trees(windows: DataFrame, rounds: int = 20, depth: int = 4, rate: float = 0.2, seed: int = 7) -> Trees:
    """Boosted trees over the train windows of all symbols; ends early where the validation windows gain no more."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    known = windows.where("split <> 'test'").select(array_to_vector(F.col("x").cast("array<double>")).alias("features"), F.col("y").alias("label"), (F.col("split") == "val").alias("held"))
    known = known.persist()
    try:
        held = known.where("held")
        some = not held.isEmpty()
        made = GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, checkpointInterval=-1, **({"validationIndicatorCol": "held"} if some else {}))
        began = time.perf_counter()
        model = made.fit(known)
        seconds = time.perf_counter() - began
        losses = model.evaluateEachIteration(known.where("not held"), "squared")
        held_losses = model.evaluateEachIteration(held, "squared") if some else [None] * len(losses)
        return Trees(model, [(i + 1, a, b) for i, (a, b) in enumerate(zip(losses, held_losses, strict=True))], seconds)
    finally:
        known.unpersist()


def predict_trees(windows: DataFrame, fitted: Trees, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, time, model, truth, predicted) of test windows."""
    from pyspark.ml.functions import array_to_vector

    test = windows.where("split = 'test'").withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
    return fitted.model.transform(test).select(spec.symbol, spec.time, F.lit("trees").alias("model"), F.col("y").alias("truth"), F.col("prediction").alias("predicted"))


def training_history(spark, fitted: Trees) -> DataFrame:
    """(round, loss, val_loss, seconds): the loss curves, and the seconds of the whole training."""
    return spark.createDataFrame([(*row, fitted.seconds) for row in fitted.history], "round int, loss double, val_loss double, seconds double")


def naive_scaled(df: DataFrame, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """The naive forecast in the scaled units of the models: (symbol, time, model, truth, predicted) of test rows."""
    scaled = prepare.standardise(prepare.split3(df, spec=spec), [column], spec)
    rows = naive(scaled, f"z_{column}", spec).where("split = 'test'")
    return rows.select(spec.symbol, spec.time, F.lit("naive").alias("model"), F.col(f"z_{column}").alias("truth"), "predicted")


MODELS = ("linear", "trees")


def _predictions(windows: DataFrame, fit_on: DataFrame, models: tuple[str, ...], source: str | None, spec: SeriesSpec) -> DataFrame:
    """Predictions of test windows by each of models fitted on fit_on."""
    parts = []
    for model in models:
        if model not in MODELS:
            raise ValueError(f"no model {model!r}")
        parts.append(predict_linear(windows, fit_linear(fit_on, spec=spec), source, spec) if model == "linear" else predict_trees(windows, fit_trees(fit_on), spec))
    return reduce(DataFrame.unionByName, parts)


def grid(df: DataFrame, columns: list[str], models: tuple[str, ...] = MODELS, spec: SeriesSpec = BARS) -> DataFrame:
    """Scores of every symbol and model, naive and those of models. All in scaled units."""
    windows = model_windows(df, columns, spec=spec)
    rows = naive_scaled(df, spec=spec).unionByName(_predictions(windows, windows, models, None, spec))
    return score(rows, [spec.symbol, "model"])


def transfer(df: DataFrame, columns: list[str], source: str, models: tuple[str, ...] = MODELS, spec: SeriesSpec = BARS) -> DataFrame:
    """Scores, on the other symbols' test windows, of the models fitted on one symbol."""
    windows = model_windows(df, columns, spec=spec)
    own, others = windows.where(F.col(spec.symbol) == source), windows.where(F.col(spec.symbol) != source)
    return score(_predictions(others, own, models, source, spec), [spec.symbol, "model"])


# ARIMA


def arma_likelihood(y: np.ndarray, p: np.ndarray) -> tuple[float, float, float, float]:
    """(log-likelihood, variance, last innovation, its weight) of ARMA(1,1) with mean: exact, by the innovations recursion.

    p: mean, phi, theta; the variance is the one that makes the likelihood largest.
    """
    mu, phi, theta = p
    z = (y - mu).tolist()
    r = (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)
    ahead = squares = logs = e = 0.0
    for x in z:
        e = x - ahead
        squares += e * e / r
        logs += math.log(r)
        weight = theta / r
        ahead = phi * x + weight * e
        r = 1 + theta * theta - theta * weight
    n = len(z)
    variance = max(squares / n, 1e-300)
    return -0.5 * (n * (math.log(2 * math.pi * variance) + 1) + logs), variance, e, weight


def _begin(y: np.ndarray) -> np.ndarray:
    """Hannan and Rissanen's estimate: a regression on the value and the residual of a long autoregression before."""
    z = y - y.mean()
    order = min(10, len(y) // 4)
    past = np.column_stack([z[order - i : len(z) - i] for i in range(1, order + 1)])
    shocks = z[order:] - past @ np.linalg.lstsq(past, z[order:], rcond=None)[0]
    begin = np.linalg.lstsq(np.column_stack([z[order:-1], shocks[:-1]]), z[order + 1 :], rcond=None)[0]
    return np.array([y.mean(), *np.clip(begin, -0.9, 0.9)])


def fit_arima(y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """((mean, phi, theta), their standard errors) of ARIMA(1,0,1) by exact maximum likelihood: Newton steps, halved until they gain."""
    step = np.array([1e-3 * max(float(y.std()), 1e-9), 1e-4, 1e-4])
    value = lambda q: arma_likelihood(y, q)[0]
    basis = np.diag(step)

    def slopes(q):
        here = value(q)
        up, down = np.array([value(q + b) for b in basis]), np.array([value(q - b) for b in basis])
        gradient, bend = (up - down) / 2, np.diag(up - 2 * here + down)
        for i in range(3):
            for j in range(i):
                bend[i, j] = bend[j, i] = (value(q + basis[i] + basis[j]) - value(q + basis[i] - basis[j]) - value(q - basis[i] + basis[j]) + value(q - basis[i] - basis[j])) / 4
        return here, gradient, bend  # in units of step

    p = _begin(y)
    for _ in range(rounds):
        here, gradient, bend = slopes(p)
        # Where the likelihood isn't concave, directions are turned uphill.
        sizes, directions = np.linalg.eigh(-bend)
        move, fraction = directions @ ((directions.T @ gradient) / np.maximum(np.abs(sizes), 1e-9)), 1.0
        while fraction > 1e-6:
            trial = p + fraction * move * step
            if np.abs(trial[1:]).max() < 0.995 and value(trial) > here:
                break
            fraction /= 2
        else:
            break
        gained = value(trial) - here
        p = trial
        if gained < 1e-10 * max(1.0, abs(here)):
            break
    covariance = np.linalg.pinv(-slopes(p)[2])
    return p, np.sqrt(np.maximum(np.diag(covariance), 0.0)) * step


def _train_rows(df: DataFrame, column: str, train: float, spec: SeriesSpec) -> DataFrame:
    return prepare.split2(df.where(F.col(column).isNotNull()), train, spec).select(spec.symbol, *spec.order, "split", column)


def _train_values(group: pd.DataFrame, column: str) -> np.ndarray | None:
    y = group.loc[group["split"] == "train", column].to_numpy(dtype=float)
    return y if len(y) >= 20 and y.min() < y.max() else None


def arima(df: DataFrame, column: str = "close_diff", train: float = 0.8, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, time, truth, predicted, low, high, mean, phi, theta) of the test rows, forecast in many steps from the end of train.

    Exact maximum likelihood. A symbol's narrow series goes to one task: for bars, which the
    calendar bounds. Nulls are left out; under 20 train rows, or constant ones, give none.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(spec.order)
        y, ahead = _train_values(group, column), group[group["split"] == "test"]
        out = pd.DataFrame({spec.symbol: ahead[spec.symbol], spec.time: ahead[spec.time], "truth": ahead[column]})
        if y is None:
            return out.iloc[:0].assign(predicted=0.0, low=0.0, high=0.0, mean=0.0, phi=0.0, theta=0.0)
        mu, phi, theta = p = fit_arima(y)[0]
        _, variance, e, weight = arma_likelihood(y, p)
        h = np.arange(len(ahead))
        predicted = mu + phi**h * (phi * (y[-1] - mu) + weight * e)
        grown = np.concatenate([[0.0], np.cumsum(phi ** (2 * h[:-1]))]) if len(h) else np.empty(0)
        spread = 1.959963984540054 * np.sqrt(variance * (1 + (phi + theta) ** 2 * grown))
        return out.assign(predicted=predicted, low=predicted - spread, high=predicted + spread, mean=mu, phi=phi, theta=theta)

    kinds = dict(df.dtypes)
    return _train_rows(df, column, train, spec).groupBy(spec.symbol).applyInPandas(run, f"{spec.symbol} {kinds[spec.symbol]}, {spec.time} {kinds[spec.time]}, truth double, predicted double, low double, high double, mean double, phi double, theta double")


def arima_summary(df: DataFrame, column: str = "close_diff", train: float = 0.8, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, term, estimate, std_error, z, log_likelihood, aic, bic, n) of the fit: terms mean, phi, theta, sigma2. As arima for nulls and short series."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y = _train_values(group.sort_values(spec.order), column)
        if y is None:
            return pd.DataFrame(columns=[spec.symbol, "term", "estimate", "std_error", "z", "log_likelihood", "aic", "bic", "n"])
        p, errors = fit_arima(y)
        likelihood, variance, *_ = arma_likelihood(y, p)
        n, estimate, error = len(y), np.append(p, variance), np.append(errors, variance * math.sqrt(2 / len(y)))
        return pd.DataFrame({spec.symbol: group[spec.symbol].iloc[0], "term": ["mean", "phi", "theta", "sigma2"], "estimate": estimate, "std_error": error, "z": estimate / error, "log_likelihood": likelihood, "aic": 8 - 2 * likelihood, "bic": 4 * math.log(n) - 2 * likelihood, "n": n})

    kind = dict(df.dtypes)[spec.symbol]
    return _train_rows(df, column, train, spec).groupBy(spec.symbol).applyInPandas(run, f"{spec.symbol} {kind}, term string, estimate double, std_error double, z double, log_likelihood double, aic double, bic double, n long")


__all__ = ["Trees", "arima", "arima_summary", "arma_likelihood", "fit_arima", "fit_linear", "fit_trees", "grid", "model_windows", "naive", "naive_scaled", "pivot_scores", "predict_linear", "predict_trees", "score", "training_history", "transfer"]
