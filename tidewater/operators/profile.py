"""Profiles of tables: descriptions, missing values, correlations, group means."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as X
from ..series import BARS, SeriesSpec, spined
from .clean import numeric_columns


def _long(columns: list[str], aggregates: dict[str, dict], df: DataFrame, names: list[str], kinds: list[str]) -> DataFrame:
    """One aggregate over df, turned to a row for each column."""
    row = df.agg(*(e.cast(k).alias(f"{n}__{i}") for i, c in enumerate(columns) for n, k, e in zip(names, kinds, aggregates[c].values(), strict=True)))
    structs = [F.struct(F.lit(c).alias("column"), *(F.col(f"{n}__{i}").alias(n) for n in names)) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*structs)))


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float], buckets: int = 4096) -> dict[str, list[float | None]]:
    """Exact quantiles, interpolated linearly, of columns of any length.

    Order statistics are found by histograms: each round counts, in one pass for all columns,
    the values of the buckets of the intervals still in question, and keeps the buckets that
    hold a wanted rank, narrowed to their values, until one value is left. What reaches the
    driver is at most buckets rows for each rank; no task holds a column.
    """
    ends = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("a", F.min), ("b", F.max)))).first()
    found: dict[tuple[int, int], float] = {}
    open_ranks: dict[tuple[int, int], tuple[float, float, int]] = {}  # (column, rank): interval, values before it
    for i in range(len(columns)):
        for p in probabilities if ends[f"n{i}"] else ():
            h = (ends[f"n{i}"] - 1) * p
            for rank in {int(h), min(int(h) + 1, ends[f"n{i}"] - 1)}:
                if ends[f"a{i}"] == ends[f"b{i}"]:
                    found[i, rank] = ends[f"a{i}"]
                else:
                    open_ranks[i, rank] = (ends[f"a{i}"], ends[f"b{i}"], 0)
    while open_ranks:
        asked = sorted({(i, a, b) for (i, _), (a, b, _) in open_ranks.items()})
        cells = []
        for k, (i, a, b) in enumerate(asked):
            v = F.col(columns[i]).cast("double")
            inside = F.least(F.floor((v - a) / (b - a) * buckets), F.lit(buckets - 1))
            cells.append(F.when(v.between(a, b), F.struct(F.lit(k).alias("k"), inside.alias("bucket"), v.alias("v"))))
        rows = df.select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).groupBy("cell.k", "cell.bucket").agg(F.count("*").alias("n"), F.min("cell.v").alias("a"), F.max("cell.v").alias("b")).collect()
        histogram: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["k"], r["bucket"])):
            histogram.setdefault(r["k"], []).append(r)
        following = {}
        for (i, rank), (a, b, before) in open_ranks.items():
            for r in histogram[asked.index((i, a, b))]:
                if rank < before + r["n"]:
                    if r["a"] == r["b"]:
                        found[i, rank] = r["a"]
                    else:
                        following[i, rank] = (r["a"], r["b"], before)
                    break
                before += r["n"]
        open_ranks = following

    def value(i: int, p: float) -> float | None:
        if not ends[f"n{i}"]:
            return None
        h = (ends[f"n{i}"] - 1) * p
        low, high = found[i, int(h)], found[i, min(int(h) + 1, ends[f"n{i}"] - 1)]
        return low + (high - low) * (h - int(h))

    return {c: [value(i, p) for p in probabilities] for i, c in enumerate(columns)}


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std (n - 1), min, exact linear quartiles and max of each numeric column, one row each. The quartiles are asked for at once."""
    columns = columns or numeric_columns(df)
    quarters = quantiles(df, columns, [0.25, 0.5, 0.75])
    names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    aggregates = {c: {"count": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), **{f"q{n}": F.lit(q) for n, q in zip((25, 50, 75), quarters[c], strict=True)}, "max": F.max(c)} for c in columns}
    return _long(columns, aggregates, df, names, ["long", *["double"] * 7])


def null_table(df: DataFrame) -> DataFrame:
    """Known and missing values of each column."""
    aggregates = {c: {"n": F.count(c), "nulls": F.count("*") - F.count(c)} for c in df.columns}
    return _long(df.columns, aggregates, df, ["count", "nulls"], ["long", "long"])


def missing_report(df: DataFrame, at_least: float = 0.0) -> DataFrame:
    """Columns with missing values: how many, and the percentage, from at_least on; most first."""
    aggregates = {c: {"n": F.count("*") - F.count(c), "p": (F.count("*") - F.count(c)) * 100 / F.nullif(F.count("*"), F.lit(0))} for c in df.columns}
    found = _long(df.columns, aggregates, df, ["n_missing", "percentage"], ["long", "double"])
    return found.where(f"n_missing > 0 and percentage >= {float(at_least)}").orderBy(F.desc("n_missing"), "column")


def kept_columns(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """For each column whether drop_columns keeps it."""
    def many(c):  # at least two distinct known values; min and max do where values have an order
        kind = df.schema[c].dataType
        return F.count_distinct(c) > 1 if isinstance(kind, (T.MapType, T.VariantType)) else F.coalesce(F.min(c) < F.max(c), F.lit(False))

    aggregates = {c: {"keep": many(c) & ~((F.count("*") - F.count(c)) * 100 / F.nullif(F.count("*"), F.lit(0)) > threshold)} for c in df.columns}
    return _long(df.columns, aggregates, df, ["keep"], ["boolean"])


def drop_columns(df: DataFrame, threshold: float = 50.0, columns: list[str] | None = None) -> DataFrame:
    """Without columns of which more than threshold per cent are missing, and those of at most one distinct value.

    Asks the data first (one pass, one row back); with columns, those to keep, it doesn't.
    """
    if columns is None:
        columns = [r["column"] for r in kept_columns(df, threshold).where("keep").collect()]
    return df.select([c for c in df.columns if c in set(columns)])


def any_missing(df: DataFrame, column: str, spec: SeriesSpec = BARS) -> DataFrame:
    """(symbol, any_missing): whether a symbol's column has a null."""
    return df.groupBy(spec.symbol).agg(F.bool_or(F.col(column).isNull()).alias("any_missing"))


def head(df: DataFrame, n: int = 5, spec: SeriesSpec = BARS) -> DataFrame:
    """Each symbol's first n rows."""
    return df.withColumn("_at", F.row_number().over(spec.window())).where(f"_at <= {int(n)}").drop("_at")


def tail(df: DataFrame, n: int = 5, spec: SeriesSpec = BARS) -> DataFrame:
    """Each symbol's last n rows."""
    return df.withColumn("_at", F.row_number().over(spec.backwards())).where(f"_at <= {int(n)}").drop("_at")


def select_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of columns that exist, in df's order."""
    return df.select([c for c in df.columns if c in set(columns)])


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, corr) of every pair, over rows where both are known, in one pass. Null where one is constant."""
    columns = columns or numeric_columns(df)
    aggregates = []
    for a, b in combinations(columns, 2):
        x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double")) for c in (a, b))
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        aggregates.append(F.when(varies, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))).alias(f"{len(aggregates)}"))
    row = df.agg(*aggregates)
    pairs = [F.struct(F.lit(p).alias("col_a"), F.lit(q).alias("col_b"), F.col(f"`{i}`").alias("corr")) for i, (a, b) in enumerate(combinations(columns, 2)) for p, q in ((a, b), (b, a))]
    own = [F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.lit(1.0).alias("corr")) for c in columns]
    return row.select(F.inline(F.array(*pairs, *own)))


def target_correlations(df: DataFrame, target: str = "close", columns: list[str] | None = None) -> DataFrame:
    return correlations(df, columns).where((F.col("col_a") == target) & (F.col("col_b") != target)).select(F.col("col_b").alias("feature"), "corr").orderBy(F.desc("corr"), "feature")


def month_means(df: DataFrame, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """Mean of each calendar month, with its name: (month, month_name, mean)."""
    return df.groupBy(F.month(spec.time).alias("month")).agg(F.avg(column).alias("mean")).withColumn("month_name", X.month_name(F.col("month"))).orderBy("month")


def year_month_means(df: DataFrame, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    means = df.groupBy(F.year(spec.time).alias("year"), F.month(spec.time).alias("month")).agg(F.avg(column).alias("mean"))
    return means.withColumn("year_month", X.year_month(F.col("year"), F.col("month"))).orderBy("year", "month")


def resample_months(df: DataFrame, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    """Mean of each month at its last day, null for months without rows, for each symbol."""
    month = F.trunc(spec.time, "month")
    ends = df.agg(F.struct(F.min(month).alias("first"), F.max(month).alias("last"))).scalar()
    months = F.sequence(ends.getField("first"), ends.getField("last"), F.expr("interval 1 month"))
    grid = df.select(spec.symbol).distinct().select(spec.symbol, F.explode(months).alias("m")).select(spec.symbol, F.last_day("m").alias("month_end"))
    means = df.groupBy(spec.symbol, F.last_day(spec.time).alias("month_end")).agg(F.avg(column).alias("mean"))
    return grid.join(means, [spec.symbol, "month_end"], "left")


def min_max_scaled(df: DataFrame, column: str = "close", spec: SeriesSpec = BARS) -> DataFrame:
    ends = df.groupBy(spec.symbol).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    return df.join(ends, spec.symbol).withColumn(f"norm_{column}", X.min_max(F.col(column), F.col("_low"), F.col("_high"))).drop("_low", "_high")


__all__ = ["any_missing", "correlations", "describe", "drop_columns", "head", "kept_columns", "min_max_scaled", "missing_report", "month_means", "null_table", "quantiles", "resample_months", "select_present", "spined", "tail", "target_correlations", "year_month_means"]
