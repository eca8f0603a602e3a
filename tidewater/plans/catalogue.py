"""Every query of the time-series engine, with its SQL.

Values are rounded on both sides, as sums are taken in another order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import shared_folder
from ..operators import arima as long_arima
from ..operators import clean, diagnostics, features, forecast, fourier, prepare, profile, relations, spectral, stats
from ..operators import ticks as long
from ..series import SeriesSpec, align, positioned
from ..sources.files import read_raw_csv, read_series_csv, read_table, write_csv, write_indexed_csv
from ..streaming import live
from .tables import BARS_D, BARS_H, BARS_HS, bars_daily, bars_hourly, bars_hourly_spined, ticks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TICKS = SeriesSpec(tiebreak=("event_id",))


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, to: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


def _d(body: str, bars: str = BARS_D) -> str:
    return f"WITH bars AS ({bars}) {body}"


def _h(body: str) -> str:
    return _d(body, BARS_H)


def _hs(body: str) -> str:
    return _d(body, BARS_HS)


W = "(PARTITION BY symbol ORDER BY time)"
ROUNDED_BARS = "symbol, time, open, high, low, close, round(volume, 2) AS volume, n"


@query(_d(f"SELECT {ROUNDED_BARS} FROM bars"))
def bars_by_day(spark, sf_dir):
    return rounded(bars_daily(spark, sf_dir), "volume", to=2)


@query(_h(f"SELECT {ROUNDED_BARS} FROM bars"))
def bars_by_hour(spark, sf_dir):
    return rounded(bars_hourly(spark, sf_dir), "volume", to=2)


@query(_h(f"SELECT {ROUNDED_BARS} FROM bars"))
def bars_by_hour_streamed(spark, sf_dir):
    """The same bars from a stream of ticks, kept up to date by event time; what is kept, and given here, is bounded by the calendar."""
    schema = read_table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{str(sf_dir).rstrip('/')}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"bars_{uuid.uuid4().hex}"
    made = live.stream_bars(stream, "event_type", "ts", "value", "event_id", "1 hour", "2 hours")
    made.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared_folder(spark).rstrip('/')}/{name}").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.table(name).withColumn("time", F.col("time").cast("timestamp_ntz")), "volume", to=2)


def _appended(made: DataFrame, name: str) -> DataFrame:
    """What a stream appends to files in the shared folder until all there is has been read."""
    spark = made.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(path)


def _tick_stream(spark, sf_dir) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{str(sf_dir).rstrip('/')}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(_h(f"SELECT {ROUNDED_BARS} FROM bars WHERE time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"))
def bars_by_hour_appended(spark, sf_dir):
    """Bars of closed hours, appended to files as the watermark passes them; the hours that late ticks may still change wait in the state."""
    made = live.stream_bars(_tick_stream(spark, sf_dir), "event_type", "ts", "value", "event_id", "1 hour", "2 hours")
    return rounded(_appended(made, "bars").withColumn("time", F.col("time").cast("timestamp_ntz")), "volume", to=2)


@query(_hs(f"SELECT {ROUNDED_BARS.replace(', n', ', coalesce(n, 0) AS n')} FROM bars"))
def bars_by_hour_spined(spark, sf_dir):
    return rounded(bars_hourly_spined(spark, sf_dir), "volume", to=2).fillna(0, ["n"])


BARS_SCHEMA = "symbol string, time string, open double, high double, low double, close double, volume double, n long"


@query(_d(f"SELECT {ROUNDED_BARS} FROM bars"))
def csv_round_trip(spark, sf_dir):
    """Written as CSV by tasks, read again, times parsed."""
    path = f"{shared_folder(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    write_csv(bars_by_day(spark, sf_dir), path)
    return read_raw_csv(spark, path, BARS_SCHEMA).withColumn("time", F.to_timestamp_ntz("time"))


#: What the file of each symbol holds, in this order.
FILES = {"1": ["time", "open", "close"], "2": ["close", "time", "open"], "3": ["time", "close"], "4": ["volume", "open", "time", "close"], "5": ["close", "open", "time", "n"]}


@query(_d(" UNION ALL ".join(f"SELECT '{s}' AS symbol, time, " + ", ".join((f"round({c}, 2)" if c == "volume" else c) + f" AS {c}" if c in held else f"NULL AS {c}" for c in ("open", "close", "volume", "n")) + f" FROM bars WHERE symbol[1] = '{s}'" for s, held in FILES.items())))
def csv_by_header(spark, sf_dir):
    """A file for each symbol, whose columns differ in order and number; each is read by its own header, a file that isn't there is skipped."""
    path = f"{shared_folder(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    df = bars_by_day(spark, sf_dir)
    for symbol, held in FILES.items():
        write_csv(df.where(F.col("symbol").startswith(symbol)).select(*held), f"{path}/{symbol}_bars")
    return read_series_csv(spark, [f"{path}/{s}_bars" for s in (*FILES, "6")])


@query(_d("SELECT row_number() OVER (ORDER BY symbol, time) - 1 AS index, symbol, time, close FROM bars WHERE month(time) = 1"))
def csv_indexed(spark, sf_dir):
    """A summary with an index column, types inferred when it is read."""
    path = f"{shared_folder(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    write_indexed_csv(bars_daily(spark, sf_dir).where(F.month("time") == 1).select("symbol", "time", "close"), path, ["symbol", "time"])
    return read_raw_csv(spark, path).select(F.col("index").cast("long").alias("index"), "symbol", F.col("time").cast("timestamp_ntz").alias("time"), "close")


@query(_d("SELECT symbol, time, day(time)::INT AS day, month(time)::INT AS month, year(time)::INT AS year FROM bars"))
def date_parts(spark, sf_dir):
    return prepare.with_date_parts(bars_daily(spark, sf_dir)).select("symbol", "time", "day", "month", "year")


@query(_d("SELECT month(time)::INT AS month, monthname(time) AS month_name, round(avg(close), 4) AS mean FROM bars GROUP BY ALL"))
def calendar_month_mean(spark, sf_dir):
    return rounded(profile.month_means(bars_daily(spark, sf_dir)), "mean")


@query(_d("SELECT year(time)::INT AS year, month(time)::INT AS month, year(time) || '-' || month(time) AS year_month, round(avg(close), 4) AS mean FROM bars GROUP BY ALL"))
def year_month_mean(spark, sf_dir):
    return rounded(profile.year_month_means(bars_daily(spark, sf_dir)), "mean")


@query(_d("""SELECT symbol, month_end::TIMESTAMP AS month_end, round(mean, 6) AS mean FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN
    (SELECT last_day(unnest(generate_series(date_trunc('month', min(time)), date_trunc('month', max(time)), INTERVAL 1 MONTH))::DATE) AS month_end FROM bars)
    LEFT JOIN (SELECT symbol, last_day(time) AS month_end, avg(close) AS mean FROM bars GROUP BY ALL) USING (symbol, month_end)"""))
def resample_month(spark, sf_dir):
    return rounded(profile.resample_months(bars_daily(spark, sf_dir)), "mean", to=6).withColumn("month_end", F.col("month_end").cast("timestamp_ntz"))


PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
    round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max FROM lineitem""" for c in PROFILED))
def describe(spark, sf_dir):
    return rounded(profile.describe(read_table(spark, sf_dir, "lineitem"), PROFILED), "mean", "std", "q25", "q50", "q75")


SPINED_COLUMNS = ["symbol", "time", "open", "high", "low", "close", "volume", "n"]


@query(_hs(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS nulls FROM bars""" for c in SPINED_COLUMNS)))
def null_table(spark, sf_dir):
    return profile.null_table(bars_hourly_spined(spark, sf_dir))


@query(_hs("SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_missing, round((count(*) - count({c})) * 100 / count(*), 6) AS percentage FROM bars""" for c in SPINED_COLUMNS) + ") WHERE n_missing > 0"))
def missing_report(spark, sf_dir):
    return rounded(profile.missing_report(bars_hourly_spined(spark, sf_dir)), "percentage", to=6)


@query(_hs("SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_missing, round((count(*) - count({c})) * 100 / count(*), 6) AS percentage FROM (SELECT *, CASE WHEN n > 3 THEN n END AS many FROM bars)""" for c in [*SPINED_COLUMNS, "many"]) + ") WHERE n_missing > 0 AND percentage >= 25"))
def mostly_missing(spark, sf_dir):
    df = bars_hourly_spined(spark, sf_dir).withColumn("many", F.when(F.col("n") > 3, F.col("n")))
    return rounded(profile.missing_report(df, 25), "percentage", to=6)


@query(_hs("SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", coalesce(min({c}) < max({c}), false) AND (count(*) - count({c})) * 100 / count(*) <= 5 AS keep FROM (SELECT *, 1 AS one, CASE WHEN n > 3 THEN n END AS many FROM bars)""" for c in [*SPINED_COLUMNS, "one", "many"]) + ")"))
def kept_columns(spark, sf_dir):
    df = bars_hourly_spined(spark, sf_dir).withColumns({"one": F.lit(1), "many": F.when(F.col("n") > 3, F.col("n"))})
    return profile.kept_columns(df, 5.0)


CORRELATED = ["open", "high", "low", "close", "volume"]


@query(_d(" UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, " + ("1.0::DOUBLE AS corr" if a == b else f"round(corr({a}, {b}), 6) AS corr FROM bars") for a in CORRELATED for b in CORRELATED)))
def corr_long(spark, sf_dir):
    return rounded(profile.correlations(bars_daily(spark, sf_dir), CORRELATED), "corr", to=6)


@query(_d(" UNION ALL ".join(f"SELECT '{b}' AS feature, round(corr(close, {b}), 6) AS corr FROM bars" for b in CORRELATED if b != "close")))
def target_corr(spark, sf_dir):
    return rounded(profile.target_correlations(bars_daily(spark, sf_dir), "close", CORRELATED), "corr", to=6)


@query(_d("SELECT symbol, time, round((close - min(close) OVER s) / nullif(max(close) OVER s - min(close) OVER s, 0), 6) AS norm_close FROM bars WINDOW s AS (PARTITION BY symbol)"))
def minmax_close(spark, sf_dir):
    return rounded(profile.min_max_scaled(bars_daily(spark, sf_dir)).select("symbol", "time", "norm_close"), "norm_close", to=6)


@query(_hs("SELECT symbol, time, " + ", ".join(f"coalesce(lag(close, {k}) OVER {W}, (SELECT arg_min(close, time) FROM bars c WHERE c.symbol = bars.symbol AND close IS NOT NULL), 0) AS lag_{k}" for k in range(1, 6)) + " FROM bars"))
def lag_features(spark, sf_dir):
    return features.lag_features(bars_hourly_spined(spark, sf_dir), 5).select("symbol", "time", *(f"lag_{k}" for k in range(1, 6)))


def _sma_sql(n: int, name: str) -> str:
    frame = f"(PARTITION BY symbol ORDER BY time ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count(close) OVER {frame} = {n} THEN round(avg(close) OVER {frame}, 4) END AS {name}"


@query(_d(f"SELECT symbol, time, close, {_sma_sql(10, 'sma_10')} FROM bars"))
def sma(spark, sf_dir):
    return rounded(features.sma(bars_daily(spark, sf_dir), [10]), "sma_10").select("symbol", "time", "close", "sma_10")


@query(_d("SELECT symbol, time, " + ", ".join(_sma_sql(n, f"sma_{n}") for n in (10, 30, 50, 100)) + " FROM bars"))
def sma_multi(spark, sf_dir):
    names = [f"sma_{n}" for n in (10, 30, 50, 100)]
    return rounded(features.sma(bars_daily(spark, sf_dir), [10, 30, 50, 100]), *names).select("symbol", "time", *names)


TICK_SMA = "(PARTITION BY event_type ORDER BY ts, event_id ROWS 19 PRECEDING)"


@query(f"SELECT event_type AS symbol, ts AS time, event_id, CASE WHEN count(*) OVER {TICK_SMA} = 20 THEN round(avg(value) OVER {TICK_SMA}, 4) END AS sma_20 FROM events")
def tick_sma(spark, sf_dir):
    """Over single ticks: the one series here that grows with the data, so it is cut into chunks."""
    out = features.sma_in_chunks(ticks(spark, sf_dir), 20, "value", F.date_trunc("hour", "time"), TICKS, chunk_rows=2_000_000)
    return rounded(out, "sma_20").select("symbol", "time", "event_id", "sma_20")


@query(_d("""SELECT symbol, time, half, CASE WHEN count(close) OVER f = 12 THEN round(avg(close) OVER f, 4) END AS rolling_mean, CASE WHEN count(close) OVER f = 12 THEN round(stddev_samp(close) OVER f, 4) END AS rolling_std
    FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 < floor(count(*) OVER (PARTITION BY symbol) / 2) THEN 1 ELSE 2 END AS half FROM bars)
    WINDOW f AS (PARTITION BY symbol, half ORDER BY time ROWS 11 PRECEDING)"""))
def rolling_std_halves(spark, sf_dir):
    return rounded(prepare.rolling_by_halves(bars_daily(spark, sf_dir)), "rolling_mean", "rolling_std").select("symbol", "time", "half", "rolling_mean", "rolling_std")


@query(_d(f"SELECT symbol, time, round(close - lag(close) OVER {W}, 4) AS close_diff FROM bars"))
def diff(spark, sf_dir):
    return rounded(features.diff(bars_daily(spark, sf_dir)), "close_diff").select("symbol", "time", "close_diff")


PADDED = "SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS p FROM bars"


@query(_hs(f"SELECT symbol, time, round((p - lag(p, 3) OVER {W}) / lag(p, 3) OVER {W}, 6) AS pct_change FROM ({PADDED})"))
def pct_change(spark, sf_dir):
    return rounded(features.with_pct_change(bars_hourly_spined(spark, sf_dir), periods=3), "pct_change", to=6).select("symbol", "time", "pct_change")


@query(_hs("SELECT symbol, time, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("open", "close")) + " FROM bars"))
def ffill(spark, sf_dir):
    return clean.ffill(bars_hourly_spined(spark, sf_dir), ["open", "close"]).select("symbol", "time", "open", "close")


@query(_hs("SELECT symbol, time, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("open", "close")) + " FROM bars"))
def bfill(spark, sf_dir):
    return clean.bfill(bars_hourly_spined(spark, sf_dir), ["open", "close"]).select("symbol", "time", "open", "close")


MEDIAN = "median(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(_hs(f"SELECT symbol, time, round({MEDIAN}, 4) AS rolling_median FROM bars"))
def rolling_median(spark, sf_dir):
    df = bars_hourly_spined(spark, sf_dir).withColumn("rolling_median", clean.rolling_median("close", 5))
    return rounded(df, "rolling_median").select("symbol", "time", "rolling_median")


IMPUTED = f"coalesce(close, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time DESC ROWS UNBOUNDED PRECEDING), {MEDIAN})"


@query(_hs(f"SELECT symbol, time, round({IMPUTED}, 4) AS close FROM bars"))
def impute(spark, sf_dir):
    return rounded(clean.impute(bars_hourly_spined(spark, sf_dir), ["close"]), "close").select("symbol", "time", "close")


def _ema_sql(n: int, source: str = "bars", column: str = "close") -> str:
    """The recursion over each symbol's ordered list of values."""
    a = f"(2.0::DOUBLE / {n + 1})"
    return f"""SELECT symbol, unnest(t) AS time, unnest(e) AS ema_{n} FROM (
        SELECT symbol, t, list_reduce(list_transform(x, lambda v: [v]), lambda s, v: list_append(s, (1 - {a}) * s[-1] + {a} * v[1])) AS e
        FROM (SELECT symbol, list(time ORDER BY time) AS t, list({column} ORDER BY time) AS x FROM {source} GROUP BY symbol))"""


@query(_d(f"SELECT symbol, time, round(ema_10, 4) AS ema_10 FROM ({_ema_sql(10)})"))
def ema(spark, sf_dir):
    return rounded(features.ema(bars_daily(spark, sf_dir).select("symbol", "time", "close"), [10]), "ema_10").select("symbol", "time", "ema_10")


@query(_d("SELECT symbol, time, " + ", ".join(f"round(ema_{n}, 4) AS ema_{n}" for n in (10, 30, 50, 100)) + " FROM " + " JOIN ".join(f"(SELECT symbol, time, ema_{n} FROM ({_ema_sql(n)}))" + ("" if n == 10 else " USING (symbol, time)") for n in (10, 30, 50, 100))))
def ema_multi(spark, sf_dir):
    names = [f"ema_{n}" for n in (10, 30, 50, 100)]
    return rounded(features.ema(bars_daily(spark, sf_dir).select("symbol", "time", "close"), [10, 30, 50, 100]), *names).select("symbol", "time", *names)


@query("""SELECT symbol, unnest(t) AS time, unnest(i) AS event_id, round(unnest(e), 4) AS ema_20 FROM (
        SELECT symbol, t, i, list_reduce(list_transform(x, lambda v: [v]), lambda s, v: list_append(s, (1 - 2.0::DOUBLE / 21) * s[-1] + 2.0::DOUBLE / 21 * v[1])) AS e
        FROM (SELECT event_type AS symbol, list(ts ORDER BY ts, event_id) AS t, list(event_id ORDER BY ts, event_id) AS i, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY event_type))""")
def tick_ema(spark, sf_dir):
    """Over single ticks, by composing the steps of chunks."""
    out = features.ema_in_chunks(ticks(spark, sf_dir), 20, "value", F.date_trunc("hour", "time"), TICKS)
    return rounded(out, "ema_20").select("symbol", "time", "event_id", "ema_20")


STREAMED = ORACLE_SQL["tick_ema"]


@query(f"SELECT symbol, time, event_id AS tiebreak, ema_20 AS ema FROM ({STREAMED}) WHERE date_trunc('minute', time) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def tick_ema_streamed(spark, sf_dir):
    """The exponential mean of a stream of ticks in their order of time, whatever order they come in; the last hour's wait for late ones."""
    made = live.stream_ema_by_event_time(_tick_stream(spark, sf_dir), 20, "event_type", "ts", "event_id", "value", "1 hour", "1 minute")
    out = _appended(made, "ema").withColumn("time", F.col("time").cast("timestamp_ntz"))
    return rounded(out, "ema").select("symbol", "time", "tiebreak", "ema")


#: Ticks with gaps: every seventh value, stretches, and all of a month's last days.
GAPPED = "SELECT event_type AS symbol, ts AS time, event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 1000 < 900 AND day(ts) < 28 THEN value END AS value FROM events"
ALONG, BACK = "(PARTITION BY symbol ORDER BY time, event_id ROWS UNBOUNDED PRECEDING)", "(PARTITION BY symbol ORDER BY time DESC, event_id DESC ROWS UNBOUNDED PRECEDING)"
TICK_MEDIAN = "median(value) OVER (PARTITION BY symbol ORDER BY time, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"


def _gapped(spark, sf_dir) -> DataFrame:
    known = (F.col("event_id") % 7 != 0) & (F.col("event_id") % 1000 < 900) & (F.dayofmonth("time") < 28)
    return ticks(spark, sf_dir).withColumn("value", F.when(known, F.col("value")))


@query(f"SELECT symbol, time, event_id, last_value(value IGNORE NULLS) OVER {ALONG} AS value FROM ({GAPPED})")
def tick_ffill(spark, sf_dir):
    """Over single ticks: the last known value is carried from chunk to chunk."""
    return long.ffill(_gapped(spark, sf_dir), ["value"], F.date_trunc("hour", "time"), TICKS)


@query(f"SELECT symbol, time, event_id, last_value(value IGNORE NULLS) OVER {BACK} AS value FROM ({GAPPED})")
def tick_bfill(spark, sf_dir):
    return long.bfill(_gapped(spark, sf_dir), ["value"], F.date_trunc("hour", "time"), TICKS)


@query(f"SELECT symbol, time, event_id, round({TICK_MEDIAN}, 4) AS rolling_median FROM ({GAPPED})")
def tick_median(spark, sf_dir):
    """Over single ticks: a ranked list slides along each chunk."""
    return rounded(long.rolling_median(_gapped(spark, sf_dir), 21, "value", F.date_trunc("hour", "time"), TICKS), "rolling_median").drop("value")


@query(f"SELECT symbol, time, event_id, round(coalesce(value, last_value(value IGNORE NULLS) OVER {BACK}, {TICK_MEDIAN}), 4) AS value FROM ({GAPPED})")
def tick_impute(spark, sf_dir):
    return rounded(long.impute(_gapped(spark, sf_dir), ["value"], F.date_trunc("hour", "time"), 21, TICKS), "value")


ROC = f"""r AS (SELECT symbol, time, CASE WHEN count(close) OVER f = 10 THEN avg(close) OVER f END AS m FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY time ROWS 9 PRECEDING)),
    c AS (SELECT symbol, time, (m - lag(m, 20) OVER {W}) / lag(m, 20) OVER {W} * 100 AS roc FROM r),
    b AS (SELECT symbol, time, roc, CASE WHEN roc IS NULL OR isnan(roc) THEN 'Unknown' WHEN roc > 10 THEN 'Very High Positive' WHEN roc > 5 THEN 'High Positive' WHEN roc > 1 THEN 'Low Positive'
        WHEN roc > -1 THEN 'Neutral' WHEN roc > -5 THEN 'Low Negative' ELSE 'High Negative' END AS roc_bin FROM c)"""


@query(f"WITH bars AS ({BARS_D}), {ROC} SELECT symbol, time, round(roc, 4) AS roc, roc_bin FROM b")
def roc_bins(spark, sf_dir):
    return rounded(features.rate_of_change(bars_daily(spark, sf_dir), "ma", 10, 20), "roc").select("symbol", "time", "roc", "roc_bin")


ROC_EMA = "r AS (SELECT symbol, time, ema_10 AS m FROM (" + _ema_sql(10) + "))," + ROC.partition("ROWS 9 PRECEDING)),")[2]


@query(f"WITH bars AS ({BARS_D}), {ROC_EMA} SELECT symbol, time, round(roc, 4) AS roc, roc_bin FROM b")
def roc_ema(spark, sf_dir):
    return rounded(features.rate_of_change(bars_daily(spark, sf_dir), "ema", 10, 20), "roc").select("symbol", "time", "roc", "roc_bin")


@query(f"""WITH bars AS ({BARS_D}), {ROC},
    k AS (SELECT *, list_position(['Unknown', 'Very High Positive', 'High Positive', 'Low Positive', 'Neutral', 'Low Negative', 'High Negative'], roc_bin)::INT AS code FROM b)
    SELECT symbol, time, ((code >> 2) & 1)::INT AS "ROC_0", ((code >> 1) & 1)::INT AS "ROC_1", (code & 1)::INT AS "ROC_2" FROM k""")
def roc_binary(spark, sf_dir):
    return features.binary_encode(features.rate_of_change(bars_daily(spark, sf_dir), "ma", 10, 20)).select("symbol", "time", "ROC_0", "ROC_1", "ROC_2")


@query(f"""WITH bars AS ({BARS_D}), {ROC}, p AS (SELECT *, min(time) OVER (PARTITION BY symbol, roc_bin) AS first FROM b),
    k AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY first) AS code FROM p)
    SELECT symbol, time, ((code >> 2) & 1)::INT AS "ROC_0", ((code >> 1) & 1)::INT AS "ROC_1", (code & 1)::INT AS "ROC_2" FROM k""")
def roc_binary_by_appearance(spark, sf_dir):
    return features.binary_encode(features.rate_of_change(bars_daily(spark, sf_dir), "ma", 10, 20), mode="appearance").select("symbol", "time", "ROC_0", "ROC_1", "ROC_2")


@query(_d("""SELECT symbol, time, (month(time) IN (6, 7, 9, 10))::DOUBLE AS "Month_Category_Bearish", (month(time) IN (1, 2, 3, 4))::DOUBLE AS "Month_Category_Bullish", (month(time) IN (5, 8, 11, 12))::DOUBLE AS "Month_Category_Normal" FROM bars"""))
def seasonality(spark, sf_dir):
    df = features.seasonality(prepare.with_date_parts(bars_daily(spark, sf_dir)))
    return df.select("symbol", "time", *(c for c in df.columns if c.startswith("Month_Category")))


@query(_d("SELECT symbol, time, round(sin((isodow(time) - 1) * 2 * pi() / 7), 6) AS sin_date, round(cos((isodow(time) - 1) * 2 * pi() / 7), 6) AS cos_date FROM bars"))
def cyclic_weekday(spark, sf_dir):
    return rounded(prepare.with_cyclic_weekday(bars_daily(spark, sf_dir)), "sin_date", "cos_date", to=6).select("symbol", "time", "sin_date", "cos_date")


PLACED = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS total FROM bars"
SPLIT3 = f"SELECT *, CASE WHEN pos < floor(total * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(total * (0.7::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM ({PLACED})"


@query(_d(f"SELECT symbol, time, split FROM ({SPLIT3})"))
def split3(spark, sf_dir):
    return prepare.split3(bars_daily(spark, sf_dir)).select("symbol", "time", "split")


@query(_d(f"SELECT symbol, time, CASE WHEN pos < floor(total * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM ({PLACED})"))
def split2(spark, sf_dir):
    return prepare.split2(bars_daily(spark, sf_dir)).select("symbol", "time", "split")


SCALED = ["open", "close", "volume"]


@query(_d("SELECT symbol, time, split, " + ", ".join(f"round(({c} - avg({c}) FILTER (split = 'train') OVER s) / nullif(stddev_samp({c}) FILTER (split = 'train') OVER s, 0), 4) + 0.0 AS z_{c}" for c in SCALED) + f" FROM ({SPLIT3}) WINDOW s AS (PARTITION BY symbol)"))
def standardise(spark, sf_dir):
    names = [f"z_{c}" for c in SCALED]
    return rounded(prepare.standardise(prepare.split3(bars_daily(spark, sf_dir)), SCALED), *names).select("symbol", "time", "split", *names)


EVERY = {**{c: c for c in ["open", "high", "low", "close", "volume", "n"]}, "time": "epoch_us(time)", "day": "day(time)", "month": "month(time)", "year": "year(time)"}


@query(_d("SELECT symbol, time, split, " + ", ".join(f"round(({e} - avg({e}) FILTER (split = 'train') OVER s) / nullif(stddev_samp({e}) FILTER (split = 'train') OVER s, 0), 3) + 0.0 AS z_{c}" for c, e in EVERY.items()) + f" FROM ({SPLIT3}) WINDOW s AS (PARTITION BY symbol)"))
def standardise_all(spark, sf_dir):
    """All columns but the encodings, times too."""
    df = features.seasonality(prepare.with_cyclic_weekday(prepare.with_date_parts(bars_daily(spark, sf_dir))))
    out = prepare.standardise(prepare.split3(df))
    names = [c for c in out.columns if c.startswith("z_")]
    return rounded(out, *names, to=3).select("symbol", "time", "split", *((F.col(c) + F.lit(0.0)).alias(c) for c in names))


@query(_d(f"""SELECT b.symbol, b.pos AS pos, b.close AS label, s.step AS step, a.open AS open, a.close AS close FROM ({PLACED}) b, (SELECT unnest(range(0, 5)) AS step) s
    JOIN ({PLACED}) a ON a.symbol = b.symbol AND a.pos = b.pos - 5 + s.step WHERE b.pos >= 5 AND b.pos <= b.total - 2"""))
def sequences(spark, sf_dir):
    made = prepare.sequences(bars_daily(spark, sf_dir), ["open", "close"])
    return made.select("symbol", F.col("pos").cast("long").alias("pos"), "label", F.posexplode("window").alias("step", "w")).select("symbol", "pos", "label", F.col("step").cast("long").alias("step"), "w.open", "w.close")


SEASONS = '''(month(time) IN (6, 7, 9, 10))::DOUBLE AS "Month_Category_Bearish", (month(time) IN (1, 2, 3, 4))::DOUBLE AS "Month_Category_Bullish", (month(time) IN (5, 8, 11, 12))::DOUBLE AS "Month_Category_Normal"'''
CODES = """k AS (SELECT symbol, time, list_position(['Unknown', 'Very High Positive', 'High Positive', 'Low Positive', 'Neutral', 'Low Negative', 'High Negative'], roc_bin)::INT AS code FROM b),
    e AS (SELECT symbol, time, ((code >> 2) & 1)::INT AS "ROC_0", ((code >> 1) & 1)::INT AS "ROC_1", (code & 1)::INT AS "ROC_2" FROM k)"""
PARTS = "day(time)::INT AS day, month(time)::INT AS month, year(time)::INT AS year"
FINANCES = "epoch(time)::BIGINT AS timestamp, open, close, high, low, round(close * n, 2) AS market_cap"


def _preprocessed(columns: str) -> str:
    """The bars have no nulls and no constant columns, so nothing is dropped, imputed or filled; imputation makes doubles."""
    parts = PARTS.replace("::INT", "::DOUBLE")
    return f"WITH bars AS ({BARS_D}), {ROC_EMA}, {CODES} SELECT symbol, time, {columns}, {parts}, {SEASONS}, \"ROC_0\", \"ROC_1\", \"ROC_2\" FROM bars JOIN e USING (symbol, time)"


def _financial(spark, sf_dir) -> DataFrame:
    """Daily bars with the columns of a market's table."""
    df = bars_daily(spark, sf_dir)
    return df.withColumns({"timestamp": F.unix_seconds(F.col("time").cast("timestamp")), "market_cap": F.round(F.col("close") * F.col("n"), 2)})


@query(_preprocessed("round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 2) AS volume"))
def preprocess(spark, sf_dir):
    out = prepare.preprocess(bars_daily(spark, sf_dir).drop("n"))
    return rounded(rounded(out, "open", "high", "low", "close"), "volume", to=2)


@query(_preprocessed(FINANCES.replace("BIGINT", "DOUBLE")))
def preprocess_financial(spark, sf_dir):
    """The ten financial columns alone, a lower threshold, no forward fill."""
    return prepare.preprocess(_financial(spark, sf_dir), 10.0, only=prepare.FINANCIAL, fill=False)


@query(_preprocessed(FINANCES.replace("BIGINT", "DOUBLE") + ", n::DOUBLE AS tweets"))
def preprocess_sentiment(spark, sf_dir):
    """Of the twenty columns of the sentiment models those that are there."""
    df = _financial(spark, sf_dir).withColumnRenamed("n", "tweets")
    return prepare.preprocess(df, 10.0, keep=prepare.SENTIMENT)


@query(_d(f"SELECT symbol, time, {FINANCES}, {PARTS} FROM bars"))
def simplified(spark, sf_dir):
    return prepare.simplify(prepare.with_date_parts(_financial(spark, sf_dir)))


@query(_d("SELECT symbol, open, close FROM bars"))
def present_columns(spark, sf_dir):
    return profile.select_present(bars_daily(spark, sf_dir), ["close", "tweets", "symbol", "open"])


@query(_d("SELECT symbol, time, close FROM bars"))
def close_line(spark, sf_dir):
    return relations.lines(bars_daily(spark, sf_dir), ["close"])


@query(_h("SELECT symbol, time, close, n FROM bars"))
def price_and_activity(spark, sf_dir):
    """A price beside a count, as of a price and a social volume."""
    return relations.lines(bars_hourly(spark, sf_dir), ["close", "n"])


@query(_d("SELECT symbol, time, close - (regr_intercept(close, pos) OVER s + regr_slope(close, pos) OVER s * pos) AS r FROM (" + PLACED + ") WINDOW s AS (PARTITION BY symbol)").replace("close - (", "round(close - (", 1).replace("* pos) AS r", "* pos), 4) AS close_detrend", 1))
def detrend(spark, sf_dir):
    return rounded(features.detrend(bars_daily(spark, sf_dir)), "close_detrend").select("symbol", "time", "close_detrend")


@query(_d("SELECT symbol, time, CASE WHEN close > 0 THEN round(ln(close), 6) END AS close_log FROM bars"))
def log_close(spark, sf_dir):
    return rounded(features.log(bars_daily(spark, sf_dir)), "close_log", to=6).select("symbol", "time", "close_log")


ACF = f"""x AS (SELECT symbol, pos, close - avg(close) OVER (PARTITION BY symbol) AS x FROM ({PLACED})),
    r AS (SELECT a.symbol AS symbol, (a.pos - b.pos)::INT AS lag, sum(a.x * b.x) AS s, count(*) AS m FROM x a JOIN x b ON a.symbol = b.symbol AND a.pos - b.pos BETWEEN 0 AND 10 GROUP BY ALL),
    z AS (SELECT r.symbol, r.lag, r.s / o.s AS acf, o.m AS n FROM r JOIN r o ON r.symbol = o.symbol AND o.lag = 0)"""


@query(f"""WITH bars AS ({BARS_D}), {ACF}, e AS (SELECT *, CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054 * sqrt((1 + 2 * coalesce(sum(acf * acf) FILTER (lag > 0) OVER (PARTITION BY symbol ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS d FROM z)
    SELECT symbol, lag, round(acf, 6) + 0.0 AS acf, round(acf - d, 6) + 0.0 AS low, round(acf + d, 6) + 0.0 AS high FROM e""")
def acf(spark, sf_dir):
    return rounded(stats.acf(bars_daily(spark, sf_dir), 10), "acf", "low", "high", to=6)


PACF = f"""WITH RECURSIVE bars AS ({BARS_D}), {ACF}, l AS (SELECT symbol, any_value(n) AS n, list(acf ORDER BY lag) FILTER (lag > 0) AS r FROM z GROUP BY symbol),
    d AS (SELECT symbol, n, r, 1 AS lag, [r[1]] AS phi FROM l UNION ALL
        SELECT symbol, n, r, lag + 1, list_append(list_transform(range(1, lag + 1), lambda i: phi[i] - v * phi[lag + 1 - i]), v)
        FROM (SELECT *, (r[lag + 1] - list_dot_product(phi, list_reverse(r[1:lag]))) / (1 - list_dot_product(phi, r[1:lag])) AS v FROM d WHERE lag < 10)),
    p AS (SELECT symbol, lag::INT AS lag, phi[lag] AS pacf, 1.959963984540054 / sqrt(n) AS s FROM d UNION ALL SELECT symbol, 0, 1.0, 0 FROM l)
    SELECT symbol, lag, round(pacf, 6) + 0.0 AS pacf, round(pacf - s, 6) + 0.0 AS low, round(pacf + s, 6) + 0.0 AS high FROM p"""


@query(PACF)
def pacf(spark, sf_dir):
    return rounded(stats.pacf(bars_daily(spark, sf_dir), 10), "pacf", "low", "high", to=6)


def _monthly(spark, sf_dir) -> DataFrame:
    months = profile.resample_months(bars_daily(spark, sf_dir))
    return months.select("symbol", F.col("month_end").cast("timestamp_ntz").alias("time"), F.col("mean").alias("close"))


MONTHS = f"bars AS ({BARS_D}), m AS (SELECT symbol, last_day(time) AS t, avg(close) AS x FROM bars GROUP BY ALL), p AS (SELECT symbol, x, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM m)"
DFT = "f AS (SELECT symbol, k, any_value(n) AS n, sum(x * cos(2 * pi() * k * i / n)) AS re, -sum(x * sin(2 * pi() * k * i / n)) AS im FROM p, (SELECT unnest(range(0, 2000)) AS k) WHERE k <= n // 2 GROUP BY symbol, k)"


@query(f"WITH {MONTHS}, {DFT} SELECT symbol, k::BIGINT AS k, round(k / n, 6) AS freq, round(sqrt(re * re + im * im) / n, 3) AS amplitude FROM f")
def rfft(spark, sf_dir):
    """Amplitudes over the number of months, so that rounding is alike for all."""
    df = _monthly(spark, sf_dir)
    n = df.where("close is not null").groupBy("symbol").agg(F.count("*").alias("n"))
    out = spectral.rfft(df).join(n, "symbol").withColumn("amplitude", F.col("amplitude") / F.col("n"))
    return rounded(rounded(out, "freq", to=6), "amplitude", to=3).select("symbol", "k", "freq", "amplitude")


def _peaks_sql(where: str) -> str:
    return f"""WITH {MONTHS}, {DFT}, a AS (SELECT symbol, k, k / n AS freq, sqrt(re * re + im * im) AS v FROM f WHERE {where}),
    q AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM a WINDOW w AS (PARTITION BY symbol ORDER BY k))
    SELECT symbol, k::BIGINT AS k, round(freq, 6) AS freq, round(1 / freq, 6) AS period FROM q WHERE v > before AND v > after"""


@query(_peaks_sql("true"))
def spectrum_peaks(spark, sf_dir):
    out = spectral.with_period(spectral.peaks(spectral.rfft(_monthly(spark, sf_dir))))
    return rounded(out, "freq", "period", to=6).select("symbol", "k", "freq", "period")


@query(_peaks_sql("k / n BETWEEN 1 / 24 AND 1 / 3"))
def band_peaks(spark, sf_dir):
    out = spectral.band_peaks(spectral.rfft(_monthly(spark, sf_dir)), 1 / 24, 1 / 3)
    return rounded(out, "freq", "period", to=6).select("symbol", "k", "freq", "period")


@query(f"""WITH bars AS ({BARS_D}), p AS (SELECT symbol, close AS x, pos AS i, total AS n FROM ({PLACED})),
    f AS (SELECT symbol, k, any_value(n) AS n, sum(x * cos(2 * pi() * ((k * i) % n) / n)) AS re, sum(x * sin(2 * pi() * ((k * i) % n) / n)) AS im FROM p, (SELECT unnest(range(0, 2000)) AS k) WHERE k <= n // 2 AND k * 12 < n GROUP BY symbol, k),
    a AS (SELECT symbol, k, k / n AS freq, re * re + im * im AS v FROM f), q AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM a WINDOW w AS (PARTITION BY symbol ORDER BY k))
    SELECT symbol, k::BIGINT AS k, round(freq, 6) AS freq, round(1 / freq, 6) AS period FROM q WHERE v > before AND v > after AND round_even(1 / freq, 0) BETWEEN 17 AND 22""")
def monthly_cycles(spark, sf_dir):
    out = spectral.monthly_cycles(spectral.with_period(spectral.peaks(spectral.rfft(bars_daily(spark, sf_dir)))))
    return rounded(out, "freq", "period", to=6).select("symbol", "k", "freq", "period")


@query(f"""WITH {MONTHS}, f AS (SELECT symbol, k, any_value(n) AS n, sum(x * cos(2 * pi() * ((k * i) % n) / n)) AS re, -sum(x * sin(2 * pi() * ((k * i) % n) / n)) AS im FROM p, (SELECT unnest(range(0, 2000)) AS k) WHERE k < n GROUP BY symbol, k),
    g AS (SELECT symbol, k, n, re, CASE WHEN k = 0 OR 2 * k = n THEN 0.0 ELSE im END AS im FROM f)
    SELECT symbol, k::BIGINT AS k, round(re / n, 3) + 0.0 AS re, round(im / n, 3) + 0.0 AS im, round(sqrt(re * re + im * im) / n, 3) AS absolute, round(atan2(im, re), 3) + 0.0 AS angle FROM g""")
def fft_table(spark, sf_dir):
    """All but the angle over the number of months, so that rounding is alike for all."""
    df = _monthly(spark, sf_dir)
    n = df.where("close is not null").groupBy("symbol").agg(F.count("*").alias("n"))
    out = spectral.fft_table(df).join(n, "symbol").withColumns({c: F.col(c) / F.col("n") for c in ("re", "im", "absolute")}).drop("n")
    return rounded(out, "re", "im", "absolute", "angle", to=3).withColumns({c: F.col(c) + F.lit(0.0) for c in ("re", "im", "angle")})


KEPT = [5, 10, 25, 50]


@query(f"""WITH {MONTHS}, g AS (SELECT symbol, k, any_value(n) AS n, sum(x * cos(2 * pi() * ((k * i) % n) / n)) AS re, -sum(x * sin(2 * pi() * ((k * i) % n) / n)) AS im FROM p, (SELECT unnest(range(0, 2000)) AS k) WHERE k < n GROUP BY symbol, k),
    v AS (SELECT p.symbol AS symbol, p.i AS i, p.n AS n, k, (re * cos(2 * pi() * ((k * p.i) % p.n) / p.n) - im * sin(2 * pi() * ((k * p.i) % p.n) / p.n)) / p.n AS part FROM p JOIN g ON p.symbol = g.symbol)
    SELECT symbol, i::BIGINT AS pos, """ + ", ".join(f"round(sum(part) FILTER (k < {k} OR k >= n - {k}) + 0.0001234, 3) AS rec_{k}" for k in KEPT) + " FROM v GROUP BY symbol, i")
def fft_reconstruct(spark, sf_dir):
    """A little is added before rounding, as means of cents often lie half-way between two rounded values."""
    out = spectral.reconstruct(_monthly(spark, sf_dir), KEPT)
    out = out.withColumns({f"rec_{k}": F.col(f"rec_{k}") + 0.0001234 for k in KEPT})
    pos = (F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1).cast("long")
    return rounded(out, *(f"rec_{k}" for k in KEPT), to=3).select("symbol", pos.alias("pos"), *(f"rec_{k}" for k in KEPT))


def _dickey_fuller_sql(source: str, column: str) -> str:
    """(symbol, n, statistic) of the regression of changes on the value before, by symbol."""
    return f"""SELECT symbol, count(*) AS n, regr_slope(d, l) / sqrt((regr_syy(d, l) - regr_sxy(d, l) ^ 2 / regr_sxx(d, l)) / (count(*) - 2) / regr_sxx(d, l)) AS statistic
        FROM (SELECT symbol, lag(x) OVER w AS l, x - lag(x) OVER w AS d FROM (SELECT symbol, time, {column} AS x FROM {source} WHERE {column} IS NOT NULL) WINDOW w AS (PARTITION BY symbol ORDER BY time)) WHERE d IS NOT NULL GROUP BY symbol"""


# Where p is 0.05 at most: the polynomial of the p-value at the normal distribution's 5 % point.
STATIONARY = "(statistic < -18.83 OR (statistic <= -1.61 AND 2.1659 + 1.4412 * statistic + 0.038269 * statistic ^ 2 <= -1.6448536269514722))"


@query(_d(f"SELECT symbol, n, round(statistic, 5) AS statistic, round(-3.43035 - 6.5393 / n - 16.786 / n ^ 2 - 79.433 / n ^ 3, 5) AS crit_1, {STATIONARY} AS stationary FROM ({_dickey_fuller_sql('bars', 'close')})"))
def dickey_fuller(spark, sf_dir):
    """Without lags, so that SQL can say it."""
    return rounded(stats.stationarity(bars_daily(spark, sf_dir), "adf", max_lag=0), "statistic", "crit_1", to=5).select("symbol", "n", "statistic", "crit_1", "stationary")


def _kpss_sql(column: str) -> str:
    most = "CAST(floor(n ** (2.0::DOUBLE / 9)) AS BIGINT)"
    return f"""SELECT symbol, 'kpss' AS test, '{column}' AS series, statistic, greatest(0.01, least(0.10, CASE WHEN statistic < 0.463 THEN 0.10 + (statistic - 0.347) / (0.463 - 0.347) * (0.05 - 0.10)
            WHEN statistic < 0.574 THEN 0.05 + (statistic - 0.463) / (0.574 - 0.463) * (0.025 - 0.05) ELSE 0.025 + (statistic - 0.574) / (0.739 - 0.574) * (0.01 - 0.025) END)) AS p_value, lags, n
        FROM (WITH x AS (SELECT symbol, {column} - avg({column}) OVER (PARTITION BY symbol) AS e, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n FROM s WHERE {column} IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY time)),
            g AS (SELECT a.symbol AS symbol, b.i - a.i AS k, sum(a.e * b.e) AS c, any_value(a.n) AS n FROM x a JOIN x b ON a.symbol = b.symbol AND b.i >= a.i GROUP BY ALL),
            m AS (SELECT symbol, any_value(n) AS n, sum(c / n) FILTER (k = 0) + coalesce(sum(c / (n / 2)) FILTER (k BETWEEN 1 AND {most}), 0) AS s0, coalesce(sum(k * c / (n / 2)) FILTER (k BETWEEN 1 AND {most}), 0) AS s1 FROM g GROUP BY symbol),
            h AS (SELECT symbol, n, least(CAST(floor(1.1447::DOUBLE * ((s1 / s0) ** 2) ** (1.0::DOUBLE / 3) * n ** (1.0::DOUBLE / 3)) AS BIGINT), n - 1) AS lags FROM m),
            v AS (SELECT symbol, h.n AS n, any_value(lags) AS lags, (sum(c) FILTER (k = 0) + 2 * coalesce(sum((1 - k / (lags + 1)) * c) FILTER (k BETWEEN 1 AND lags), 0)) / h.n AS variance FROM g JOIN h USING (symbol) GROUP BY symbol, h.n),
            u AS (SELECT symbol, sum(c ^ 2) AS q FROM (SELECT symbol, sum(e) OVER (PARTITION BY symbol ORDER BY i) AS c FROM x) GROUP BY symbol)
            SELECT symbol, lags, n, q / n ^ 2 / variance AS statistic FROM v JOIN u USING (symbol))"""


@query(_d(f"SELECT symbol, test, series, round(statistic, 5) AS statistic, round(p_value, 5) AS p_value, lags, n, p_value >= 0.05 AS stationary FROM (WITH s AS (SELECT *, close - lag(close) OVER {W} AS close_diff FROM bars) {_kpss_sql('close')} UNION ALL {_kpss_sql('close_diff')})"))
def kpss(spark, sf_dir):
    df = features.diff(bars_daily(spark, sf_dir))
    both = stats.stationarity(df, "kpss").unionByName(stats.stationarity(df, "kpss", "close_diff"))
    return rounded(both, "statistic", "p_value", to=5).select("symbol", "test", "series", "statistic", "p_value", "lags", "n", "stationary")


def _eliminated(name: str, vectors: str, ridge: float = 0.0, other: str = "i <= k + 1") -> str:
    """Steps of Gauss's elimination, one a row (symbol, k, m, w), on the moments of each symbol's vectors (symbol, t, v). other: the rows that stay."""
    return f"""{name}_e AS (SELECT symbol, t, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM ({vectors})),
        {name}_g AS (SELECT a.symbol AS symbol, a.i AS i, b.i AS j, sum(a.x * b.x) + max(CASE WHEN a.i = b.i THEN {ridge} ELSE 0 END) AS s FROM {name}_e a JOIN {name}_e b ON a.symbol = b.symbol AND a.t = b.t GROUP BY ALL),
        {name}_m AS (SELECT symbol, list(r ORDER BY i) AS m FROM (SELECT symbol, i, list(s ORDER BY j) AS r FROM {name}_g GROUP BY ALL) GROUP BY symbol),
        {name} AS (SELECT symbol, 0 AS k, m, len(m) AS w FROM {name}_m UNION ALL
            SELECT symbol, k + 1, list_transform(m, lambda r, i: CASE WHEN {other} THEN r ELSE list_transform(r, lambda q, j: q - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END), w FROM {name} WHERE k < w - 1)"""


def _adf_sql(source: str, column: str) -> str:
    """The test with lags by AIC: of all orders at once by elimination on one sample, then of the best on its own. source: (symbol, time, column)."""
    lagged = "list_reverse(d[t - {p} + 1:t])"
    one = f"SELECT symbol, t, list_concat([1.0::DOUBLE, y[t + 1]], {lagged.format(p='most')}, [d[t + 1]]) AS v FROM (SELECT *, unnest(range(most, n - 1)) AS t FROM b)"
    two = f"SELECT symbol, t, list_concat([1.0::DOUBLE], {lagged.format(p='lags')}, [y[t + 1], d[t + 1]]) AS v FROM (SELECT *, unnest(range(lags, n - 1)) AS t FROM b JOIN best USING (symbol))"
    return f"""SELECT symbol, '{column}' AS series, round(statistic, 5) AS statistic, lags, n, round(-3.43035 - 6.5393 / n - 16.786 / n ^ 2 - 79.433 / n ^ 3, 5) AS crit_1, round(-2.86154 - 2.8903 / n - 4.234 / n ^ 2 - 40.04 / n ^ 3, 5) AS crit_5,
        round(-2.56677 - 1.5384 / n - 2.809 / n ^ 2, 5) AS crit_10, {STATIONARY} AS stationary FROM (
        WITH RECURSIVE x AS (SELECT symbol, time, {column} - avg({column}) OVER (PARTITION BY symbol) AS x FROM ({source}) WHERE {column} IS NOT NULL),
        b AS (SELECT *, list_transform(range(1, n), lambda j: y[j + 1] - y[j]) AS d, least(ceil(12 * (n / 100) ** 0.25::DOUBLE)::BIGINT, n // 2 - 2) AS most FROM (SELECT symbol, list(x ORDER BY time) AS y, count(*) AS n FROM x GROUP BY symbol)),
        {_eliminated("z", one)},
        best AS (SELECT symbol, arg_min(k - 2, (n - 1 - most) * ln(m[w][w] / (n - 1 - most)) + 2 * k) AS lags FROM z JOIN b USING (symbol) WHERE k >= 2 GROUP BY symbol),
        {_eliminated("u", two)}
        SELECT symbol, lags, n - 1 - lags AS n, m[w - 1][w] / m[w - 1][w - 1] / sqrt((m[w][w] - m[w - 1][w] ^ 2 / m[w - 1][w - 1]) / (n - 2 * lags - 3) / m[w - 1][w - 1]) AS statistic FROM u JOIN b USING (symbol) JOIN best USING (symbol) WHERE k = lags + 1)"""


def _tested(df: DataFrame) -> DataFrame:
    return rounded(df, "statistic", "crit_1", "crit_5", "crit_10", to=5).select("symbol", "series", "statistic", "lags", "n", "crit_1", "crit_5", "crit_10", "stationary")


@query(f"{_adf_sql(BARS_D, 'close')} UNION ALL {_adf_sql(f'SELECT symbol, time, close - lag(close) OVER {W} AS close_diff FROM ({BARS_D})', 'close_diff')}")
def adf(spark, sf_dir):
    """Lags by AIC. The p-value has no SQL, what follows from it has."""
    df = features.diff(bars_daily(spark, sf_dir))
    return _tested(stats.stationarity(df, "adf").unionByName(stats.stationarity(df, "adf", "close_diff")))


ORDERED_TICKS = "SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS time, value FROM events"


@query(_adf_sql(ORDERED_TICKS, "value"))
def tick_adf(spark, sf_dir):
    """Over single ticks, from lagged sums of chunks."""
    return _tested(long.adf(ticks(spark, sf_dir), "value", F.date_trunc("hour", "time"), spec=TICKS))


@query(f"SELECT symbol, test, series, round(statistic, 5) AS statistic, round(p_value, 5) AS p_value, lags, n, p_value >= 0.05 AS stationary FROM (WITH s AS ({ORDERED_TICKS}) {_kpss_sql('value')})")
def tick_kpss(spark, sf_dir):
    """Over single ticks, from lagged sums and squares of partial sums of chunks."""
    df = long.kpss(ticks(spark, sf_dir), "value", F.date_trunc("hour", "time"), spec=TICKS)
    return rounded(df, "statistic", "p_value", to=5).select("symbol", "test", "series", "statistic", "p_value", "lags", "n", "stationary")


FRACTION = stats.fractional_weights(0.4, 20)


@query(_d("SELECT symbol, time, round(" + " + ".join(f"({w!r})::DOUBLE * " + (f"lag(close, {k}) OVER w" if k else "close") for k, w in enumerate(FRACTION)) + ", 4) AS fracdiff FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)"))
def fractional_difference(spark, sf_dir):
    return rounded(stats.fractional_difference(bars_daily(spark, sf_dir), 0.4), "fracdiff").select("symbol", "time", "fracdiff")


TICK_PLACED = f"SELECT symbol, time - 1 AS pos, value AS close FROM ({ORDERED_TICKS})"


@query(f"""WITH {ACF.replace(PLACED, TICK_PLACED)}, e AS (SELECT *, CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054 * sqrt((1 + 2 * coalesce(sum(acf * acf) FILTER (lag > 0) OVER (PARTITION BY symbol ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS d FROM z)
    SELECT symbol, lag, round(acf, 6) + 0.0 AS acf, round(acf - d, 6) + 0.0 AS low, round(acf + d, 6) + 0.0 AS high FROM e""")
def tick_acf(spark, sf_dir):
    """Over single ticks, from lagged sums of chunks."""
    return rounded(long.acf(ticks(spark, sf_dir), 10, "value", F.date_trunc("hour", "time"), TICKS), "acf", "low", "high", to=6)


@query(PACF.replace(PLACED, TICK_PLACED))
def tick_pacf(spark, sf_dir):
    return rounded(long.pacf(ticks(spark, sf_dir), 10, "value", F.date_trunc("hour", "time"), TICKS), "pacf", "low", "high", to=6)


@query(f"SELECT symbol, pos + 1 AS pos, round(close - (regr_intercept(close, pos) OVER s + regr_slope(close, pos) OVER s * pos), 4) AS detrended FROM ({TICK_PLACED}) WINDOW s AS (PARTITION BY symbol)")
def tick_detrend(spark, sf_dir):
    """Over single ticks: the line is one aggregate, joined back."""
    made = positioned(long.detrend(ticks(spark, sf_dir), "value", F.date_trunc("hour", "time"), TICKS), TICKS, F.date_trunc("hour", "time"))
    return made.select("symbol", (F.col("_pos") + 1).cast("long").alias("pos"), F.round("value_detrend", 4).alias("detrended"))


P_TICKS = f"p AS (SELECT symbol, value AS x, time - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({ORDERED_TICKS}))"


@query(f"""WITH {P_TICKS}, f AS (SELECT symbol, k, any_value(n) AS n, sum(x * cos(2 * pi() * ((k * i) % n) / n)) AS re, sum(x * sin(2 * pi() * ((k * i) % n) / n)) AS im FROM p JOIN (SELECT DISTINCT n AS m, unnest(range(0, n // 2 + 1)) AS k FROM p) ON m = n GROUP BY symbol, k)
    SELECT symbol, k::BIGINT AS k, round(k / n, 6) AS freq, round(sqrt(re * re + im * im) / n, 4) AS amplitude FROM f""")
def tick_spectrum(spark, sf_dir):
    """Over single ticks, by the four-step method; amplitudes over the number of ticks."""
    df = ticks(spark, sf_dir)
    n = df.groupBy("symbol").agg(F.count("value").alias("n"))
    out = fourier.rfft(df, "value", F.date_trunc("hour", "time"), TICKS).join(n, "symbol").withColumn("amplitude", F.col("amplitude") / F.col("n"))
    return rounded(rounded(out, "freq", to=6), "amplitude").select("symbol", "k", "freq", "amplitude")


@query(f"""WITH {P_TICKS}, w AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE -exp(sum(ln(abs((k - 1.4::DOUBLE) / greatest(k, 1)))) FILTER (k > 0) OVER (ORDER BY k)) END AS w FROM (SELECT unnest(range(0, max(n))) AS k FROM p))
    SELECT a.symbol AS symbol, a.i + 1 AS pos, round(sum(w * b.x), 4) + 0.0 AS fracdiff FROM p a JOIN p b ON a.symbol = b.symbol AND b.i <= a.i JOIN w ON k = a.i - b.i GROUP BY ALL""")
def tick_fractional_difference(spark, sf_dir):
    """Over single ticks, with the weights of all lags, by one convolution."""
    made = fourier.fractional_difference(ticks(spark, sf_dir), 0.4, "value", F.date_trunc("hour", "time"), TICKS)
    placed = positioned(made, TICKS, F.date_trunc("hour", "time"))
    return placed.select("symbol", (F.col("_pos") + 1).cast("long").alias("pos"), (F.round("fracdiff", 4) + F.lit(0.0)).alias("fracdiff"))


ORDERS = [0.0, 0.4, 1.0]
ORDERED = ", ".join("round(" + " + ".join(f"({w!r})::DOUBLE * " + (f"lag(close, {k}) OVER w" if k else "close") for k, w in enumerate(stats.fractional_weights(d, 20))) + f", 9) AS d_{i}" for i, d in enumerate(ORDERS))


@query(_d("SELECT symbol, min(d) AS d FROM (" + " UNION ALL ".join(f"SELECT symbol, CASE WHEN {STATIONARY} THEN {d}::DOUBLE END AS d FROM ({_dickey_fuller_sql('o', f'd_{i}')})" for i, d in enumerate(ORDERS)) + ") GROUP BY symbol").replace(") SELECT symbol, min(d)", f"), o AS (SELECT symbol, time, {ORDERED} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)) SELECT symbol, min(d)", 1))
def fractional_order(spark, sf_dir):
    """The least of a few orders of differencing that the test without lags calls stationary."""
    return stats.least_stationary_order(bars_daily(spark, sf_dir), ORDERS, max_lag=0)


NAIVE = f"SELECT symbol, time, close AS truth, lag(close) OVER {W} AS predicted FROM bars"


def _scores_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, avg((truth - predicted) ^ 2) AS mse, sqrt(avg((truth - predicted) ^ 2)) AS rmse, avg(abs(truth - predicted)) AS mae,
        avg(abs(truth - predicted) / greatest(abs(truth), 2.220446049250313e-16::DOUBLE)) AS mape FROM ({source}) WHERE truth IS NOT NULL AND predicted IS NOT NULL GROUP BY {keys}"""


@query(_d(f"SELECT symbol, round(mae, 4) AS mae FROM ({_scores_sql(NAIVE, 'symbol')})"))
def baseline_mae(spark, sf_dir):
    """In the units of the price."""
    rows = forecast.naive(bars_daily(spark, sf_dir)).withColumnRenamed("close", "truth")
    return rounded(forecast.score(rows, ["symbol"]).select("symbol", "mae"), "mae")


SMOOTHED = f"""SELECT symbol, time, 'naive' AS model, close AS truth, lag(close) OVER {W} AS predicted FROM bars
    UNION ALL SELECT symbol, time, 'mean_10' AS model, close AS truth, avg(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS predicted FROM bars"""


def _two_models(spark, sf_dir) -> DataFrame:
    df = bars_daily(spark, sf_dir)
    w = Window.partitionBy("symbol").orderBy("time")
    made = df.select("symbol", "time", F.col("close").alias("truth"), F.lag("close", 1).over(w).alias("naive"), F.avg("close").over(w.rowsBetween(-10, -1)).alias("mean_10"))
    return made.unpivot(["symbol", "time", "truth"], ["naive", "mean_10"], "model", "predicted")


@query(_d(f"SELECT symbol, model, round(mse, 1) AS mse, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 6) AS mape FROM ({_scores_sql(SMOOTHED, 'symbol, model')})"))
def metrics(spark, sf_dir):
    return rounded(rounded(rounded(forecast.score(_two_models(spark, sf_dir), ["symbol", "model"]), "mse", to=1), "rmse", "mae"), "mape", to=6)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(_d("SELECT model, " + ", ".join(f"""round(max(mae) FILTER (symbol = '{p}'), 4) AS "{p}\"""" for p in PRIORITIES) + f" FROM ({_scores_sql(SMOOTHED, 'symbol, model')}) GROUP BY model"))
def metrics_pivot(spark, sf_dir):
    pivoted = forecast.pivot_scores(forecast.score(_two_models(spark, sf_dir), ["symbol", "model"]), PRIORITIES)
    return pivoted.select("model", *(F.round(f"`{p}`", 4).alias(p) for p in PRIORITIES))


INPUTS = ["open", "high", "low", "close", "volume"]


@query()
def arima(spark, sf_dir):
    return rounded(forecast.arima(features.diff(bars_daily(spark, sf_dir))), "predicted", "low", "high", "mean", "phi", "theta", to=2)


@query()
def arima_summary(spark, sf_dir):
    return rounded(forecast.arima_summary(features.diff(bars_daily(spark, sf_dir))), "estimate", "std_error", "z", "log_likelihood", "aic", "bic", to=2)


#: Mean, phi and theta of the first four fifths of each symbol's ticks by their autocorrelations, and the exact likelihood there.
LIKELIHOOD = f"""WITH t AS (SELECT symbol, time, value FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM ({ORDERED_TICKS})) WHERE time - 1 < floor(n * 0.8::DOUBLE)),
    e AS (SELECT symbol, time, avg(value) OVER (PARTITION BY symbol) AS mean, value - avg(value) OVER (PARTITION BY symbol) AS x FROM t),
    l AS (SELECT symbol, time, mean, x, lag(x, 1) OVER {W} AS x1, lag(x, 2) OVER {W} AS x2 FROM e),
    m AS (SELECT symbol, count(*) AS n, any_value(mean) AS mean, sum(x * x1) / sum(x * x) AS r1, sum(x * x2) / sum(x * x) AS r2, list(x ORDER BY time) AS xs FROM l GROUP BY symbol),
    p AS (SELECT *, phi - r1 AS a, 1 + phi ^ 2 - 2 * phi * r1 AS b FROM (SELECT *, greatest(-0.9, least(0.9, r2 / r1)) AS phi FROM m)),
    q AS (SELECT *, greatest(-0.9, least(0.9, -2 * a / (b + sign(b) * sqrt(greatest(0, b ^ 2 - 4 * a ^ 2))))) AS theta FROM p),
    z AS (SELECT *, list_reduce(list_prepend([0, 0, 0, (1 + 2 * phi * theta + theta ^ 2) / (1 - phi ^ 2)], list_transform(xs, lambda v: [v])),
        lambda s, v: [phi * v[1] + theta / s[4] * (v[1] - s[1]), s[2] + (v[1] - s[1]) ^ 2 / s[4], s[3] + ln(s[4]), 1 + theta ^ 2 - theta ^ 2 / s[4]]) AS s FROM q)"""


@query(f"{LIKELIHOOD} SELECT symbol, n, round(mean, 4) AS mean, round(phi, 5) AS phi, round(theta, 5) AS theta, round(s[2] / n, 2) AS variance, round(-0.5 * (n * (ln(2 * pi() * s[2] / n) + 1) + s[3]), 2) AS likelihood, round(s[1], 4) + 0.0 AS ahead FROM z")
def tick_likelihood(spark, sf_dir):
    """Where the fit over single ticks begins: the moments' estimate, its exact likelihood and the next forecast, from composed chunks."""
    hour = F.date_trunc("hour", "time")
    placed, chunks = long_arima.in_stretches(ticks(spark, sf_dir), "value", hour, 0.8, TICKS, long.CHUNK)
    start = long_arima.moment_estimate(long_arima.moments(placed, 0.8, TICKS, hour, long.CHUNK), TICKS)
    told = long_arima.likelihoods(chunks, start.select("symbol", F.array(F.array("mean", "phi", "theta")).alias("params")), TICKS).join(start, "symbol")
    return rounded(rounded(rounded(told, "phi", "theta", to=5), "variance", "likelihood", to=2), "mean", "ahead").select("symbol", "n", "mean", "phi", "theta", "variance", "likelihood", (F.col("ahead") + F.lit(0.0)).alias("ahead"))


@query()
def tick_arima(spark, sf_dir):
    """The most likely fit over single ticks, and its forecast with band."""
    made = long_arima.arima(ticks(spark, sf_dir), "value", F.date_trunc("hour", "time"), spec=TICKS)
    return rounded(made, "predicted", "low", "high", "mean", "phi", "theta", to=2)


RESIDUALS = f"SELECT symbol, time, value - lag(value) OVER {W} AS r FROM ({ORDERED_TICKS})"
MOMENTS = "SELECT symbol, n, s2, s3 / n / (s2 / n) ^ 1.5 AS skew, s4 / n / (s2 / n) ^ 2 AS kurtosis FROM (SELECT symbol, count(*) AS n, sum(x ^ 2) AS s2, sum(x ^ 3) AS s3, sum(x ^ 4) AS s4 FROM x GROUP BY symbol)"


@query(f"""WITH x AS (SELECT symbol, r, r - avg(r) OVER (PARTITION BY symbol) AS x, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({RESIDUALS}) WHERE r IS NOT NULL),
    m AS ({MOMENTS}), g AS (SELECT a.symbol AS symbol, b.i - a.i AS k, sum(a.x * b.x) AS c FROM x a JOIN x b ON a.symbol = b.symbol AND b.i - a.i BETWEEN 1 AND 10 GROUP BY ALL),
    q AS (SELECT symbol, any_value(n) * (any_value(n) + 2) * sum((c / s2) ^ 2 / (n - k)) AS q FROM g JOIN m USING (symbol) GROUP BY symbol),
    h AS (SELECT symbol, sum(r ^ 2) FILTER (i > n - round(n / 3)) / sum(r ^ 2) FILTER (i <= round(n / 3)) AS h FROM x GROUP BY symbol)
    SELECT symbol, n, round(q, 3) AS ljung_box, round(exp(-q / 2) * (1 + q / 2 + (q / 2) ^ 2 / 2 + (q / 2) ^ 3 / 6 + (q / 2) ^ 4 / 24), 6) AS ljung_box_p, round(skew, 6) + 0.0 AS skew, round(kurtosis, 6) AS kurtosis,
        round(n / 6 * (skew ^ 2 + (kurtosis - 3) ^ 2 / 4), 4) AS jarque_bera, round(exp(-(n / 6 * (skew ^ 2 + (kurtosis - 3) ^ 2 / 4)) / 2), 6) AS jarque_bera_p, round(h, 6) AS heteroskedasticity FROM m JOIN q USING (symbol) JOIN h USING (symbol)""")
def residual_diagnostics(spark, sf_dir):
    """What the naive forecast leaves over single ticks: autocorrelation, skew, kurtosis, normality, changing spread."""
    hour = F.date_trunc("hour", "time")
    rest = diagnostics.lagged_residuals(ticks(spark, sf_dir), "value", hour, TICKS)
    made = diagnostics.residual_tests(rest, "residual", hour, 10, TICKS)
    made = rounded(rounded(rounded(made, "ljung_box_p", "skew", "kurtosis", "jarque_bera_p", "heteroskedasticity", to=6), "jarque_bera"), "ljung_box", to=3)
    return made.withColumn("skew", F.col("skew") + F.lit(0.0))


def _polynomial_sql(x: str, coefficients: tuple[float, ...]) -> str:
    value = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        value = f"({value} * {x} + {c!r}::DOUBLE)"
    return value


TAIL_SQL = f"{_polynomial_sql('u', diagnostics.TAIL_ABOVE)} / {_polynomial_sql('u', diagnostics.TAIL_BELOW)}"


@query(f"""SELECT symbol, rank, round(CASE WHEN p < {diagnostics.TAIL} THEN {TAIL_SQL} WHEN p > 1 - {diagnostics.TAIL} THEN -({TAIL_SQL})
        ELSE {_polynomial_sql('((p - 0.5) ^ 2)', diagnostics.CENTRE_ABOVE)} * (p - 0.5) / {_polynomial_sql('((p - 0.5) ^ 2)', diagnostics.CENTRE_BELOW)} END, 6) + 0.0 AS theoretical, round(z, 6) + 0.0 AS sample
    FROM (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS u FROM (SELECT symbol, rank, z, rank / (n + 1) AS p FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY r) AS rank, count(*) OVER (PARTITION BY symbol) AS n,
        (r - avg(r) OVER (PARTITION BY symbol)) / stddev_samp(r) OVER (PARTITION BY symbol) AS z FROM ({RESIDUALS}) WHERE r IS NOT NULL)))""")
def residual_quantiles(spark, sf_dir):
    """The same residuals' quantiles against the normal distribution's, by exact ranks."""
    rest = diagnostics.lagged_residuals(ticks(spark, sf_dir), "value", F.date_trunc("hour", "time"), TICKS)
    made = rounded(diagnostics.quantile_pairs(rest, "residual", TICKS), "theoretical", "sample", to=6)
    return made.withColumns({c: F.col(c) + F.lit(0.0) for c in ("theoretical", "sample")})


ALL_SCALED = ", ".join(f"({c} - avg({c}) FILTER (split = 'train') OVER s) / nullif(stddev_samp({c}) FILTER (split = 'train') OVER s, 0) AS z_{c}" for c in INPUTS)
SCALED_ROWS = f"SELECT symbol, time, split, {ALL_SCALED}, sin((isodow(time) - 1) * 2 * pi() / 7) AS z_sin, cos((isodow(time) - 1) * 2 * pi() / 7) AS z_cos FROM ({SPLIT3}) WINDOW s AS (PARTITION BY symbol)"
NAIVE_SCALED = "SELECT symbol, truth, predicted FROM (SELECT symbol, split, z_close AS truth, lag(z_close) OVER (PARTITION BY symbol ORDER BY time) AS predicted FROM z) WHERE split = 'test'"


@query(_d(f"SELECT symbol, round(mse, 4) AS mse, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 4) AS mape FROM (WITH z AS ({SCALED_ROWS}) {_scores_sql(NAIVE_SCALED, 'symbol')})"))
def naive_scaled_scores(spark, sf_dir):
    """The baseline in the units of the models."""
    return rounded(forecast.score(forecast.naive_scaled(bars_daily(spark, sf_dir)), ["symbol"]), "mse", "rmse", "mae", "mape")


@query(_d(f"""SELECT symbol, split, place, count(*) AS n, round(avg(x), 2) + 0.0 AS mean, round(avg(y), 2) + 0.0 AS label FROM (
    WITH z AS ({SCALED_ROWS}), p AS (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY time) - 1 AS at, count(*) OVER (PARTITION BY symbol, split) AS rows FROM z),
    w AS (SELECT b.symbol AS symbol, b.split AS split, b.z_close AS y, s.step AS step, [{', '.join(f'a.z_{c}' for c in [*INPUTS, 'sin', 'cos'])}] AS x FROM p b, (SELECT unnest(range(0, 5)) AS step) s
        JOIN p a ON a.symbol = b.symbol AND a.split = b.split AND a.at = b.at - 5 + s.step WHERE b.at >= 5 AND b.at <= b.rows - 2)
    SELECT symbol, split, y, (step * {len(INPUTS) + 2} + unnest(range(0, {len(INPUTS) + 2})))::INT AS place, unnest(x)::FLOAT AS x FROM w) GROUP BY ALL"""))
def model_inputs(spark, sf_dir):
    """What models are given: for each place of a window how many there are and their mean, by split."""
    windows = forecast.model_windows(bars_daily(spark, sf_dir), INPUTS)
    cells = windows.select("symbol", "split", "y", F.posexplode("x").alias("place", "x"))
    made = cells.groupBy("symbol", "split", "place").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.avg("y").alias("label"))
    return rounded(made, "mean", "label", to=2).withColumns({c: F.col(c) + F.lit(0.0) for c in ("mean", "label")})


LINEAR = f"""WITH RECURSIVE bars AS ({BARS_D}), z AS ({SCALED_ROWS}), p AS (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY time) - 1 AS at, count(*) OVER (PARTITION BY symbol, split) AS rows FROM z),
    s AS (SELECT b.symbol AS symbol, b.split AS split, b.time AS time, b.at AS t, b.z_close AS y, s.step AS step, [{', '.join(f'a.z_{c}' for c in [*INPUTS, 'sin', 'cos'])}]::FLOAT[] AS x FROM p b, (SELECT unnest(range(0, 5)) AS step) s
        JOIN p a ON a.symbol = b.symbol AND a.split = b.split AND a.at = b.at - 5 + s.step WHERE b.at >= 5 AND b.at <= b.rows - 2),
    v AS (SELECT symbol, split, time, t, y, flatten(list(x ORDER BY step))::DOUBLE[] AS x FROM s GROUP BY ALL),
    {_eliminated("g", "SELECT symbol, t, list_concat(x, [1.0::DOUBLE, y]) AS v FROM v WHERE split = 'train'", 1e-3, "i = k + 1")},
    c AS (SELECT symbol, list_transform(range(1, w), lambda i: m[i][w] / m[i][i]) AS c FROM g WHERE k = w - 1)
    """
DOT = "list_dot_product(x, c[1:len(x)]) + c[len(x) + 1]"


@query(f"{LINEAR} SELECT symbol, time, 'linear' AS model, round(y, 4) AS truth, round({DOT}, 4) AS predicted FROM v JOIN c USING (symbol) WHERE split = 'test'")
def linear_forecast(spark, sf_dir):
    windows = forecast.model_windows(bars_daily(spark, sf_dir), INPUTS)
    return rounded(forecast.predict_linear(windows, forecast.fit_linear(windows)), "truth", "predicted")


@query()
def trees_forecast(spark, sf_dir):
    windows = forecast.model_windows(bars_daily(spark, sf_dir), INPUTS)
    return rounded(forecast.predict_trees(windows, forecast.fit_trees(windows)), "truth", "predicted")


@query()
def training_history(spark, sf_dir):
    """The loss of each round on train and validation windows, and the seconds of the training."""
    return forecast.training_history(spark, forecast.fit_trees(forecast.model_windows(bars_daily(spark, sf_dir), INPUTS)))


@query()
def forecast_band(spark, sf_dir):
    """The changes of the price beside their forecast and its band, which begin where the fit ends."""
    return rounded(relations.with_band(features.diff(bars_daily(spark, sf_dir)), "close_diff"), "close_diff", "truth", "predicted", "low", "high", "mean", "phi", "theta", to=2)


@query()
def transfer(spark, sf_dir):
    """The first symbol's models on the others' test windows."""
    return rounded(forecast.transfer(bars_daily(spark, sf_dir), INPUTS, PRIORITIES[0]), "mse", "rmse", "mae", "mape", to=3)


ROUNDED_SCORES = "symbol, model, round(mse, 4) AS mse, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 3) AS mape"


@query(f"""{LINEAR} SELECT {ROUNDED_SCORES} FROM ({_scores_sql(f"SELECT symbol, 'linear' AS model, y AS truth, {DOT} AS predicted FROM v, (SELECT c FROM c WHERE symbol = '1-URGENT') WHERE split = 'test' AND symbol <> '1-URGENT'", 'symbol, model')})""")
def transfer_linear(spark, sf_dir):
    """The first symbol's coefficients on the others' test windows."""
    return rounded(rounded(forecast.transfer(bars_daily(spark, sf_dir), INPUTS, PRIORITIES[0], ("linear",)), "mse", "rmse", "mae"), "mape", to=3)


@query(f"""{LINEAR} SELECT {ROUNDED_SCORES} FROM ({_scores_sql(f"SELECT symbol, 'linear' AS model, y AS truth, {DOT} AS predicted FROM v JOIN c USING (symbol) WHERE split = 'test' UNION ALL SELECT symbol, 'naive' AS model, truth, predicted FROM ({NAIVE_SCALED})", 'symbol, model')})""")
def forecast_grid_linear(spark, sf_dir):
    """Symbols by models, the baseline among them."""
    return rounded(rounded(forecast.grid(bars_daily(spark, sf_dir), INPUTS, ("linear",)), "mse", "rmse", "mae"), "mape", to=3)


@query()
def forecast_grid(spark, sf_dir):
    return rounded(forecast.grid(bars_daily(spark, sf_dir), INPUTS), "mse", "rmse", "mae", "mape", to=3)


@query(_d("SELECT symbol, time, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k FROM bars) WHERE k <= 5"))
def head(spark, sf_dir):
    return profile.head(bars_daily(spark, sf_dir)).select("symbol", "time", "close")


@query(_d("SELECT symbol, time, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM bars) WHERE k <= 5"))
def tail(spark, sf_dir):
    return profile.tail(bars_daily(spark, sf_dir)).select("symbol", "time", "close")


@query(_hs("SELECT symbol, bool_or(close IS NULL) AS any_missing FROM bars GROUP BY symbol"))
def any_missing(spark, sf_dir):
    return profile.any_missing(bars_hourly_spined(spark, sf_dir), "close")


@query(f"WITH d AS ({BARS_D}), h AS (SELECT 'click' AS symbol, date_trunc('day', ts)::TIMESTAMP AS time, count(*) AS ticks FROM events GROUP BY ALL) SELECT symbol, time, coalesce(close, -1) AS close, coalesce(ticks, -1) AS ticks FROM d FULL JOIN h USING (symbol, time)")
def aligned(spark, sf_dir):
    """Two tables by a shared key, rows of either side kept; missing values as -1."""
    daily = bars_daily(spark, sf_dir).select("symbol", "time", "close")
    counts = ticks(spark, sf_dir).groupBy(F.lit("click").alias("symbol"), F.date_trunc("day", "time").cast("timestamp_ntz").alias("time")).agg(F.count("*").alias("ticks"))
    return align(daily, counts, ["symbol", "time"]).fillna(-1)


@query(_d(f"SELECT symbol, time, close, round(close - lag(close) OVER {W}, 4) AS close_diff, round(close - (regr_intercept(close, pos) OVER s + regr_slope(close, pos) OVER s * pos), 4) AS close_detrend, CASE WHEN close > 0 THEN round(ln(close), 6) END AS close_log FROM ({PLACED}) WINDOW s AS (PARTITION BY symbol)"))
def transformed_close(spark, sf_dir):
    return rounded(rounded(relations.transformed(bars_daily(spark, sf_dir)), "close_diff", "close_detrend"), "close_log", to=6)


@query(_d(f"""SELECT pos, coalesce(max(close) FILTER (symbol = '1-URGENT'), -1) AS urgent, coalesce(max(close) FILTER (symbol = '5-LOW'), -1) AS low FROM ({PLACED}) WHERE symbol IN ('1-URGENT', '5-LOW') GROUP BY pos"""))
def side_by_side(spark, sf_dir):
    return relations.side_by_side(bars_daily(spark, sf_dir), ["1-URGENT", "5-LOW"]).toDF("pos", "urgent", "low").fillna(-1.0)


@query()
def arima_residuals(spark, sf_dir):
    rows = forecast.arima(features.diff(bars_daily(spark, sf_dir)))
    return rounded(relations.residuals(rows).select("symbol", "time", "residual", "standardised"), "residual", "standardised")
