"""The driver tables as series, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import bars, spined
from ..sources.files import read_table


def bars_daily(spark, sf_dir: str) -> DataFrame:
    return bars(read_table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "day")


def bars_hourly(spark, sf_dir: str) -> DataFrame:
    return bars(read_table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id", "hour")


def bars_hourly_spined(spark, sf_dir: str) -> DataFrame:
    return spined(bars_hourly(spark, sf_dir))


def ticks(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("time"), "event_id", "value")


def _bars_sql(table: str, symbol: str, time: str, value: str, tiebreak: str, unit: str) -> str:
    at = f"row({time}, {tiebreak})"
    return f"""SELECT {symbol} AS symbol, date_trunc('{unit}', {time})::TIMESTAMP AS time, arg_min({value}, {at}) AS open, max({value}) AS high, min({value}) AS low,
        arg_max({value}, {at}) AS close, sum({value}) AS volume, count(*) AS n FROM {table} GROUP BY ALL"""


BARS_D = _bars_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "day")
BARS_H = _bars_sql("events", "event_type", "ts", "value", "event_id", "hour")
BARS_HS = f"""SELECT symbol, time, b.open, b.high, b.low, b.close, b.volume, b.n FROM (SELECT DISTINCT event_type AS symbol FROM events) CROSS JOIN
        (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR))::TIMESTAMP AS time FROM events)
        LEFT JOIN ({BARS_H}) b USING (symbol, time)"""
