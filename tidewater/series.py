"""What a series is: rows of a symbol in a stated, total order of time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeriesSpec:
    """Column names of a long table of series. time and tiebreak together must order a symbol's rows totally."""

    symbol: str = "symbol"
    time: str = "time"
    tiebreak: tuple[str, ...] = ()

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tiebreak]

    def window(self) -> WindowSpec:
        return Window.partitionBy(self.symbol).orderBy(*self.order)

    def backwards(self) -> WindowSpec:
        return Window.partitionBy(self.symbol).orderBy(*(F.col(c).desc() for c in self.order))

    def whole(self) -> WindowSpec:
        return Window.partitionBy(self.symbol)


BARS = SeriesSpec()

#: Rows of a chunk: a Python worker holds one chunk and some copies of it, so this bounds its memory, however long a series is.
CHUNK = 200_000


def position(spec: SeriesSpec) -> Column:
    """0, 1, 2 ... in a symbol."""
    return F.row_number().over(spec.window()) - 1


def instant(time: Column, tiebreak: Column | None) -> Column:
    """One number that orders by time, then tiebreak (0 <= tiebreak < 10**18): a plain hash aggregate can keep its smallest and largest.

    Without a tiebreak it is a long, which is about three times as fast as the wide decimal.
    """
    if tiebreak is None:
        return F.unix_micros(time.cast("timestamp"))
    micros = F.unix_micros(time.cast("timestamp")).cast("decimal(20,0)")
    return (micros * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)") + tiebreak.cast("decimal(20,0)")


def bars(ticks: DataFrame, symbol: str, time: str, value: str, tiebreak: str | None, unit: str) -> DataFrame:
    """open, high, low, close, volume and n of each symbol and unit of time ('hour', 'day'). tiebreak: None only if a symbol's times don't repeat.

    Summed before the shuffle; what leaves it is bounded by symbols and calendar, not by
    ticks, so windows over bars stay small however many ticks there are.
    """
    at = instant(F.col(time), None if tiebreak is None else F.col(tiebreak))
    return ticks.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(unit, F.col(time)).cast("timestamp_ntz").alias("time")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.sum(value).alias("volume"), F.count("*").alias("n")
    )


def spined(df: DataFrame, step: str = "interval 1 hour", spec: SeriesSpec = BARS) -> DataFrame:
    """df with a row for every step from the first to the last time of the whole table, for each symbol; values of added rows are null."""
    ends = df.agg(F.struct(F.min(spec.time).alias("first"), F.max(spec.time).alias("last"))).scalar()
    times = F.sequence(ends.getField("first"), ends.getField("last"), F.expr(step))
    grid = df.select(spec.symbol).distinct().select(spec.symbol, F.explode(times).alias(spec.time))
    return grid.join(df, [spec.symbol, spec.time], "left")


def align(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Columns of both, side by side, rows matched by a key; rows of either side alone are kept. Clashing names get an _r."""
    renamed = right.select(*(F.col(c).alias(c if c in on or c not in left.columns else f"{c}_r") for c in right.columns))
    return left.join(renamed, on, "full")


def positioned(df: DataFrame, spec: SeriesSpec, bucket: Column) -> DataFrame:
    """df with _pos, each row's position in its symbol, without a task that holds a symbol.

    bucket must not fall as time rises (a truncated time). Rows are numbered inside their
    bucket and shifted by the counts of the buckets before.
    """
    keyed = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(spec.symbol).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(spec.symbol, "_bucket").count()
    offsets = counts.select(spec.symbol, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(spec.symbol, "_bucket").orderBy(*spec.order)
    numbered = keyed.withColumn("_row", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [spec.symbol, "_bucket"]).withColumn("_pos", F.col("_offset") + F.col("_row")).drop("_bucket", "_row", "_offset")


def chunked(df: DataFrame, spec: SeriesSpec, bucket: Column, chunk_rows: int, before: int = 0, after: int = 0) -> DataFrame:
    """df with _pos, _chunk (chunk_rows rows each) and _at, the chunk a row serves: its own, and as one of the before rows ahead of a chunk or the after rows behind it, a neighbour's too."""
    if max(before, after) > chunk_rows:
        raise ValueError("rows of neighbours must not exceed chunk_rows")
    placed = positioned(df, spec, bucket).withColumn("_chunk", F.floor(F.col("_pos") / chunk_rows))
    within = F.col("_pos") % chunk_rows
    serves = F.array_compact(F.array("_chunk", F.when(within >= chunk_rows - before, F.col("_chunk") + 1), F.when((within < after) & (F.col("_chunk") > 0), F.col("_chunk") - 1)))
    return placed.withColumn("_at", F.explode(serves))


def in_chunks(df: DataFrame, spec: SeriesSpec, bucket: Column, before: int, frame: Callable[[WindowSpec], dict[str, Column]], chunk_rows: int = CHUNK) -> DataFrame:
    """frame's columns for series too long for one task: each reads at most before rows back.

    A series is cut into chunks of chunk_rows; the last rows of a chunk also go to the next,
    where they only serve its first frames. The result is that of one window over the symbol.
    """
    copied = chunked(df, spec, bucket, chunk_rows, before)
    window = Window.partitionBy(spec.symbol, "_at").orderBy("_pos")
    return copied.withColumns(frame(window)).where("_at = _chunk").drop("_pos", "_chunk", "_at")
