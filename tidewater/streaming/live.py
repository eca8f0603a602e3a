"""The causal operators on streams: bars by event time, and exponential means with kept state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import instant

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_bars(ticks: DataFrame, symbol: str, time: str, value: str, tiebreak: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Bars of windows of event time; ticks later than late are left out, so state stays bounded. Works on a table too."""
    at = instant(F.col(time), F.col(tiebreak))
    grouped = ticks.withWatermark(time, late).groupBy(F.col(symbol).alias("symbol"), F.window(time, width).alias("w"))
    made = grouped.agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.sum(value).alias("volume"), F.count("*").alias("n"))
    return made.select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume", "n")


def stream_ema(ticks: DataFrame, span: int, symbol: str, order: list[str], value: str) -> DataFrame:
    """ema_n of each tick as it comes; a symbol's state is one number. Batches must come in order; values must be known."""
    a = 2.0 / (span + 1)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ticks.schema.fields), f"ema_{span} double"])

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(frames)).sort_values(order)
        y, out = state.get[0] if state.exists else None, []
        for x in group[value]:
            y = x if y is None else (1 - a) * y + a * x
            out.append(y)
        state.update((y,))
        yield group.assign(**{f"ema_{span}": out})

    return ticks.groupBy(symbol).applyInPandasWithState(run, schema, "y double", "append", "NoTimeout")


def smoother(span: int):
    """step(state, x) -> state of the exponential mean: state is (mean, weight), None before the first known value.

    A gap (None) carries the mean and lowers its weight against the next known value, as in features.ema.
    """
    a = 2.0 / (span + 1)

    def step(state: tuple[float, float] | None, x: float | None) -> tuple[float, float] | None:
        if state is None:
            return None if x is None else (x, 1.0)
        mean, weight = state[0], state[1] * (1 - a)
        return (mean, weight) if x is None else ((weight * mean + a * x) / (weight + a), 1.0)

    return step


#: A tick that waits, the block of time that waiting ticks are kept in, and how many are gathered before they are put away.
TICK = np.dtype([("at", "<i8"), ("tie", "<i8"), ("x", "<f8")])
BLOCK_US = 3_600_000_000
GATHERED = 500_000


def _in_order(ticks: list[np.ndarray]) -> np.ndarray:
    joined = np.concatenate(ticks)
    return joined[np.lexsort((joined["tie"], joined["at"]))]


def _ema_processor(span: int, slot_ms: int, out_rows: int = 100_000):
    """What keeps a symbol's mean and its ticks that may still be overtaken.

    Ticks wait as bytes, those of an hour together, so the state is read and written by blocks and
    not by ticks, and an hour at a time is in memory.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    slot_us = slot_ms * 1000

    class Smoothed(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.step = smoother(span)
            self.mean = handle.getValueState("mean", "mean double, weight double")
            self.parts = handle.getValueState("parts", "n long")
            self.waiting = handle.getMapState("waiting", "block long, part long", "ticks binary")

        def wait(self, held: list[np.ndarray]) -> None:
            """A new part, for each block of time that the ticks held fall into. Part 0 is what a timer left."""
            part = self.parts.get()[0] + 1 if self.parts.exists() else 1
            self.parts.update((part,))
            ticks = _in_order(held)
            blocks = ticks["at"] // BLOCK_US
            for run in np.split(ticks, np.flatnonzero(np.diff(blocks)) + 1):
                self.waiting.updateValue((int(run["at"][0] // BLOCK_US), part), (run.tobytes(),))

        def wake(self, at: int) -> None:
            """When the watermark has passed a slot, no tick of it can come any more."""
            self.handle.registerTimer((at // slot_us + 1) * slot_ms)

        def handleInputRows(self, key, rows, timerValues):
            held, n, least = [], 0, None
            for frame in rows:
                if frame.empty:
                    continue
                ticks = np.empty(len(frame), TICK)
                ticks["at"], ticks["tie"], ticks["x"] = frame["at"].astype("int64"), frame["tiebreak"].astype("int64"), frame["value"].astype("float64")
                first = int(ticks["at"].min())
                least = first if least is None else min(least, first)
                held.append(ticks)
                n += len(ticks)
                if n >= GATHERED:
                    self.wait(held)
                    held, n = [], 0
            if held:
                self.wait(held)
            if least is not None:
                self.wake(least)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            # All slots that the watermark has passed, so one reading of the waiting ticks serves them.
            until = timerValues.getCurrentWatermarkInMs() // slot_ms * slot_us
            parts: dict[int, list[int]] = {}
            for block, part in sorted(tuple(k) for k in self.waiting.keys()):
                parts.setdefault(block, []).append(part)
            state = tuple(self.mean.get()) if self.mean.exists() else None
            made, n = [], 0
            for block, own in parts.items():
                ticks = _in_order([np.frombuffer(self.waiting.getValue((block, part))[0], TICK) for part in own])
                due, later = np.split(ticks, [np.searchsorted(ticks["at"], until)])
                if len(due):
                    for part in own:
                        self.waiting.removeKey((block, part))
                    if len(later):
                        self.waiting.updateValue((block, 0), (later.tobytes(),))
                    ema = np.full(len(due), np.nan)
                    for i, x in enumerate(due["x"].tolist()):
                        state = self.step(state, None if x != x else x)
                        if state is not None:
                            ema[i] = state[0]
                    made.append(pd.DataFrame({"symbol": key[0], "at": due["at"], "tiebreak": due["tie"], "value": due["x"], "ema": ema}))
                    n += len(due)
                if n >= out_rows:
                    yield pd.concat(made)
                    made, n = [], 0
                if len(later):  # what follows is later still
                    self.wake(int(later["at"][0]))
                    break
            if state is not None:
                self.mean.update(state)
            if made:
                yield pd.concat(made)

        def close(self) -> None:
            pass

    return Smoothed()


def stream_ema_by_event_time(ticks: DataFrame, span: int, symbol: str, time: str, tiebreak: str, value: str, late: str = "1 hour", slot: str = "1 minute") -> DataFrame:
    """(symbol, time, tiebreak, value, ema): the exponential mean of a stream whose ticks may come in any order within late.

    A tick waits in its symbol's state until the watermark has passed its slot of time; then
    the slot's ticks go through the mean in order of time and tiebreak. So results are those of
    features.ema over all ticks in order: late ones count at their place, ticks later than late are left
    out by Spark, a null value is a gap, and a tick without a time is left out. State is the mean and the
    ticks of about late. Needs the RocksDB state store, which is set here if none is.
    """
    spark = ticks.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    slot_ms = int(pd.Timedelta(slot) / pd.Timedelta("1ms"))
    rows = ticks.select(F.col(symbol).alias("symbol"), F.col(time).cast("timestamp").alias("time"), F.col(tiebreak).cast("long").alias("tiebreak"), F.col(value).cast("double").alias("value"))
    rows = rows.withWatermark("time", late).where("time is not null").withColumn("at", F.unix_micros("time"))
    kind = dict(rows.dtypes)["symbol"]
    made = rows.groupBy("symbol").transformWithStateInPandas(_ema_processor(span, slot_ms), f"symbol {kind}, at long, tiebreak long, value double, ema double", "Append", "EventTime")
    return made.select("symbol", F.timestamp_micros("at").alias("time"), "tiebreak", "value", "ema")
