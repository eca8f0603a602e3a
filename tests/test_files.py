import datetime as dt
import math

import pytest

from tidewater.sources import files
from tidewater.streaming import live


def test_csv_round_trip_and_symbols(spark, tmp_path):
    for name, v in (("ada", 1.5), ("btc", math.nan)):
        (tmp_path / f"{name}_hourly.csv").write_text(f"time,close\n2024-01-01 00:00:00,{v}\n2024-01-01 01:00:00,2\n")
    df = files.read_series_csv(spark, [str(tmp_path / f"{n}_hourly.csv") for n in ("ada", "btc", "none")], "time string, close double")
    rows = {(r["symbol"], r["time"]): r["close"] for r in df.collect()}
    assert rows == {("ada", dt.datetime(2024, 1, 1)): 1.5, ("ada", dt.datetime(2024, 1, 1, 1)): 2.0, ("btc", dt.datetime(2024, 1, 1)): None, ("btc", dt.datetime(2024, 1, 1, 1)): 2.0}
    with pytest.raises(FileNotFoundError):
        files.read_series_csv(spark, str(tmp_path / "none.csv"))
    files.write_csv(df, str(tmp_path / "out"))
    assert files.read_raw_csv(spark, str(tmp_path / "out")).count() == 4
    files.write_indexed_csv(df, str(tmp_path / "indexed"), ["symbol", "time"])
    assert sorted(r["index"] for r in files.read_raw_csv(spark, str(tmp_path / "indexed")).collect()) == [0, 1, 2, 3]


def test_stream_bars_equal_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("x" if i % 3 else "y", start + dt.timedelta(minutes=7 * i), i, float(i % 11)) for i in range(200)]
    ticks = spark.createDataFrame(rows, "symbol string, time timestamp, tick long, value double")
    for k in range(4):
        ticks.where(f"tick div 50 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = live.stream_bars(stream, "symbol", "time", "value", "tick", "1 hour", "2 hours").writeStream.format("memory").queryName("live_bars").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = live.stream_bars(ticks, "symbol", "time", "value", "tick", "1 hour", "2 hours")
    assert sorted(map(tuple, spark.table("live_bars").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_ema_equals_batch(spark, tmp_path):
    from tidewater.operators import features
    from tidewater.series import SeriesSpec

    start = dt.datetime(2024, 1, 1)
    rows = [("x" if i % 3 else "y", start + dt.timedelta(minutes=i), i, float((i * 7) % 11)) for i in range(120)]
    ticks = spark.createDataFrame(rows, "symbol string, time timestamp, tick long, value double")
    ticks.where("tick < 60").coalesce(1).write.parquet(str(tmp_path / "in"))
    ticks.where("tick >= 60").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    first = sorted(p for p in (tmp_path / "in").iterdir() if p.suffix == ".parquet")
    assert len(first) == 2
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    run = live.stream_ema(stream, 5, "symbol", ["time", "tick"], "value").writeStream.format("memory").queryName("live_ema").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r["symbol"], r["tick"]): round(r["ema_5"], 9) for r in spark.table("live_ema").collect()}
    want = {(r["symbol"], r["tick"]): round(r["ema_5"], 9) for r in features.ema(ticks, [5], "value", SeriesSpec(tiebreak=("tick",))).collect()}
    assert got == want


def folder_of(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}_hourly.csv").write_text(text)
    return f"{tmp_path}/*_hourly.csv"


HEADERS = {
    "ada": "time,open,close\n2024-01-01 00:00:00,1.0,2.0\n",
    "btc": "time,close,open\n2024-01-01 00:00:00,20.0,10.0\n",  # swapped
    "eth": "time,close\n2024-01-01 00:00:00,7\n",  # one missing
    "xrp": "tweets,time,open,close\n3,2024-01-01 00:00:00,,4.5\n5,2024-01-01 01:00:00,nan,\n",  # one more, and gaps
    "doge": "",
    "xmr": "time,open,close\n",
}


@pytest.mark.parametrize("schema", [None, "time string, open double, close double, tweets long"])
def test_files_are_read_by_their_own_headers(spark, tmp_path, schema):
    df = files.read_series_csv(spark, folder_of(tmp_path, **HEADERS), schema)
    assert dict(df.dtypes) == {"symbol": "string", "time": "timestamp_ntz", "open": "double", "close": "double", "tweets": "bigint"}
    rows = sorted((r["symbol"], r["time"].hour, r["open"], r["close"], r["tweets"]) for r in df.collect())
    assert rows == [("ada", 0, 1.0, 2.0, None), ("btc", 0, 10.0, 20.0, None), ("eth", 0, None, 7.0, None), ("xrp", 0, None, 4.5, 3), ("xrp", 1, None, None, 5)]


def test_types_of_all_files_agree(spark, tmp_path):
    """Whole numbers in one file and fractions in another are doubles; a word anywhere makes a text; a column of gaps is text."""
    paths = folder_of(tmp_path, a="time,x,y,z,up\n2024-01-01,1,1,,true\n", b="up,y,x,time\nfalse,one,2.5,2024-01-02\n", c='time,"q,r"\n2024-01-03,9\n')
    df = files.read_series_csv(spark, paths)
    assert dict(df.dtypes) == {"symbol": "string", "time": "timestamp_ntz", "x": "double", "y": "string", "z": "string", "up": "boolean", "q,r": "bigint"}
    assert sorted((r["symbol"], r["x"], r["y"], r["q,r"]) for r in df.collect()) == [("a", 1.0, "1", None), ("b", 2.5, "one", None), ("c", None, None, 9)]


def test_packed_files_folders_and_odd_headers(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "zip_1.csv.gz", "wt") as f:
        f.write("close,time\n3,2024-01-01\n")
    (tmp_path / "dir_1").mkdir()
    (tmp_path / "dir_1" / "part-0.csv").write_text("\ufefftime,close\n2024-01-01,4\n")
    (tmp_path / "dir_1" / "_SUCCESS").write_text("")
    df = files.read_series_csv(spark, [f"{tmp_path}/zip_1.csv.gz", f"{tmp_path}/dir_1", f"{tmp_path}/absent_1.csv"], "time string, close double")
    assert sorted((r["symbol"], r["close"]) for r in df.collect()) == [("dir", 4.0), ("zip", 3.0)]
    (tmp_path / "twice_1.csv").write_text("time,close,close\n2024-01-01,1,2\n")
    with pytest.raises(ValueError, match="twice"):
        files.read_series_csv(spark, f"{tmp_path}/twice_1.csv")
    (tmp_path / "empty_1.csv").write_text("")
    assert files.read_series_csv(spark, f"{tmp_path}/empty_1.csv", "time string, close double").count() == 0
    with pytest.raises(ValueError, match="header"):
        files.read_series_csv(spark, f"{tmp_path}/empty_1.csv")


def test_stream_ema_by_event_time(spark, tmp_path):
    """Ticks out of order between batches, gaps, a tick later than the watermark allows, and one without a time: as the batch form over the rest."""
    import random

    from tidewater.operators import features
    from tidewater.series import SeriesSpec

    start, rng = dt.datetime(2024, 1, 1), random.Random(4)
    rows = [("xyz"[i % 3], start + dt.timedelta(seconds=20 * (i // 2)), i, None if i % 3 == 0 and (i < 9 or i % 5 == 0) else float((i * 7) % 11)) for i in range(300)]
    schema = "symbol string, time timestamp, tick long, value double"
    order = sorted(range(300), key=lambda i: i + rng.randrange(40))  # each tick within some minutes of its place
    for k in range(5):
        part = [rows[i] for i in order[60 * k : 60 * k + 60]]
        if k == 4:
            part += [("x", start, 900, 1e9), ("x", None, 901, 1e9)]  # too late, and without a time
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for p in sorted((tmp_path / "in").glob("part-*")):
            p.rename(tmp_path / "in" / f"batch{k}-{p.name.replace('part-', 'p')}")
    spark.createDataFrame([(s, start + dt.timedelta(days=1), 1000, 0.0) for s in "xyz"], schema).coalesce(1).write.parquet(str(tmp_path / "end"))  # moves the watermark on
    for p in (tmp_path / "end").glob("part-*"):
        p.rename(tmp_path / "in" / f"batch9-{p.name.replace('part-', 'p')}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = live.stream_ema_by_event_time(stream, 5, "symbol", "time", "tick", "value", "20 minutes", "1 minute")
    run = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    got = {r["tiebreak"]: r["ema"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    ticks = spark.createDataFrame(rows, schema)
    want = {r["tick"]: r["ema_5"] for r in features.ema(ticks, [5], "value", SeriesSpec(tiebreak=("tick",))).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert (got[k] is None) == (w is None or w != w) and (got[k] is None or abs(got[k] - w) < 1e-9), (k, got[k], w)


def test_waiting_ticks_are_kept_in_blocks():
    """Ticks of two days in any order, with gaps: the state is touched by blocks of an hour and not by ticks, and the means are those in order."""
    import random

    import pandas as pd

    calls = []

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Blocks(dict):
        def updateValue(self, key, value):
            calls.append("put")
            self[key] = value

        def getValue(self, key):
            calls.append("get")
            return self[key]

        def removeKey(self, key):
            calls.append("remove")
            del self[key]

    class Handle:
        timers = set()

        def getValueState(self, name, schema):
            return Value()

        def getMapState(self, name, key, value):
            return Blocks()

        def registerTimer(self, at):
            self.timers.add(at)

    class Watermark:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    n, rng = 20_000, random.Random(8)
    rows = [(8_640_000 * (i // 2), i, None if i % 5 == 0 else float(i * 37 % 101)) for i in range(n)]  # micros, two ticks at each time
    handle, mean = Handle(), live._ema_processor(5, 60_000)
    mean.init(handle)
    mixed = rng.sample(rows, n)
    frame = lambda part: pd.DataFrame(part, columns=["at", "tiebreak", "value"])
    mean.handleInputRows(("a",), iter([frame(mixed[:9000]), frame(mixed[9000:9001]), frame([])]), None)
    mean.handleInputRows(("a",), iter([frame(mixed[9001:])]), None)
    end = rows[-1][0] // 1000
    first = pd.concat(mean.handleExpiredTimer(("a",), Watermark(end // 2), None))
    assert first["at"].max() < end // 2 // 60_000 * 60_000_000 <= min(mean.waiting)[0] * 3_600_000_000 + 3_600_000_000
    assert max(handle.timers) > end // 2  # for what waits still
    second = pd.concat(mean.handleExpiredTimer(("a",), Watermark(end + 120_000), None))
    assert not mean.waiting and len(calls) < 500
    got, step, state = pd.concat([first, second]), live.smoother(5), None
    assert got["tiebreak"].tolist() == list(range(n)) and set(got["symbol"]) == {"a"}
    for (_, _, x), y in zip(rows, got["ema"], strict=True):
        state = step(state, x)
        assert y == state[0] if state else y != y
