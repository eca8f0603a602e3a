"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import contextvars
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


#: The tables written on the way inside passing, of each thread its own.
_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """A folder of the shared folder, with all that is in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def passing(spark: SparkSession, *paths: str):
    """Afterwards, delete the tables written on the way inside, also where it fails, and, where it doesn't, paths: what was made of them is stored by then."""
    made: list[str] = []
    before = _scratch.set(made)
    done = False
    try:
        yield
        done = True
    finally:
        _scratch.reset(before)
        for path in [*(paths if done else ()), *made]:
            delete(spark, path)


@contextlib.contextmanager
def tidied(spark: SparkSession):
    """Of the frames made and executed inside, the shuffle files are deleted as soon as they aren't needed, not when the driver next collects its garbage. Spark reads the setting as a frame is made."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder: computed once, its lineage cut, its shuffle files deleted."""
    shared_folder(df.sparkSession)
    with tidied(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: for what is too large to checkpoint row by row. Inside passing it is deleted at its end, elsewhere it stays."""
    path = shared_path(df.sparkSession, label)
    if (held := _scratch.get()) is not None:
        held.append(path)
    with tidied(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads (others, whatever their names, are left out); a null text is empty. Ids are whole numbers, also as text; others raise an error."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


class BoundedCache(dict):
    """make(key) for each key asked for, remembered; emptied when limit keys are held, so its memory is bounded."""

    def __init__(self, make, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def flushed(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int], flush_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about flush_bytes, so that large cells don't pile up in memory."""

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 64
        if total >= flush_bytes:
            yield batch(held)
            held, total = [], 0
    if held:
        yield batch(held)


def released(run: Callable) -> Callable:
    """run, after which the worker, which Spark keeps for later tasks, gives its free Arrow memory back."""

    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return inner


def open_store(uri: str):
    """(file system, path in it) of a folder in the shared store, for Python tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
