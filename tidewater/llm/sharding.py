"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key and the shard count alone decide the shard: no ring table, and appending a
shard moves rows only into the new one, about 1 in shards + 1 of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read_table

MULTIPLIER = np.uint64(2862933555777941757)  # of the published generator


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = np.array(keys, dtype=np.uint64)
    bucket = np.zeros(len(state), dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        bucket[live] = ahead[live]
        state[live] = state[live] * MULTIPLIER + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((bucket[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket.astype(np.int32)


def jump_shard(key, shards: int):
    """Column: the shard of a long column, on the 64-bit hash of the key. A null key counts as a key of its own."""

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return shard(F.xxhash64(key))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 20_000) -> DataFrame:
    """Place every row in a shard by its id, and number each shard's rows 0, 1, 2 ... without a gap.

    Numbering is two-level, so that no task holds a shard: rows fall into hash buckets inside
    their shard, and a row's slot is the number of rows in the buckets before it plus its place
    in its own. A bucket that repeated rows have filled far beyond its share is cut into parts.

    Nulls: a null id is one key and goes to one shard; a null text has size 1 and the CRC
    of nothing. Repeated ids share a shard and get slots of their own. An empty table gives
    no rows. Other columns are left out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    measured = texts.select("doc_id", (F.octet_length("text") + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"))
    # Narrow rows, checkpointed: numbers of rows are then fixed, whatever is computed again.
    rows = cut(measured.withColumns({"shard": jump_shard(F.col("doc_id"), shards), "grown_shard": jump_shard(F.col("doc_id"), shards + 1), "number": F.monotonically_increasing_id()}))
    buckets = max(256, rows.count() // rows_per_bucket)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    filled = cut(rows.groupBy("shard", "bucket").agg(F.ceil(F.count("*") / (8 * rows_per_bucket)).alias("parts")))
    rows = rows.join(filled, ["shard", "bucket"]).withColumn("part", F.pmod(F.xxhash64("number"), "parts"))
    key = ["shard", "bucket", "part"]
    before = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*key).count().select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*key).orderBy("doc_id", "size", "text_crc32")
    placed = rows.withColumn("place", F.row_number().over(within) - 1).join(offsets, key)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def op9_jump_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=8)
