"""Exact duplicates found through an index of cuckoo filters over live digests.

A digest is the SHA-256 of a text without white space. Digests are dealt to shards by their bits;
each shard is a cuckoo filter (Fan et al., 2014): 16-bit fingerprints in buckets of four slots, of
which a key has two, each told from the other by the fingerprint alone. Beside its fingerprint a
slot stores the whole digest and the digest's record, so a hit is verified against what the bucket
holds, a deletion takes out the right entry, and a full filter is made anew with twice the
buckets from the keys it stores.

The same filter, of a bounded number of keys, merges copies inside each task before the shuffle:
when it is full the oldest digest is deleted from it and sent on. So a group of copies that holds a
third of all rows is one row of each task, and no task holds a group.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read_table, released

SPACES = " \t\n\x0b\x0c\r"
SLOTS = 4
KICKS = 200  # moves after which a filter counts as full


def better(a: tuple, b: tuple) -> tuple:
    """Of two (length, doc_id, number) the one to stay: the longer, then the smaller id (a null one last), then the smaller number."""
    rank = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    return a if rank(a) <= rank(b) else b


class CuckooFilter:
    """Live digests, each with a record [rows, (length, doc_id, number)]."""

    def __init__(self, buckets: int = 256):
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.live = 0
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)
        self.records: list = [None] * (buckets * SLOTS)

    def _home(self, key: bytes) -> tuple[int, int, int]:
        """(fingerprint, first bucket, second bucket)."""
        mark = int.from_bytes(key[:2], "big") or 1
        first = int.from_bytes(key[8:16], "big") & self.mask
        return mark, first, first ^ (mark * 0x5BD1E995 & self.mask)

    def find(self, key: bytes) -> int:
        """The slot of a live digest, or -1: slots with its fingerprint count only if they hold the digest."""
        mark, first, second = self._home(key)
        prints, keys = self.prints, self.keys
        for bucket in (first, second):
            at = bucket * SLOTS
            for slot in range(at, at + SLOTS):
                if prints[slot] == mark and keys[slot] == key:
                    return slot
        return -1

    def _place(self, key: bytes, record) -> tuple | None:
        """Put a new digest in, moving others where both its buckets are full; what is left without a place after KICKS moves."""
        mark, first, second = self._home(key)
        bucket = first
        for kick in range(KICKS):
            for candidate in (first, second) if kick == 0 else (bucket,):
                at = candidate * SLOTS
                for slot in range(at, at + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.keys[slot], self.records[slot] = mark, key, record
                        return None
            slot = bucket * SLOTS + kick % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.keys[slot], key = key, self.keys[slot]
            self.records[slot], record = record, self.records[slot]
            bucket ^= mark * 0x5BD1E995 & self.mask
        return key, record

    def put(self, key: bytes, rows: int, best: tuple) -> bool:
        """Insert a digest, or add to the record of a live one. Whether it is new."""
        slot = self.find(key)
        if slot >= 0:
            record = self.records[slot]
            record[0] += rows
            record[1] = better(record[1], best)
            return False
        self.live += 1
        left = self._place(key, [rows, best])
        while left is not None:
            left = self._grow(left)
        return True

    def _grow(self, left: tuple) -> tuple | None:
        """Twice the buckets, filled from the stored keys."""
        held = [(k, r) for k, r in zip(self.keys, self.records, strict=True) if k is not None] + [left]
        live, size = self.live, 2 * (self.mask + 1)
        while True:
            self._clear(size)
            self.live = live
            if all(self._place(k, r) is None for k, r in held):
                return None
            size *= 2

    def delete(self, key: bytes) -> list | None:
        """Take a digest out; its record, or None where it isn't live."""
        slot = self.find(key)
        if slot < 0:
            return None
        record = self.records[slot]
        self.prints[slot], self.keys[slot], self.records[slot] = 0, None, None
        self.live -= 1
        return record

    def restore(self, slot: int, key: bytes, record: list) -> None:
        """Put a stored entry back in its slot."""
        self.prints[slot], self.keys[slot], self.records[slot] = self._home(key)[0], key, record
        self.live += 1

    def entries(self) -> Iterator[tuple]:
        for slot, (k, r) in enumerate(zip(self.keys, self.records, strict=True)):
            if k is not None:
                yield slot, k, r


MERGED = pa.schema([("digest", pa.binary()), ("rows", pa.int64()), ("length", pa.int32()), ("doc_id", pa.int64()), ("number", pa.int64())])
MERGED_DDL = "digest binary, rows long, length int, doc_id long, number long"
STATE_DDL = "shard int, buckets long, slot long, " + MERGED_DDL
STATE = pa.schema([("shard", pa.int32()), ("buckets", pa.int64()), ("slot", pa.int64()), *MERGED])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, length, number): a narrow row for each document; number tells rows apart, also rows of several tables."""
    salt = F.lit(uuid.uuid4().int >> 65)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.translate(text, SPACES, ""), 256))
    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"), F.length(text).alias("length"), F.xxhash64(salt, F.monotonically_increasing_id()).alias("number"))
    return cut(made)  # numbers are then fixed, whatever is computed again


def merged(rows: DataFrame, held: int = 50_000) -> DataFrame:
    """(digest, rows, length, doc_id, number): copies inside a task merged by a filter of at most held live digests; the oldest is deleted and sent on when it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = CuckooFilter(), deque()

        def out() -> Iterator[tuple]:
            for b in batches:
                for digest, length, doc_id, number in zip(*(b[c].to_pylist() for c in ("digest", "length", "doc_id", "number")), strict=True):
                    if known.put(digest, 1, (length, doc_id, number)):
                        order.append(digest)
                        if known.live > held:
                            oldest = order.popleft()
                            count, best = known.delete(oldest)
                            yield (oldest, count, *best)
            for _, key, (count, best) in known.entries():
                yield (key, count, *best)

        yield from _batches(out(), MERGED)

    return rows.mapInArrow(released(run), MERGED_DDL)


class ExactIndex:
    """The live digests of a corpus: cuckoo filters by shard, kept as a table of their slots.

    state: (shard, buckets, slot, digest, rows, length, doc_id, number), a row for each live
    digest: how many documents have it, and which of them stays (the longest text, then the
    smallest id; a null id last). insert and remove give new indexes; a state written as a table can be read again and
    passed in with its number of shards.
    """

    def __init__(self, shards: int, state: DataFrame):
        self.shards, self.state = shards, state

    @classmethod
    def empty(cls, spark, shards: int) -> ExactIndex:
        return cls(shards, spark.createDataFrame([], STATE_DDL))

    def _changed(self, rows: DataFrame | None, gone: DataFrame | None) -> ExactIndex:
        shards = self.shards
        shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
        names = ["digest", "rows", "length", "doc_id", "number"]
        events = self.state.select("shard", F.lit(0).alias("kind"), "buckets", "slot", *names)
        for kind, part in ((1, gone), (2, rows)):
            if part is not None:
                events = events.union(part.select(shard, F.lit(kind), F.lit(None).cast("long"), F.lit(None).cast("long"), *names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done(at: int, known: CuckooFilter) -> Iterator[tuple]:
                return ((at, known.mask + 1, slot, key, count, *best) for slot, key, (count, best) in known.entries())

            def out() -> Iterator[tuple]:
                at, known = None, CuckooFilter()
                for b in batches:
                    for s, kind, buckets, slot, digest, count, length, doc_id, number in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        if s != at:
                            if at is not None:
                                yield from done(at, known)
                            at, known = s, CuckooFilter(buckets or 256)
                        if kind == 0:
                            known.restore(slot, digest, [count, (length, doc_id, number)])
                        elif kind == 1:
                            known.delete(digest)
                        else:
                            known.put(digest, count, (length, doc_id, number))
                if at is not None:
                    yield from done(at, known)

            yield from _batches(out(), STATE)

        dealt = events.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
        return ExactIndex(shards, cut(dealt.mapInArrow(released(run), STATE_DDL)))

    def insert(self, rows: DataFrame, held: int = 50_000) -> ExactIndex:
        """With the documents of rows (see digested) besides."""
        return self._changed(merged(rows, held), None)

    def remove(self, gone: DataFrame, live: DataFrame) -> ExactIndex:
        """Without the documents of gone. live: the rows that stay in the corpus.

        The digests of gone are deleted; those that documents of live still have are inserted
        again from their rows, so a group whose kept document goes gets its next one.
        """
        out = cut(merged(gone))
        touched = cut(out.select("digest").distinct())
        return self._changed(merged(live.join(touched, "digest", "left_semi").select("doc_id", "digest", "length", "number")), out)

    def resolve(self, rows: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of documents whose digests are live. Only groups of two and more are joined."""
        groups = cut(self.state.where("rows > 1").select("digest", F.col("rows").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("number").alias("keep_number")))
        joined = rows.join(groups, "digest", "left")
        alone = F.col("group_size").isNull()
        return joined.select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (alone | (F.col("number") == F.col("keep_number"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests_per_shard: int = 400_000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document; texts that differ in white space only are equal.

    Of a group the longest text stays (code points, white space too), then the smallest id; a
    null id comes last; of rows equal in id and length one stays. Null and empty texts, and texts
    of white space, are one group. An empty table gives no rows; other columns are left out.
    """
    rows = digested(docs, id_col, text_col)
    shards = max(16, -(-rows.count() // digests_per_shard))
    return ExactIndex.empty(docs.sparkSession, shards).insert(rows).resolve(rows)


def op11_cuckoo_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))
