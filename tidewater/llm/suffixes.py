"""Repeated passages by sparse suffix arrays.

Of a text's word suffixes only those at minimiser positions are kept: of every w = 26
neighbouring runs of k = 25 words the one with the smallest hash. Any passage of
min_words = k + w - 1 = 50 words holds such a run, whichever document it is in. The kept
suffixes are range-partitioned and sorted by their first k words, a word sequence standing in
the order of its hash, then by place; each is compared with its neighbours, also across the
edges of partitions. Suffixes with an equal neighbour are candidates, the others (nearly all in
clean text) are done with.

Around each candidate the match is extended to the left and right, up to min_words in all. As
what is on the left may part suffixes that are neighbours, and bring together some that aren't,
the extension compares all windows of min_words words that hold the run, window by window. A
window met at several places is a repeated passage; its first place, by document id and
position, keeps it, and the windows of other places join to spans. Windows are equal if 96 bits
of two hashes agree, made from different hashes of the words: of 10**12 windows, two unlike ones
agree with a probability of less than 1 in 100 000.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, delete, id_and_text, read_table, released, shared_path, written

RADIX, CHECK_RADIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so they have inverses modulo 2**64
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 4096), base, dtype=np.uint64)
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known[:n]


def words_of(text: str) -> list[str]:
    return text.split() if text.isascii() and not re.search(r"[\x1c-\x1f]", text) else WORD.findall(text)


def hashed(words: list[str], digest=xxhash.xxh64_intdigest) -> np.ndarray:
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


def word_hashes(text: str) -> np.ndarray:
    return hashed(words_of(text))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, k: int, at: np.ndarray | None = None, radix: int = RADIX) -> np.ndarray:
    """A hash of the k words from each position, or from the positions in at."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * powers(radix, len(words)), dtype=np.uint64)])
    if at is None:
        at = np.arange(len(words) - k + 1)
    return mixed((sums[at + k] - sums[at]) * powers(pow(radix, -1, 1 << 64), len(words))[at])


def window_checks(words: list[str], k: int, at: np.ndarray) -> np.ndarray:
    """A second hash, of 32 bits, of the k words from each position in at."""
    return (window_hashes(hashed(words, xxhash.xxh32_intdigest), k, at, CHECK_RADIX) >> np.uint64(32)).astype(np.uint32)


def minimisers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the smallest, and of equal ones the first, of w neighbours."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    if len(hashes) <= w:
        return np.array([hashes.argmin()])
    chosen = np.zeros(len(hashes), dtype=bool)
    for start in range(0, len(hashes) - w + 1, 1 << 15):
        part = np.lib.stride_tricks.sliding_window_view(hashes[start : start + (1 << 15) + w - 1], w)
        chosen[start + np.arange(len(part)) + part.argmin(axis=1)] = True
    return np.flatnonzero(chosen)


def sampled_suffixes(docs: DataFrame, k: int, w: int) -> DataFrame:
    """(head, doc_id, pos): the kept suffixes, by the hash of their first k words."""
    schema = pa.schema([("head", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, ids, places = [], [], []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                words = word_hashes(text.as_py())
                if len(words) >= k + w - 1:
                    hashes = window_hashes(words, k)
                    at = minimisers(hashes, w)
                    heads.append(hashes[at])
                    places.append(at.astype(np.int32))
                    ids.append(np.full(len(at), doc_id, dtype=np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places))], schema=schema)

    return docs.mapInArrow(released(run), "head long, doc_id long, pos int")


def with_equal_neighbour(suffixes: DataFrame) -> DataFrame:
    """(doc_id, pos) of the suffixes whose first words another one has too.

    Sorted by head and place over all partitions, so that one head in very many places is dealt
    to several tasks; the first and last suffix of each partition are compared afterwards.
    """
    schema = pa.schema([("head", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("edge", pa.bool_()), ("equal", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # of the rows before: head, doc_id, pos, whether it is the partition's first, whether it equals the one before

        def made(head, doc_id, pos, edge, equal) -> pa.RecordBatch:
            wanted = equal | edge
            columns = ((head, pa.int64()), (doc_id, pa.int64()), (pos, pa.int32()), (edge, pa.bool_()), (equal, pa.bool_()))
            return pa.RecordBatch.from_arrays([pa.array(x[wanted], t) for x, t in columns], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            columns = [b[c].to_numpy() for c in ("head", "doc_id", "pos")]
            first = np.zeros(b.num_rows, dtype=bool)
            if last is None:
                first[0] = True
                before = np.zeros(0, dtype=bool)
            else:
                columns = [np.concatenate([[x], c]) for x, c in zip(last[:3], columns, strict=True)]
                first, before = np.concatenate([[last[3]], first]), np.array([last[4]])
            same = columns[0][1:] == columns[0][:-1]
            equal_before = np.concatenate([before if len(before) else [False], same])
            equal = equal_before.copy()
            equal[:-1] |= same
            yield made(*(c[:-1] for c in columns), first[:-1], equal[:-1])
            last = (*(c[-1] for c in columns), first[-1], equal_before[-1])
        if last is not None:
            yield made(*(np.array([x]) for x in last[:3]), np.array([True]), np.array([last[4]]))

    order = ["head", "doc_id", "pos"]
    compared = written(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(released(run), "head long, doc_id long, pos int, edge boolean, equal boolean"), "compared")
    edges = compared.where("edge")
    shared = edges.groupBy("head").agg(F.count("*").alias("n")).where("n > 1")
    across = edges.where("not equal").join(shared, "head", "left_semi")
    return compared.where("equal").unionByName(across).select("doc_id", "pos")


WINDOWS = pa.schema([("win", pa.int64()), ("check", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("inner", pa.bool_())])


def windows_of(batches: Iterator[pa.RecordBatch], min_words: int, k: int) -> Iterator[pa.RecordBatch]:
    """extended_windows of a task's batches."""
    held: list[list[np.ndarray]] = [[] for _ in WINDOWS]

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in held], schema=WINDOWS)
        for c in held:
            c.clear()
        return made

    for b in batches:
        for doc_id, text, at in zip(b["doc_id"].to_pylist(), b["text"], b["at"], strict=True):
            own = words_of(text.as_py())
            if len(own) < min_words:
                continue
            around = np.zeros(len(own) - min_words + 2, dtype=np.int64)
            runs = at.values.to_numpy()
            np.add.at(around, np.clip(runs - (min_words - k), 0, len(around) - 1), 1)
            np.add.at(around, np.clip(runs + 1, 0, len(around) - 1), -1)
            starts = np.flatnonzero(np.cumsum(around)[:-1] > 0)
            hashes, checks = window_hashes(hashed(own), min_words, starts), window_checks(own, min_words, starts)
            inner = np.ones(len(starts), dtype=bool)
            order = np.lexsort((starts, checks, hashes))
            first = np.concatenate([[True], (np.diff(hashes[order]) != 0) | (np.diff(checks[order]) != 0)])[: len(starts)]
            inner[order[first]] = False
            for c, x in zip(held, (hashes.view(np.int64), checks.view(np.int32), np.full(len(starts), doc_id, dtype=np.int64), starts.astype(np.int32), inner), strict=True):
                c.append(x)
            if sum(map(len, held[0])) >= 1 << 18:
                yield batch()
    if held[0]:
        yield batch()


def extended_windows(candidates: DataFrame, min_words: int, k: int) -> DataFrame:
    """(win, check, doc_id, pos, inner): the windows of min_words words that hold one of the runs at; inner if the text has the window before. candidates: doc_id, text, at array<int>."""
    run = released(lambda batches: windows_of(batches, min_words, k))
    return candidates.mapInArrow(run, "win long, check int, doc_id long, pos int, inner boolean")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(doc_id, pos, first_doc_id) of each window of min_words words that stands elsewhere before: by id, then position.

    One row per window and place, so a passage in n places costs about n rows. Rows with a
    null id are left out. Rows of one id count as one document. Texts of fewer words have no
    window.
    """
    k = (min_words + 1) // 2
    w = min_words - k + 1
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    path = shared_path(docs.sparkSession, "suffixes")
    sampled_suffixes(texts, k, w).write.parquet(path)
    candidates = with_equal_neighbour(docs.sparkSession.read.schema("head long, doc_id long, pos int").parquet(path))
    delete(docs.sparkSession, path)  # what is kept of it is written
    runs = candidates.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    windows = written(extended_windows(texts.join(runs, "doc_id"), min_words, k), "windows")
    # Written, so both sides of the join are plain exchanges, which Spark splits where a passage is everywhere.
    firsts = windows.groupBy("win", "check").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(written(firsts, "firsts"), ["win", "check"]).where("doc_id <> first_doc_id or inner").select("doc_id", "pos", "first_doc_id")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id): words start_word to end_word (exclusive) are a passage of at least min_words words that first_doc_id has before.

    Neighbouring windows with the same first document join to one span. See repeated_windows
    for null and repeated ids, short and empty texts; an empty table gives no rows.
    """
    windows = repeated_windows(docs, id_col, text_col, min_words)
    order = Window.partitionBy("doc_id").orderBy("pos")
    joined = (F.col("pos") <= F.lag("pos").over(order) + 1) & (F.col("first_doc_id") == F.lag("first_doc_id").over(order))
    numbered = windows.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("span", F.sum("new").over(order))
    spans = numbered.groupBy("doc_id", "span", "first_doc_id").agg(F.min("pos").alias("start_word"), (F.max("pos") + min_words).alias("end_word"))
    return spans.select("doc_id", F.col("start_word").cast("long"), F.col("end_word").cast("long"), "first_doc_id")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and the white space after each; all else stays as it is."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at, done = [], 0, 0
    for start, end in sorted(spans):
        start, end = max(start, done), min(end, len(places))
        if start >= end:
            continue
        out.append(text[at : max(at, places[start][0])])
        at = places[end][0] if end < len(places) else places[end - 1][1]
        done = end
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with each repeated passage cut but at its first place; n_chars, if there is one, is counted again. No row goes.

    Texts without a repeat pass unchanged, null and empty ones too, as do rows without an id and
    rows whose id others have (places are told by the id; what they repeat is cut elsewhere).
    An empty table gives no rows; further columns pass, whatever their names.
    """
    spans_col, text_col = (f"{c}_{uuid.uuid4().hex}" for c in ("spans", "text"))
    merged = repeated_spans(docs, min_words=min_words).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(spans_col))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1").select("doc_id")
    merged = cut(merged.join(ids, "doc_id", "left_semi"))  # so Spark can split an id that very many rows have

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else cut_spans(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    # Rows without an id meet nothing, so they don't go to one task.
    joined = docs.where("doc_id is not null").join(merged, "doc_id", "left").unionByName(docs.where("doc_id is null").withColumn(spans_col, F.lit(None).cast(merged.schema[spans_col].dataType)))
    touched = F.col(spans_col).isNotNull() & F.col("text").isNotNull()
    cleaned = joined.withColumn(text_col, F.when(touched, without("text", spans_col)).otherwise(F.col("text")))
    values = {"text": F.col(text_col)}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(touched, F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*(values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op7_sparse_suffixes(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(read_table(spark, sf_dir, "documents"))
