"""Benchmark decontamination with DataFrame functions alone.

A document is contaminated by a benchmark item if one of its windows of as many words as the
item has a weighted similarity of at least 0.8 to it: shingles of five words, each weighing
as often as it occurs, shared weight over united weight.

Windows. A window at 0.8 shares a known number of shingles with its item, so no window is laid
where fewer of a text's shingles are an item's of that length. Of a run of starts the first best
one is the text's first start or one at which a shared shingle comes in at the end; all of these
that hold enough shared shingles are laid. The result is that of trying every start.

Candidates. Windows and items get 64-bit SimHashes. Items are filed by length and block: of 8
blocks of 8 bits one differs in at most radius // 8 bits if the whole differs in at most radius,
so each block is filed under all such variants. A window looks up its own blocks and meets every
item within radius, whichever item's shingles laid it. What it meets is verified by its exact
similarity. At a similarity of 0.8 a SimHash differs in 10 of 64 bits on average, in over 23
with a probability of about 1 in 100 000, hence the radius.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, read_table

# Arrays are exploded with the _outer forms: for the plain ones Spark infers a filter on the array, pushes it
# below the projection that makes the array, and so makes it over and over.
BLOCKS, BLOCK_BITS = 8, 8
BROADCAST_ROWS = 500_000  # a side of more rows is joined without a broadcast hint


def with_words(df: DataFrame) -> DataFrame:
    """text becomes words: lower-cased, parted at ASCII white space."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[\\x20\\x09-\\x0D]+", " ")), " ")
    return df.withColumn("words", F.filter(words, lambda w: w != "")).drop("text")


def shingle_hashes(words, k: int):
    """Array of the 64-bit hashes of each k neighbouring words, in order."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) >= k, hashes).otherwise(F.array().cast("array<long>"))


def simhash(hashes):
    """The 64-bit SimHash of an array of hashes: the bits set in over half of them."""
    bits = F.sequence(F.lit(0), F.lit(63))

    def bit(acc, b):
        ones = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, b))
        return acc.bitwiseOR(F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(bits, F.lit(0).cast("long"), bit)


def block(column, number):
    return F.call_function("shiftright", column, number * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """df of at most rows rows, to be broadcast if that is few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = 0.8, radius: int = 23, shingle: int = 5) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): each contaminated document and item once, by the best, then first window.

    A text shorter than an item is one window. Items of fewer than five words are one shingle of
    all their words; empty or null items and texts match nothing. Rows with a null id are left
    out; of several rows of one id each is judged alone and the best window of all is given. No
    contamination, or an empty table, gives no rows. Other columns are left out.
    """
    items = cut(with_words(id_and_text(benchmark, item_col, text_col).withColumnRenamed("doc_id", "item_id"))).where((F.size("words") > 0) & F.col("item_id").isNotNull())
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    found = None
    for k in [r[0] for r in items.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect()]:  # at most five values
        exact = (F.size("words") >= k) if k == shingle else (F.size("words") == k)
        part = _contaminated(texts, items.where(exact), k, threshold, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = texts.select("doc_id", F.col("doc_id").alias("item_id"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity")).where("false")
    return found


def _hashed(texts: DataFrame, k: int) -> DataFrame:
    """(doc_id, row, doc_words, doc_hashes and the other columns): row tells apart texts of one id."""
    words = with_words(texts.withColumn("row", F.xxhash64("text")))
    return words.select(*(c for c in words.columns if c != "words"), F.size("words").alias("doc_words"), shingle_hashes(F.col("words"), k).alias("doc_hashes"))


def _starts(places, in_window, enough):
    """Starts of the windows of in_window shingles that end with one of places (sorted) and hold at least enough of them, in order, each once."""
    start = lambda last: F.greatest(F.lit(0), last - in_window + 1)
    last = F.when(F.size(places) >= enough, F.slice(places, enough, F.size(places) - enough + 1))
    full = F.filter(last, lambda p, i: F.get(places, i) >= start(p))  # the place that is enough - 1 places before is in the window
    return F.array_distinct(F.transform(full, start))


def _contaminated(texts: DataFrame, items: DataFrame, k: int, threshold: float, radius: int) -> DataFrame:
    hashed = cut(items.select("item_id", F.size("words").alias("n_words"), shingle_hashes(F.col("words"), k).alias("hashes")).withColumn("item_fp", simhash(F.col("hashes"))))
    item_count, shingles = hashed.agg(F.count("*"), F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()
    filed = hashed.select("item_id", "n_words", F.explode_outer("hashes").alias("h"))

    # Windows that can reach the threshold.
    met = _hashed(texts, k).select("doc_id", "row", "doc_words", F.posexplode_outer("doc_hashes").alias("p", "h")).join(_bounded(filed.select("n_words", "h").distinct(), shingles), "h")
    places = met.groupBy("doc_id", "row", "doc_words", "n_words").agg(F.array_sort(F.collect_set("p")).alias("places"))
    in_window = F.least("n_words", "doc_words") - k + 1
    enough = F.greatest(F.lit(1), F.ceil(threshold / (1 + threshold) * (in_window + F.col("n_words") - k + 1) - 1e-9).cast("int"))  # shingles that a window at threshold shares
    laid = places.select("doc_id", "row", "n_words", _starts(F.col("places"), in_window, enough).alias("starts")).where(F.size("starts") > 0)
    asked = laid.groupBy("doc_id", "row").agg(F.collect_list(F.struct("n_words", "starts")).alias("asked"))
    sizes = F.flatten(F.transform("asked", lambda a: F.transform(a["starts"], lambda s: F.struct(a["n_words"].alias("n_words"), s.alias("start_word")))))
    wanted = texts.withColumn("row", F.xxhash64("text")).join(asked, ["doc_id", "row"])
    # A row for each start first, then its slice: no row holds the windows of a whole text.
    started = _hashed(wanted.drop("row"), k).select("doc_id", "row", "doc_hashes", F.explode_outer(sizes).alias("w"))
    windows = started.select("doc_id", "row", "w.*", F.slice("doc_hashes", F.col("w.start_word") + 1, F.col("w.n_words") - k + 1).alias("hashes"))
    windows = cut(windows.dropDuplicates(["doc_id", "row", "n_words", "start_word"]).withColumn("fp", simhash(F.col("hashes"))))

    # Multi-index Hamming blocks: a window meets the items of its length within radius.
    masks = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= radius // BLOCKS]
    flips = F.array(*(F.lit(m) for m in masks))
    numbers = F.array(*(F.lit(i) for i in range(BLOCKS)))
    index = hashed.select("item_id", "n_words", "item_fp", F.explode(numbers).alias("block")).select("*", F.explode(flips).alias("flip"))
    index = index.select("item_id", "n_words", "item_fp", "block", block(F.col("item_fp"), F.col("block")).bitwiseXOR(F.col("flip")).alias("value"))
    looked = windows.select("*", F.explode(numbers).alias("block")).withColumn("value", block(F.col("fp"), F.col("block")))
    near = looked.join(_bounded(index, item_count * BLOCKS * len(masks)), ["n_words", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    # Of the blocks that meet, the first one counts.
    agreeing = lambda i: F.bit_count(block(F.col("fp").bitwiseXOR(F.col("item_fp")), i).cast("long")) <= radius // BLOCKS
    near = near.where(F.col("block") == F.array_min(F.filter(numbers, agreeing))).select("doc_id", "row", "item_id", "n_words", "start_word", "hashes")

    # Exact weighted similarity, in the row: no window is taken apart.
    weighed = near.join(_bounded(hashed.select("item_id", F.col("hashes").alias("item_hashes")), shingles), "item_id")
    times = lambda hashes, h: F.size(F.filter(hashes, lambda x: x == h))
    common = F.array_intersect("hashes", "item_hashes")
    shared = F.aggregate(common, F.lit(0), lambda total, h: total + F.least(times("hashes", h), times("item_hashes", h)))
    united = F.size("hashes") + F.size("item_hashes") - F.col("shared")
    scored = weighed.withColumn("shared", shared).withColumn("similarity", F.col("shared") / united).where(F.col("similarity") >= threshold)
    best = scored.groupBy("doc_id", "item_id", "n_words").agg(F.min(F.struct((-F.col("similarity")).alias("loss"), "start_word")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start_word").alias("start_word"), "n_words", F.round(-F.col("b.loss"), 6).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without the contaminated ones.

    All rows of a contaminated id go; rows with a null id or text stay, as do all where a table is
    empty. Columns are those of docs, whatever their names beside doc_id and text.
    """
    gone = cut(contaminated(docs, benchmark, threshold=threshold).select("doc_id").distinct())
    kept = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    return kept.unionByName(docs.where("doc_id is null"))


def op8_benchmark_windows(spark, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
