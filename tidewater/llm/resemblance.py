"""Near-duplicates at a resemblance of 0.8 and more: candidates by SimHash and min-hash bands, links by exact similarity.

Texts are near-duplicates if the sets of their five-word shingles have a Jaccard similarity of
at least 0.8. Equal sets are one node. Links come from two searches:

- The trie self-join of 64-bit SimHashes gives those within two bits, nearly all copies with few
  changes. At 0.8 SimHashes differ in 10 bits on average; a radius that loses next to nothing (23)
  holds over 1 % of all pairs of unlike texts, which no trie can cut down.
- So the rest comes from bands: 20 bands of 6 min-hashes, of which two sets at 0.8 share one with
  a probability of 0.998, at 0.85 of 0.99999. SimHashes over 23 bits apart rule a pair out.

A band that many sets share is not expanded into pairs. Its sets are held against its centre, the
set that meets most others in all bands: of an original and its copies that is the original. What
isn't linked to the same one after that is tried whole: in bands of at most SMALL sets each pair, and
for the sets of larger ones, which texts of one template fill, the pairs of different components that
share one of their rarest shingles (prefix_pairs): no two sets as alike as asked for share none, and
what a template says is frequent, so it isn't among them. So no link of a band is lost, and pairs don't
grow with the square of a band.

Each pair is verified by its exact similarity, a pair's smaller side going to the other's group in
blocks of members.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, id_and_text, released
from .components import connected_components
from .simhash import majority, near_pairs
from .suffixes import mixed, window_hashes, word_hashes

BANDS, ROWS = 20, 6
FARTHEST = 23  # differing bits of SimHashes at a similarity of 0.8: 10 on average, more than this once in 100 000
SMALL = 8  # sets of a band of which all pairs are tried
MEMBERS = 64  # of a block of a centre's members
SLOTS = 1 << 26  # bits of the map of wanted texts
COUNTERS = 1 << 20  # of shingles among sets still apart

MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of lower-cased words; a shorter text is one shingle."""
    words = word_hashes(text.lower())
    return np.unique(window_hashes(words, min(shingle, len(words)))) if len(words) else words


def _name(hashes: np.ndarray) -> int:
    """The set's signed 64-bit name; equal sets share it."""
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of the set's bands: each a hash of ROWS minima under different hashes."""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        turned = hashes[at : at + 2048, None] * MULTIPLIERS
        least = np.minimum(least, ((turned >> np.uint64(32)) ^ turned).min(axis=0))
    powers = MULTIPLIERS[:ROWS]
    return mixed((mixed(least).reshape(BANDS, ROWS) * powers).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def sketched(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row long, set long, n int, fp long, bands array<long>) of each text: row tells texts of one id apart. One without words has an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("set", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, prints, keys = [], [], [], []
            for t in b["text"]:
                hashes = shingle_set(t.as_py(), shingle)
                names.append(_name(hashes))
                sizes.append(len(hashes))
                prints.append(majority(hashes))
                keys.append(bands(hashes).view(np.int64) if len(hashes) else np.empty(0, dtype=np.int64))
            columns = [b["doc_id"], b["row"], pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return texts.withColumn("row", F.xxhash64("text")).select("doc_id", "row", "text").mapInArrow(released(run), "doc_id long, row long, set long, n int, fp long, bands array<long>")


def hashed_sets(asked: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(set, hashes): the shingles of the sets asked for, made again from their texts, and some others; a task gives a set once, so may several."""
    # Which texts: a bitmap of fixed size over hashes of their ids, so no text is shuffled. Sets that it adds meet no pair.
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = nodes.join(asked, "set").groupBy(F.floor(slot / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(SLOTS // 64, dtype=np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    schema = pa.schema([("set", pa.int64()), ("hashes", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            at = b["slot"].to_numpy()
            names, sets = [], []
            for i in np.flatnonzero(bitmap[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)):
                made = shingle_set(b["text"][int(i)].as_py(), shingle)
                name = _name(made)
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    sets.append(made.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return texts.select(slot.alias("slot"), "text").mapInArrow(released(make), "set long, hashes binary")


def prefix_pairs(apart: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(a, b): the pairs of sets of different components c that may be at threshold: all of apart (set, c, n, fp) that are.

    Shingles are ordered, the rarest among these sets first (by counters that several may share: any order does, this one gives few
    pairs). Two sets at the threshold have their first common shingle within the first n - ceil(2 t / (1 + t) n) + 1 of the
    smaller and the first n - ceil(t n) + 1 of the larger (Xiao et al., 2008), so those alone are dealt out. Of a
    shingle's sets, those outside its largest component meet the others; a component's sets never meet each other.
    """
    held = cut(hashed_sets(apart.select("set"), nodes, texts, shingle).join(apart, "set"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            for h in b["hashes"]:
                total += np.bincount((np.frombuffer(h.as_buffer(), dtype=np.uint64) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    counted = held.select("hashes").mapInArrow(released(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTERS, dtype=np.int64)
    often[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    schema = pa.schema([("h", pa.int64()), ("at", pa.int32()), ("set", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("fp", pa.int64())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, h in enumerate(b["hashes"]):
                tokens = np.frombuffer(h.as_buffer(), dtype=np.uint64)
                counts = often[(tokens % np.uint64(COUNTERS)).astype(np.int64)]
                first = np.lexsort((tokens, counts))[: len(tokens) - math.ceil(threshold * len(tokens) - 1e-9) + 1]
                at = np.flatnonzero(counts[first] > 1)  # others have it too
                out.append((tokens[first[at]].view(np.int64), at, np.full(len(at), k)))
            h, at, k = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(at.astype(np.int32)), *(b[c].take(pa.array(k)) for c in ("set", "c", "n", "fp"))], schema=schema)

    rows = cut(held.mapInArrow(released(prefixes), "h long, at int, set long, c long, n int, fp long"))
    parts = rows.groupBy("h", "c").agg(F.count("*").alias("k"))
    shared = cut(parts.groupBy("h").agg(F.count("*").alias("parts"), F.max_by("c", "k").alias("most")).where("parts > 1").select("h", "most"))
    met = cut(rows.join(shared, "h"))
    side = lambda df, s: df.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("at", "set", "c", "n", "fp")))
    x_first = F.struct("n_x", "set_x") < F.struct("n_y", "set_y")
    inside = lambda s: F.col(f"at_{s}") <= F.col(f"n_{s}") - F.ceil(2 * threshold / (1 + threshold) * F.col(f"n_{s}") - 1e-9)
    left = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))  # shingles that can be shared from here on
    pairs = side(met, "x").join(side(met.where("c <> most"), "y"), "h").where(
        (F.col("c_x") != F.col("c_y")) & F.when(x_first, inside("x")).otherwise(inside("y")) & (left >= F.ceil(threshold / (1 + threshold) * (F.col("n_x") + F.col("n_y")) - 1e-9)) & _alike(_of("x"), _of("y"), threshold)
    )
    return pairs.select(F.least("set_x", "set_y").alias("a"), F.greatest("set_x", "set_y").alias("b")).distinct()


def _of(s: str) -> dict:
    return {c: F.col(f"{c}_{s}") for c in ("n", "fp")}


def _alike(x: dict, y: dict, threshold: float):
    """Column: whether sizes and SimHashes allow the threshold."""
    return (F.least(x["n"], y["n"]) >= F.ceil(threshold * F.greatest(x["n"], y["n"]) - 1e-9)) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= FARTHEST)


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is at least threshold. Only their texts' sets are made again.

    Pairs are dealt by a and a block of its members, so a task holds a's set and streams the
    members'; a with very many members has many blocks. No pairs give no rows.
    """
    pairs = cut(pairs.where("a <> b").distinct())
    made = hashed_sets(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), nodes, texts, shingle)
    members = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("blocks")))
    blocks = cut(pairs.join(members, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), "b"))
    # Each set goes to where it is a member, and once to each block where it is the centre.
    places = cut(blocks.select(F.col("b").alias("set"), "a", "block").union(blocks.select(F.col("a").alias("set"), "a", "block").distinct()))
    dealt = made.join(places, "set").repartition("a", "block").sortWithinPartitions("a", "block", F.col("set") != F.col("a"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            a, b = [], []
            for x, s, h in zip(batch["a"].to_pylist(), batch["set"].to_pylist(), batch["hashes"], strict=True):
                own = np.frombuffer(h.as_buffer(), dtype=np.uint64)
                if s == x:
                    centre, held = x, own.copy()
                elif centre == x:
                    shared = np.intersect1d(held, own, assume_unique=True).size
                    if shared >= threshold * (len(held) + len(own) - shared) - 1e-9:
                        a.append(x)
                        b.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    return cut(dealt.select("a", "block", "set", "hashes").mapInArrow(released(compare), "a long, b long").distinct())


def similar_sets(docs: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int) -> DataFrame:
    """(doc_id, row, c): the component c of each text's set; rows of a null id are left out."""
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    sets = cut(sketched(texts, shingle))
    nodes = cut(sets.groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    side = lambda df, s: df.select("h", *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "h"))

    # Within two bits: sets of one fingerprint by the smallest, fingerprints by their smallest neighbour.
    prints = cut(nodes.groupBy("fp").agg(F.min("set").alias("id"), F.count("*").alias("sets")))
    near = near_pairs(prints.select("fp", "id")).select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).groupBy("b").agg(F.min("a").alias("a"))
    same = nodes.join(prints.where("sets > 1"), "fp").where("set <> id").select(F.col("id").alias("a"), F.col("set").alias("b"))

    # Bands, each with its centre.
    met = nodes.select(F.explode("bands").alias("h"), "set", "n", "fp")
    shared = cut(met.groupBy("h").agg(F.count("*").alias("sets")).where("sets > 1"))
    met = cut(met.join(shared, "h"))
    degree = cut(met.groupBy("set").agg(F.sum("sets").alias("degree")))
    met = cut(met.join(degree, "set"))
    centre = lambda df: cut(df.groupBy("h").agg(F.max(F.struct("degree", "set", "n", "fp")).alias("m")).select("h", *(F.col(f"m.{c}").alias(f"{c}_x") for c in ("set", "n", "fp"))))
    to_centre = side(met, "y").join(centre(met), "h").where((F.col("set_x") != F.col("set_y")) & _alike(_of("x"), _of("y"), threshold))
    pairs = to_centre.select(F.col("set_x").alias("a"), F.col("set_y").alias("b")).unionByName(near.select("a", "b")).unionByName(same)
    links = verified(pairs, nodes, texts, threshold, shingle)

    # What isn't known to be alike yet: a set is held to be its most connected linked set's, if that is more connected than itself, and once more.
    ranked = links.join(degree.select(F.col("set").alias("a"), F.col("degree").alias("d_a")), "a").join(degree.select(F.col("set").alias("b"), F.col("degree").alias("d_b")), "b")
    rank = lambda d, s: F.struct(F.col(d).alias("d"), F.col(s).alias("s"))
    upward = F.struct(F.least(rank("d_a", "a"), rank("d_b", "b")).alias("low"), F.greatest(rank("d_a", "a"), rank("d_b", "b")).alias("high"))
    linked = cut(ranked.select(upward.alias("e")).groupBy(F.col("e.low.s").alias("node")).agg(F.max("e.high").alias("h")).select("node", F.col("h.s").alias("c")))
    again = linked.select(F.col("node").alias("c"), F.col("c").alias("beyond"))
    linked = cut(linked.join(again, "c", "left").select("node", F.coalesce("beyond", "c").alias("component")))
    told = met.join(linked, F.col("set") == F.col("node"), "left").select("h", "set", "n", "fp", "sets", "degree", F.coalesce("component", "set").alias("c"))
    told = cut(told)
    apart = cut(told.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("h"))
    told = cut(told.join(apart, "h"))
    few = told.where(F.col("sets") <= SMALL)
    across = side(few, "x").join(side(few, "y"), "h").where((F.col("set_x") < F.col("set_y")) & (F.col("c_x") != F.col("c_y")) & _alike(_of("x"), _of("y"), threshold)).select("set_x", "set_y")
    many = cut(told.where(F.col("sets") > SMALL).groupBy("set").agg(*(F.first(c).alias(c) for c in ("c", "n", "fp"))))
    pairs = across.select(F.col("set_x").alias("a"), F.col("set_y").alias("b"))
    if not many.isEmpty():
        pairs = pairs.union(prefix_pairs(many, nodes, texts, threshold, shingle))
    joined = connected_components(links.union(verified(pairs, nodes, texts, threshold, shingle)))
    return sets.select("doc_id", "row", "set").join(joined, F.col("set") == F.col("node"), "left").select("doc_id", "row", F.coalesce("component", "set").alias("c"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id): the component of documents linked by a similarity of at least threshold, by its smallest id.

    Texts without words, null ones too, are alike. Rows with a null id are left out; a repeated
    id has a row for each of its components. An empty table gives no rows.
    """
    rows = cut(similar_sets(docs, id_col, text_col, threshold, shingle))
    smallest = cut(rows.groupBy("c").agg(F.min("doc_id").alias("component_id")))
    return rows.join(smallest, "c").select("doc_id", "component_id").distinct()


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs, of each component one row: that of the smallest doc_id, and of several texts of this id that with the smallest hash.

    Of rows equal in id and text the one whose other columns have the smallest hash stays. Rows
    with a null id have no place in an order and stay. Null and empty texts are alike; an empty
    table gives no rows; further columns pass, whatever their names.
    """
    id_key, text_key, order = (f"{c}_{uuid.uuid4().hex}" for c in ("id", "text", "order"))
    rows = similar_sets(docs, "doc_id", "text", threshold, shingle)
    kept = rows.groupBy("c").agg(F.min(F.struct("doc_id", "row")).alias("m")).select(F.col("m.doc_id").alias(id_key), F.col("m.row").alias(text_key))
    keyed = docs.withColumns({id_key: F.col("doc_id").cast("long"), text_key: F.xxhash64(F.coalesce("text", F.lit("")))})
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    first = F.row_number().over(Window.partitionBy(id_key, text_key).orderBy(F.xxhash64(*hashable)))
    named = keyed.where(F.col(id_key).isNotNull()).join(kept, [id_key, text_key], "left_semi").withColumn(order, first).where(F.col(order) == 1)
    return named.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where("doc_id is null"))
