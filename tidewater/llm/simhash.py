"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

The trie's nodes are prefixes of the distinct fingerprints. Pairs of nodes go down together,
their differing bits add up, and a pair ends when the error budget is exceeded. The upper
levels are DataFrame joins, four bits at a time, until both nodes of a pair are small; then
each pair is one group, and a task walks on below it bit by bit over sorted arrays. Copies
share a fingerprint and so enter as one; a dense node is just split further down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, read_table, released
from .components import connected_components

BITS = 64
STEP = 4  # bits that a level of the upper trie takes

# For each byte, its 8 bits spread over the 8 bytes of a word, lowest first.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles: a bit is set if it is in over half of their XXH64 hashes."""
    words = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([digest(line[a:b], seed) for a, b in spans], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of some 64-bit hashes."""
    hashes = np.ascontiguousarray(hashes, dtype="<u8")
    bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        lanes = SPREAD[hashes[at : at + (1 << 16)].view(np.uint8)].reshape(-1, 8)
        packed = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # a byte counts to 255
        bits += packed.view(np.uint8).reshape(len(packed), BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed integer. A text without words, or null, has 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b["text"]), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found.view(np.int64))], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(released(run), "doc_id long, fp long")


def trie_pairs(a: np.ndarray, b: np.ndarray, depth: int, used: int, budget: int, same: bool, width: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of a[i] and b[j] that differ in at most budget bits. a, b: sorted, distinct, below one node each.

    depth bits are behind, in which the nodes differ by used. A frontier of pairs of nodes goes
    down bit by bit; at most about width pairs are walked at once, the others wait on a stack.
    With same, a is b, and each pair comes once.
    """
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def count(bit: int):
        if bit not in ones:
            shift = np.uint64(BITS - 1 - bit)
            ones[bit] = tuple(np.concatenate([[0], np.cumsum((x >> shift) & np.uint64(1), dtype=np.int64)]) for x in (a, b))
        return ones[bit]

    zero = np.zeros(1, dtype=np.int64)
    stack = [(depth, zero, zero + len(a), zero, zero + len(b), zero + used)]
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > width:
            half = len(a0) // 2
            stack += [(bit, *(x[:half] for x in (a0, a1, b0, b1, err))), (bit, *(x[half:] for x in (a0, a1, b0, b1, err)))]
            continue
        few = (a1 - a0) * (b1 - b0) <= 4
        if few.any() or bit == BITS:
            at = np.flatnonzero(few) if bit < BITS else np.arange(len(a0))
            n, m = a1[at] - a0[at], b1[at] - b0[at]
            each = np.repeat(np.arange(len(at)), n * m)
            place = np.arange(len(each)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            i, j = a0[at][each] + place // m[each], b0[at][each] + place % m[each]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            if bit == BITS:
                continue
            a0, a1, b0, b1, err = (x[~few] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        ca, cb = count(bit)
        am, bm = a1 - (ca[a1] - ca[a0]), b1 - (cb[b1] - cb[b0])
        more = err < budget
        children = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), *(tuple(x[more] for x in c) for c in ((a0, am, bm, b1, err + 1), (am, a1, b0, bm, err + 1)))]
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*children, strict=True))
        alive = (a1 > a0) & (b1 > b0)
        if same:
            alive &= b1 > a0 + 1  # the pair's mirror image is walked
            alive &= b0 >= a0
        stack.append((bit + 1, *(x[alive] for x in (a0, a1, b0, b1, err))))


def _prefix(column, depth: int):
    return F.shiftrightunsigned(column, BITS - depth)


def near_pairs(nodes: DataFrame, budget: int = 2, leaf: int = 1 << 17) -> DataFrame:
    """(a, b): ids of every two of nodes' fingerprints that differ in at most budget bits. nodes: fp long, distinct, and id long.

    leaf: a pair of trie nodes is dealt to one task once neither has more fingerprints.
    An empty table gives no rows.
    """
    flips = lambda bits: F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("errors")) for m in range(1 << bits) if m.bit_count() <= budget))
    open_pairs, leaves, depth = None, [], 0
    while depth < BITS:
        depth += STEP
        level = nodes.groupBy(_prefix(F.col("fp"), depth).alias("node")).agg(F.count("*").alias("n"))
        left, right = level.select(F.col("node").alias("x"), F.col("n").alias("nx")), level.select(F.col("node").alias("y"), F.col("n").alias("ny"))
        if open_pairs is None:
            begun = left.select("x", "nx", F.lit(0).alias("used"), F.lit(0).cast("long").alias("up"))
        else:
            at = open_pairs.select(F.col("x").alias("ux"), F.col("y").alias("up"), "used")
            begun = left.withColumn("ux", F.shiftrightunsigned("x", STEP)).join(at, "ux").select("x", "nx", "used", "up")
        flipped = begun.select("*", F.explode(flips(STEP)).alias("flip")).where(F.col("used") + F.col("flip.errors") <= budget)
        goal = F.shiftleft("up", STEP).bitwiseOR(F.col("x").bitwiseAND(F.lit((1 << STEP) - 1)).bitwiseXOR(F.col("flip.mask")))
        met = flipped.select("x", "nx", goal.alias("y"), (F.col("used") + F.col("flip.errors")).alias("used")).join(right, "y")
        if depth < BITS:  # at full depth the order of unsigned numbers doesn't show in signed ones
            met = met.where("x <= y")
        pairs = cut(met)
        small = (F.greatest("nx", "ny") <= leaf) | F.lit(depth == BITS)
        leaves.append((depth, pairs.where(small)))
        open_pairs = pairs.where(~small)
        if open_pairs.isEmpty():
            break
    found = None
    for depth, at in leaves:
        if at.isEmpty():
            continue
        part = _below(nodes, at, depth, budget)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")


def _below(nodes: DataFrame, pairs: DataFrame, depth: int, budget: int) -> DataFrame:
    """The walk below pairs of nodes of one depth: a group for each pair, of at most two leaves."""
    keyed = nodes.select(_prefix(F.col("fp"), depth).alias("node"), "fp", "id")
    first = pairs.select(F.col("x").alias("node"), "x", "y", "used", F.lit(0).alias("side"))
    second = pairs.where("x <> y").select(F.col("y").alias("node"), "x", "y", "used", F.lit(1).alias("side"))
    members = keyed.join(first.unionByName(second), "node").select("x", "y", "used", "side", "fp", "id")

    def walk(group: pa.Table) -> pa.Table:
        x, y, used = (group[c][0].as_py() for c in ("x", "y", "used"))
        fp, ids, side = (group[c].to_numpy() for c in ("fp", "id", "side"))
        fp = fp.view(np.uint64) if fp.dtype == np.int64 else fp.astype(np.int64).view(np.uint64)
        order = np.argsort(fp)
        fp, ids, side = fp[order], ids[order], side[order]
        mine, theirs = side == 0, side == (0 if x == y else 1)
        a, b, ia, ib = fp[mine], fp[theirs], ids[mine], ids[theirs]
        got = list(trie_pairs(a, b, depth, used, budget, x == y)) if len(a) and len(b) else []
        i = np.concatenate([g[0] for g in got]) if got else np.empty(0, dtype=np.int64)
        j = np.concatenate([g[1] for g in got]) if got else np.empty(0, dtype=np.int64)
        return pa.table({"a": pa.array(ia[i], pa.int64()), "b": pa.array(ib[j], pa.int64())})

    return members.groupBy("x", "y").applyInArrow(walk, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2, leaf: int = 1 << 17) -> DataFrame:
    """(doc_id, fp, component_id): the component of documents linked by fingerprints within budget bits, by its smallest id.

    Texts without words have fingerprint 0 and are linked like any other. Rows with a null id
    don't name a component: their component_id is that of other rows of their fingerprint's
    component, or null. Repeated rows are kept as they are, an empty table gives none, other
    columns are left out.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
    # Two fingerprints can share a smallest id if ids repeat; such nodes are one.
    components = connected_components(near_pairs(nodes, budget, leaf))
    named = nodes.join(components, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op6_simhash_trie(spark, sf_dir: str) -> DataFrame:
    rows = simhash_components(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
