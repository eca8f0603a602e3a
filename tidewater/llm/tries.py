"""A trie of conversations' prefixes, by partition refinement.

Equal conversations are one sequence with a weight first. Then all sequences are one class, that of
the root. Turn after turn each class is split by its sequences' next turn; a class of a single
sequence retires, and what is left of the sequence is a unary chain that no other meets. Turns are
read in blocks that double in length, so the rounds are the logarithm of the longest shared prefix, up to
BLOCK turns a round. A class is named by 128 bits over its turns and their places, carried on from block to block.

Folding back needs no rounds: a node belongs to its smallest member. The nodes a sequence owns are
the lower end of its path, so what lies below a node is the sum over its members of what each owns
from there down: one aggregate over the rows of the classes that were split.

A conversation is never one task's: places are counted inside parts of a range sort and shifted by
the parts before, sums along a chain likewise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read_table, released, written

BLOCK = 4096  # turns of a round at most
PART = 65_536  # turns of a chain summed in one go
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, chars): turns numbered from 0 in their conversation; a and b are 64 bits each of role and text.

    By turn, null first; ties by role, by the text's beginning, then by its bits. Null roles and
    texts are empty; rows without a conv_id are in no conversation and are left out.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.left(text, F.lit(64)).alias("head"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(text, role).alias("b"), F.length(text).cast("long").alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "head", "a", "b"]
    # Range partitions: a conversation with very many turns lies in several.
    placed = cut(rows.repartitionByRange("conv_id", *order)).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    numbered = cut(placed.select("conv_id", "part", "a", "b", "chars", (F.row_number().over(inside) - 1).alias("row")))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    offsets = cut(counts.withColumn("offset", F.sum("n").over(before)).where("offset is not null").select("conv_id", "part", "offset"))
    shifted = numbered.join(offsets, ["conv_id", "part"], "left")
    return shifted.select("conv_id", (F.col("row") + F.coalesce("offset", F.lit(0))).cast("long").alias("pos"), "a", "b", "chars")


def with_base_prompts(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(rebuilt turns, all conv_ids): each conversation c with the first h turns of c - c % group in place of its own first h.

    h is the CRC of c in decimal, modulo most. A base with fewer turns gives all it has, an absent one none.
    """
    lengths = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    base = F.col("conv_id") - F.col("conv_id") % group
    h = F.crc32(F.col("conv_id").cast("string")) % most
    of_base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    ids = cut(lengths.select("conv_id", base.alias("base"), h.alias("h")).join(of_base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).cast("long").alias("given")))
    heads = cut(turns.where((F.col("conv_id") == base) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base"))
    given = heads.join(ids.select("conv_id", "base", "given"), "base").where("pos < given").select("conv_id", "pos", "a", "b", "chars")
    short = cut(ids.where("given < h").select("conv_id", (F.col("h") - F.col("given")).alias("missing")))
    own = turns.where(F.col("pos") >= h).join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") - F.coalesce("missing", F.lit(0))).alias("pos"), "a", "b", "chars")
    return cut(given.union(own)), ids.select("conv_id")


def _bits() -> tuple[Column, Column]:
    """128 bits of a turn at its place: those of a prefix are the exclusive or of its turns'."""
    return F.xxhash64("a", "b", "pos"), F.xxhash64("b", "pos", "a")


def member_digests(members: DataFrame) -> DataFrame:
    """(seq, ends): the SHA-256 of each sequence's conv_ids, numerically ascending, joined by commas.

    The ids of a sequence come in order and are hashed as they come: one digest is one stream by its definition, but is never held.
    """
    schema = pa.schema([("seq", pa.int64()), ("ends", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = digest = None
        for b in batches:
            done = []
            for seq, conv in zip(b["seq"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
                if seq == at:
                    digest.update(b",%d" % conv)
                else:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = seq, hashlib.sha256(b"%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], schema=schema)

    return members.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(released(run), "seq long, ends string")


def sequences(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(seq, w, n, ends): the different sequences, by their smallest conversation; how many have it, its turns, and the digest of their ids."""
    x, y = _bits()
    sums = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.bit_xor(x).alias("x"), F.bit_xor(y).alias("y"))
    named = cut(ids.join(sums, "conv_id", "left").select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "x", "y"))))
    groups = cut(named.groupBy("n", "x", "y").agg(F.min("conv_id").alias("seq"), F.count("*").alias("w")))
    many = named.join(groups.where("w > 1"), ["n", "x", "y"]).select("seq", "conv_id")
    ends = F.coalesce("ends", F.sha2(F.col("seq").cast("string").cast("binary"), 256))
    return cut(groups.select("seq", "w", "n").join(cut(member_digests(many)), "seq", "left").select("seq", "w", "n", ends.alias("ends")))


def refine(turns: DataFrame, seqs: DataFrame, first: int = 8) -> DataFrame:
    """(seq, w, n, depth, c1, c2, chars, owner, members): the turns whose class has several sequences, in rounds over the classes still active."""
    shared, start, size, rounds = [], 0, first, 0
    active = seqs.where("n > 0").select("seq", F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c2"))
    along = Window.partitionBy("seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        x, y = _bits()
        block = turns.where((F.col("pos") >= start) & (F.col("pos") < start + size)).join(active, "seq")
        block = block.select("seq", "w", "n", (F.col("pos") + 1).alias("depth"), F.col("c1").bitwiseXOR(F.bit_xor(x).over(along)).alias("c1"), F.col("c2").bitwiseXOR(F.bit_xor(y).over(along)).alias("c2"), "chars")
        block = cut(block)
        split = block.groupBy("depth", "c1", "c2").agg(F.min("seq").alias("owner"), F.sum("w").alias("members"), F.count("*").alias("seqs"))
        several = cut(split.where("seqs > 1").drop("seqs"))
        kept = cut(block.join(several, ["depth", "c1", "c2"]))
        shared.append(kept)
        start += size
        active = kept.where((F.col("depth") == start) & (F.col("n") > start)).select("seq", "c1", "c2")
        # Of a table Spark knows the size; its estimate for a checkpoint grows with the joins of all rounds before.
        rounds += 1
        active = cut(active) if rounds % 3 else written(active, "active")
        size = min(2 * size, BLOCK)
        if active.isEmpty():
            return reduce(DataFrame.unionByName, shared)


def _sums_to_the_end(rows: DataFrame) -> DataFrame:
    """rows of (seq, pos, value) with below, the sum of value from each place to its sequence's end, without a task that holds a sequence."""
    parts = rows.withColumn("part", F.floor(F.col("pos") / PART))
    backwards = Window.partitionBy("seq", "part").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("seq").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("seq", "part").agg(F.sum("value").alias("total"))
    offsets = totals.withColumn("offset", F.sum("total").over(later)).where("offset is not null").select("seq", "part", "offset")
    return parts.withColumn("below", F.sum("value").over(backwards)).join(cut(offsets), ["seq", "part"], "left").withColumn("below", F.col("below") + F.coalesce("offset", F.lit(0))).drop("part", "offset")


def prefix_trie(turns: DataFrame, ids: DataFrame, first: int = 8) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each different prefix.

    turns: (conv_id, pos, a, b, chars), places from 0 without gaps; ids: every conversation, also
    those without turns. A node's members are the conversations that begin with its turns, and
    conv_id the smallest; saved_tokens sums, below it and for itself, (members - 1) times the
    characters of the last turn; ends_sha256 is over the members that end there. first: turns of
    the first round. No conversation, no rows.
    """
    seqs = sequences(turns, ids)
    own = cut(turns.join(seqs.select(F.col("seq").alias("conv_id"), "w", "n"), "conv_id").withColumnRenamed("conv_id", "seq"))
    shared = cut(refine(own, seqs, first))
    reach = shared.groupBy("seq").agg(F.max("depth").alias("last"))
    known = cut(seqs.join(reach, "seq", "left").select("seq", "w", "n", "ends", F.coalesce("last", F.lit(0).cast("long")).alias("last")))

    # Chains: what is left of a sequence once its class has no other.
    tail = own.join(known.where("n > last").select("seq", "last", "ends"), "seq").where("pos >= last").select("seq", "pos", "w", "n", "last", "ends", ((F.col("w") - 1) * F.col("chars")).alias("value"))
    tail = cut(tail)
    copied = _sums_to_the_end(tail.where("w > 1"))
    chains = tail.where("w = 1").withColumn("below", F.lit(0).cast("long")).unionByName(copied)
    # Whose node the chain hangs from: the owner of the last shared one.
    hung = shared.where("depth < n").groupBy("seq").agg(F.max(F.struct("depth", "owner")).alias("m")).select("seq", F.col("m.owner").alias("parent"))
    root = seqs.agg(F.min("seq")).scalar()
    tops = cut(tail.where("pos = last").select("seq").join(hung, "seq", "left").select("seq", F.coalesce("parent", root).alias("parent")))
    inner, top = chains.where("pos > last"), chains.where("pos = last").join(tops, "seq")
    end = F.col("n") == F.col("pos") + 1
    chain = lambda rows, parent: rows.select(F.col("seq").alias("conv_id"), (F.col("pos") + 1).alias("depth"), parent.alias("parent_conv_id"), F.col("w").alias("n_convs"), F.when(end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("below").alias("saved_tokens"), F.when(end, F.col("ends")).otherwise(EMPTY).alias("ends_sha256"))

    # Folding back over the turns of classes that were split.
    hanging = cut(known.join(copied.where("pos = last").select("seq", "below"), "seq", "left").select("seq", "last", "ends", F.coalesce("below", F.lit(0)).alias("below"), (F.col("n") > F.col("last")).cast("long").alias("leaf")))
    down = Window.partitionBy("seq").orderBy("depth")
    owned = (F.col("owner") == F.col("seq")).cast("long")
    rows = shared.withColumns({
        "parent": F.lag("owner").over(down),
        "child": F.coalesce(F.lead(owned).over(down), F.lit(0)),
        "sum": F.sum(owned * (F.col("members") - 1) * F.col("chars")).over(Window.partitionBy("seq").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)),
    }).join(hanging, "seq")
    nodes = rows.groupBy("depth", "c1", "c2").agg(
        F.min("seq").alias("conv_id"),
        F.min("parent").alias("parent"),
        F.sum("w").alias("n_convs"),
        F.sum(F.col("child") + F.when((F.col("depth") == F.col("last")), F.col("leaf")).otherwise(0)).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("sum") + F.col("below")).alias("saved_tokens"),
        F.max(F.when(F.col("n") == F.col("depth"), F.col("ends"))).alias("ends"),
    )
    inside = nodes.select("conv_id", "depth", F.coalesce("parent", root).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    parts = (
        seqs.select("seq", "w", F.when(F.col("n") == 0, F.col("ends")).alias("ends"), zero.alias("leaf"), zero.alias("saved"), zero.alias("child"))
        .union(shared.where("owner = seq").select(none, none, F.lit(None).cast("string"), zero, (F.col("members") - 1) * F.col("chars"), (F.col("depth") == 1).cast("long")))
        .union(hanging.select(none, none, F.lit(None).cast("string"), "leaf", "below", F.when(F.col("last") == 0, F.col("leaf")).otherwise(zero)))
    )
    sums = parts.agg(F.min("seq").alias("conv_id"), F.sum("w").alias("n_convs"), F.max("ends").alias("ends"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), F.sum("child").alias("children"))
    top_node = sums.where("conv_id is not null").select("conv_id", zero, none, "n_convs", "children", F.greatest("leaves", F.lit(1).cast("long")), "saved", F.coalesce("ends", F.lit(EMPTY)))
    return chain(inner, F.col("seq")).union(chain(top, F.col("parent"))).union(inside).union(top_node)


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    turns, ids = with_base_prompts(turns_in_order(read_table(spark, sf_dir, "conversations")))
    return prefix_trie(turns, ids)
