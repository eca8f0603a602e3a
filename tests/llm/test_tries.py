"""The conversation trie against a brute-force one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.llm import tries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def slow(conversations):
    members = defaultdict(list)
    for c, ts in conversations.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(conversations[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(rng, n, words, deep=0):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            rows.append((c * 7 % 331, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "ua"[t % 2], f"say {rng.randrange(words)}" if t else f"hello {rng.randrange(2)}"))
    for c in (500, 501, 502, 503, 504):  # a long shared way, forks far down, one a prefix of the others
        for t in range(deep - (7 if c == 502 else 0)):
            rows.append((c, t, "u", f"long {t}" if t < deep - 5 or c % 2 else f"fork {c}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, words, deep, first", [(1, 1, 0, 8), (2, 2, 40, 2), (3, 3, 30, 1), (4, 50, 25, 8)])
def test_trie_is_brute_forces(spark, monkeypatch, seed, words, deep, first):
    monkeypatch.setattr(tries, "PART", 5)
    monkeypatch.setattr(tries, "BLOCK", 8)
    rows = rows_of(random.Random(seed), 150, words, deep)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    turns, ids = tries.with_base_prompts(tries.turns_in_order(table))
    got = tries.prefix_trie(turns, ids, first)
    assert got.columns == COLUMNS and {t for _, t in got.dtypes[:-1]} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == slow(rebuilt(rows))


def test_odd_conversations(spark, tmp_path):
    """Null turns, roles, texts and ids, ties and repeated rows, conversations left without turns, absent and short bases, clashing names; an empty table."""
    rows = [(100, None, "u", "first"), (100, 3, None, None), (100, 3, "a", "tie"), (100, 3, "a", "tie"), (101, 1, "u", "own"), (102, 0, "u", ""), (None, 0, "u", "no one's"), (205, 0, "u", "x"), (206, 0, "u", "x"), (-50, 0, "u", "x"), (-50, 1, "a", "é" * 100 + "2"), (-50, 1, "a", "é" * 100 + "1")]
    clash = {c: F.lit("clash") for c in ("pos", "a", "b", "chars", "part", "row", "n", "w", "seq", "h", "base", "depth", "owner")}
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(clash)
    turns, ids = tries.with_base_prompts(tries.turns_in_order(table))
    assert ids.count() == 6
    want = rebuilt([r for r in rows if r[0] != -50])
    want[-50] = [("u", "x"), ("a", "é" * 100 + "1"), ("a", "é" * 100 + "2")]  # the remainder has the dividend's sign: its base is 0
    h = zlib.crc32(b"-50") % 6
    want[-50] = want[-50][h:]
    got = sorted(map(tuple, tries.prefix_trie(turns, ids).collect()), key=str)
    # Ties of -50 fall in the order of the texts' bits, which brute force doesn't know: its shape alone.
    shape = lambda found: sorted(str(r[:-1]) for r in found)
    assert shape(got) == shape(slow(want)) and any(not ts for ts in want.values())
    table.limit(0).write.parquet(str(tmp_path / "conversations.parquet"))
    assert tries.op12_conversation_trie(spark, str(tmp_path)).count() == 0
    only = spark.createDataFrame([(7, 0, "u", "x")], "conv_id long, turn long, role string, text string")
    turns, ids = tries.with_base_prompts(tries.turns_in_order(only))
    assert sorted(map(tuple, tries.prefix_trie(turns, ids).collect()), key=str) == slow(rebuilt([(7, 0, "u", "x")]))


def test_query(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, tries.op12_conversation_trie(spark, folder).collect()), key=str) == slow(rebuilt(rows))


def test_many_rounds(spark, monkeypatch):
    """Two conversations alike for fifty turns, two turns a round."""
    monkeypatch.setattr(tries, "BLOCK", 2)
    rows = [(c, t, "u", f"{t}" if t < 50 else f"{c} {t}") for c in (100, 101, 102) for t in range(50 + c % 4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns, ids = tries.with_base_prompts(tries.turns_in_order(table))
    assert sorted(map(tuple, tries.prefix_trie(turns, ids, 2).collect()), key=str) == slow(rebuilt(rows))
