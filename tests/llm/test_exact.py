"""The cuckoo index against dictionaries, and its query against brute force."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import exact


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["put", "delete"]), st.integers(0, 60), st.integers(0, 9)), max_size=400), st.sampled_from([1, 2, 64]))
def test_filter_is_a_dictionary(steps, buckets):
    known, want = exact.CuckooFilter(buckets), {}
    for step, i, length in steps:
        if step == "put":
            assert known.put(key(i), 1, (length, i, 0)) == (i not in want)
            count, best = want.get(i, (0, (length, i, 0)))
            want[i] = (count + 1, exact.better(best, (length, i, 0)))
        else:
            got = known.delete(key(i))
            assert (got and tuple(got)) == want.pop(i, None)
    assert known.live == len(want) and {k: tuple(r) for _, k, r in known.entries()} == {key(i): r for i, r in want.items()}
    assert all(known.find(key(i)) >= 0 for i in want) and all(known.find(key(i)) < 0 for i in range(61) if i not in want)


def test_overflow_resizes_from_stored_keys():
    known = exact.CuckooFilter(1)
    for i in range(5000):
        known.put(key(i), 1, (i, i, i))
    assert known.live == 5000 and known.mask + 1 >= 5000 / exact.SLOTS
    # Digests of one fingerprint and first bucket: nine can't have the eight slots, at any size until their bits differ.
    alike = [b"\x07\x07" + bytes(6) + (i << 20).to_bytes(8, "big") + bytes(16) for i in range(12)]
    for k in alike:
        known.put(k, 1, (1, 1, 1))
    assert all(known.find(k) >= 0 for k in alike) and known.live == 5012


def test_equal_fingerprints_are_told_apart():
    """Digests that share fingerprint and buckets are verified by their stored keys."""
    known = exact.CuckooFilter(8)
    a, b = (b"\x01\x02" + bytes(14) + bytes([i]) * 16 for i in (1, 2))
    known.put(a, 1, (1, 1, 1))
    assert known.find(b) < 0 and known.delete(b) is None
    assert known.put(b, 1, (2, 2, 2)) and known.delete(a) == [1, (1, 1, 1)] and known.find(b) >= 0


def slow(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [(rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    texts = [None, "", " \t", "a b", "ab", "a  b", "\x0bab\x0c", "a\x85b", "a b", "\x1fab", "é 漢 😀", "é漢😀", "A b"] + [f"text {rng.randrange(40)}" + " " * rng.randrange(3) for _ in range(300)] + ["hot"] * 200
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a b"), (3, "a b"), (None, "hot"), (None, "only  null"), (-5, "hot ")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("held", [1, 7, 50_000])
def test_groups_are_brute_forces(spark, held):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("digest", "number", "shard", "rows", "length", "keep_id", "kept", "slot")}).repartition(5)
    made = exact.digested(docs)
    got = exact.ExactIndex.empty(spark, 3).insert(made, held).resolve(made).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == slow(rows)
    kept = [r for r in got if r["kept"]]
    assert len({r["text_sha256"] for r in kept}) == len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact.exact_groups(docs.limit(0)).count() == 0


def test_batches_and_deletions(spark, tmp_path):
    """Documents in three batches, the state written and read between, some taken out: as if only the others had come."""
    rows = [(i, t) for i, (_, t) in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = exact.digested(docs)
    index = exact.ExactIndex.empty(spark, 4)
    for k in range(3):
        index = index.insert(made.where(f"doc_id % 3 = {k}"))
        index.state.write.parquet(str(tmp_path / f"state{k}"))
        index = exact.ExactIndex(4, spark.read.schema(index.state.schema).parquet(str(tmp_path / f"state{k}")))
    gone = "doc_id % 4 = 1 or doc_id in (select min(doc_id) from ids)"
    made.createOrReplaceTempView("ids")
    out, live = made.where(gone), made.where(f"not ({gone})")
    index = index.remove(out, live)
    left = {r["doc_id"] for r in live.select("doc_id").collect()}
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in index.resolve(live).collect()), key=str)
    assert got == slow([r for r in rows if r[0] in left])
    digests = {hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).digest() for i, t in rows if i in left}
    assert {bytes(r["digest"]) for r in index.state.select("digest").collect()} == digests
