"""Runs of words against brute force over all periods and starts."""

import hashlib
import random
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import periods


def slow_runs(x, least):
    n, out = len(x), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if x[i] == x[i + p]:
                j = i
                while j + p < n and x[j] == x[j + p]:
                    j += 1
                run = x[i : j + p]
                if len(run) >= max(least, 2 * p) and not any(all(run[t] == run[t + q] for t in range(len(run) - q)) for q in range(1, p)):
                    out.append((i, len(run), p))
                i = j
            i += 1
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.sampled_from([2, 3, 6, 12]))
def test_runs_are_brute_forces(x, least):
    assert periods.runs_of(np.array(x, dtype=np.int64), least) == slow_runs(x, least)


def test_planted_periods():
    rng = random.Random(3)
    for trial in range(400):
        x = [rng.randrange(rng.choice((2, 3, 30))) for _ in range(rng.randrange(2, 120))]
        for _ in range(rng.randrange(3)):
            a, p = rng.randrange(len(x)), rng.randrange(1, 20)
            e = rng.randrange(a, len(x)) + 1
            x[a:e] = [x[a + i % p] if a + i % p < e else x[a] for i in range(e - a)]
        words = [f"w{v}" for v in x]
        assert periods.find_runs(words) == slow_runs(x, 12)


def test_squares_of_a_fibonacci_word():
    a, b = "a", "ab"
    while len(b) < 300:
        a, b = b, b + a
    assert periods.runs_of(np.array([ord(c) for c in b]), 2) == slow_runs(b, 2)


def test_long_texts():
    """Two hundred thousand words: periodic, of one word, and without a run."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    began = time.perf_counter()
    assert periods.find_runs(words) == []
    a, p = 30_000, 21_001
    made = words[:a] + [words[a + i % p] for i in range(170_000)]
    assert periods.find_runs(made) == [(a, 170_000, p)] or periods.find_runs(made)[0][2] == p
    assert periods.find_runs(["long"] * 200_000) == [(0, 200_000, 1)]
    assert time.perf_counter() - began < 60


def slow_row(doc_id, text):
    words = periods.WORD.findall(text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words, 12)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *longest, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_is_brute_force(spark, tmp_path):
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    texts = [None, "", " \n", "one", "a b c d e f " * 3, "x " * 30, "a\x85b c d \x1f " * 15, "Ünï 漢字\t😀 " * 9] + [prose(rng.randrange(1, 150)) for _ in range(150)]
    line = prose(9)
    texts += [f"{prose(20)} {' '.join([line] * 4)} {prose(10)} {' '.join([line] * 2)}"] * 3
    rows = list(enumerate(texts)) + [(None, "x " * 30), (3, "x " * 30), (-17, prose(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "start", "n_runs", "collapsed")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = periods.op13_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((slow_row(*r) for r in rows), key=str)
    assert sum(r["n_runs"] > 0 for r in got.collect()) > 15
    whole = {r["doc_id"]: r for r in periods.periodic_runs(docs.where("doc_id in (5, 4)")).collect()}
    assert [tuple(r) for r in whole[5]["runs"]] == [(0, 30, 1)] and whole[5]["collapsed"] == "x" and whole[4]["collapsed"] == "a b c d e f"
    assert periods.run_digests(docs.limit(0)).count() == 0
