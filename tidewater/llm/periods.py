"""Periodic runs of words, by Gusfield and Stoye's linear method for tandem repeats (2004).

A tandem repeat, or square, is a stretch of words said twice in a row. Of a text's words:

1. The Lempel-Ziv blocks are found; around their borders the squares of a leftmost covering set.
   Each of the other kinds of square is some steps to the right of one of those.
2. So each is walked to the right, from a place in the suffix tree over its suffix link to the
   next place, for as long as the next word goes on with the period. That gives the vocabulary:
   one place in the tree for each different square.
3. The leaves below a place are a square's occurrences. Those of one period that follow each other
   are one run.

The tree is kept as its sorted suffixes and the ranks of all stretches of 1, 2, 4 ... words: a place
is an interval of suffixes that begin alike, the suffix link of a place is the interval around
the suffix one word on, and common extensions of two places to both sides are read off the ranks.
Only squares of roots that are no repeats themselves are followed: a run of period q needs no
squares of 2q, and there are at most n log n places of the others.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flushed, id_and_text, read_table, released

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 12  # words of a run


class Suffixes:
    """The sorted suffixes of a sequence, and the ranks of its stretches of 2^l items."""

    def __init__(self, items: np.ndarray):
        self.n = n = len(items)
        rank = np.unique(items, return_inverse=True)[1].astype(np.int64)
        self.levels, width = [rank.astype(np.int32)], 1
        while True:
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1
            self.order = np.argsort(key, kind="stable")
            ranked = key[self.order]
            rank = np.empty(n, dtype=np.int64)
            rank[self.order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
            if rank[self.order[-1]] == n - 1:
                break
            self.levels.append(rank.astype(np.int32))
            width *= 2
            if width >= n:
                break
        self.rank = rank

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items from each a on equal those from b on; a and b differ."""
        a, b = a.copy(), b.copy()
        begun = a.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            ranks = self.levels[level]
            inside = np.flatnonzero((a < self.n) & (b < self.n))
            same = inside[ranks[a[inside]] == ranks[b[inside]]]
            a[same] += 1 << level
            b[same] += 1 << level
        return a - begun

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items up to each a, itself included, equal those up to b."""
        a, b = a.copy(), b.copy()
        begun = a.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            ranks, width = self.levels[level], 1 << level
            inside = np.flatnonzero((a >= width - 1) & (b >= width - 1))
            same = inside[ranks[a[inside] - width + 1] == ranks[b[inside] - width + 1]]
            a[same] -= width
            b[same] -= width
        return begun - a

    def previous(self) -> np.ndarray:
        """The length of the longest stretch from each place on that also begins at an earlier one."""
        n = self.n
        order = self.order.tolist()
        before, after, places = [-1] * n, [-1] * n, self.rank.tolist()
        up, down = list(range(-1, n - 1)), [*range(1, n), -1]
        for i in range(n - 1, -1, -1):  # the largest place left: its neighbours among the sorted suffixes are earlier ones
            r = places[i]
            u, d = up[r], down[r]
            if u >= 0:
                before[i] = order[u]
                down[u] = d
            if d >= 0:
                after[i] = order[d]
                up[d] = u
        longest = np.zeros(n, dtype=np.int64)
        for found in (np.array(before), np.array(after)):
            some = np.flatnonzero(found >= 0)
            longest[some] = np.maximum(longest[some], self.ahead(some, found[some]))
        return longest

    def places(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals, from low up to high, of the sorted suffixes that begin with the size items from each at on."""
        begins = lambda where: (self.order[where] == at) | (self.ahead(self.order[where], np.where(self.order[where] == at, (at + 1) % self.n, at)) >= size)
        low, high = np.zeros(len(at), dtype=np.int64), self.rank[at]
        while (open_ := low < high).any():  # the first suffix that begins so
            middle = (low + high) // 2
            good = begins(middle)
            high = np.where(open_ & good, middle, high)
            low = np.where(open_ & ~good, middle + 1, low)
        first = high
        low, high = self.rank[at], np.full(len(at), self.n - 1, dtype=np.int64)
        while (open_ := low < high).any():  # the last one
            middle = (low + high + 1) // 2
            good = begins(middle)
            low = np.where(open_ & good, middle, low)
            high = np.where(open_ & ~good, middle - 1, high)
        return first, low + 1


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, offset): for each entry its number as often as it counts, and 0, 1, 2 ... beside."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


@functools.lru_cache(100_000)
def shorter_roots(k: int) -> tuple[int, ...]:
    """k over each of its prime divisors."""
    out, rest, p = [], k, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(k // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return (*out, k // rest) if rest > 1 else tuple(out)


def covering(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of squares around the borders of Lempel-Ziv blocks, which cover all kinds of square from the left."""
    longest = s.previous().tolist()
    starts, at = [], 0
    while at < s.n:
        starts.append(at)
        at += max(1, longest[at])
    h = np.array(starts)
    ends = np.append(h[1:], s.n)  # of a block, where the next begins
    sizes = ends - h
    found = []
    # Squares whose right half begins in the block's next one, or on its border.
    which, k = spread(np.where(ends < s.n, np.minimum(sizes, s.n // 2), 0))
    k = k + 1
    if len(k):
        border = ends[which]
        q = border - k
        forward, back = s.ahead(border, q), np.where(q > 0, s.behind(border - 1, np.maximum(q - 1, 0)), 0)
        start = np.maximum(q - back, q - k + 1)
        good = (forward + back >= k) & (forward > 0)
        found.append((start[good], k[good]))
    # Squares from before the block with their middle in it.
    which, k = spread(np.minimum(np.minimum(sizes + np.append(sizes[1:], 0), s.n // 2), s.n - 1 - h))
    k = k + 1
    if len(k):
        border = h[which]
        q = border + k
        forward, back = s.ahead(border, q), np.where(border > 0, s.behind(np.maximum(border - 1, 0), q - 1), 0)
        start = np.maximum(border - back, border - k + 1)
        good = (forward + back >= k) & (forward > 0) & (back > 0) & (start + k <= ends[which])
        found.append((start[good], k[good]))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    start, k = (np.concatenate(x) for x in zip(*found, strict=True))
    # Those whose root is itself a repeat add nothing.
    roots = [shorter_roots(int(x)) for x in k]
    which, nth = spread(np.array([len(r) for r in roots], dtype=np.int64))
    if len(which):
        p = np.array([roots[w][i] for w, i in zip(which.tolist(), nth.tolist(), strict=True)])
        repeated = which[s.ahead(start[which], start[which] + p) >= 2 * k[which] - p]
        single = np.ones(len(k), dtype=bool)
        single[repeated] = False
        start, k = start[single], k[single]
    return start, k


def vocabulary(s: Suffixes, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One (start, root length) of each different square: those of the covering set, and all on the walks to their right."""
    steps = np.minimum(s.ahead(start, start + k) - k, k - 1) + 1  # after k steps a walk meets its own beginning
    which, step = spread(steps)
    start, k = start[which] + step, k[which]
    level = np.int64(np.floor(np.log2(2 * k + 0.5)))
    first, last = np.empty(len(k), dtype=np.int64), np.empty(len(k), dtype=np.int64)
    for l in np.unique(level):
        of, ranks = level == l, s.levels[min(l, len(s.levels) - 1)] if l < len(s.levels) else s.rank
        first[of], last[of] = ranks[start[of]], ranks[start[of] + 2 * k[of] - (1 << l)]
    one = np.unique(np.stack([k, first, last]), axis=1, return_index=True)[1]
    return start[one], k[one]


def runs_of(items: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period), sorted, of every run of at least least items and two periods that no neighbour extends; the period is the smallest."""
    if len(items) < max(2, least):
        return []
    s = Suffixes(items)
    start, k = covering(s)
    if not len(k):
        return []
    start, k = vocabulary(s, start, k)
    low, high = s.places(start, 2 * k)
    which, offset = spread(high - low)
    at, k = s.order[low[which] + offset], k[which]
    sort = np.lexsort((at, k))
    at, k = at[sort], k[sort]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (at[1:] > at[:-1] + 1)]))
    first, last, period = at[new], at[np.append(new[1:], len(at)) - 1], k[new]
    length = last - first + 2 * period
    good = length >= least
    return sorted(zip(first[good].tolist(), length[good].tolist(), period[good].tolist(), strict=True))


def may_have_runs(words: list[str], least: int = LEAST) -> bool:
    """Whether some stretch of half of least words is there twice: a run has one, as it goes on for that long one period on."""
    width = least // 2
    if len(words) < least:
        return False
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64) | np.uint64(1)
    n, total = len(hashes) - width + 1, np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for j in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def find_runs(words: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    if not may_have_runs(words, least):
        return []
    seen: dict[str, int] = {}
    return runs_of(np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64), least)


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run says again after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words, of every tenth id (by its CRC) periodic from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _each(docs: DataFrame, row: Callable, schema: pa.Schema, ddl: str, least: int, rebuild: Callable | None) -> DataFrame:
    """row(doc_id, words, runs) of each document, text by text: no document meets another, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                    key, words = doc_id.as_py(), WORD.findall(text.as_py())
                    if rebuild is not None:
                        words = rebuild(key, words)
                    yield row(key, words, find_runs(words, least))

        yield from flushed(rows(), schema, lambda r: sum(len(x) for x in r if isinstance(x, (str, list))) * 8)

    return docs.mapInArrow(released(run), ddl)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rebuild: Callable | None = None) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed): every document's runs by start and period, and its words without what they say again, joined by one space.

    least: words of a run. rebuild(doc_id, words): the words to look at instead. Null and empty
    texts have no runs and an empty collapsed text; null and repeated ids are rows like others;
    an empty table gives no rows; other columns are left out. A text is one task's work: about 150
    bytes a word where some half of a least run repeats in it, and that many again for a long period.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("runs", RUNS), ("collapsed", pa.string())])
    row = lambda key, words, runs: (key, [{"start": a, "length": n, "period": p} for a, n, p in runs], " ".join(collapse(words, runs)))
    return _each(id_and_text(docs, id_col, text_col), row, schema, "doc_id long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", least, rebuild)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rebuild: Callable | None = None) -> DataFrame:
    """periodic_runs in short: how many runs, the longest (ties: the smallest start, then period; null without runs), and digests of all of them and of the collapsed text."""
    names = ["n_runs", "start", "length", "period", "exponent_milli"]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in names), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def row(key, words, runs):
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        exponent = None if period is None else 1000 * length // period
        return (key, len(runs), start, length, period, exponent, _digest("".join(f"{a},{n},{p}\n" for a, n, p in runs)), _digest(" ".join(collapse(words, runs))))

    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", runs_sha256 string, collapsed_sha256 string"
    return _each(id_and_text(docs, id_col, text_col), row, schema, ddl, least, rebuild)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return run_digests(read_table(spark, sf_dir, "documents"), rebuild=planted)
