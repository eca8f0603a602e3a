"""Exact token counts of every prefix of a text, by dynamic programming.

For a byte-pair encoding whose tokens all encode to themselves, a sequence of tokens is the
encoding of its bytes exactly if every two neighbours are (they are then what encoding
their joined bytes gives). So the encodings of all prefixes form one table: the last token
of a prefix is the token t that ends there and that goes with the last token of the prefix
before t, and the count is one more than the count there. One pass fills it; questions of
truncation and budget are then look-ups.

The pre-tokenizer cuts the text into pieces first. A prefix that ends inside a piece cuts
there too, in the same places, with three exceptions, which are set right below: runs of
white space (their last character goes with what follows), the contractions 're, 've and
'll, and special tokens (ordinary text until complete).
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, id_and_text, read_table

# Fixed values of the byte-level BPE format: the pre-tokenizer's pattern, and the contractions of two letters.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts at every character prefix of a text, for a byte-level BPE in a tokenizer JSON file."""

    def __init__(self, path: str, cache: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_alphabet()
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_re = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.space_runs = regex.compile(r"\p{White_Space}{2,}")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.verified = False
        self.cache = BoundedCache(self._piece, cache)

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a few bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def verify(self) -> None:
        """Raise where a token doesn't encode to itself, on which the table of prefixes rests."""
        if self.verified:
            return
        other = next((b for b in self.ids if b and b.decode(errors="replace") not in self.special and self.merged(b) != [b]), None)
        if other is not None:
            raise ValueError(f"the token {other!r} doesn't encode to itself")
        self.verified = True

    def goes_with(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            a, b = self.bytes_of[left], self.bytes_of[right]
            known = self.merged(a + b) == [a, b]
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def table(self, data: bytes) -> list[int]:
        """Tokens of data[:i] for i from 0 to len(data), taken as one piece."""
        n, ids, longest, pairs = len(data), self.ids, self.longest, self.pairs
        last, count = [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                token = ids.get(data[j:i])
                if token is None:
                    continue
                if j:
                    fits = pairs.get((last[j], token))
                    if fits is None:
                        fits = self.goes_with(last[j], token)
                    if not fits:
                        continue
                last[i], count[i] = token, count[j] + 1
                break
        return count

    def _piece(self, piece: str) -> bytes:
        """Counts after each character of the piece, as 32-bit integers."""
        data = piece.encode()
        counts = self.table(data)
        if len(data) == len(piece):
            kept = counts[1:]
        else:
            kept = [counts[i + 1] for i in range(len(data)) if i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80]
        if piece in LONG_CONTRACTIONS:
            kept[1] = 2
        return array("i", kept).tobytes()

    def _ordinary(self, text: str) -> np.ndarray:
        """Counts after each character of a text without special tokens."""
        if not text:
            return np.empty(0, dtype=np.int32)
        found = self.pieces.findall(text)
        flat = np.frombuffer(bytearray().join(map(self.cache.__getitem__, found)), dtype=np.int32)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        totals = flat[np.cumsum(lengths) - 1]
        flat += np.repeat(np.cumsum(totals, dtype=np.int32) - totals, lengths)
        for m in self.space_runs.finditer(text):
            a, b = m.span()
            flat[a:b] = np.frombuffer(self.cache[m[0]], dtype=np.int32) + (flat[a - 1] if a else 0)
        return flat

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to len(text)."""
        zero = np.zeros(1, dtype=np.int32)
        if self.special_re is None or not any(s in text for s in self.special):
            return np.concatenate([zero, self._ordinary(text)])
        out, base, at = [zero], 0, 0
        for m in self.special_re.finditer(text):
            part = self._ordinary(text[at : m.end() - 1])
            whole = int(part[m.start() - at - 1]) if m.start() > at else 0
            out += [part + np.int32(base), np.array([base + whole + 1], dtype=np.int32)]
            base, at = base + whole + 1, m.end()
        return np.concatenate([*out, self._ordinary(text[at:]) + np.int32(base)])


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary file and Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def longest_prefix_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def prefix_token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", flush_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_bytes, prefix_tokens): element i of prefix_tokens (from 0) is the exact token count of the first i characters.

    A null or empty text has [0]. Null ids and repeated rows are kept as they are, an empty
    table gives none, other columns are left out. Whole texts are counted, whatever their
    length; output is passed on in batches of about flush_bytes. A vocabulary with a token that
    doesn't encode to itself is refused.
    """
    counter(tokenizer_path).verify()
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("prefix_tokens", pa.list_(pa.int32()))])

    def batch(ids: list, sizes: list, tables: list) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in tables])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tables)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for b in batches:
            ids, sizes, tables, held = [], [], [], 0
            for doc_id, n, text in zip(b["doc_id"], b["n_bytes"], b["text"], strict=True):
                ids.append(doc_id.as_py())
                sizes.append(n.as_py())
                tables.append(c.prefix_counts(text.as_py()))
                held += tables[-1].nbytes
                if held >= flush_bytes:
                    yield batch(ids, sizes, tables)
                    ids, sizes, tables, held = [], [], [], 0
            if ids:
                yield batch(ids, sizes, tables)

    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return texts.mapInArrow(run, "doc_id long, n_bytes long, prefix_tokens array<int>")


def truncation(counts: DataFrame, budget: int) -> DataFrame:
    """From prefix_token_counts: characters of each text's longest prefix of at most budget tokens. No text is read or encoded again."""
    last = F.expr(f"array_max(filter(transform(prefix_tokens, (c, i) -> if(c <= {int(budget)}, i, -1)), i -> i >= 0))")
    return counts.select("doc_id", last.cast("long").alias("n_chars_within"))


def op2_prefix_token_counts(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    counts = prefix_token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path)
    total = F.element_at("prefix_tokens", -1)
    return counts.select("doc_id", "n_bytes", total.cast("long").alias("n_tokens"), (total > 1024).alias("over_limit"))
