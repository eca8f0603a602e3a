"""Word-level byte-pair encoding and decoding.

Encoding keeps a word's symbols in a doubly linked list and its mergeable neighbours in a
priority queue by merge rank and place; an entry whose symbols have since been merged is
stale and skipped. Decoding joins the vocabulary's strings.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, flushed, id_and_text, read_table, released
from .token_counts import byte_alphabet

# Fixed value of the vocabulary's format: the pre-tokenizer's pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


class WordBPE:
    """Encoder and decoder for a BPE with word ends in a tokenizer JSON file."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        self.inner, self.final = [0] * 256, [0] * 256
        for c, b in byte_alphabet().items():
            self.inner[b], self.final[b] = vocab[c], vocab[c + end]
        self.ranks, self.merged = {}, []
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.words = regex.compile(WORDS)
        self.cache = BoundedCache(self.packed_word, cache)

    def encode_word(self, data: bytes) -> list[int]:
        merged, rank_of, push, pop = self.merged, self.ranks.get, heapq.heappush, heapq.heappop
        n = len(data)
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        # An entry is a whole number: the rank, of one pair only, above the place.
        queue = [rank << 32 | i for i, rank in enumerate(map(rank_of, zip(symbols, symbols[1:], strict=False))) if rank is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = pop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or rank_of((symbols[i], symbols[j])) != rank:
                continue  # stale
            symbols[i] = new = merged[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := rank_of((new, symbols[k]))) is not None:
                    push(queue, found << 32 | i)
            h = before[i]
            if h >= 0 and (found := rank_of((symbols[h], new))) is not None:
                push(queue, found << 32 | h)
        return [s for s in symbols if s >= 0]

    def packed_word(self, word: str) -> bytes:
        ids = self.encode_word(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        """White space only parts words here, so it isn't normalised first; each character is lower-cased by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.cache.__getitem__, self.words.findall(text.lower())))

    def encode(self, text: str) -> np.ndarray:
        """Token ids as little-endian 32-bit integers."""
        if self.special_re is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), dtype="<u4")
        parts = (np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self._plain(p) for p in self.special_re.split(text))
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, np.asarray(ids).tolist()))


_CODERS: dict[str, WordBPE] = {}


def coder(path: str) -> WordBPE:
    """One coder for each vocabulary file and Python worker."""
    if path not in _CODERS:
        _CODERS[path] = WordBPE(path)
    return _CODERS[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", flush_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are the text's tokens as little-endian unsigned 32-bit integers.

    A null or empty text has no tokens. Null ids and repeated rows are kept as they are, an
    empty table gives none, other columns are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer_path)

        def rows():
            for b in batches:
                for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                    ids = c.encode(text.as_py())
                    yield doc_id.as_py(), len(ids), ids.tobytes()

        return flushed(rows(), schema, lambda r: len(r[2]), flush_bytes)

    return id_and_text(docs, id_col, text_col).mapInArrow(released(run), "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer_path: str, flush_bytes: int = 8 << 20) -> DataFrame:
    """encode_documents' rows with the decoded string as decoded. Null ids decode to an empty string."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer_path)

        def rows():
            for b in batches:
                for doc_id, n, ids in zip(b["doc_id"], b["n_tokens"], b["ids"], strict=True):
                    data = ids.as_py() or b""
                    yield doc_id.as_py(), n.as_py(), data, c.decode(np.frombuffer(data, dtype="<u4"))

        return flushed(rows(), schema, lambda r: len(r[2]) + len(r[3]), flush_bytes)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(released(run), "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip(docs: DataFrame, tokenizer_path: str, flush_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every row: encode_documents and decode_documents in one pass, so one Python worker a task does both.

    A null or empty text has no tokens and decodes to an empty one; null ids and repeated rows are
    kept as they are; an empty table gives no rows; other columns are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer_path)

        def rows():
            for b in batches:
                for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                    ids = c.encode(text.as_py())
                    yield doc_id.as_py(), len(ids), ids.tobytes(), c.decode(ids)

        return flushed(rows(), schema, lambda r: len(r[2]) + len(r[3]), flush_bytes)

    return id_and_text(docs).mapInArrow(released(run), "doc_id long, n_tokens long, ids binary, decoded string")


def op10_word_bpe(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    rows = round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
