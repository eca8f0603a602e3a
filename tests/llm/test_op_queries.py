"""Each opN_ query on small tables: its columns, digests included, against brute force or the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from test_operators import WORD, slow_components, slow_contaminated, slow_fingerprint, slow_jump, slow_landmarks, slow_peaks, slow_spans  # noqa: E402
from tidewater.llm import queries, sharding  # noqa: E402


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item, passage = prose(30), prose(55)
    made = [None, "", " \t", "One two", "Ünïcode <|endoftext|> \x00 漢字", "long " * 1500, f"{passage} {prose(40)}", f"{prose(9)} {passage}", f"{prose(20)} {item} {prose(5)}", "Released under the MIT License.\nvileword"]
    made += [prose(rng.randrange(3, 200)) for _ in range(30)]
    return made + made[10:16] + [made[20] + " more"], item


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    at = tmp_path_factory.mktemp("queries")
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts[0])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(5, texts[1]), (6, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i == 9)) for i in range(len(docs))], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(1, "u", "é" * 60), (2, "u", "é" * 60), (3, None, "short"), (4, "v", "short"), (5, "w", None), (0, "w", "é" * 60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


def rows(spark, folder, name, key="doc_id"):
    got = queries.QUERIES[name](spark, folder).collect()
    assert len({r[key] for r in got}) == len(got)
    return {r[key]: r for r in got}


def test_op1(spark, folder):
    got = rows(spark, folder, "op1_warc_chunks", "page_id")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {0: (120, sha("é" * 60), "response", None), 1: (120, sha("é" * 60), "revisit", 0), 2: (120, sha("é" * 60), "revisit", 0), 3: (5, sha("short"), "response", None), 4: (5, sha("short"), "response", None), 5: (0, sha(""), "response", None)}
    assert {k: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for k, r in got.items()} == want


def test_op2(spark, folder, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, folder, "op2_prefix_token_counts")
    for i, t in enumerate(texts[0]):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)
    assert got[5]["over_limit"]


def test_op3(spark, folder, texts):
    got = rows(spark, folder, "op3_wav_fingerprints")
    for i, t in enumerate(texts[0]):
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] == len(payload) + 44 and re.fullmatch("[0-9a-f]{64}", r["media_sha256"])
        if len(payload) < 2000:
            codes = slow_landmarks(slow_peaks(np.frombuffer(payload, dtype=np.uint8)))
            assert r["feature"].split(":")[0] == str(len(codes))
    assert all(got[10 + j][c] == got[40 + j][c] for j in range(6) for c in ("media_sha256", "feature"))


def test_op4(spark, folder):
    got = queries.QUERIES["op4_license_scan"](spark, folder).collect()
    assert [(r["doc_id"], r["line_no"], r["license"], r["differing_words"], r["differences"]) for r in got] == [(9, 0, "MIT", 0, "")]


def test_op5(spark, folder, texts):
    got = rows(spark, folder, "op5_ordinal_toxicity")
    assert len(got) == len(texts[0]) and all(0 <= r["expected_severity"] <= 2 and r["toxic"] == (r["grade"] > 0) for r in got.values())


def test_op6(spark, folder, texts):
    got = rows(spark, folder, "op6_simhash_trie")
    prints = np.array([slow_fingerprint(t) for t in texts[0]], dtype=np.uint64)
    assert [got[i]["fingerprint"] for i in range(len(prints))] == [f"{p:016x}" for p in prints.tolist()]
    assert [got[i]["component_id"] for i in range(len(prints))] == slow_components(range(len(prints)), prints).tolist()


def test_op7_and_op8(spark, folder, texts):
    spans = sorted(map(tuple, queries.QUERIES["op7_sparse_suffixes"](spark, folder).collect()))
    assert spans == slow_spans([(i, t) for i, t in enumerate(texts[0]) if t is not None], 50) and spans
    found = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in queries.QUERIES["op8_benchmark_windows"](spark, folder).collect()}
    assert found == slow_contaminated(list(enumerate(texts[0])), [(5, texts[1])]) and set(found) == {(8, 5)}


def test_op9(spark, folder, texts):
    from pyspark.sql import functions as F

    got = rows(spark, folder, "op9_jump_sharding")
    keys = {r["i"]: r["h"] & (1 << 64) - 1 for r in spark.range(len(texts[0])).select(F.col("id").alias("i"), F.xxhash64("id").alias("h")).collect()}
    for i, t in enumerate(texts[0]):
        r = got[i]
        assert (r["size"], r["text_crc32"], r["law"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key")
        assert r["shard"] == slow_jump(keys[i], 8) and r["grown_shard"] == slow_jump(keys[i], 9) and r["grown_shard"] in (r["shard"], 8)
    slots = sorted((r["shard"], r["slot"]) for r in got.values())
    assert all(slot == sum(s == shard for s, _ in slots[:at]) for at, (shard, slot) in enumerate(slots))
    assert sharding.MULTIPLIER == 2862933555777941757


def test_op10(spark, folder, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(spark, folder, "op10_word_bpe")
    for i, t in enumerate(texts[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = np.array(ids, dtype="<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_words_are_those_of_the_contracts():
    assert WORD.pattern == r"[^\x20\x09-\x0D]+"


def test_op10_keeps_the_words_it_has_met():
    """300 000 different words, read twice: each is encoded once, and as the library does."""
    from tidewater.llm import bpe
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    coder, rng = bpe.WordBPE(path), random.Random(3)
    words = list({"".join(rng.choices("etaoinshrdlu", k=rng.randrange(5, 11))) for _ in range(330_000)})[:300_000]
    made, make = [], coder.cache.make
    coder.cache.make = lambda word: made.append(word) or make(word)
    first, again = coder.encode(" ".join(words)), coder.encode(" ".join(words))
    assert len(words) == len(made) == 300_000 and (first == again).all()
    for text in (" ".join(words[:3000]), "aaaaaaaa" * 40 + " abababab" * 3, "x" * 5000):
        assert coder.encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
