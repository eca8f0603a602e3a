"""Each operator against a brute-force version, an exact round trip, or its library."""

import hashlib
import json
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidewater.llm import bpe, components, decontam, license_texts, licenses, media, resemblance, sharding, simhash, suffixes, token_counts, toxicity, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with nulls, empties, exact and near copies, shared passages, a hot text, and a long one."""
    rng = random.Random(11)
    texts = [None, "", "   \n\t ", "one", "one two", "one two three", "\x1cA b\x85c d", "ÀÉ ß Σ σ İ"]
    base = [prose(rng, rng.randrange(20, 300)) for _ in range(40)]
    texts += base + base[:10] + [base[0]] * 15
    for t in base[:15]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(8)] + [f"{passage} {passage}", prose(rng, 20_000, 50)]
    return texts


# WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(1)
    big = "".join(chr(rng.randrange(32, 1000)) for _ in range(300_000))
    rows = [(7, "http://a/\r\nX: y", big, "clash"), (3, None, big, ""), (9, "u", None, ""), (4, "u", "", ""), (5, "u", "é" * 49, ""), (6, "u", "é" * 49, ""), (1, "u", "é" * 50, ""), (2, "u", "é" * 50, ""), (None, "u", big, ""), (3, "again", big, "")]
    index = warc.write_archives(warc.with_record_types(pages(spark, rows)), f"file://{tmp_path}/a", segment_bytes=1000)
    got = warc.read_chunks(index, f"file://{tmp_path}/a", chunk_bytes=10_000).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    last = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got if r["is_last"])
    want = Counter()
    for p, _, t, _ in rows:
        same = [q for q, _, u, _ in rows if (u or "") == (t or "") and q is not None]
        revisit = len((t or "").encode()) >= 100 and p != min(same)
        want[p, len((t or "").encode()), digest(t), "revisit" if revisit else "response", min(same) if revisit else None] += 1
    assert last == want
    parts = sorted((r["chunk_no"], bytes(r["chunk"]), r["digest_so_far"]) for r in got if r["page_id"] == 3 and r["url"] is None)
    assert b"".join(p[1] for p in parts).decode() == big and len(parts) > 20 and max(len(p[1]) for p in parts) == 10_000
    assert parts[0][2] == hashlib.sha256(parts[0][1]).hexdigest() and parts[-1][2] == digest(big)


def test_warc_refuses_damage(spark, tmp_path):
    index = warc.write_archives(warc.with_record_types(pages(spark, [(1, "u", "x" * 500, "")])), f"file://{tmp_path}/a")
    row = index.first()
    data = bytearray(zlib.decompress((tmp_path / "a" / row["archive"]).read_bytes(), 31).replace(b"xxxxx", b"xxyxx", 1))
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    (tmp_path / "a" / row["archive"]).write_bytes(z.compress(bytes(data)) + z.flush())
    damaged = spark.createDataFrame([(row["archive"], 0, (tmp_path / "a" / row["archive"]).stat().st_size, 1)], index.schema)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_chunks(damaged, f"file://{tmp_path}/a").collect()


def test_warc_of_others(spark, tmp_path):
    """An archive with other kinds of records and other digests, read without an index of our own."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    records = [
        ("WARC/1.0", "warcinfo", "application/warc-fields", None, "software: x\r\n" * 3),
        ("WARC/1.0", "request", "application/http; msgtype=request", None, "GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        ("WARC/1.0", "response", "application/http; msgtype=response", "sha1:ABCDEF", http + "<p>" * 400),
        ("WARC/1.1", "metadata", "text/plain", None, ""),
    ]
    data = b""
    for i, (version, kind, content, digest, block) in enumerate(records):
        head = f"{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nContent-Type: {content}\r\n" + (f"WARC-Payload-Digest: {digest}\r\n" if digest else "")
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        data += z.compress(f"{head}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n".encode()) + z.flush()
    (tmp_path / "x.warc.gz").write_bytes(data)
    index = warc.list_archives(spark, f"file://{tmp_path}")
    rows = warc.read_chunks(index, f"file://{tmp_path}", chunk_bytes=500).where("is_last").orderBy("record_id").collect()
    assert [(r["record_type"], r["payload_bytes"], r["page_id"]) for r in rows] == [("warcinfo", 39, None), ("request", 0, None), ("response", 1200, None), ("metadata", 0, None)]
    assert rows[2]["payload_digest"] == hashlib.sha256(b"<p>" * 400).hexdigest()


def test_warc_of_nothing(spark, tmp_path):
    index = warc.write_archives(warc.with_record_types(pages(spark, [])), f"file://{tmp_path}/a")
    assert warc.read_chunks(index, f"file://{tmp_path}/a").count() == 0


# Tokens

PIECES = st.lists(st.sampled_from([*"abcdefghij KLM.,'\n\t<|>0123", "<|endoftext|>", "<|startoftext|>", "'re", "'ll", "'ve", "  ", "   \n", "the", " and", "ing", "é", "漢字", "²½", "　", "\x85", "\x1c", "Σ", "İ", "é", "aaaaaaaaa"]), max_size=25).map("".join)


def test_vocabularies_are_verified(tmp_path):
    token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json")).verify()
    made = {"model": {"vocab": {"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4, "abc": 5}, "merges": ["a b", "b c"]}, "added_tokens": []}
    (tmp_path / "odd.json").write_text(json.dumps(made))
    with pytest.raises(ValueError, match="abc"):
        token_counts.PrefixCounter(str(tmp_path / "odd.json")).verify()


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_prefix_counts_are_the_librarys(libraries, text):
    counts = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json")).prefix_counts(text)
    encoded = libraries["byte_bpe_50k.json"].encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)
    assert counts.tolist() == [len(e.ids) for e in encoded]


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_word_bpe_is_the_librarys(libraries, text):
    own, library = bpe.coder(public_tokenizers.path("word_bpe_49k.json")), libraries["word_bpe_49k.json"]
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_token_tables(spark, corpus, libraries):
    docs = table(spark, corpus)
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = token_counts.prefix_token_counts(docs, path, flush_bytes=1000)
    want = [len(e.ids) for e in libraries["byte_bpe_50k.json"].encode_batch([t or "" for t in corpus], add_special_tokens=False)]
    rows = {r["doc_id"]: r for r in counts.collect()}
    assert [rows[i]["prefix_tokens"][-1] for i in range(len(corpus))] == want
    assert all(len(rows[i]["prefix_tokens"]) == len(t or "") + 1 and rows[i]["n_bytes"] == len((t or "").encode()) for i, t in enumerate(corpus))
    within = {r["doc_id"]: r["n_chars_within"] for r in token_counts.truncation(counts, 7).collect()}
    assert all(within[i] == token_counts.longest_prefix_within(np.array(rows[i]["prefix_tokens"]), 7) for i in rows)
    tripped = {r["doc_id"]: r for r in bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    library = libraries["word_bpe_49k.json"]
    for i, e in enumerate(library.encode_batch([t or "" for t in corpus], add_special_tokens=False)):
        assert np.frombuffer(tripped[i]["ids"], dtype="<u4").tolist() == e.ids and tripped[i]["n_tokens"] == len(e.ids)
        assert tripped[i]["decoded"] == library.decode(e.ids, skip_special_tokens=False)
    apart = bpe.decode_documents(bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")), public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: r for r in apart.collect()} == tripped


# Media


def test_wav_is_lossless(spark, corpus):
    rows = {r["doc_id"]: r for r in media.wav_features(media.to_wav(table(spark, corpus))).collect()}
    for i, t in enumerate(corpus):
        data = (t or "").encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r["media_bytes"] == len(padded) + 44
    assert rows[8]["landmarks"] == rows[48]["landmarks"] and corpus[8] == corpus[48]


def slow_peaks(samples, frame=512, hop=256):
    """By the sums that define the transform, a frame at a time."""
    found = []
    frames = max(1, -(-len(samples) // hop))
    filled = [float(x) - 128 for x in samples] + [0.0] * (frames * hop + frame)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(frame // 2 + 1), np.arange(frame)) / frame)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / (frame - 1))
    for t in range(frames):
        power = [abs(x) for x in turn @ (np.array(filled[t * hop : t * hop + frame]) * taper)]
        for low, high in ((1, 11), (11, 41), (41, 111), (111, 257)):
            best = max(range(low, high), key=lambda k: power[k])
            if power[best] > 1.5 * sum(power[low:high]) / (high - low) + 1e-9:
                found.append((t, best))
    return sorted(found)


def slow_landmarks(found, fan_out=3, reach=15):
    codes = []
    for t, f in found:
        later = [(u, g) for u, g in found if u > t][:fan_out]
        codes += [(t << 32) | (f << 16) | (g << 6) | (u - t) for u, g in later if u - t <= reach]
    return sorted(codes)


@pytest.mark.parametrize("n", [192, 512, 768, 5000])
def test_spectral_features_by_direct_transform(n):
    rng = np.random.default_rng(n)
    samples = (128 + 40 * np.sin(np.arange(n) / 3) + 20 * np.sin(np.arange(n) / 11) + rng.integers(-20, 20, n)).astype(np.uint8)
    t, f = media.peaks(samples, block=3)
    assert list(zip(t.tolist(), f.tolist(), strict=True)) == slow_peaks(samples)
    assert media.landmarks(t, f).tolist() == slow_landmarks(slow_peaks(samples))


def test_peaks_of_a_tone():
    n = np.arange(4096)
    tone = (128 + 50 * np.sin(2 * np.pi * 60 / 512 * n)).astype(np.uint8)
    t, f = media.peaks(tone)
    assert set(np.flatnonzero(np.bincount(t[f == 60], minlength=15))) >= set(range(15))
    codes = media.landmarks(np.array([0, 0, 2]), np.array([5, 60, 7]))
    assert codes.tolist() == sorted([(0 << 32) | (5 << 16) | (7 << 6) | 2, (0 << 32) | (60 << 16) | (7 << 6) | 2])


def test_null_media(spark):
    made = media.to_wav(table(spark, ["a", "b"])).withColumn("media", F.when(F.col("doc_id") == 0, F.col("media")))
    rows = {r["doc_id"]: r for r in media.wav_features(made).collect()}
    assert rows[1]["payload_bytes"] is None and rows[1]["landmarks"] is None and rows[0]["payload_bytes"] == 192


# Licenses


SCANNER = licenses.Scanner(license_texts.templates())


def found_licenses(text):
    return [r for block in SCANNER.blocks(text) for r in SCANNER.scan(tuple(block))]


def test_license_scan(spark):
    lines = {
        "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "this work is licenced under the gnu general public license, version 3!": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "All rights reserved.": "All-Rights-Reserved",
        "My driving license and the warranty of my car are both over by now.": None,
    }
    texts = [f"some text\n{line}\nmore\n" for line in lines] + [None, "", "nothing here", "\nmy aunt came\n".join([*lines] * 2)]
    rows = licenses.scan_licenses(table(spark, texts, [*range(len(texts) - 1), None]).withColumn("line_no", F.lit("clash"))).collect()
    assert {r["block"]: r["license"] for r in rows} == lines and len(rows) == 3 * len(lines)
    assert {(r["line_no"], r["end_line"]) for r in rows if r["doc_id"] is not None} == {(1, 2)}
    assert [r["line_no"] for r in rows if r["doc_id"] is None] == list(range(0, 4 * len(lines), 2))
    exact = next(r for r in rows if r["block"].startswith("Released"))
    changed = next(r for r in rows if "licenced" in r["block"])
    assert exact["differing_words"] == 0 and exact["reduction"] > 0.4 and sorted(changed["differences"]) == ["+licenced", "-licensed"]
    assert licenses.scan_licenses(table(spark, [])).count() == 0


def test_license_names_are_told_apart():
    """Texts that a tolerance for differing words alone would give to a sister license."""
    lgpl = license_texts.TEXTS["LGPL-2.1"]
    gpl_line = "This program is free software: you can redistribute it and/or modify"
    mit, bsd = license_texts.TEXTS["MIT"].split("\n"), license_texts.TEXTS["BSD-3-Clause"].split("\n")
    want = {
        lgpl: "LGPL-2.1",
        "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the Apache License, Version 1.1.": None,
        "Licensed under the GNU General Public License, version 4.": None,
        "This work is not licensed under the MIT License.": None,
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        gpl_line: "ambiguous",
        mit[0]: "MIT",
        mit[2]: "ambiguous",  # MIT and MIT-0 share it
        bsd[2]: "ambiguous",
        license_texts.TEXTS["BSD-2-Clause"]: "BSD-2-Clause",
    }
    assert {t: found_licenses(t)[0][3] for t in want} == want and all(len(found_licenses(t)) == 1 for t in want)
    assert found_licenses(gpl_line)[0][4] == ["AGPL-3.0", "GPL-2.0", "GPL-3.0"] and found_licenses(bsd[2])[0][4] == ["BSD-2-Clause", "BSD-3-Clause"]


@pytest.mark.parametrize("name", sorted(license_texts.TEXTS))
def test_whole_licenses_however_they_are_laid_out(name):
    text = license_texts.TEXTS[name]
    paragraphs = text.split("\n")
    boxed = "\n\n".join(textwrap.fill(p, 60, initial_indent=" * ", subsequent_indent=" * ") for p in paragraphs)
    for laid in (text, "\n".join(textwrap.fill(p, 72) for p in paragraphs), " ".join(paragraphs), f"Copyright (c) 2020 Jo Doe\n\n{boxed}"):
        assert re.search(licenses.CUES, laid)
        rows = found_licenses(f"We were at sea for a week.\n{laid}\nThe end came soon.")
        assert [r[3] for r in rows if r[3]] == [name], [(r[3], r[2]) for r in rows]
    rows = found_licenses(f"{text}\n\n\n\nLicensed under CC BY-SA 4.0.")
    assert [r[3] for r in rows] == [name, "CC-BY-SA-4.0"]


NAMED_SHORTLY = {
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "SPDX-License-Identifier: CC-BY-SA-4.0": "CC-BY-SA-4.0",
    "MIT License": "MIT",
    "ISC License": "ISC",
    "Licensed under MIT.": "MIT",
    "Licensed under the GPL v2.": "GPL-2.0",
    "This program is licensed under GPLv3 or later.": "GPL-3.0",
    "Licensed under the GNU GPL, version 2 or any later version.": "GPL-2.0",
    "Licensed under the Mozilla Public License 2.0.": "MPL-2.0",
    "Licensed under the Apache License 2.0": "Apache-2.0",
    "GNU Lesser General Public License v3.0": "LGPL-3.0",
    "Released under the GNU Affero General Public License, v. 3.": "AGPL-3.0",
    "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
    # and what is none, or not that one
    "SPDX-License-Identifier: GPL-4.0": None,
    "Licensed under the Apache License 1.1": None,
    "Licensed under the GPL v1.": None,
    "This is not licensed under MIT.": None,
    "Driving License": None,
    "Your licence plate, version 2.0": None,
}


@pytest.mark.parametrize("text", NAMED_SHORTLY)
def test_licenses_named_in_a_line(text):
    assert re.search(licenses.CUES, text)
    for around in ("{}", "We were at sea for a week.\n\n{}\n\nThe end came soon."):
        rows = found_licenses(around.format(text))
        assert {r[3] for r in rows} == {NAMED_SHORTLY[text]}, rows


def test_parts_are_in_all_that_the_cues_match():
    """Each cue, however it is written, holds one of the parts."""
    cues = ["license", "Licence", "COPYRIGHT", "warranty", "redistribution", "permission", "permitted", "public domain", "Public at large", "Rights Reserved", "Creative Commons", "CC BY", "cc-by", "CC0", "merchantability", "liable", "Liability", "as is", "AS-IS", "free software", "restriction", "hereby", "source code", "source form", "source distribution", "compiled binary", "original software", "and/or", "relinquish", "MPL", "GPL", "LGPLv2", "GPL3", "acknowledgment"]
    assert all(re.search(licenses.CUES, c) and any(p in c.lower() for p in licenses.PARTS) for c in cues)
    body = licenses.CUES.removeprefix("(?i)")
    alternatives = re.split(r"\|(?![^(]*\))", body)
    assert len(alternatives) == 28 and all(any(re.search(a, c, re.I) for c in cues) for a in alternatives)


def test_passing_over_changes_no_winner(monkeypatch):
    """Blocks of all templates' sentences, some changed: the rows are those of confirming every template that saves bytes."""
    rng = random.Random(15)
    blocks = []
    for text in license_texts.templates().values():
        lines = [u for _, u in licenses.units(text) if u]
        for _ in range(3):
            some = rng.sample(lines, min(len(lines), rng.randrange(1, 4)))
            blocks.append(tuple((i, " ".join(w if rng.random() > 0.04 else "other" for w in u.split())) for i, u in enumerate(some)))
    quick = [SCANNER.scan(b) for b in blocks]
    monkeypatch.setattr(licenses.Scanner, "least", lambda *_: -(10**9))
    assert quick == [SCANNER.scan(b) for b in blocks] and sum(r[0][3] not in (None, "ambiguous") for r in quick) > 30


def test_licenses_said_again_and_lines_of_marks():
    rows = found_licenses("All rights reserved.\nAll rights reserved.\n" + "Released under the MIT License.\n" * 1500)
    assert [r[3] for r in rows] == ["All-Rights-Reserved"] * 2 + ["MIT"] * 1500 and rows[-1][0] == 1501
    rows = found_licenses("-" * 60 + "\n" + "*-#" * 40_000 + "\n" + "." * 100_000 + "\n# 7.5\nReleased under the MIT License.\n" + "=" * 70)
    assert [r[3] for r in rows] == ["MIT"] and licenses.words("2.0 b") == ["2.0", "b"] and licenses.words(" * 1. Redistributions, (b) and") == ["redistributions", "b", "and"]
    different = "\n".join(f"Released under the MIT License.\nLicensed under number {i} of the licenses." for i in range(1200))
    assert sum(r[3] == "MIT" for r in found_licenses(different)) == 1200


def slow_differences(block, template):
    """Edit distance of the block to the nearest stretch, by the textbook."""
    row = [0] * (len(template) + 1)
    for i, w in enumerate(block):
        new = [i + 1]
        for j, t in enumerate(template):
            new.append(min(row[j] + (w != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_licenses_against_all_templates():
    """Texts with some words changed, dropped or put in: the winner is nearest of all templates, told from the others by brute force."""
    rng = random.Random(4)
    for name in sorted(license_texts.TEXTS):
        own = SCANNER.words[name]
        for size in (12, 40):
            at = rng.randrange(max(1, len(own) - size))
            block = own[at : at + size]
            assert licenses.differences(block, own)[0] == 0
            for _ in range(size // 12):
                block[rng.randrange(len(block))] = rng.choice(["qwe", "rty"])
            del block[rng.randrange(len(block))]
            slow = {n: slow_differences(block, w) for n, w in SCANNER.words.items()}
            for n, w in SCANNER.words.items():
                count, found = licenses.differences(block, w)
                assert count == slow[n] and count <= len(found) <= 2 * count
            rows = SCANNER.scan(((0, " ".join(block)),))
            fits = {n for n, d in slow.items() if d == min(slow.values())}
            assert all(r[3] is None or set(r[4]) <= fits for r in rows)


def test_license_ranking_is_of_all_templates():
    scanner = licenses.Scanner({"a": "alpha beta gamma delta epsilon zeta license", "b": "alpha beta gamma delta epsilon zeta eta license"})
    assert scanner.scan(((0, "alpha beta gamma delta epsilon zeta eta license"),))[0][3] == "b"


# Toxicity


def labelled(spark, n=400):
    rng = random.Random(2)
    texts, rows = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["vileword", "nastyfolk", "nastyfolkest", "foulthing"])
        texts.append(" ".join(words))
        rows.append((i, 0 if i % 8 == 0 else 1, int(toxic)))
    return table(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels.where("doc_id < 280"))
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).where("doc_id >= 280").collect()}
    wrong = [i for i in scored if scored[i]["toxic"] != (i % 4 == 0)]
    assert len(wrong) <= 2
    mean = lambda t: np.mean([r["expected_severity"] for i, r in scored.items() if (i % 4 == 0) == t])
    assert mean(True) > mean(False) + 0.5
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).where("doc_id >= 280").collect()}
    assert kept == {i for i, r in scored.items() if not r["toxic"]}


def test_toxicity_edges(spark):
    docs, labels = labelled(spark, 40)
    odd = table(spark, [None, "", "vileword"], [None, 5, 5])
    nothing = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(odd, nothing).where("toxic").count() == 0
    assert toxicity.fit_toxicity(docs, labels.where("toxic = 0")).weights == {}
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 0, 1)], labels.schema))
    assert toxicity.sample_labels(more, 5).groupBy("grade").count().where("count > 5").count() == 0
    assert toxicity.drop_toxic(odd, nothing).count() == 3 and toxicity.score_toxicity(odd.limit(0), nothing).count() == 0


def test_cumulative_link_gradient_lowers_loss():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(600)]
    true = np.concatenate([np.full(5, 2.0), np.zeros(25)])
    score = np.array([true[r].sum() for r in rows]) + rng.logistic(size=600)
    weights, thresholds = toxicity.fit_ordinal(rows, (score > 3).astype(int) + (score > 5), 3)
    assert weights[:5].min() > 0.8 and np.abs(weights[5:]).max() < 0.6 and thresholds[0] < thresholds[1]


def test_ordinal_loss_by_brute_force():
    """The likelihood of each row by its definition, the gradients by differences."""
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(40)]
    flat, owner = np.concatenate(rows), np.repeat(np.arange(40), [len(r) for r in rows])
    grades, share = rng.integers(0, 3, 40), rng.random(40)
    weights, thresholds = rng.normal(size=12), np.array([-0.3, 0.9])

    def slow(w, t):
        above = lambda x, k: 1 / (1 + np.exp(-(sum(w[j] for j in x) - t[k])))
        total = 0.0
        for x, g, s in zip(rows, grades, share, strict=True):
            p = (1 - above(x, 0), above(x, 0) - above(x, 1), above(x, 1))[g]
            total -= s * np.log(p)
        return total

    loss, d_weights, d_thresholds = toxicity.ordinal_loss(flat, owner, grades, share, weights, thresholds)
    assert abs(loss - slow(weights, thresholds)) < 1e-9
    h = 1e-6
    for i in range(12):
        assert abs((slow(weights + h * np.eye(12)[i], thresholds) - slow(weights - h * np.eye(12)[i], thresholds)) / (2 * h) - d_weights[i]) < 1e-6
    for i in range(2):
        assert abs((slow(weights, thresholds + h * np.eye(2)[i]) - slow(weights, thresholds - h * np.eye(2)[i])) / (2 * h) - d_thresholds[i]) < 1e-6


def test_scores_by_brute_force(spark, corpus):
    """Every document's severity from its features, one by one."""
    docs, labels = labelled(spark, 120)
    model = toxicity.fit_toxicity(docs, labels)
    texts = [*corpus, "Vileword vileword nastyfolkest", *(r["text"] for r in docs.collect())]
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(table(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        words = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
        keys = {zlib.crc32(f.encode()) for w in words for f in [w] + [w[:n] + "*" for n in (4, 5) if len(w) > n]}
        score = sum(model.weights.get(k, 0.0) for k in keys)
        above = [1 / (1 + np.exp(-max(-60, min(60, score - k)))) for k in model.thresholds]
        assert abs(rows[i]["expected_severity"] - sum(above)) < 2e-6 and rows[i]["grade"] == sum(p >= 0.5 for p in above)


# SimHash


def slow_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, budget=2):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= budget
    component = np.array(ids)
    while True:
        new = np.where(near, component[None, :], 1 << 60).min(axis=1)
        if (new == component).all():
            return component
        component = new


@pytest.mark.parametrize("leaf", [1, 16_384])
def test_simhash_components(spark, corpus, leaf):
    texts = corpus + ["one two three four", "one two three four five"]
    prints = np.array([slow_fingerprint(t) for t in texts], dtype=np.uint64)
    want = slow_components(range(len(texts)), prints)
    rows = {r["doc_id"]: r for r in simhash.simhash_components(table(spark, texts), leaf=leaf).collect()}
    assert [rows[i]["fp"] & (1 << 64) - 1 for i in range(len(texts))] == prints.tolist()
    assert [rows[i]["component_id"] for i in range(len(texts))] == want.tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 3), st.booleans())
def test_trie_finds_all_pairs(seed, budget, same):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64) * np.uint64(2)
    flips = np.uint64(1) << rng.integers(0, 64, (4, 20)).astype(np.uint64)
    x = np.unique(np.concatenate([base, base ^ flips[0], base ^ flips[1] ^ flips[2], base ^ flips[3], np.arange(9, dtype=np.uint64)]))
    a, b = (x, x) if same else (x[::2], x[1::2])
    got = [p for i, j in simhash.trie_pairs(a, b, 0, 0, budget, same, width=50) for p in zip(i.tolist(), j.tolist())]
    near = np.argwhere(np.bitwise_count(a[:, None] ^ b[None, :]) <= budget).tolist()
    want = sorted((i, j) for i, j in near if not same or i < j)
    assert sorted(got) == want


def test_near_pairs_with_the_top_bit(spark):
    prints = [-1, -2, 0, 1, -(1 << 63), 5 - (1 << 63), 7]
    nodes = spark.createDataFrame(list(zip(prints, range(len(prints)))), "fp long, id long")
    want = {frozenset((i, j)) for i, p in enumerate(prints) for j, q in enumerate(prints) if i < j and ((p ^ q) & (1 << 64) - 1).bit_count() <= 2}
    for leaf in (1, 100):
        assert {frozenset(r) for r in simhash.near_pairs(nodes, 2, leaf).collect()} == want


def test_simhash_edges(spark):
    docs = table(spark, ["a b c d", "a b c d", None, "a b c d"], [None, 4, None, 4])
    rows = sorted(map(str, simhash.simhash_components(docs).collect()))
    assert len(rows) == 4 and sum("component_id=4" in r for r in rows) == 3
    assert simhash.simhash_components(table(spark, []).select("doc_id", "text")).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=15))
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: n for ab in links for n in ab if ab[0] != ab[1]}
    for _ in want:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == {n: c for n, c in want.items() if n != c}


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)]
    assert components.connected_components(spark.createDataFrame(links, "a long, b long")).where("component <> 0").count() == 0


# Suffixes


def slow_spans(rows, m):
    first, windows = {}, set()
    for d, t in sorted(rows):
        words = WORD.findall(t)
        for i in range(len(words) - m + 1):
            key = tuple(words[i : i + m])
            if key in first:
                windows.add((d, i, first[key]))
            else:
                first[key] = d
    spans = []
    for d, i, f in sorted(windows):
        if spans and spans[-1][0] == d and spans[-1][3] == f and i <= spans[-1][2] - m + 1:
            spans[-1][2] = i + m
        else:
            spans.append([d, i, i + m, f])
    return sorted(map(tuple, spans))


@pytest.mark.parametrize("m", [50, 8, 3])
def test_repeated_spans(spark, corpus, m):
    rows = [(i, t) for i, t in enumerate(corpus) if t is not None]
    got = sorted(tuple(r) for r in suffixes.repeated_spans(table(spark, corpus), min_words=m).collect())
    assert got == slow_spans(rows, m)


def test_repeats_are_cut(spark, corpus):
    docs = table(spark, corpus).withColumn("extra", F.lit(1)).withColumn("pos", F.lit("clash"))
    cleaned = suffixes.remove_repeats(docs)
    assert cleaned.schema == docs.schema and cleaned.count() == len(corpus)
    rows = {r["doc_id"]: r for r in cleaned.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"] is not None) and rows[0]["text"] is None
    assert slow_spans([(i, r["text"]) for i, r in rows.items() if r["text"]], 50) == []
    spans = {d for d, *_ in slow_spans([(i, t) for i, t in enumerate(corpus) if t is not None], 50)}
    assert all(rows[i]["text"] == t for i, t in enumerate(corpus) if i not in spans)
    assert suffixes.cut_spans("a  b c\nd e", [(1, 3)]) == "a  d e" and suffixes.cut_spans("a b c", [(1, 3), (2, 9)]) == "a "


def test_span_edges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = table(spark, [text, text, text, None, "short", text + " more"], [None, 5, 5, 6, 7, 9])
    assert [tuple(r) for r in suffixes.repeated_spans(docs).collect()] == [(9, 0, 60, 5)]
    assert suffixes.repeated_spans(table(spark, [])).count() == 0


def test_forced_collisions(spark, corpus, monkeypatch):
    """With window hashes of three bits all windows collide in them; the second hash keeps unlike passages apart."""
    rows = [(i, t) for i, t in enumerate(corpus) if t is not None]
    plain = suffixes.window_hashes
    monkeypatch.setattr(suffixes, "window_hashes", lambda words, k, at=None, radix=suffixes.RADIX: plain(words, k, at, radix) & np.uint64(7) if at is not None and radix == suffixes.RADIX else plain(words, k, at, radix))
    texts = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    assert plain(np.arange(9, dtype=np.uint64), 3, np.arange(3)).max() > 7 >= suffixes.window_hashes(np.arange(9, dtype=np.uint64), 3, np.arange(3)).max()
    candidates = texts.withColumn("at", F.array(*(F.lit(i) for i in range(0, 400, 20))).cast("array<int>"))
    batches = iter(candidates.select("doc_id", "text", "at").toArrow().to_batches())
    made = pa.Table.from_batches(list(suffixes.windows_of(batches, 50, 25))).to_pandas()
    by_both = made.groupby(["win", "check"]).apply(lambda g: len({tuple(WORD.findall(corpus[d])[p : p + 50]) for d, p in zip(g["doc_id"], g["pos"], strict=True)}))
    assert made["win"].between(0, 7).all() and (by_both == 1).all() and len(by_both) > 5000


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_equal_neighbours_over_partitions(spark, partitions):
    """Runs of equal heads that end, begin and go on at the edges of partitions, and empty partitions."""
    rng = random.Random(partitions)
    rows = [(rng.choice([5, 6, 7, 100 + i, 200 + i // 2]), i, i % 3) for i in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for some in (rows, rows[:1], []):
            many = {h for h, n in Counter(h for h, *_ in some).items() if n > 1}
            got = suffixes.with_equal_neighbour(spark.createDataFrame(some, "head long, doc_id long, pos int")).collect()
            assert sorted(map(tuple, got)) == sorted((d, p) for h, d, p in some if h in many)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_of_one_id_keep_their_repeats(spark):
    passage, own = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    docs = table(spark, [passage, f"{own} {passage}", f"x {passage}", f"y z {passage}"], [1, 2, 3, 3]).withColumns({"__spans": F.lit("clash"), "__text": F.lit("clash"), "a.b": F.lit("clash")})
    cleaned = suffixes.remove_repeats(docs)
    assert cleaned.columns == docs.columns
    assert sorted((r["doc_id"], r["text"].strip()) for r in cleaned.collect()) == [(1, passage), (2, own), (3, f"x {passage}"), (3, f"y z {passage}")]


# Benchmark


def slow_contaminated(docs, items, k=5):
    found = {}
    for i, t in items:
        own = WORD.findall((t or "").lower())
        size = min(k, len(own))
        grams = lambda w, size=size: Counter(tuple(w[j : j + size]) for j in range(len(w) - size + 1))
        for d, text in docs:
            words = WORD.findall((text or "").lower())
            for s in range(max(1, len(words) - len(own) + 1)) if own and len(words) >= size else ():
                a, b = grams(words[s : s + len(own)]), grams(own)
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()) > 0:
                    similarity = round(sum((a & b).values()) / sum((a | b).values()), 6)
                    if similarity > found.get((d, i), (0, 0))[0]:
                        found[d, i] = (similarity, s)
    return found


def found_windows(docs, benchmark):
    return {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in decontam.contaminated(docs, benchmark).collect()}


def test_contamination(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((20, 35, 60, 5, 4, 1, 80))] + [(90, ""), (91, None), (92, "ha " * 30)]
    texts = [prose(rng, 200) for _ in range(6)] + [None, "", "w1 w2"]
    for i, t in items[:7]:
        words = t.split()
        near = words[: len(words) // 2] + ["new"] + words[len(words) // 2 :]
        far = [w if j % 6 else "other" for j, w in enumerate(words)]
        texts += [f"{prose(rng, 40)} {t.upper()} {prose(rng, 40)}", f"{prose(rng, 9)} {' '.join(near)} {prose(rng, 9)}", f"{prose(rng, 9)} {' '.join(far)}", t, " ".join(words[:-1])]
    texts.append("ha " * 500)
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = slow_contaminated(list(enumerate(texts)), items)
    assert found_windows(table(spark, texts), benchmark) == want and len(want) > 15
    broadcast, decontam.BROADCAST_ROWS = decontam.BROADCAST_ROWS, 0
    try:
        assert found_windows(table(spark, texts), benchmark) == want
    finally:
        decontam.BROADCAST_ROWS = broadcast
    left = {r["doc_id"] for r in decontam.decontaminate(table(spark, texts), benchmark).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}
    assert decontam.contaminated(table(spark, texts), benchmark.limit(0)).count() == 0


def test_contamination_between_offsets(spark):
    """Words inserted in the middle and changed at both ends: the best window is at neither offset."""
    rng = random.Random(10)
    items, texts = [], []
    for i, (n, changed, inserted) in enumerate([(59, 1, 2), (100, 3, 6), (100, 3, 7), (120, 4, 6), (59, 0, 2)]):
        words = prose(rng, n, 10**6).split()
        near = words.copy()
        for j in range(changed):
            near[j], near[-1 - j] = "first", "last"
        near[n // 2 : n // 2] = [f"new{j}" for j in range(inserted)]
        items.append((i, " ".join(words)))
        texts += [" ".join(near), f"{prose(rng, 30)} {' '.join(near)} {prose(rng, 30)}", f"{' '.join(near)} {prose(rng, 7)} {' '.join(near)}"]
    for n, edge in ((100, 3), (300, 3)):  # the first and last words go, four come in the middle
        words = prose(rng, n, 10**6).split()
        items.append((len(items), " ".join(words)))
        inner = words[edge : n // 2] + ["in", "the", "very", "middle"] + words[n // 2 : n - edge]
        texts.append(f"{prose(rng, 200)} {' '.join(inner)} {prose(rng, 200)}")
    want = slow_contaminated(list(enumerate(texts)), items)
    assert found_windows(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")) == want
    assert want[1, 0] == (round(49 / 61, 6), 31) and want[4, 1][0] == round(86 / 106, 6)
    assert want[15, 5] == (round(86 / 106, 6), 198) and want[16, 6] == (0.934641, 198)


def test_contamination_by_items_of_one_length_and_rows_of_one_id(spark):
    """A window laid by one item's words is held against all items of its length; rows of one id are judged apart."""
    rng = random.Random(12)
    base = prose(rng, 50, 10**6).split()
    other = base.copy()
    other[0], other[49] = "swapped", "too"
    items = [(0, " ".join(base)), (1, " ".join(other)), (2, prose(rng, 50, 10**6))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    text = f"{prose(rng, 20)} {items[0][1]} {prose(rng, 20)}"
    assert set(found_windows(table(spark, [text]), benchmark)) == {(0, 0), (0, 1)}
    half = " ".join(base[:25])
    rows = [text, text, f"{half} {prose(rng, 65)}", f"{prose(rng, 65)} {half}", None]
    assert found_windows(table(spark, rows, [7, 7, 7, 7, None]), benchmark) == {(7, i): v for (_, i), v in slow_contaminated([(0, text)], items).items()}
    apart = table(spark, [f"{half} {prose(rng, 65)}", f"{prose(rng, 25)} {' '.join(base[25:])} {prose(rng, 40)}"], [8, 8])
    assert found_windows(apart, benchmark) == {}


# Sharding


def slow_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump_hash(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    a, b = sharding.jump_hash(keys, 8), sharding.jump_hash(keys, 9)
    assert set(b[a != b]) == {8} and 0.05 < (a != b).mean() < 0.2
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_shards(spark, corpus):
    docs = table(spark, [*corpus, "x", "x", None], [*range(len(corpus)), 3, None, None]).withColumn("shard", F.lit("clash"))
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(corpus) + 3 and {r["law"] for r in rows} == {"key"}
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] != 3}
    assert all(by_id[i]["size"] == len((t or "").encode()) + 1 and by_id[i]["text_crc32"] == zlib.crc32((t or "").encode()) for i, t in enumerate(corpus) if i != 3)
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert sharding.shard_documents(table(spark, [])).count() == 0


def test_shards_of_one_hot_row(spark):
    """Rows alike in all columns fill one bucket: it is cut into parts, and slots stay gapless."""
    docs = table(spark, ["same"] * 700 + [f"t{i}" for i in range(100)], [7] * 350 + [None] * 350 + list(range(100, 200)))
    rows = sharding.shard_documents(docs, rows_per_bucket=10).collect()
    assert len(rows) == 800 and all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(8))


# All operators on odd tables

BYTE, WORDS_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "2": lambda d, s: token_counts.prefix_token_counts(d, BYTE),
    "3": lambda d, s: media.wav_features(media.to_wav(d)),
    "4": lambda d, s: licenses.scan_licenses(d),
    "5": lambda d, s: toxicity.score_toxicity(d, toxicity.OrdinalModel({1: 1.0}, [1.0, 2.0])),
    "5 drop": lambda d, s: toxicity.drop_toxic(d, toxicity.OrdinalModel({1: 1.0}, [1.0, 2.0])),
    "6": lambda d, s: simhash.simhash_components(d),
    "6 drop": lambda d, s: resemblance.drop_near_duplicates(d),
    "7": lambda d, s: suffixes.repeated_spans(d),
    "7 cut": lambda d, s: suffixes.remove_repeats(d),
    "8": lambda d, s: decontam.contaminated(d, s.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (None, "x"), (2, None)], "item_id long, text string")),
    "8 drop": lambda d, s: decontam.decontaminate(d, s.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")),
    "9": lambda d, s: sharding.shard_documents(d),
    "10": lambda d, s: bpe.round_trip(d, WORDS_FILE),
}
ROWS = {"2": 8, "3": 8, "4": 2, "5": 8, "5 drop": 8, "6": 8, "6 drop": 5, "7": 0, "7 cut": 8, "8": 2, "8 drop": 5, "9": 8, "10": 8}
CLASHES = "word words head pos win inner fp id node component_id shard slot bucket size media feature toxic grade ids decoded block license line_no item_id asked doc_hashes a b x y used side n first_doc_id at row bands set places starts candidates end_line check edge equal part parts number __spans __text".split()


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    texts = ["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zeta", None, "", "Released under the MIT License.\nx", "Released under the MIT License.\nx", "\x00 \ud7ff odd \u200b", "alpha beta gamma delta epsilon zeta"]
    docs = table(spark, texts, [1, 1, 2, 3, 4, None, None, 6]).withColumns({c: F.lit("clash") for c in CLASHES})
    assert OPERATORS[name](docs, spark).count() == ROWS[name]
    assert OPERATORS[name](docs.limit(0), spark).count() == 0
    assert OPERATORS[name](docs.withColumn("text", F.lit(None).cast("string")), spark).count() >= 0


def test_contamination_of_a_long_text(spark):
    """Two hundred thousand words made of twenty items: a row for each window, none for all of them."""
    rng = random.Random(17)
    items = [(i, prose(rng, 90, 100_000)) for i in range(20)]
    own = [t.split() for _, t in items]
    words: list[str] = []
    while len(words) < 200_000:
        words += own[rng.randrange(20)] if rng.random() < 0.8 else prose(rng, 30, 100_000).split()
    docs = table(spark, [" ".join(words), "short"]).unionByName(table(spark, ["short"] * 3, [1, 1, 1]))
    got = found_windows(docs, spark.createDataFrame(items, "item_id long, text string"))
    first = {}
    for i, w in items:
        size = 90
        first[0, i] = next((1.0, s) for s in range(len(words) - size + 1) if words[s] == own[i][0] and words[s : s + size] == own[i])
    assert got == first


def test_components_of_a_long_chain(spark):
    """Many rounds, whose estimates of size must not grow with each."""
    rng = random.Random(22)
    names = rng.sample(range(10**6), 6000)
    links = [(a, b) for a, b in zip(names, names[1:])]
    rng.shuffle(links)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == 5999 and {r["component"] for r in got} == {min(names)}


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    """Inside passing only, also where it fails, and of each thread its own."""
    import os
    import threading

    from tidewater.llm import common

    made = {}

    def work(name, fails):
        try:
            with common.passing(spark, f"{tmp_path}/{name}"):
                made[name] = common.written(spark.range(3), name).inputFiles()[0].replace("file://", "")
                both.wait(60)
                if fails:
                    raise ValueError
        except ValueError:
            pass

    for name in ("a", "b"):
        os.makedirs(tmp_path / name)
    both = threading.Barrier(2)
    threads = [threading.Thread(target=work, args=(n, n == "b")) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    kept = common.written(spark.range(3), "kept")
    assert not any(os.path.exists(p) for p in made.values()) and len(made) == 2 and kept.count() == 3
    assert not (tmp_path / "a").exists() and (tmp_path / "b").exists()


def test_very_long_text(spark):
    text = "lorem ipsum dolor sit amet, " * 40_000 + "a" * 50_000
    docs = table(spark, [text, "short"])
    assert token_counts.prefix_token_counts(docs, BYTE).select(F.max(F.size("prefix_tokens"))).first()[0] == len(text) + 1
    assert bpe.round_trip(docs, WORDS_FILE).count() == 2
    assert media.wav_features(media.to_wav(docs)).where("n_bytes > 1000000").first()["payload_bytes"] % 192 == 0
    spans = suffixes.repeated_spans(docs).collect()
    assert all(r["doc_id"] == r["first_doc_id"] == 0 for r in spans) and sum(r["end_word"] - r["start_word"] for r in spans) > 199_000
    assert simhash.simhash_components(docs).count() == 2
    rng = random.Random(20)
    words = prose(rng, 200_000, 50_000)
    docs = table(spark, [words, f"new {words} end", "short", words])
    assert [r["component_id"] for r in resemblance.similar_components(docs).orderBy("doc_id").collect()] == [0, 0, 2, 0]
    assert {r["doc_id"]: r["size"] for r in sharding.shard_documents(docs).collect()} == {i: len(t) + 1 for i, t in enumerate([words, f"new {words} end", "short", words])}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    few = table(spark, [f"{prose(rng, 20)} {'vileword' if i % 2 else ''}" for i in range(40)] + [words, f"{words} {'vileword ' * 60_000}"])
    model = toxicity.fit_toxicity(few, labels)
    assert {40, 41} <= {r["doc_id"] for r in toxicity.score_toxicity(few, model).collect()}
