"""License scans by conditional compression.

Texts are cut into units: sentences of lines. A unit speaks of licensing if it has a cue word or
if at least half of its words are in runs of three that stand in a template; neighbouring units that do are
one candidate block, however its lines are wrapped. Each block is compressed alone and with each
template as a zstandard raw-content dictionary, which ranks the templates by the bytes saved.

Those that save are confirmed by the exact differences in wording, smallest first, until what is left can't do as well. The units that a template
covers are compared with its stretch: it fits if at most a fifth of the words differ and none of
the differences is a word that tells licenses apart (a name, an element such as NC, a version, a
negation). The fit of most words, a difference counting against two, is the license; if several
licenses have it, as with a clause they share, it is "ambiguous". The block's other units are
then a block of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, flushed, id_and_text, read_table
from .license_texts import ELEMENTS, templates

# Words of which a text with a license has one, and words that tell licenses apart: fixed values.
CUES = r"(?i)licen[sc]|copyright|warrant|redistribut|permission|permitted|public domain|public at large|rights reserved|creative commons|CC[ -]BY|\bCC0|merchantab|liab(?:le|ility)|as[ -]is\b|free software|restriction|hereby|source code|source form|source distribution|compiled binary|original software|and/or|relinquish|\bMPL\b|GPL(?:\b|v?\d)|acknowledgment"
# What each of the cues holds, in lower case: looked for first, which takes a small part of the pattern's time.
PARTS = ["licen", "copyright", "warrant", "redistribut", "permission", "permitted", "public domain", "public at large", "rights reserved", "creative commons", "cc by", "cc-by", "cc0", "merchantab", "liab", "as is", "as-is", "free software", "restriction", "hereby", "source code", "source form", "source distribution", "compiled binary", "original software", "and/or", "relinquish", "mpl", "gpl", "acknowledgment"]
TELLING = {"affero", "lesser", "library-general", "gpl", "lgpl", "agpl", "mit", "isc", "bsd", "apache", "mozilla", "mpl", "eclipse", "epl", "boost", "zlib", "unlicense", "cc", "cc0", "zero", "commercial", "non-commercial", "noderivs", "public", "not", "no", "non", "without", "never", "neither", "except", "simplified", "domain"} | {e.lower() for e in ELEMENTS.values()}
VERSION = re.compile(r"v?\d+(?:\.\d+)*(?:-clause)?|by(?:-(?:nc|nd|sa))+|(?:attribution|noncommercial)-.*")
CUE = re.compile(CUES)
WORD = re.compile(r"\w(?:[.\-+/]*+\w)*+")
MARK = re.compile(r"^\s*+(?:(?:[-*•#/;%>|]++|\(?[0-9a-z]{1,2}[.)](?=\s))\s*+)++", re.I)  # of a list or a comment
SENTENCE = re.compile(r"(?<=\w\w[.;:!?])(?<!dentifier:)\s+(?=[\"'(]?[A-Z0-9])")
COPYRIGHT = re.compile(r"(?i)^\W*(?:copyright\s*(?:\(c\)|©|\d{4}|by\b)|\(c\)\s|©)")
DIFFERENCE = 0.2


# Versions are said in many ways: "version 2", "v2", "v. 2.0", "GPLv2", "GPL-2.0" are all the word 2.0 after the name.
SAID = re.compile(r"\bv(?:ersion\b|\.)?\s*(\d+(?:\.\d+)*)(?![\w.]*-clause)\b")
NAMED = re.compile(r"\b([al]?gpl|mpl|bsl|epl|apache)[\s-]*v?(\d+(?:\.\d+)*)(?:-(or-later|only))?(?![\w-])")
SUFFIX = {None: "", "only": "", "or-later": " or later"}


def words(text: str) -> list[str]:
    """The words that are compared: lower-cased, without list marks, versions said one way."""
    plain = re.sub(r"\blibrary general\b", "library-general", MARK.sub("", text.lower()))
    if any(c.isdigit() for c in plain):
        dotted = lambda n: n if "." in n else f"{n}.0"
        plain = SAID.sub(lambda m: f" {dotted(m[1])}", plain)
        plain = NAMED.sub(lambda m: f"{m[1]} {dotted(m[2])}{SUFFIX[m[3]]}", plain)
    return WORD.findall(plain)


def telling(word: str) -> bool:
    return word in TELLING or VERSION.fullmatch(word) is not None


def differences(block: list[str], template: list[str]) -> tuple[int, list[str]]:
    """The fewest words by which the block differs from any stretch of the template (edit distance), and the differences, as "-word" and "+word"."""
    code = {w: n for n, w in enumerate(dict.fromkeys(template))}
    own, other = np.array([code.get(w, -1) for w in block]), np.array([code[w] for w in template])
    steps = np.arange(len(template) + 1)
    rows = np.zeros((len(block) + 1, len(template) + 1), dtype=np.int16 if len(block) < 32_000 else np.int32)
    for i, w in enumerate(own):
        row = np.concatenate([[i + 1], np.minimum(rows[i, :-1] + (other != w), rows[i, 1:] + 1)])
        rows[i + 1] = np.minimum.accumulate(row - steps) + steps
    i, j, found = len(block), int(rows[-1].argmin()), []
    count = int(rows[-1, j])
    while i:
        if j and rows[i, j] == rows[i - 1, j - 1] + (own[i - 1] != other[j - 1]):
            i, j = i - 1, j - 1
            if own[i] != other[j]:
                found += [f"+{block[i]}", f"-{template[j]}"]
        elif rows[i, j] == rows[i - 1, j] + 1:
            i -= 1
            found.append(f"+{block[i]}")
        else:
            j -= 1
            found.append(f"-{template[j]}")
    return count, found[::-1]


def trigrams(own: list[str]) -> list[tuple[str, ...]]:
    return list(zip(own, own[1:], own[2:], strict=False))


def marked(own: list[list[str]], runs: set[tuple[str, ...]]) -> list[int]:
    """How many words of each unit are in a run of three words, also across units, that is in runs; of a unit of two words both, if it is in runs itself."""
    flat = [w for u in own for w in u]
    marks = bytearray(len(flat))
    for i, r in enumerate(trigrams(flat)):
        if r in runs:
            marks[i : i + 3] = b"\1\1\1"
    at, counts = 0, []
    for u in own:
        counts.append(2 if len(u) == 2 and tuple(u) in runs else sum(marks[at : at + len(u)]))
        at += len(u)
    return counts


def units(text: str) -> list[tuple[int, str]]:
    """(line, sentence) of each sentence; a blank line is an empty one."""
    return [(n, part) for n, line in enumerate(text.split("\n")) for part in (SENTENCE.split(line.strip()) if line.strip() else [""])]


class Scanner:
    """Finds, ranks and confirms."""

    def __init__(self, texts: dict[str, str], level: int = 3):
        self.words = {name: [w for line in text.split("\n") for w in words(line)] for name, text in texts.items()}
        pairs = {name: {tuple(w) for _, u in units(text) if len(w := words(u)) == 2} for name, text in texts.items()}  # names such as "MIT License"
        self.runs = {name: set(trigrams(own)) | pairs[name] for name, own in self.words.items()}
        self.vocabulary = {name: set(own) for name, own in self.words.items()}
        self.any_runs = set().union(*self.runs.values())
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.with_template = {}
        for name, text in texts.items():
            raw = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.with_template[name] = zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)

    def blocks(self, text: str) -> Iterator[list[tuple[int, str]]]:
        """The runs of units that speak of licensing; up to two blank lines may part them. A unit said again begins another run."""
        parts = units(text)
        own = [words(u) for _, u in parts]
        held: list[tuple[int, str]] = []
        said: set[tuple[str, ...]] = set()
        blank = 0
        for (line, unit), w, n in zip(parts, own, marked(own, self.any_runs), strict=True):
            if not unit:
                blank += 1
                continue
            speaks = CUE.search(unit) or (w and 2 * n >= len(w))
            again = (len(w) > 2 or tuple(w) in self.any_runs) and tuple(w) in said
            if held and (not speaks or again or blank > 2):
                yield held
                held, said = [], set()
            if speaks:
                held.append((line, unit))
                said.add(tuple(w))
            blank = 0
        if held:
            yield held

    def spans(self, own: list[list[str]], name: str) -> list[tuple[int, int]]:
        """The runs (first unit, end unit) of units that the template covers, those of most covered words first."""
        met = marked(own, self.runs[name])
        covered = [bool(u) and 2 * n >= len(u) for n, u in zip(met, own, strict=True)]
        spans, at = [], 0
        while at < len(own):
            end = at
            while end < len(own) and (covered[end] or (end > at and end + 1 < len(own) and covered[end + 1])):
                end += 1
            if end > at:
                spans.append((sum(met[at:end]), -at, end))
            at = end + 1
        return [(-first, end) for _, first, end in sorted(spans, reverse=True)]

    def least(self, own: list[list[str]], name: str, spans: list[tuple[int, int]]) -> int:
        """What fit can give at best over spans: each word that the template lacks is a difference."""
        known = self.vocabulary[name]
        return min(sum(1 if w not in known else -1 for u in own[first:end] for w in u) for first, end in spans)

    def fit(self, own: list[list[str]], name: str, spans: list[tuple[int, int]]) -> tuple[int, int, int, int, list[str]] | None:
        """(differing words, words, first unit, end unit, differences) of the first of spans that the template fits; None if it fits none."""
        template = self.words[name]
        for first, end in spans:
            block = [w for u in own[first:end] for w in u]
            if (1 - DIFFERENCE) * len(block) > len(template):
                continue
            count, found = differences(block, template)
            if count <= DIFFERENCE * len(block) and not any(telling(d[1:]) for d in found):
                return count, len(block), first, end, found
        return None

    def best_fit(self, block: tuple[tuple[int, str], ...]) -> tuple[tuple, int, int]:
        """(row as of scan, first unit, end unit) of the units that some license fits best; of the whole block if none does.

        Templates are confirmed in the order of their compressed sizes. One that can't do as well as the
        best so far, whatever its exact differences, is passed over: it could be neither the winner nor its equal.
        """
        text = "\n".join(u for _, u in block)
        data = text.encode()
        alone = len(self.plain.compress(data))
        ranked = sorted((len(z.compress(data)), name) for name, z in self.with_template.items())
        own = [[] if COPYRIGHT.match(u) and "license" not in u.lower() else words(u) for _, u in block]
        fits, best = [], None
        for size, name in ranked:
            if size >= alone:
                break
            spans = self.spans(own, name)
            if not spans or (best is not None and self.least(own, name, spans) > best):
                continue
            f = self.fit(own, name, spans)
            if f:
                fits.append((2 * f[0] - f[1], size, name, f[0], *f[2:]))
                best = min(fits)[0]
        if not fits:
            size = min(ranked[0][0], alone) if ranked else alone
            return (block[0][0], block[-1][0] + 1, text, None, [], alone, size, round(1 - size / alone, 6), None, []), 0, len(block)
        names = sorted(f[2] for f in fits if f[0] == best)
        _, size, _, count, first, end, found = min(f for f in fits if f[0] == best)
        return (block[0][0], block[-1][0] + 1, text, names[0] if len(names) == 1 else "ambiguous", names, alone, size, round(1 - size / alone, 6), count, found), first, end

    def scan(self, block: tuple[tuple[int, str], ...]) -> list[tuple]:
        """Rows (first line, end line, text, license, candidates, plain bytes, bytes with the best template, reduction, differing words, differences), in order."""
        rows, waiting = [], [(0, block)]
        while waiting:
            at, part = waiting.pop()
            row, first, end = self.best_fit(part)
            if (first, end) == (0, len(part)):
                rows.append((at, row))
            else:
                waiting += [(at + i, part[i:j]) for i, j in ((0, first), (first, end), (end, len(part))) if i < j]
        return [row for _, row in sorted(rows, key=lambda r: r[0])]


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", cues: str = CUES, level: int = 3) -> DataFrame:
    """A row per candidate block: doc_id, line_no (from 0), end_line, block, license, candidates, plain_bytes, template_bytes, reduction, differing_words, differences.

    license is null where no template is confirmed (differing_words too), "ambiguous" where
    several are that candidates lists. texts: name to wording, by default short licenses whole
    and long ones by their notices and names; read_texts adds whole ones from a folder. Texts
    without any cue have no candidates, null and empty ones neither; null ids stay null; repeated
    rows and lines have rows of their own; an empty table gives no rows. Other columns are left out.
    """
    chosen = dict(templates() if texts is None else texts)
    kinds = [("doc_id", pa.int64()), ("line_no", pa.int32()), ("end_line", pa.int32()), ("block", pa.string()), ("license", pa.string()), ("candidates", pa.list_(pa.string())), ("plain_bytes", pa.int64()), ("template_bytes", pa.int64()), ("reduction", pa.float64()), ("differing_words", pa.int64()), ("differences", pa.list_(pa.string()))]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, level)
        known, speaks = BoundedCache(scanner.scan, 20_000, longest=64), re.compile(cues)

        def rows():
            for b in batches:
                for doc_id, cell in zip(b["doc_id"], b["text"], strict=True):
                    text = cell.as_py()
                    low = text.lower() if cues == CUES else ""
                    if (cues == CUES and not any(p in low for p in PARTS)) or not speaks.search(text):
                        continue
                    for block in scanner.blocks(text):
                        base = block[0][0]
                        for first, end, *rest in known[tuple((line - base, unit) for line, unit in block)]:
                            yield doc_id.as_py(), first + base, end + base, *rest

        return flushed(rows(), schema, lambda r: 4 * len(r[3]))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, line_no int, end_line int, block string, license string, candidates array<string>, plain_bytes long, template_bytes long, reduction double, differing_words long, differences array<string>")


def read_texts(spark, folder: str) -> dict[str, str]:
    """Whole license texts for scan_licenses: each file of a folder (some dozen, on any file system Spark reads) by its name."""
    return {r["path"].rpartition("/")[2]: bytes(r["content"]).decode(errors="replace") for r in spark.read.format("binaryFile").load(folder).select("path", "content").collect()}


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    rows = scan_licenses(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "line_no", "end_line", "license", F.array_join("candidates", " ").alias("candidates"), "plain_bytes", "template_bytes", "reduction", "differing_words", F.array_join("differences", " ").alias("differences"))
