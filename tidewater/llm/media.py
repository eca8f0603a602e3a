"""Texts as sound: WAV media columns, short-time spectra, and spectral-peak fingerprints.

to_wav stores a payload as 8-bit mono samples; wav_features reads the stored bytes back with
the wave module, takes short-time Fourier transforms in blocks of frames, keeps the strongest
bin of each band of each frame, and codes pairs of near peaks as (time, frequency, frequency,
time difference) landmarks.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flushed, id_and_text, read_table

UNIT = 192  # payloads are filled up to a multiple of this
FILL = b"\x20"
BANDS = (1, 11, 41, 111, 257)  # edges of the four bands, in bins of a 512-sample frame


def payload_of(text: str) -> tuple[bytes, int]:
    data = text.encode()
    whole = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data.ljust(whole, FILL), len(data)


def write_wav(payload: bytes, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def peaks(samples: np.ndarray, frame: int = 512, hop: int = 256, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(frame number, bin) of the strongest bin of each band in each frame, where it stands out from its band. Frames overlap, so every sample counts in one."""
    short = max(frame, -(-len(samples) // hop) * hop + frame - hop) - len(samples)
    filled = np.concatenate([samples, np.full(short, 128, dtype=np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(filled, frame)[::hop]
    taper = np.hanning(frame)
    times, bins = [], []
    for at in range(0, len(frames), block):
        power = np.abs(np.fft.rfft((frames[at : at + block].astype(np.float64) - 128.0) * taper, axis=1))
        for low, high in zip(BANDS, BANDS[1:], strict=False):
            band = power[:, low:high]
            best = band.argmax(axis=1)
            strong = np.flatnonzero(band[np.arange(len(band)), best] > 1.5 * band.mean(axis=1) + 1e-9)
            times.append(strong + at)
            bins.append(best[strong] + low)
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def landmarks(t: np.ndarray, f: np.ndarray, fan_out: int = 3, reach: int = 15) -> np.ndarray:
    """Time-coded pairs of a peak and the first fan_out peaks of later frames within reach: the anchor's frame in the high 32 bits; below, 10 bits for each frequency and 6 for the frames between."""
    after, codes = np.searchsorted(t, t, side="right"), [np.empty(0, dtype=np.int64)]
    for step in range(fan_out):
        anchor = np.flatnonzero(after + step < len(t))
        other = after[anchor] + step
        gap = t[other] - t[anchor]
        near = gap <= reach
        codes.append((t[anchor][near] << 32) | (f[anchor][near] << 16) | (f[other][near] << 6) | gap[near])
    return np.sort(np.concatenate(codes))


def to_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 8000) -> DataFrame:
    """(doc_id, n_bytes, media): the text's UTF-8 bytes, filled with spaces to a positive multiple of 192, as WAV.

    A null text is an empty one. Null ids and repeated rows are kept as they are, an empty
    table gives none, other columns are left out. A text's WAV must stay under 4 GB.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                    payload, n = payload_of(text.as_py())
                    yield doc_id.as_py(), n, write_wav(payload, rate)

        return flushed(rows(), schema, lambda r: len(r[2]))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def wav_features(media: DataFrame) -> DataFrame:
    """to_wav's rows read back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, landmarks array<long>.

    Media of 8-bit mono WAV only; another format raises an error. Of null media all of these are
    null; null ids and repeated rows are kept as they are; an empty table gives no rows.
    """
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("landmarks", pa.list_(pa.int64()))]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for doc_id, n, stored in zip(b["doc_id"], b["n_bytes"], b["media"], strict=True):
                    stored = stored.as_py()
                    if stored is None:
                        yield doc_id.as_py(), n.as_py(), *[None] * 6
                        continue
                    with wave.open(io.BytesIO(stored), "rb") as w:
                        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
                            raise ValueError("8-bit mono samples are asked for")
                        payload = w.readframes(w.getnframes())
                    codes = landmarks(*peaks(np.frombuffer(payload, dtype=np.uint8)))
                    yield doc_id.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), codes

        return flushed(rows(), schema, lambda r: 0 if r[7] is None else r[7].nbytes)

    names = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{k} {names[v]}" for k, v in kinds))


def op3_wav_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = wav_features(to_wav(read_table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.size("landmarks").cast("string"), F.lower(F.hex(F.xxhash64("landmarks"))))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
