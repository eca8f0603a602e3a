"""WARC archives written and read by Spark tasks, records as tables of chunks.

Each task writes archives of its own into the shared folder, a gzip member per record, and
returns index rows (archive, offset, length). Only index rows of tasks that Spark committed
are kept, so what lost or repeated tasks left is never read. Reading deals the index rows
out; each task inflates its stretch piece by piece and gives a row per chunk: record, chunk
number, bytes, and the digest of the payload so far. No record is ever held whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flushed, open_store, read_table, shared_path

VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT_BYTES = 100


def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the response's id for records that revisit it, else null.

    Of equal payloads of at least 100 bytes the smallest id is the response. Ids and digests
    alone meet in the shuffle for that, summed before it; payloads only follow their own id.

    A null payload is an empty one. Rows with a null id revisit the smallest id that isn't
    null, and are responses if there is none. Repeated rows with the smallest id are all
    responses. An empty table gives no rows. Other columns are left out.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2(F.encode("payload", "utf-8"), 256))
    narrow = base.where(F.octet_length("payload") >= LEAST_REVISIT_BYTES).select("page_id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    revisits = narrow.join(firsts, "digest").where("page_id is null or page_id <> refers_to").distinct()
    revisits = revisits.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    joined = base.join(revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    return joined.select("page_id", "url", "payload", "digest", "refers_to")


def _record(page_id, url, digest: str, refers_to, payload: memoryview, date: str, chunk_bytes: int, level: int) -> Iterator[bytes]:
    """A gzip member, piece by piece."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>".encode(), b"WARC-Date: " + date.encode()]
    if url:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url).encode())
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), b"WARC-Profile: " + REVISIT.encode()]
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % (len(http) + (0 if revisit else len(payload)))]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    yield z.compress(b"\r\n".join(head) + b"\r\n\r\n" + http)
    if not revisit:
        for at in range(0, len(payload), chunk_bytes):
            yield z.compress(payload[at : at + chunk_bytes])
    yield z.compress(b"\r\n\r\n") + z.flush()


def write_archives(records: DataFrame, path: str, chunk_bytes: int = 64 << 10, segment_bytes: int = 4 << 20, archive_bytes: int = 1 << 30, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write with_record_types' rows as archives under path, which all executors share. Returns the index: archive, offset, length, records.

    The index is written too, as Parquet under path/index. A segment is a run of whole records
    of about segment_bytes, the unit of reading. Repeated rows of a page share a record id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        index: list[tuple] = []
        out, name, at, start, count = None, "", 0, 0, 0
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(b[c] for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, at, start, count = store.open_output_stream(f"{folder}/{name}", compression=None), 0, 0, 0
                for piece in _record(page_id.as_py(), url.as_py(), digest.as_py(), refers_to.as_py(), memoryview(payload.as_buffer()), date, chunk_bytes, level):
                    out.write(piece)
                    at += len(piece)
                count += 1
                if at - start >= segment_bytes:
                    index.append((name, start, at - start, count))
                    start, count = at, 0
                if at >= archive_bytes:
                    if count:
                        index.append((name, start, at - start, count))
                    out.close()
                    out = None
        if out is not None:
            if count:
                index.append((name, start, at - start, count))
            out.close()
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("records", pa.int64())])
        yield from flushed(iter(index), schema, lambda r: 64)

    store, folder = open_store(path)
    store.create_dir(folder, recursive=True)
    records.mapInArrow(run, "archive string, offset long, length long, records long").write.mode("overwrite").parquet(f"{path}/index")
    return records.sparkSession.read.parquet(f"{path}/index")


class Inflated:
    """The bytes of consecutive gzip members in a stretch of a file, a bounded piece at a time."""

    def __init__(self, raw, length: int, piece: int):
        self.raw, self.left, self.piece = raw, length, piece
        self.z, self.ahead, self.held = zlib.decompressobj(31), b"", bytearray()

    def more(self) -> bool:
        while True:
            if self.z.eof:
                self.ahead, self.z = self.z.unused_data, zlib.decompressobj(31)
            if not self.ahead and self.left:
                self.ahead = self.raw.read(min(self.piece, self.left))
                self.left -= len(self.ahead)
            if not self.ahead:
                return False
            got = self.z.decompress(self.ahead, self.piece)
            self.ahead = b"" if self.z.eof else self.z.unconsumed_tail
            if got:
                self.held += got
                return True

    def head(self) -> bytes | None:
        """Up to a blank line, or None at the end."""
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if not self.more():
                if self.held.strip():
                    raise ValueError("a record is cut off")
                return None
        got = bytes(self.held[:end])
        del self.held[: end + 4]
        return got

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("a record is cut off")
        got = bytes(self.held[:n])
        del self.held[:n]
        return got


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode(errors="replace").strip().split("\r\n")[1:])}


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def chunks(raw, length: int, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of read_chunks, in order, from a stretch of an archive."""
    data = Inflated(raw, length, chunk_bytes)
    while (head := data.head()) is not None:
        if not head.lstrip().startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        f = _fields(head)
        left, whole, kind = int(f["content-length"]), None, f["warc-type"]
        if f.get("content-type", "").startswith("application/http") and left:
            http = data.head()
            left, whole = left - len(http) - 4, _fields(http).get("content-length")
        sort, _, stated = f.get("warc-payload-digest", "").partition(":")
        stated = stated.lower() if sort.lower() == "sha256" else None
        digest, done, n = hashlib.sha256(), 0, 0
        while True:
            part = data.take(min(chunk_bytes, left - done))
            digest.update(part)
            done += len(part)
            last = done >= left
            so_far = digest.copy().hexdigest()
            own = last and kind != "revisit"
            if own and (stated not in (None, so_far) or (kind == "response" and whole not in (None, str(done)))):
                raise ValueError(f"{f['warc-record-id']}: the payload differs from its digest or length")
            size = done if own else None if whole is None else int(whole)
            yield f["warc-record-id"], _page(f["warc-record-id"]), kind, _page(f.get("warc-refers-to")), f.get("warc-target-uri"), n, part, done, so_far, last, size, so_far if own else stated
            n += 1
            if last:
                break
        if data.take(4) != b"\r\n\r\n":
            raise ValueError("a record isn't ended")


CHUNK_FIELDS = [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def list_archives(spark, folder: str) -> DataFrame:
    """An index for read_chunks of the archives (*.warc.gz) in a folder: one stretch each, as where their records begin isn't known."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.lit(0).cast("long").alias("offset"), "length")


def read_chunks(index: DataFrame, path: str, chunk_bytes: int = 256 << 10, task_bytes: int = 256 << 20) -> DataFrame:
    """The chunk table: record_id, page_id, record_type, refers_to, url, chunk_no, chunk, bytes_so_far, digest_so_far, is_last, payload_bytes, payload_digest.

    Every record has at least one chunk, its last flagged is_last; a revisit's is empty, its
    payload_bytes and payload_digest those of the payload it refers to. A payload that differs
    from its stated SHA-256 or length raises an error. Archives of others are read as well:
    records without an HTTP head are payload as a whole, page ids and what isn't stated are null,
    sizes and digests are then known on the last chunk. Tasks take about task_bytes of archives.
    """
    kinds = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}
    ddl = ", ".join(f"{k} {kinds[v]}" for k, v in CHUNK_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)

        def rows():
            for b in batches:
                for archive, offset, length in zip(b["archive"], b["offset"], b["length"], strict=True):
                    with store.open_input_file(f"{folder}/{archive.as_py()}") as raw:
                        raw.seek(offset.as_py())
                        yield from chunks(raw, length.as_py(), chunk_bytes)

        return flushed(rows(), pa.schema(CHUNK_FIELDS), lambda r: len(r[6]))

    stretches, total = index.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = min(stretches, max(2 * index.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes)))
    return index.repartition(max(1, tasks)).mapInArrow(run, ddl)


def op1_warc_chunks(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    index = write_archives(with_record_types(read_table(spark, sf_dir, "pages")), path)
    return read_chunks(index, path).where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
