"""WARC archives in Zstandard: one frame for each record, with a dictionary in the leading skippable frame.

Each task writes archives of its rows into a folder that all executors see; the dictionary comes from the first records of
that archive. What a task attempt wrote counts only once Spark has committed that attempt's list of archives: the listed ones then move to
the folder that is read, so attempts that died or ran twice leave nothing behind. Reading takes the dictionary from the archive itself, decodes frame by frame and checks each record's headers,
lengths and digest; anything that does not hold raises ArchiveError.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, pick, text_of

#: The frame of the dictionary (RFC 8878 skippable frame; the number used for .warc.zst), WARC's version and revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A record revisits an earlier equal one only if its payload has this many bytes.
REVISIT_BYTES = 100
#: The dictionary is trained on this many bytes of the archive's first payloads, each cut to SAMPLE_PART; it has at most DICTIONARY bytes.
SAMPLE, SAMPLE_PART, DICTIONARY = 1 << 20, 1 << 14, 1 << 15
LEVEL = 3
#: An archive is closed and another begun when it has this many bytes.
ARCHIVE = 32 << 20


class ArchiveError(ValueError):
    """An archive or a record that is not valid."""


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str) -> bytes:
    """A WARC record: response with its payload, or revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)] if kind == "revisit" else []), ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, what: str) -> tuple[dict[str, str], int]:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ArchiveError(f"{what}: headers do not end")
    found = {}
    for line in data[:end].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            raise ArchiveError(f"{what}: header without colon")
        found[k.decode("ascii", "replace").strip().lower()] = v.decode("utf-8", "surrogatepass").strip()
    return found, end + 4


def _number(h: dict[str, str], what: str) -> int:
    if not h.get("content-length", "").isdigit():
        raise ArchiveError(f"{what}: no valid Content-Length")
    return int(h["content-length"])


def _page(value: str) -> int | None:
    if not (value.startswith("<urn:page:") and value.endswith(">")):
        raise ArchiveError(f"not a page's record id: {value[:80]}")
    return int(value[10:-1]) if value[10:-1] else None


def parse(data: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (None for revisits) of one record, validated."""
    if not data.startswith(VERSION + b"\r\n"):
        raise ArchiveError("no WARC version line")
    h, at = _headers(data, "record")
    n = _number(h, "record")
    if len(data) != at + n + 4 or data[at + n :] != b"\r\n\r\n":
        raise ArchiveError("the record's length is not its Content-Length")
    block = data[at : at + n]
    if not block.startswith(b"HTTP/1.1 "):
        raise ArchiveError("no HTTP status line")
    http, start = _headers(block, "block")
    size, payload, kind = _number(http, "block"), block[start:], h.get("warc-type")
    digest = h.get("warc-payload-digest", "")
    if not digest.startswith("sha256:") or len(digest) != 71:
        raise ArchiveError("no payload digest")
    digest = digest[7:]
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ArchiveError("the payload does not match its length or digest")
    elif kind == "revisit":
        if payload or h.get("warc-profile") != PROFILE or "warc-refers-to" not in h:
            raise ArchiveError("not a valid revisit")
    else:
        raise ArchiveError(f"record type {kind!r}")
    return {"page_id": _page(h.get("warc-record-id", "")), "url": h.get("warc-target-uri"), "record_type": kind, "refers_to": _page(h["warc-refers-to"]) if kind == "revisit" else None, "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


class Writer:
    """Writes frames to a file object. The first records wait until there is a sample to train the dictionary on."""

    def __init__(self, out):
        self.out, self.waiting, self.sample, self.size, self.compressor, self.n, self.written = out, [], [], 0, None, 0, 0

    def add(self, data: bytes) -> None:
        self.n += 1
        if self.compressor is None:
            self.waiting.append(data)
            self.sample.append(data[:SAMPLE_PART])
            self.size += len(self.sample[-1])
            if self.size >= SAMPLE:
                self._begin()
        else:
            self._frame(data)

    def _begin(self) -> None:
        try:
            dictionary = zstandard.train_dictionary(min(DICTIONARY, self.size // 8), self.sample)
        except (zstandard.ZstdError, ValueError):  # too few records to learn from: their own bytes serve as one
            dictionary = zstandard.ZstdCompressionDict(b"".join(self.sample)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        body = dictionary.as_bytes()
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
        for data in self.waiting:
            self._frame(data)
        self.waiting, self.sample = [], []

    def _frame(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def close(self) -> None:
        if self.compressor is None:
            self._begin()


def records(archive: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one record each."""
    view, at, dictionary = memoryview(archive), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_FRAME:
        n = struct.unpack_from("<I", view, 4)[0]
        body = bytes(view[8 : 8 + n])
        if len(body) != n:
            raise ArchiveError("the dictionary is cut off")
        if body[:4] == struct.pack("<I", ZSTD_FRAME):  # it may itself be compressed
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
        dictionary, at = zstandard.ZstdCompressionDict(body), 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        if len(view) - at >= 8 and struct.unpack_from("<I", view, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]  # another skippable frame
            continue
        try:
            expected = zstandard.get_frame_parameters(view[at : at + 18]).content_size
            frame, out = reader.decompressobj(), io.BytesIO()
            while not frame.eof:
                piece = view[at : at + (1 << 16)]
                if not len(piece):
                    raise ArchiveError("a frame is cut off")
                out.write(frame.decompress(piece))
                at += len(piece) - len(frame.unused_data)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"a frame does not decode: {e}") from e
        data = out.getvalue()
        if expected not in (len(data), zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR):
            raise ArchiveError("a frame's length is not what its header says")
        yield data


#: Digests of payloads that occur again are broadcast up to this number (at most 64 MB); beyond it they are joined by shuffle.
BROADCAST_DIGESTS = 1 << 20


def plan(pages: DataFrame, work: Workspace, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest, first: what is to be written; first is the page that a revisit refers to, else null.

    What occurs again shows from digests alone, counted before they are shuffled. Payloads stay where they are read, unless more
    than BROADCAST_DIGESTS digests occur again. Rows without an id refer to one that has an id; null html is an empty payload.
    """
    rows = pick(pages, page_id=page_id, url=url, html=html)
    rows = rows.select(F.col("page_id").cast("long"), "url", text_of("html").alias("html"), F.unhex(F.sha2(text_of("html"), 256)).alias("digest"))
    long_ = rows.filter(F.octet_length("html") >= REVISIT_BYTES).select("digest", "page_id")
    again = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    again = work.keep(again, "again")
    if again.count() <= BROADCAST_DIGESTS:
        again = F.broadcast(again)
    first = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    return rows.join(again, "digest", "left").select("page_id", "url", "html", F.lower(F.hex("digest")).alias("digest"), first.alias("first"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes archives into folder and returns archive, records, bytes of each. Names hold the task attempt, so no attempt touches another's.

    The folder's scheme must be one that pyarrow knows (file, hdfs, s3, gs, abfs). No rows: no archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        context, done = TaskContext.get(), []
        writer = out = name = None

        def end():
            writer.close()
            out.close()
            done.append((name, writer.n, writer.written))

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html", "digest", "first"))):
                if writer is None:
                    name = f"part-{context.partitionId():05}-{context.taskAttemptId()}-{len(done):04}.warc.zst"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    writer = Writer(out)
                page, url, html, digest, first = r
                writer.add(record(page, url, html.encode("utf-8", "surrogatepass"), "response" if first is None else "revisit", first, digest))
                if writer.written >= ARCHIVE:
                    end()
                    writer = None
        if writer is not None:
            end()
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["archive", "records", "bytes"])

    return rows.mapInArrow(run, "archive string, records bigint, bytes bigint")


def publish(written: DataFrame, folder: str, final: str) -> DataFrame:
    """Moves the archives that written (a committed table) lists from folder to final; returns archive. A task that runs again finds them moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        to = pyarrow.fs.FileSystem.from_uri(final)[1]
        fs.create_dir(to)
        for b in batches:
            for name in b.column(0).to_pylist():
                try:
                    fs.move(f"{base}/{name}", f"{to}/{name}")
                except OSError:
                    if fs.get_file_info(f"{to}/{name}").type != pyarrow.fs.FileType.File:
                        raise
            yield b.select(["archive"])

    return written.select("archive").mapInArrow(run, "archive string")


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """A row for each record of the folder's archives, validated; with payloads if asked for.

    A record, a length, a digest or a frame that does not hold raises ArchiveError, which names the archive.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if payload else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                held, size = [], 0
                try:
                    for data in records(content.as_buffer()):
                        held.append(parse(data))
                        size += len(data)
                        if size > 1 << 22:
                            yield _rows(held, fields)
                            held, size = [], 0
                except ArchiveError as e:
                    raise ArchiveError(f"{os.path.basename(path)}: {e}") from e
                if held:
                    yield _rows(held, fields)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("path", "content")
    kinds = {"page_id": "bigint", "url": "string", "record_type": "string", "refers_to": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "payload": "binary"}
    return files.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n, _ in fields))


def _rows(held: list[dict], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], t) for n, t in fields], [n for n, _ in fields])


def round_trip(pages: DataFrame, work: Workspace, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row of pages and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Of records with equal payloads of at least REVISIT_BYTES bytes the one with the smallest page_id is the response (repeated rows
    with that id all are), the others revisit it; rows without an id are revisits if another equal row has one. Null html is an empty payload.
    An empty table gives an empty result.
    """
    spark, folder = pages.sparkSession, work.file("archives")
    written = work.keep(write(plan(pages, work, page_id, url, html), work.file("attempts")), "written")
    if not publish(written, work.file("attempts"), folder).count():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def oracle_sql() -> str:
    return f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
           CASE WHEN n >= {REVISIT_BYTES} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= {REVISIT_BYTES} AND first <> page_id THEN first END AS refers_to, url FROM f"""
