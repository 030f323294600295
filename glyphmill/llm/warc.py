"""WARC archives: a writer of one gzip member a record, and a sequential reader.

The reader decompresses a member bit by bit, frames the record by its Content-Length, digests the block and the payload on the way,
and holds both against the digests in the header. Archives are files in the cluster's shared folder. Where that folder is not mounted on
the executors (any scheme but file:), the same bytes are kept in a Parquet table there, a row for each archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.rows import map_batches, pick, raw_of, settle, shared_folder

#: Payloads of at least so many bytes are written once; later equals revisit.
LEAST_BYTES = 1000
#: An archive is closed once it has so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _uri(page: object) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def _clean(value: str) -> bytes:
    """Header values hold no control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value).encode("utf-8", "surrogatepass")


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A gzip member with one record; fields of None are left out."""
    head = b"WARC/1.1\r\n" + b"".join(k.encode() + b": " + _clean(v) + b"\r\n" for k, v in [*fields, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))] if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page: object, url: str | None, payload: bytes, refers_to: object, revisit: bool, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit with the HTTP header of the full response alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uri(page)), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", _sha1(payload))]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _uri(refers_to))]
    return record(fields, http if revisit else http + payload)


@dataclass
class Record:
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes
    digest_ok: bool

    @property
    def kind(self) -> str:
        return self.fields.get("warc-type", "")


class FramingError(ValueError):
    pass


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise FramingError(f"header line without a colon: {line[:80]!r}")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "surrogatepass")
    return out


def _member(stream: BinaryIO, left: bytes) -> tuple[Iterator[bytes], list[bytes]]:
    """Decompressed parts of the member that `left` and the stream go on with; the list gets what follows it."""
    rest: list[bytes] = []

    def parts() -> Iterator[bytes]:
        unpacker, raw = zlib.decompressobj(31), left
        while True:
            while raw and not unpacker.eof:
                yield unpacker.decompress(raw, CHUNK)
                raw = unpacker.unconsumed_tail if not unpacker.eof else unpacker.unused_data
            if unpacker.eof:
                rest.append(unpacker.unused_data)
                return
            raw = stream.read(CHUNK)
            if not raw:
                raise FramingError("the archive ends inside a gzip member")

    return parts(), rest


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """The records of an archive, in order; FramingError where it isn't one."""
    left = stream.read(CHUNK)
    while left:
        parts, rest = _member(stream, left)
        held = bytearray()
        while (end := held.find(b"\r\n\r\n")) < 0:
            part = next(parts, None)
            if part is None:
                raise FramingError("a record without the end of its header")
            held += part
        version, *lines = bytes(held[:end]).split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise FramingError(f"not a WARC record: {version[:80]!r}")
        fields = _fields(lines)
        if not fields.get("content-length", "").isdigit():
            raise FramingError("a record without a Content-Length")
        length = int(fields["content-length"])
        del held[: end + 4]
        for part in parts:
            held += part
            if len(held) > length + 4:
                raise FramingError("a record is longer than its Content-Length")
        if len(held) != length + 4 or held[length:] != b"\r\n\r\n":
            raise FramingError("a record's end is not where its Content-Length says")
        block = bytes(held[:length])
        ok = fields.get("warc-block-digest") in (None, _sha1(block))
        http, payload = {}, block
        if fields.get("content-type", "").startswith("application/http"):
            head, gap, payload = block.partition(b"\r\n\r\n")
            if not gap:
                raise FramingError("an HTTP block without the end of its header")
            http = _fields(head.split(b"\r\n")[1:])
            if fields.get("warc-type") != "revisit":
                ok &= fields.get("warc-payload-digest") in (None, _sha1(payload)) and http.get("content-length", str(len(payload))) == str(len(payload))
        yield Record(fields, http, payload, ok)
        left = rest[0] or stream.read(CHUNK)


def _mounted(folder: str) -> str | None:
    """The folder as a path that Python opens, if it is one."""
    parts = urlsplit(folder)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row into new archives in the folder, and returns (archive, records, bytes[, content]).

    Of rows with equal payloads of least_bytes or more, that with the largest page_id is a response, the others revisit it. A name holds
    the task attempt that wrote it; archives of attempts that failed or were lost are not in the returned rows.
    """
    local = _mounted(folder)
    if local:
        os.makedirs(local, exist_ok=True)
    p = pick(pages, page_id, url, html).toDF("page", "url", "html")
    p = p.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("seal", F.when(F.octet_length("html") >= least_bytes, F.sha2("html", 256)))
    first = p.where("seal IS NOT NULL").groupBy("seal").agg(F.max("page").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n").withColumnRenamed("seal", "_seal")
    # pages too small to be revisited have keys of their own, so that they aren't sent to one task
    key = F.coalesce("seal", F.concat(F.lit("-"), F.xxhash64("page", "url", "html").cast("string")))
    p = p.join(first, key == F.col("_seal"), "left")
    revisit = F.col("_seal").isNotNull() & F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper"))
    p = p.select(F.col("page").cast("string").alias("page"), F.col("url").cast("string").alias("url"), "html", F.col("keeper").cast("string").alias("keeper"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem, number = f"part-{context.partitionId():06d}-{context.taskAttemptId():08d}", 0
        out: BinaryIO | None = None
        name, n = "", 0

        def close() -> pa.RecordBatch:
            size = out.tell()
            content = None if local else out.getvalue()
            if local:
                out.flush()
                os.fsync(out.fileno())
                out.close()
                os.replace(f"{local}/.{name}", f"{local}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([content], pa.binary())], ["archive", "records", "bytes", "content"])

        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_of(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
            for page, link, payload, keeper, again in rows:
                if out is None:
                    name, n = f"{stem}-{number:04d}.warc.gz", 0
                    out = open(f"{local}/.{name}", "wb") if local else io.BytesIO()
                    out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                out.write(page_record(page, link, payload, keeper, again))
                n += 1
                if out.tell() >= archive_bytes:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    written = map_batches(p, run, "archive string, records bigint, bytes bigint, content binary")
    if local:
        return settle(written.drop("content"))
    written.write.parquet(f"{folder}/archives")
    return pages.sparkSession.read.parquet(f"{folder}/archives")


def _page_of(uri: str | None) -> str | None:
    found = re.fullmatch(r"<urn:x-page:(.*)>", uri or "", re.S)
    return None if found is None or found[1] == "null" else found[1]


_READ = "page string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, digest_ok boolean, payload binary"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each response and revisit of the archives (a column `archive` of paths, or `content` of bytes too).

    payload_bytes and payload_digest (hex) are of the full payload: of a revisit, what its stored header says. digest_ok tells
    whether the record's bytes have the digests in its header.
    """
    inside = "content" in archives.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source in b.column(0).to_pylist():
                with io.BytesIO(source) if inside else open(_mounted(source), "rb") as stream:
                    rows, held = [], 0
                    for r in read_records(stream):
                        if r.kind not in ("response", "revisit"):
                            continue
                        digest = base64.b32decode(r.fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = int(r.http["content-length"]) if r.kind == "revisit" else len(r.payload)
                        rows.append((_page_of(r.fields.get("warc-record-id")), r.fields.get("warc-target-uri"), size, digest, r.kind, _page_of(r.fields.get("warc-refers-to")), r.digest_ok, r.payload if with_payload and r.kind == "response" else None))
                        held += len(rows[-1][-1] or b"") + 200
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
        names = [x.split()[0] for x in _READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return map_batches(archives.select("content" if inside else "archive"), run, _READ)


def read_files(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of archives at a path or pattern of any file system that Spark reads; each archive is held in memory once."""
    return read_archives(spark.read.format("binaryFile").load(path).select("content"), with_payload)


def round_trip(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): the pages as the archives written for them read back.

    Null html is an empty payload, a null url leaves out its header line. A null page_id is below any other: it revisits, or
    among null ids only all are responses. Rows that repeat the largest page_id of a group are all responses. A record whose bytes
    don't have its digests ends the query with an error.
    """
    spark = pages.sparkSession
    kind = pages.schema[page_id].dataType.simpleString()
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    back = read_archives(write_archives(pages, folder, page_id, url, html), with_payload=False)
    sound = F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest mismatch in the record of page "), F.coalesce("page", F.lit("null")))))
    return back.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", sound.alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
