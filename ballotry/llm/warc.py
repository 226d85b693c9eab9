"""WARC archives: a writer of one compressed member a record, and a reader that salvages damaged archives.

Writing: each task writes archives of a bounded size to the shared folder and returns their paths, so
that only archives of tasks that ended count; those of lost attempts are never read. Of records with
equal payloads the first becomes a response, the others revisits that refer to it.

Reading: a record counts if its version line, headers, length, block digest, payload digest, ending
and, where compressed, its member's checksum hold. After a failed check the reader goes on behind the
record if its frame is whole, and else searches byte by byte for the next member or version line from
which a record passes all checks; the bytes between are logged as quarantined. Archives are read
piece by piece: a task holds one record and one piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballotry.sources.shared import new_folder

from .common import Scratch, bound_batches, lean

#: Compressed bytes after which an archive is closed, bytes that are read at a time, and bytes of headers at most.
ARCHIVE_BYTES, PIECE, HEAD_BYTES = 32 << 20, 1 << 20, 1 << 16
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")
_START = re.compile(rb"WARC/\d\.\d\r\n|\x1f\x8b\x08")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A record's name: the same for the same parts in every task."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest(), version=4)}>"


def record_bytes(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", len(block))] if v is not None)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, name: str, refers_to: str | None, first_page: int | None, date: str) -> bytes:
    """A response with its payload, or, where ``refers_to`` names a response, a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", refers_to), ("X-Refers-To-Page-ID", first_page if revisit else None), ("X-Page-ID", page_id),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    return record_bytes(headers, http if revisit else http + payload)


def compressed(record: bytes) -> bytes:
    """One gzip member."""
    work = zlib.compressobj(6, zlib.DEFLATED, 31)
    return work.compress(record) + work.flush()


# Reading -------------------------------------------------------------------------------------------


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int = 0

    def get(self, name: str) -> str | None:
        return self.headers.get(name.lower())

    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers and body of an HTTP block; other blocks are all body."""
        if not (self.get("content-type") or "").startswith("application/http"):
            return {}, self.block
        head, _, body = self.block.partition(b"\r\n\r\n")
        pairs = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, _, v in pairs}, body


class Broken(Exception):
    """A failed check; ``end`` is where the record ends if its frame is whole."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


@dataclass
class Source:
    """Bytes of a file by offset, one piece held."""

    file: object
    size: int
    at: int = 0
    held: bytes = field(default=b"", repr=False)

    def read(self, offset: int, n: int) -> bytes:
        begin = offset - self.at
        if not 0 <= begin <= begin + n <= len(self.held) and offset < self.size:
            self.file.seek(offset)
            self.at, self.held = offset, self.file.read(min(max(n, PIECE), self.size - offset))
            begin = 0
        return self.held[begin : begin + n] if 0 <= begin else b""


def parse_head(head: bytes) -> tuple[dict[str, str], int]:
    """Headers, and the block's length."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("header line without a colon")
        last = name.strip().lower()
        headers[last] = value.strip()
    length = headers.get("content-length", "")
    if "warc-type" not in headers or "warc-record-id" not in headers or not length.isdigit():
        raise Broken("headers are missing")
    return headers, int(length)


def check_digests(record: Record, end: int | None) -> None:
    for name in ("warc-block-digest", "warc-payload-digest"):
        kind, _, want = (record.get(name) or "").partition(":")
        if not want or kind.lower() != "sha1" or name == "warc-payload-digest" and record.get("warc-type") == "revisit":
            continue
        if sha1_base32(record.block if name == "warc-block-digest" else record.http()[1]) != want.upper():
            raise Broken(f"{name} differs", end)


def plain_record(source: Source, offset: int) -> tuple[Record, int]:
    """The record whose version line is at an offset, and where it ends."""
    head = source.read(offset, min(HEAD_BYTES, source.size - offset))
    if not _VERSION_LINE.match(head):
        raise Broken("no version line")
    stop = head.find(b"\r\n\r\n")
    if stop < 0:
        raise Broken("headers don't end")
    headers, length = parse_head(head[:stop])
    begin = offset + stop + 4
    if begin + length + 4 > source.size:
        raise Broken("block is cut off")
    if source.read(begin + length, 4) != b"\r\n\r\n":
        raise Broken("record doesn't end where its length says")
    record = Record(headers, source.read(begin, length), offset)
    check_digests(record, begin + length + 4)
    return record, begin + length + 4


def member_records(source: Source, offset: int) -> Iterator[tuple[Record | None, int]]:
    """The records of the gzip member at an offset, each with the member's end so far; then (None, end). A record
    with a block digest is given as soon as it is read, others when the member's checksum holds."""
    work, at, buffer, waiting, first = zlib.decompressobj(31), offset, bytearray(), [], True
    head: tuple[dict[str, str], int, int] | None = None
    while not work.eof:
        piece = source.read(at, min(PIECE // 8, source.size - at))
        if not piece:
            raise Broken("member is cut off")
        try:
            buffer += work.decompress(piece)
        except zlib.error as error:
            raise Broken(f"member: {error}") from None
        at += len(piece) - len(work.unused_data)
        end = at if work.eof else None
        while True:
            if head is None:
                if len(buffer) >= 10 and not _VERSION_LINE.match(buffer):
                    raise Broken("member holds no record" if first else "no version line in a member", end)
                stop = buffer.find(b"\r\n\r\n", 0, HEAD_BYTES)
                if stop < 0:
                    if len(buffer) >= HEAD_BYTES:
                        raise Broken("headers don't end", end)
                    break
                head = (*parse_head(bytes(buffer[:stop])), stop + 4)
            headers, length, begin = head
            if len(buffer) < begin + length + 4:
                break
            if buffer[begin + length : begin + length + 4] != b"\r\n\r\n":
                raise Broken("record doesn't end where its length says", end)
            record = Record(headers, bytes(buffer[begin : begin + length]), offset)
            del buffer[: begin + length + 4]
            head, first = None, False
            check_digests(record, end)
            if record.get("warc-block-digest"):
                yield record, at
            else:
                waiting.append(record)
    if buffer or head:
        raise Broken("record is cut off in its member", at)
    for record in waiting:
        yield record, at
    yield None, at


@dataclass
class Gap:
    begin: int
    end: int
    reason: str


def salvage(source: Source) -> Iterator[Record | Gap]:
    """All records of an archive that pass every check, in order, and the byte gaps between them."""
    at, lost, reason = 0, None, ""  # where reading goes on, and where the gap before it began
    while at < source.size:
        start = source.read(at, min(10, source.size - at))
        end = None
        try:
            if start.startswith(MEMBER):
                for record, end in member_records(source, at):
                    if record is None:
                        break
                    if lost is not None:
                        yield Gap(lost, at, reason)
                        lost = None
                    yield record
            else:
                record, end = plain_record(source, at)
                if lost is not None:
                    yield Gap(lost, at, reason)
                    lost = None
                yield record
            at = end
        except Broken as broken:
            if lost is None:
                lost, reason = at, str(broken)
            at = broken.end if broken.end is not None else next_start(source, at + 1)
    if lost is not None:
        yield Gap(lost, source.size, reason)


def next_start(source: Source, offset: int) -> int:
    """Where the next version line or member begins."""
    while offset < source.size:
        piece = source.read(offset, min(PIECE, source.size - offset))
        if found := _START.search(piece):
            return offset + found.start()
        if offset + len(piece) >= source.size:
            break
        offset += len(piece) - 16
    return source.size


# Spark jobs ----------------------------------------------------------------------------------------


def _open(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_kinds(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, copy, first_page, kind): rows as they are to be written; ``digest`` is SHA-1 in
    hexadecimals, ``kind`` response or revisit. Payloads below ``least_bytes`` are always responses.

    Payloads meet by digest and id, which spreads the copies of a hot payload over all tasks; who comes first is
    decided on digests and ids alone.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    # keys without nulls, so that the join and the window share one shuffle of the payloads
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("at", F.coalesce("page_id", F.lit(0).cast("long"))).withColumn("unnamed", F.col("page_id").isNull())
    key = ["digest", "at", "unnamed"]
    ids = rows.where(F.octet_length("payload") >= least_bytes).groupBy(*key).agg(F.first("page_id").alias("page_id"))
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first_page"))
    plan = ids.select(*key).join(firsts, "digest").withColumn("known", F.lit(True))
    met = rows.join(plan, key, "left")
    copy = F.row_number().over(Window.partitionBy(*key).orderBy("url"))
    response = F.col("known").isNull() | (F.col("page_id").eqNullSafe(F.col("first_page")) & (F.col("copy") == 1))
    return met.withColumn("copy", copy).withColumn("kind", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))).drop("known", "at", "unnamed")


def write_archives(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Write a record of every row (page_id, url, html) to archives in the shared folder; (path, records, bytes) of
    each archive. The table is written, so that no archive is written twice."""
    folder = new_folder(pages.sparkSession)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, sink, path, records, size = [], None, "", 0, 0
        files, where = _open(folder)
        files.create_dir(where, recursive=True)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "copy", "first_page", "kind")]
            for page_id, url, payload, digest, copy, first, kind in zip(*columns):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, sink, records = f"{folder}/{name}", files.open_output_stream(f"{where}/{name}", compression=None), 0
                    info = record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    size = sink.write(compressed(info)) or 0
                to = None if kind == "response" else record_id(digest, first, 1)
                member = compressed(page_record(page_id, url, payload, record_id(digest, page_id, copy), to, first, date))
                sink.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    sink.close()
                    done.append((path, records, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((path, records, size))
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    rows = record_kinds(pages, least_bytes).select("page_id", "url", "payload", "digest", "copy", "first_page", "kind")
    return scratch.table(rows.mapInArrow(lean(each), "path string, records long, bytes long"))


RECORDS = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("gap_end", pa.int64()), ("reason", pa.string()),
])


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"-?\d{1,19}", value) else None


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives at column ``path``: (path, offset, record_type, record_id, refers_to_id,
    target_uri, page_id, refers_to, payload_bytes, payload_digest, payload, gap_end, reason). Size and digest are
    those of the full payload, a revisit's as its headers name them; a quarantined gap has record_type ``gap``, its
    bytes are [offset, gap_end). Without ``payloads`` that column stays null."""
    bound_batches(archives.sparkSession)

    def row(path: str, one: Record | Gap) -> tuple:
        if isinstance(one, Gap):
            return (path, one.begin, "gap", *[None] * 8, one.end, one.reason)
        kind = one.get("warc-type")
        http, body = one.http()
        digest = (one.get("warc-payload-digest") or "").partition(":")[2].upper()
        size, digest = (_number(http.get("content-length")), digest or None) if kind == "revisit" else (len(body), sha1_base32(body))
        return (
            path, one.offset, kind, one.get("warc-record-id"), one.get("warc-refers-to"), one.get("warc-target-uri"), _number(one.get("x-page-id")), _number(one.get("x-refers-to-page-id")),
            size, digest, body if payloads and kind != "revisit" else None, None, None,
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, where = _open(path)
                held, size = [], 0
                with files.open_input_file(where) as file:
                    for one in salvage(Source(file, file.size())):
                        held.append(row(path, one))
                        size += len(held[-1][10] or b"") + 256
                        if size > 4 << 20:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), RECORDS)], schema=RECORDS)
                            held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), RECORDS)], schema=RECORDS)

    names = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return archives.select("path").mapInArrow(lean(each), ", ".join(f"{f.name} {names[f.type]}" for f in RECORDS))


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row, as read back from the archives.

    Defined results: null html is empty; null ids come last, among equal ids the smaller url is first, and of rows
    equal in both one; revisits of a response without an id refer to null; an empty table gives no rows; other
    columns don't matter.
    """
    spark: SparkSession = pages.sparkSession
    archives = write_archives(pages, Scratch(spark), least_bytes)
    got = read_archives(archives, payloads=False).where("record_type in ('response', 'revisit')")
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in DuckDB, without archives.
WARC_SQL = r"""
with p as (select page_id::bigint page_id, url, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
r as (select *, row_number() over (partition by html order by page_id nulls last, url nulls first) i, min(page_id) over (partition by html) first_page from p)
select page_id, strlen(html)::bigint payload_bytes,
    list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
        lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[5 * i + 1:5 * i + 5])::int >> s) & 31) + 1]), 'string_agg', '')), 'string_agg', '') payload_digest,
    case when i = 1 then 'response' else 'revisit' end record_type, case when i > 1 then first_page end refers_to from r
"""
