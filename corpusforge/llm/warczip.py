"""WARC records in ZIP archives, written from pages and read back by ranges.

An archive is a ZIP whose members are stored, not deflated: ``archive/data.warc.gz``
with one gzip member for each record, and ``indexes/index.cdxj`` with a line for
each record: its page, offset and length. The reader finds the central directory
from the archive's end (ZIP64 included), locates the members in the archive
itself, and reads each record by its range; nothing is extracted.

Defined results: a null payload counts as empty. Of equal payloads of at least
``revisit_bytes`` the largest page id is the response and the others revisit it;
rows that repeat that page id are responses too. A null id is below all others,
and without a known id in its group a row is a response. Payloads of any size
have a record; one over the archive's size has an archive of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import common

ARCHIVE_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- ZIP directories -------------------------------------------------------


class ByteRange:
    """Reads ranges of a bytes-like object or of a seekable file."""

    def __init__(self, source):
        if hasattr(source, "seek"):
            self._file, self.size = source, source.seek(0, io.SEEK_END)
        else:
            self._file, self._view = None, memoryview(source)
            self.size = len(self._view)

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"range {offset}+{length} is outside {self.size} bytes")
        if self._file is None:
            return bytes(self._view[offset : offset + length])
        self._file.seek(offset)
        return self._file.read(length)


class ZipDirectory:
    """name -> (method, packed size, size, offset of the local header)."""

    def __init__(self, source: ByteRange):
        self.source, self.members = source, {}
        offset, size, total = self._end()
        data = source.read(offset, size)
        at = 0
        for _ in range(total):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, full, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", data, at + 20)
            (header,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + name_size : at + 46 + name_size + extra_size]
            full, packed, header = self._wide(extra, full, packed, header)
            self.members[name] = (method, packed, full, header)
            at += 46 + name_size + extra_size + comment_size

    def _end(self) -> tuple[int, int, int]:
        """Offset, size and number of entries of the central directory."""
        tail_size = min(self.source.size, 22 + 0xFFFF)
        tail_at = self.source.size - tail_size
        tail = self.source.read(tail_at, tail_size)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        total, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == total or 0xFFFFFFFF in (size, offset):
            locator = self.source.read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            (end64,) = struct.unpack_from("<Q", locator, 8)
            record = self.source.read(end64, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            total, size, offset = struct.unpack_from("<QQQ", record, 32)
        return offset, size, total

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Values of 2**32-1 are in the ZIP64 extra field, in this order."""
        at, wide = 0, b""
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = extra[at + 4 : at + 4 + size]
            at += 4 + size
        out, used = [], 0
        for v in values:
            if v == 0xFFFFFFFF:
                (v,) = struct.unpack_from("<Q", wide, used)
                used += 8
            out.append(v)
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        method, packed, full, header = self.members[name]
        if method != 0 or packed != full:
            raise ValueError(f"{name} is not stored")
        local = self.source.read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: no local header")
        name_size, extra_size = struct.unpack_from("<HH", local, 26)
        return header + 30 + name_size + extra_size, full


# --- records ---------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP head and no payload."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Target-URI: " + " ".join((url or "").split()),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the payload after the HTTP head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    names = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return names, rest[: int(names["content-length"])].partition(b"\r\n\r\n")[2]


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def build_archive(records: list[tuple[int | None, bytes]]) -> bytes:
    """A ZIP of stored members from (page, gzipped record)."""
    lines, at = [], 0
    for page, data in records:
        lines.append(json.dumps({"page": page, "offset": at, "length": len(data)}))
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(DATA), b"".join(data for _, data in records))
        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines).encode())
    return out.getvalue()


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, each by its range."""
    ranges = ByteRange(source)
    directory = ZipDirectory(ranges)
    data_at, data_size = directory.locate(DATA)
    for line in ranges.read(*directory.locate(INDEX)).splitlines():
        entry = json.loads(line)
        if entry["offset"] + entry["length"] > data_size:
            raise ValueError("the index points outside the archive")
        yield parse(gzip.decompress(ranges.read(data_at + entry["offset"], entry["length"])))


# --- Spark -----------------------------------------------------------------

_ARCHIVES = "name string, records long, content binary"
_RECORDS = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def write_archives(pages: DataFrame, out: str, revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages (page_id, url, html) as a table of archives at ``out``.

    Only groups of equal payloads are joined back, so that one hot payload is a
    single row on the small side and its pages are split as any skewed join's.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("p"), F.col("url").cast("string").alias("u"), payload.cast("binary").alias("h"), F.sha1(payload).alias("d"), F.octet_length(payload).alias("n"))
    groups = rows.filter(F.col("n") >= revisit_bytes).groupBy("d").agg(F.max("p").alias("top"), F.count("*").alias("c")).filter("c > 1").select("d", "top")
    top = F.when((F.col("n") >= revisit_bytes) & F.col("top").isNotNull() & ~F.col("p").eqNullSafe(F.col("top")), F.col("top"))
    records = rows.join(groups, "d", "left").select("p", "u", "h", top.alias("r"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive():
            content = build_archive(held)
            name = hashlib.sha256(content).hexdigest()[:32] + ".zip"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([content], pa.binary())], names=["name", "records", "content"])

        for batch in batches:
            for p, u, h, r in zip(*batch.columns, strict=True):
                page = p.as_py()
                data = gzip.compress(record(page, u.as_py(), h.as_py(), r.as_py()), 1, mtime=0)
                if held and size + len(data) > archive_bytes:
                    yield archive()
                    held, size = [], 0
                held.append((page, data))
                size += len(data)
        if held:
            yield archive()

    common.map_arrow(records, write, _ARCHIVES).write.option("compression", "none").parquet(out)


def read_records(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives; a response's digest is checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for head, payload in read_archive(content.as_buffer()):
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (payload_digest(payload) != digest or len(payload) != int(head["x-payload-length"])):
                        raise ValueError(f"{head['warc-record-id']}: the payload was changed")
                    out.append((_page(head["warc-record-id"]), kind, _page(head.get("warc-refers-to")), digest, int(head["x-payload-length"]), payload if payloads and kind == "response" else None))
                    size += len(payload)
                    if size > common.SLICE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RECORDS_ARROW, strict=True)], schema=_RECORDS_ARROW)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RECORDS_ARROW, strict=True)], schema=_RECORDS_ARROW)

    return common.map_arrow(spark.read.schema(_ARCHIVES).parquet(path).select("content"), read, _RECORDS)


def op5_warc_zip(spark, sf_dir: str) -> DataFrame:
    out = common.fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), out)
    return read_records(spark, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
