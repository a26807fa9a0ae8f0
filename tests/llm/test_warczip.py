"""Archives: round trips, revisits, ZIP64 directories and broken input."""

import base64
import hashlib
import io
import zipfile

import pytest

from corpusforge.llm import common, warczip
from tests.llm import fixtures

PAGES = [(1, "http://a/", "<p>same</p>"), (5, "http://b/", "<p>same</p>"), (3, None, "<p>same</p>"), (2, "u", None), (4, "u\r\nX: y", ""), (6, "ü", "é🙂\r\n\r\nWARC/1.1\r\n"), (7, "u", "x" * 300_000), (None, "u", "<p>same</p>"), (None, "u", "null id"), (8, "u", "twice"), (8, "u", "twice")]
SCHEMA = "page_id long, url string, html string"


def expected(pages, least=0):
    out = []
    for p, _, h in pages:
        data = (h or "").encode()
        top = max((q for q, _, g in pages if (g or "") == (h or "") and q is not None), default=None)
        refers = top if len(data) >= least and top is not None and top != p else None
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_op5(spark, tmp_path):
    path = fixtures.save(spark, tmp_path, pages=(PAGES, SCHEMA))
    assert sorted(map(tuple, warczip.op5_warc_zip(spark, path).collect()), key=str) == expected(PAGES)
    assert warczip.op5_warc_zip(spark, fixtures.save(spark, tmp_path / "none", pages=([], SCHEMA))).count() == 0


def test_small_payloads_and_archives(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], SCHEMA + ", h string")
    out = common.fresh_path(spark, "warc-test")
    warczip.write_archives(pages, out, revisit_bytes=6, archive_bytes=600)
    assert spark.read.parquet(out).count() > 1
    got = warczip.read_records(spark, out)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == expected(PAGES, 6)
    assert {bytes(r.payload).decode() for r in got.filter("record_type = 'response'").collect()} == {h or "" for _, _, h in PAGES}


def test_zip64_directories(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.comment = b"a comment PK"
        for name in ("first", "ünicode"):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(name.encode() * 100)
        z.writestr("deflated", b"0" * 500, zipfile.ZIP_DEFLATED)
    assert b"PK\x06\x06" in out.getvalue()
    for source in (out.getvalue(), out):
        directory = warczip.ZipDirectory(warczip.ByteRange(source))
        assert list(directory.members) == ["first", "ünicode", "deflated"]
        for name in ("first", "ünicode"):
            assert directory.source.read(*directory.locate(name)) == name.encode() * 100
        with pytest.raises(ValueError):
            directory.locate("deflated")


def test_an_archive_reads_elsewhere():
    blob = warczip.build_archive([(1, b"one"), (2, b"two")])
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        assert z.testzip() is None and z.read(warczip.DATA) == b"onetwo"
    for broken in (b"", blob[:-30], b"x" * 100):
        with pytest.raises(ValueError):
            list(warczip.read_archive(broken))
