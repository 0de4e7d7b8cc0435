import base64
import hashlib
import io
import zipfile

import pytest

from gridtrend.llm import warc
from gridtrend.llm.common import new_folder

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (1, "http://a.example/é x\r\ny%20", "<p>one</p>"),
    (2, None, "<p>one</p>"),
    (3, "http://b.example/", "é" * 5000),
    (4, "http://b.example/", None),
    (5, "", ""),
    (6, "http://c.example/", "<p>one</p>"),
    (6, "http://c.example/2", "<p>one</p>"),
    (None, "http://c.example/", "<p>one</p>"),
    (7, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, least=0):
    largest = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= least:
            largest[digest(h)] = max(largest.get(digest(h), p), p)
    out = []
    for p, u, h in rows:
        first = largest.get(digest(h))
        again = first is not None and p != first and len((h or "").encode()) >= least
        out.append((p, u, len((h or "").encode()), digest(h), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 11])
def test_round_trip(spark, clash, least):
    pages = clash(spark.createDataFrame(ROWS, SCHEMA), "digest", "first", "body", "kind")
    got = [tuple(r) for r in warc.round_trip(pages, least).collect()]
    assert sorted(got, key=str) == expected(ROWS, least)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = [tuple(r) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=str) == expected([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])


def test_payloads_in_many_archives(spark, monkeypatch):
    pages = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    listed = warc.write(warc.marked(pages), new_folder(spark))
    got = {(r["page_id"], bytes(r["payload"])) for r in warc.read(listed, payload=True).collect() if r["payload"] is not None}
    assert (3, ("é" * 5000).encode()) in got and (7, ROWS[-1][2].encode()) in got


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_zip64_directory(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    archive = warc.Archive(str(tmp_path))
    for i in range(20):
        archive.add(i, warc.record(i, "u", b"x" * 50, digest("x" * 50), "response", None, "2000-01-01T00:00:00Z"))
    uri, n, _ = archive.close()
    raw = open(uri, "rb").read()
    assert n == 20 and warc.END64 in raw and warc.LOCATOR64 in raw
    assert [r["page_id"] for a, m in warc.ranges(uri) for r in warc.records(uri, a, m)] == list(range(20))


def test_directory_with_comment_and_other_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("é.txt", b"abc")
        z.writestr("packed", b"d" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"comment with PK\x05\x06 inside it, and more text behind"
    members = warc.directory(out)
    at, n = warc.stored(out, members, "é.txt")
    assert out.getvalue()[at : at + n] == b"abc"
    with pytest.raises(ValueError, match="not stored"):
        warc.stored(out, members, "packed")
    with pytest.raises(ValueError, match="end of a central directory"):
        warc.directory(io.BytesIO(b"no archive"))


def test_damage_is_seen():
    raw = warc.record(1, "u", b"abc", digest("abc"), "response", None, "2000-01-01T00:00:00Z")
    assert warc.parsed(raw)["payload"] == b"abc"
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(raw.replace(b"abc", b"abd"))
