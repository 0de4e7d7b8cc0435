"""WARC records in ZIP archives: written by tasks, read back by byte ranges.

An archive holds two stored (uncompressed) members: ``archive/data.warc.gz``, with
one gzip member per record, and ``indexes/index.cdxj``, a line of JSON per record
with its place. A reader finds the end of the central directory (and its ZIP64
form), parses the directory, locates the stored members through their local headers,
reads the index, and then reads only the byte ranges of records; nothing is unpacked.

Archives lie in a folder all executors share. A task writes each archive under a new
name and returns the name with its result, so what a lost or repeated task has left
is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrend.llm.common import keep, new_folder, small

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 256 << 20
CHUNK_BYTES = 1 << 20
TASK_BYTES = 32 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is a local one."""
    if ":" not in uri.split("/")[0]:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


# Records


def escaped(url: str) -> str:
    """A URL on one header line: per cent, control characters and outer space escaped."""
    return re.sub(r"[%\x00-\x20\x7f-\x9f  ]", lambda m: "".join("%%%02X" % b for b in m[0].encode()), url)


def unescaped(url: str) -> str:
    raw = re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), url.encode())
    return raw.decode("utf-8", "replace")


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP header of the response, with the length
    of the full payload, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    head.append(f"WARC-Date: {date}")
    if url is not None:
        head.append(f"WARC-Target-URI: {escaped(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def headers(lines: bytes) -> dict[str, str]:
    pairs = (x.split(": ", 1) for x in lines.decode().split("\r\n")[1:])
    return {p[0].lower(): p[1] if len(p) > 1 else "" for p in pairs}


def parsed(raw: bytes) -> dict:
    """Fields of a record; the digest of a response is computed from its payload and
    has to equal the header's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(headers(http)["content-length"])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != size:
            raise ValueError(f"record {h['warc-record-id']} is damaged")
    page = h["warc-record-id"][len("<urn:page:") : -1]
    refers = h.get("warc-refers-to")
    return {
        "page_id": int(page) if page else None,
        "url": unescaped(h["warc-target-uri"]) if "warc-target-uri" in h else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": h["warc-type"],
        "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None,
        "payload": payload if h["warc-type"] == "response" else None,
    }


# Archives


class Archive:
    """Writes one archive, as a stream."""

    def __init__(self, folder: str):
        system, path = opened(folder)
        self.uri = f"{folder}/{uuid.uuid4().hex}.zip"
        system.create_dir(path, recursive=True)
        self.raw = system.open_output_stream(f"{path}/{self.uri.rsplit('/', 1)[1]}")
        self.zip = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id, raw: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.data.write(packed)
        self.lines.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            f.write("".join(x + "\n" for x in self.lines).encode())
        self.zip.close()
        self.raw.close()
        return self.uri, len(self.lines), self.at


def directory(f) -> dict[str, tuple[int, int, int]]:
    """Central directory of a seekable ZIP file: name -> (method, size, local header).

    The end record is the last one whose comment reaches the end of the file. Fields
    that are all ones are in the ZIP64 end record, or in an entry's ZIP64 field.
    """
    f.seek(0, 2)
    size = f.tell()
    f.seek(max(0, size - 65_557))
    tail = f.read()
    at = tail.rfind(END)
    while at >= 0 and not (len(tail) >= at + 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = size - len(tail) + at
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        f.seek(end - 20)
        locator = f.read(20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        f.seek(struct.unpack_from("<Q", locator, 8)[0])
        whole = f.read(56)
        if whole[:4] != END64:
            raise ValueError("no ZIP64 end of the central directory")
        n, length, start = struct.unpack_from("<QQQ", whole, 32)
    f.seek(start)
    block, out, at = f.read(length), {}, 0
    for _ in range(n):
        if block[at : at + 4] != ENTRY:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", block, at + 8)
        packed, plain, names, extras, comment = struct.unpack_from("<IIHHH", block, at + 20)
        local = struct.unpack_from("<I", block, at + 42)[0]
        name = block[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = block[at + 46 + names : at + 46 + names + extras], 0
        while e + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, e)
            if tag == 1:
                values = [x[0] for x in struct.iter_unpack("<Q", extra[e + 4 : e + 4 + width // 8 * 8])]
                plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            e += 4 + width
        out[name] = (method, packed, local)
        at += 46 + names + extras + comment
    return out


def stored(f, members: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    """(offset, length) of a stored member's bytes in the file."""
    method, length, local = members[name]
    if method != 0:
        raise ValueError(f"{name} is not stored")
    f.seek(local)
    head = f.read(30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header for {name}")
    names, extras = struct.unpack_from("<HH", head, 26)
    return local + 30 + names + extras, length


def ranges(uri: str) -> Iterator[tuple[int, int]]:
    """Byte ranges (offset, length) of whole records that lie together, from the index."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        members = directory(f)
        base, _ = stored(f, members, DATA)
        at, length = stored(f, members, INDEX)
        f.seek(at)
        start = end = None
        for line in f.read(length).splitlines():
            x = json.loads(line)
            if start is not None and (x["offset"] != end or end - start >= CHUNK_BYTES):
                yield base + start, end - start
                start = None
            start = x["offset"] if start is None else start
            end = x["offset"] + x["length"]
        if start is not None:
            yield base + start, end - start


def records(uri: str, offset: int, length: int) -> Iterator[dict]:
    """The records of one byte range."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        f.seek(offset)
        rest = f.read(length)
    while rest:
        unpack = zlib.decompressobj(31)
        raw = unpack.decompress(rest) + unpack.flush()
        rest = unpack.unused_data
        yield parsed(raw)


# Spark


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` as (page_id, url, body, digest, kind, refers_to).

    Of pages with equal payloads of at least ``least`` bytes the one with the largest
    page_id is the response, the others revisit it; rows that repeat that page_id are
    responses too. A null html is an empty payload. A null page_id is smaller than any.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("body"), F.sha1(body).alias("digest"))
    groups = (
        rows.filter(F.octet_length("body") >= least)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first"))
    )
    copied = keep(groups.filter("n > 1 and first is not null").select("digest", "first"))
    if small(copied, 128):
        copied = F.broadcast(copied)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(copied, "digest", "left").select(
        "page_id", "url", "body", "digest",
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write(rows: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``marked`` rows to archives in ``folder``; returns the written list of
    archives (path, n_records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, url, body, digest, kind, refers_to = x
                archive = archive or Archive(folder)
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                archive.add(page_id, record(page_id, url, body, name, kind, refers_to, date))
                if archive.at >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        columns = list(zip(*done)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            ["path", "n_records", "bytes"],
        )

    return keep(rows.mapInArrow(run, "path string, n_records long, bytes long"))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame, payload: bool = False) -> DataFrame:
    """Every record of the archives named in ``path``. First the directories and
    indexes are read, one archive in a task; then ranges of some MB, dealt to all."""

    places_schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                found = [{"path": uri, "offset": a, "length": n} for a, n in ranges(uri)]
                yield pa.RecordBatch.from_pylist(found, schema=places_schema)

    schema = READ + (", payload binary" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
        for batch in batches:
            for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                found = [{k: x[k] for k in names} for x in records(uri, offset, length)]
                yield pa.RecordBatch.from_pylist(found, schema=types)

    # A range is a tiny row that stands for megabytes, so rows are dealt to a stated
    # number of tasks: left to their own size, they would all go to one.
    total = archives.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(archives.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    places = archives.select("path").repartition(tasks, "path").mapInArrow(index, "path string, offset long, length long")
    return places.repartition(tasks, "path", "offset").mapInArrow(fetch, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read all records back."""
    return read(write(marked(pages, least), new_folder(pages.sparkSession)))
