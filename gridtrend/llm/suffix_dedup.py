"""Suffix-array dedup: removing byte strings that start in an earlier document too.

Texts are dealt to chunks of some MB, bucketed once, so that all later steps join a
chunk's texts with small notes about it and shuffle no text again.

1. Every 50-byte string has an anchor, a gram chosen by its bytes alone, so equal
   strings have the same anchor at the same place. Chunks send the hashes of their
   anchors; hashes that occur once in the whole table are dropped.
2. Runs of strings whose anchor occurs elsewhere are sent with their bytes to the
   anchor's bucket. There their suffixes are sorted (see ``suffixes``): neighbours
   with 50 common bytes, verified, are equal strings, and the smallest document of
   each keeps its own. The buckets send back which strings others have to remove.
   The strings of an anchor that occurs very often are sent one by one, each to the
   bucket of its own hash and once from each chunk, so no bucket grows with a group.
3. Chunks mark the bytes that are covered and return what is left.

Equal whole texts are found by their digest first; only the one with the smallest id
takes part, the others are covered whole.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtrend.llm.common import keep, new_folder
from gridtrend.llm.suffixes import PAD, mixed, pack, planes, runs, suffix_sort, unpack, unplanes, word_offsets, words8

LENGTH = 50
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 3 << 20
CHUNKS_A_FILE = 4
#: Runs of one anchor above which its strings are sent one by one.
HOT = 256
NO_ID = (1 << 63) - 1
NOTE = "chunk int, kind string, a binary, b binary, c binary"
SENT = "bucket int, chunk int, hot boolean, hash binary, n binary, first binary, doc binary, row binary, place binary, text binary"


def as_table(rows: list[dict], schema: dict) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=pa.schema(list(schema.items())))


NOTE_TYPES = {"chunk": pa.int32(), "kind": pa.string(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
SENT_TYPES = {"bucket": pa.int32(), "chunk": pa.int32(), "hot": pa.bool_()} | {
    k: pa.binary() for k in ("hash", "n", "first", "doc", "row", "place", "text")
}


class Chunk:
    """The texts of a chunk, in the order of document and digest, with its notes."""

    def __init__(self, texts: pa.Table, notes: pa.Table):
        texts = texts.sort_by([("doc", "ascending"), ("digest", "ascending")])
        self.id = texts["id"].to_pylist()
        self.doc = texts["doc"].to_numpy()
        self.body = texts["body"].to_pylist()
        digest = texts["digest"].to_pylist()
        self.notes: dict[str, list[tuple]] = {}
        for kind, a, b, c in zip(*(notes[k].to_pylist() for k in ("kind", "a", "b", "c"))):
            self.notes.setdefault(kind, []).append((a, b, c))
        lowest = {a.decode(): int(b) for a, b, _ in self.notes.get("copy", ())}
        self.copy = self.doc > np.array([lowest.get(g, NO_ID) for g in digest], np.int64)
        self.bytes = b"".join([*self.body, bytes(4096)])
        self.text = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.cumsum([len(b) for b in self.body], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def runs(self, length: int) -> tuple[np.ndarray, ...]:
        """(first window, windows, anchor, hash, row) of rows that are not copies."""
        first, n, anchor, h = runs(self.text, self.ends, length)
        row = np.searchsorted(self.ends, first, "right")
        own = ~self.copy[row] if len(row) else np.zeros(0, bool)
        return first[own], n[own], anchor[own], h[own], row[own]

    def shared(self, length: int):
        """The runs whose anchor occurs elsewhere too, and whether it is a hot one."""
        found = self.runs(length)
        parts = self.notes.get("shared", [])
        known = np.concatenate([unpack(a) for a, _, _ in parts]) if parts else np.zeros(0, np.uint64)
        hot = np.concatenate([np.frombuffer(b, np.bool_) for _, b, _ in parts]) if parts else np.zeros(0, bool)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        if not len(known) or not len(found[0]):
            return tuple(x[:0] for x in found), np.zeros(0, bool)
        at = np.minimum(np.searchsorted(known, found[3]), len(known) - 1)
        is_in = known[at] == found[3]
        return tuple(x[is_in] for x in found), hot[at[is_in]]

    def strings(self, first: np.ndarray, n: np.ndarray, row: np.ndarray, length: int):
        """(place, row, hash) of every string of the runs."""
        place = np.repeat(first, n) + ramp(n)
        words = words8(self.text)
        out = np.zeros(len(place), np.uint64)
        for lo in range(0, len(place), 1 << 20):  # hashes of the strings only, part by part
            part = place[lo : lo + (1 << 20)]
            out[lo : lo + (1 << 20)] = hash_at(words, part, length)
        return place, np.repeat(row, n), out


def ramp(n: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, end to end."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def hash_at(words: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    offsets, drop = word_offsets(length)
    h = np.zeros(len(place), np.uint64)
    for o in offsets:
        h = mixed((h * np.uint64(0xFF51AFD7ED558CCD)) ^ (words[place + o] >> np.uint64(drop)))
    return h >> np.uint64(1)


def pieces(text: bytes, start: np.ndarray, n: np.ndarray) -> bytes:
    """The bytes of text[start : start + n], end to end, compressed."""
    joined = b"".join([text[a:b] for a, b in zip(start.tolist(), (start + n).tolist())])
    return pa.Codec("zstd", compression_level=1).compress(joined, asbytes=True)


def unpieced(sent: dict, length: int) -> bytes:
    strings = len(sent["hash"]) // 8
    size = strings * length if sent["hot"] else int(np.frombuffer(sent["n"], np.uint8).sum(dtype=np.int64)) + strings * (length - 1)
    return pa.Codec("zstd").decompress(sent["text"], size, asbytes=True)


def dealt(h: np.ndarray, buckets: int):
    """The places of hashes by their bucket: (bucket, places)."""
    bucket = mixed_bucket(h, buckets)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(bucket[order[lo]]), order[lo:hi]


def anchor_hashes(buckets: int, length: int):
    """Step 1, a chunk: its distinct anchor hashes and their counts, by bucket."""

    def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
        rows = []
        if len(texts):
            h, counts = np.unique(Chunk(texts, notes).runs(length)[3], return_counts=True)
            counts = np.minimum(counts, 65535).astype(np.uint16)
            chunk = texts["chunk"][0].as_py()
            for b, i in dealt(h, buckets):  # anchors have small hashes, so not by range
                rows.append({"bucket": b, "chunk": chunk, "hash": pack(h[i]), "n": counts[i].tobytes()})
        return as_table(rows, SENT_TYPES)

    return run


def shared_hashes(hot: int):
    """Step 1, a bucket: tells every chunk which of its anchors occur again."""

    def run(sent: pa.Table) -> pa.Table:
        hashes = [unpack(x) for x in sent["hash"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in sent["n"].to_pylist()]).astype(np.int64)
        every, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(which, counts, len(every)).astype(np.int64)
        rows, at = [], 0
        for chunk, h in zip(sent["chunk"].to_pylist(), hashes):
            n = total[which[at : at + len(h)]]
            at += len(h)
            again = n > 1
            if again.any():
                rows.append({"chunk": chunk, "kind": "shared", "a": pack(h[again]), "b": (n[again] > hot).tobytes()})
        return as_table(rows, NOTE_TYPES)

    return run


def shared_strings(buckets: int, length: int):
    """Step 2, a chunk: its runs with shared anchors, to the anchors' buckets."""

    def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(texts):
            return as_table([], SENT_TYPES)
        chunk, name, rows = Chunk(texts, notes), texts["chunk"][0].as_py(), []
        (first, n, anchor, h, row), hot = chunk.shared(length)
        cold = np.flatnonzero(~hot)
        for b, i in dealt(h[cold], buckets):
            i = cold[i]
            rows.append(
                {
                    "bucket": b,
                    "chunk": name,
                    "hot": False,
                    "hash": planes(h[i]),
                    "n": n[i].astype(np.uint8).tobytes(),
                    "first": (anchor[i] - first[i]).astype(np.uint8).tobytes(),
                    "doc": planes(chunk.doc[row[i]]),
                    "row": planes(row[i].astype(np.uint32)),
                    "place": planes((first[i] - chunk.starts[row[i]]).astype(np.uint64)),
                    "text": pieces(chunk.bytes, first[i], n[i] + length - 1),
                }
            )
        i = np.flatnonzero(hot)
        place, of, h = chunk.strings(first[i], n[i], row[i], length)
        order = np.lexsort((chunk.doc[of], h))
        lead = order[np.concatenate([[True], h[order][1:] != h[order][:-1]])] if len(order) else order
        for b, i in dealt(h[lead], buckets):
            i = lead[i]
            rows.append(
                {
                    "bucket": b,
                    "chunk": name,
                    "hot": True,
                    "hash": planes(h[i]),
                    "doc": planes(chunk.doc[of[i]]),
                    "text": pieces(chunk.bytes, place[i], np.full(len(i), length)),
                }
            )
        return as_table(rows, SENT_TYPES)

    return run


def mixed_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)


def sorted_strings(length: int):
    """Step 2, a bucket: sorts the suffixes of all runs and answers the chunks."""

    def run(sent: pa.Table) -> pa.Table:
        parts = sent.to_pylist()
        text = np.frombuffer(b"".join([*(unpieced(p, length) for p in parts), bytes(PAD)]), np.uint8)
        key, doc, n, anchor = [], [], [], []
        for p in parts:
            h = unplanes(p["hash"], np.uint64)
            if p["hot"]:
                key.append(h | np.uint64(1 << 63))
                n.append(np.ones(len(h), np.int64))
                anchor.append(np.zeros(len(h), np.int64))
            else:
                key.append(h)
                n.append(np.frombuffer(p["n"], np.uint8).astype(np.int64))
                anchor.append(np.frombuffer(p["first"], np.uint8).astype(np.int64))
            doc.append(unplanes(p["doc"], np.int64))
        edge = np.cumsum([0, *map(len, key)])
        key, doc, n, anchor = map(np.concatenate, (key, doc, n, anchor))
        begin = np.cumsum(n + length - 1) - (n + length - 1)
        # Only anchors of several documents have anything to remove.
        every, of = np.unique(key, return_inverse=True)
        low, high = np.full(len(every), NO_ID), np.full(len(every), -NO_ID - 1)
        np.minimum.at(low, of, doc)
        np.maximum.at(high, of, doc)
        used = np.flatnonzero((low < high)[of])
        if not len(used):
            return as_table([], NOTE_TYPES)
        doc, n, anchor, begin, of = doc[used], n[used], anchor[used], begin[used], of[used]
        item, window = np.repeat(np.arange(len(used)), n), ramp(n)
        group = (of[item] << 6) | (anchor[item] - window)
        order, same = suffix_sort(text, begin[item] + window, group.astype(np.uint64), length)
        heads = np.flatnonzero(~same)
        owner = doc[item[order]]
        least = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.append(heads, len(order))))
        gone = owner > least
        bits = np.zeros(len(order), np.uint64)
        bits[order[gone]] = 1
        mask = np.bitwise_or.reduceat(bits << window.astype(np.uint64), np.cumsum(n) - n)
        told = np.zeros(len(used), np.int64)
        told[item[order[gone]]] = least[gone]  # of a hot string, which is one window
        rows, edge = [], np.searchsorted(used, edge)
        first = np.concatenate([np.arange(len(p["hash"]) // 8) for p in parts])[used]
        for k, p in enumerate(parts):
            i = np.flatnonzero(mask[edge[k] : edge[k + 1]]) + edge[k]
            if not len(i):
                continue
            own = first[i]
            if p["hot"]:
                kept = {"kind": "hot", "a": planes(unplanes(p["hash"], np.uint64)[own]), "b": planes(told[i])}
            else:
                kept = {"kind": "cold", "a": planes(unplanes(p["row"], np.uint32)[own])}
                kept["b"] = planes(unplanes(p["place"], np.uint64)[own])
                kept["c"] = planes(mask[i])
            rows.append({"chunk": p["chunk"], **kept})
        return as_table(rows, NOTE_TYPES)

    return run


RESULT = "id long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary"
RESULT_TYPES = {
    "id": pa.int64(),
    "n_bytes": pa.int64(),
    "n_removed": pa.int64(),
    "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
    "kept": pa.binary(),
}


def remaining(length: int):
    """Step 3, a chunk: the covered bytes of each text, and what is left of it."""

    def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(texts):
            return as_table([], RESULT_TYPES)
        chunk, starts = Chunk(texts, notes), []
        for row, place, mask in chunk.notes.get("cold", ()):
            at = chunk.starts[unplanes(row, np.uint32)] + unplanes(place, np.uint64).astype(np.int64)
            mask = unplanes(mask, np.uint64)
            for j in range(int(np.bitwise_or.reduce(mask)).bit_length()):
                starts.append(at[(mask >> np.uint64(j)) & np.uint64(1) == 1] + j)
        (first, n, _, _, row), hot = chunk.shared(length) if any_hot(chunk) else ((*[None] * 5,), None)
        if hot is not None and hot.any():
            place, of, h = chunk.strings(first[hot], n[hot], row[hot], length)
            told = chunk.notes.get("hot", [])
            known = np.concatenate([h, *(unplanes(a, np.uint64) for a, _, _ in told)])
            doc = np.concatenate([chunk.doc[of], *(unplanes(b, np.int64) for _, b, _ in told)])
            order = np.lexsort((doc, known))
            heads = np.flatnonzero(np.concatenate([[True], known[order][1:] != known[order][:-1]]))
            least = np.empty(len(known), np.int64)
            least[order] = np.repeat(doc[order[heads]], np.diff(np.append(heads, len(order))))
            starts.append(place[chunk.doc[of] > least[: len(h)]])
        covered = np.zeros(len(chunk.text) - 4096, bool)
        for at in starts:
            covered[at] = True
        span = 1
        while span < length:  # a string's start marks its other bytes
            step = min(span, length - span)
            covered[step:] |= covered[:-step]
            span += step
        size = chunk.ends - chunk.starts
        for k in np.flatnonzero(chunk.copy & (size >= length)).tolist():
            covered[chunk.starts[k] : chunk.ends[k]] = True
        filled = size > 0
        first, last = covered.copy(), covered.copy()
        first[1:] &= ~covered[:-1]
        first[chunk.starts[filled]] = covered[chunk.starts[filled]]
        last[:-1] &= ~covered[1:]
        last[chunk.ends[filled] - 1] = covered[chunk.ends[filled] - 1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(chunk.ends, start, "right")
        removed = np.zeros(len(size), np.int64)
        np.add.at(removed, row, stop - start)
        pairs = [start - chunk.starts[row], stop - chunk.starts[row]]
        spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["start", "stop"])
        edges = np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)
        left = chunk.text[: len(covered)][~covered].tobytes()
        cut = np.concatenate([[0], np.cumsum(size - removed)]).tolist()
        columns = {
            "id": pa.array(chunk.id, pa.int64()),
            "n_bytes": pa.array(size),
            "n_removed": pa.array(removed),
            "spans": pa.ListArray.from_arrays(pa.array(edges), spans),
            "kept": [left[a:b] for a, b in zip(cut[:-1], cut[1:])],
        }
        return pa.table(columns, schema=pa.schema(list(RESULT_TYPES.items())))

    return run


def any_hot(chunk: Chunk) -> bool:
    return any(True in np.frombuffer(b, np.bool_) for _, b, _ in chunk.notes.get("shared", ()))


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    chunk_bytes: int = CHUNK_BYTES,
    hot: int = HOT,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, ``spans`` (start, stop of the
    maximal removed runs) and ``kept`` (the remaining bytes, concatenated).

    A byte goes if a string of ``length`` bytes that covers it, inside its text, also
    starts in a document with a smaller id. Strings are judged on the input. A null
    text is empty; texts shorter than ``length`` stay whole. Rows with one id do not
    remove each other's bytes. A null id is larger than any. An empty table gives an
    empty result. Other columns of ``docs`` play no part.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.md5(body).alias("digest"),
        body.alias("body"),
    )
    narrow = keep(rows.select("doc", "digest", F.octet_length("body").cast("long").alias("size")))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    chunks, buckets = math.ceil(total / chunk_bytes) or 1, math.ceil(total / BUCKET_BYTES) or 1
    files = math.ceil(chunks / CHUNKS_A_FILE)
    chunk: Column = F.pmod(F.xxhash64("doc", "digest"), F.lit(chunks)).cast("int").alias("chunk")
    lowest = narrow.groupBy("digest").agg(F.min("doc").alias("low"), F.count(F.lit(1)).alias("n"))
    # A chunk is told once of a text that has copies, so a large group makes no more
    # rows of its digest than there are chunks.
    held = narrow.groupBy(chunk, "digest").agg(F.max("doc").alias("high"))
    note = [F.col(c).cast("string").cast("binary").alias(a) for c, a in (("digest", "a"), ("low", "b"))]
    copies = keep(
        held.join(lowest.filter("n > 1"), "digest")
        .filter("high > low")
        .select("chunk", F.lit("copy").alias("kind"), *note, F.lit(None).cast("binary").alias("c"))
    )
    name = f"llm_chunks_{uuid.uuid4().hex}"
    writer = rows.withColumn("chunk", chunk).repartition(files, "chunk").write
    writer.bucketBy(files, "chunk").option("path", new_folder(spark)).saveAsTable(name)
    texts = spark.table(name).groupBy("chunk")

    def by_chunk(notes: DataFrame, step, schema: str) -> DataFrame:
        return texts.cogroup(notes.groupBy("chunk")).applyInArrow(step, schema)

    sent = by_chunk(copies, anchor_hashes(buckets, length), SENT)
    shared = keep(sent.groupBy("bucket").applyInArrow(shared_hashes(hot), NOTE))
    notes = copies.unionByName(shared)
    strings = by_chunk(notes, shared_strings(buckets, length), SENT)
    found = keep(strings.groupBy("bucket").applyInArrow(sorted_strings(length), NOTE))
    return by_chunk(notes.unionByName(found), remaining(length), RESULT).withColumnRenamed("id", id_column)
