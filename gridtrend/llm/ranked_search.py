"""Ranked lexical search: short lists term at a time, long lists document at a time.

The documents are indexed in blocks: for every term of an item, the block's documents
that hold it and how often. A block is searched on its own. An item's short lists are
read term at a time into summed accumulators; these then count as one list more, with
their largest sum as its bound. That list and the long ones are read document at a time,
in windows of documents: lists whose bounds together stay below the score to beat name
no candidates, and are only sought in for candidates that they can still lift over it.
The best documents of the blocks are ranked together at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtrend.llm.common import keep

BEST = 10
#: Documents and postings of a block, documents of a window, and the share of a
#: block's documents up to which a list is short.
BLOCK_DOCS, BLOCK_POSTINGS, WINDOW, SHORT = 8_192, 1 << 21, 1_024, 32
#: Bytes of the items that are searched for in one pass over the documents.
ITEM_BYTES = 4 << 20
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20

_LETTERS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Bytes of terms, A-Z lower-cased; every other byte is a blank.
_TERMS = bytes((bytes([b]).lower()[0] if b in _LETTERS else 32) for b in range(256))

INDEX = (
    "n_docs long, n_terms long, terms array<int>, sizes array<int>, "
    "ids binary, named binary, lengths binary, docs binary, times binary"
)
FOUND = "item int, doc_id long, score long"


def counted(text: str) -> Counter:
    """How often a text holds each of its terms."""
    cleaned, out, first = text.encode("utf-8", "surrogatepass").translate(_TERMS), Counter(), 0
    while first < len(cleaned):
        last = cleaned.find(b" ", first + PIECE)
        last = len(cleaned) if last < 0 else last
        out.update(cleaned[first:last].split())
        first = last
    return out


def _block(number: dict[bytes, int], ids, named, lengths, terms, docs, times) -> dict:
    """The lists of a block in the order of their terms, each in that of its documents."""
    terms = np.array(terms, np.int32)
    order = np.argsort(terms, kind="stable")
    held, sizes = np.unique(terms, return_counts=True)
    return {
        "n_docs": sum(n > 0 for n in lengths),
        "n_terms": sum(lengths),
        "terms": held.tolist(),
        "sizes": sizes.tolist(),
        "ids": np.array(ids, np.int64).tobytes(),
        "named": np.array(named, np.bool_).tobytes(),
        "lengths": np.array(lengths, np.int64).tobytes(),
        "docs": np.array(docs, np.int32)[order].tobytes(),
        "times": np.array(times, np.int64)[order].tobytes(),
    }


def indexed(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """One row per block of documents; terms are known by their number."""
    schema = pa.schema([
        ("n_docs", pa.int64()), ("n_terms", pa.int64()),
        ("terms", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
        *[(c, pa.binary()) for c in ("ids", "named", "lengths", "docs", "times")],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ids, named, lengths, terms, at, times = [], [], [], [], [], []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                held = counted(text.as_py() or "")
                for term, n in held.items():
                    if term in number:
                        terms.append(number[term])
                        at.append(len(ids))
                        times.append(n)
                ids.append(doc_id or 0)
                named.append(doc_id is not None)
                lengths.append(held.total())
                if len(ids) >= BLOCK_DOCS or len(terms) >= BLOCK_POSTINGS:
                    yield pa.RecordBatch.from_pylist([_block(number, *parts)], schema)
                    for part in parts:
                        part.clear()
        if ids:
            yield pa.RecordBatch.from_pylist([_block(number, *parts)], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


class Best:
    """The best ``k`` documents so far: (score, unnamed, id)."""

    def __init__(self, k: int):
        self.k, self.rows, self.beat = k, [], 1

    def add(self, scores: np.ndarray, named: np.ndarray, ids: np.ndarray) -> None:
        new = zip(scores.tolist(), named.tolist(), ids.tolist())
        self.rows = sorted([*self.rows, *new], key=lambda r: (-r[0], not r[1], r[2]))[: self.k]
        if len(self.rows) == self.k:
            self.beat = max(1, self.rows[-1][0])


class Block:
    """A block's lists with the worth of every posting (its score but for the weight)."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.named = np.frombuffer(row["named"], np.bool_)
        self.docs = np.frombuffer(row["docs"], np.int32).astype(np.int64)
        times = np.frombuffer(row["times"], np.int64)
        lengths = np.frombuffer(row["lengths"], np.int64)
        m = 100 - 75 + (75 * lengths * n_docs) // n_terms
        self.worth = (1_000_000_000 * times) // (1_000 * times + 8 * m[self.docs])
        ends = np.cumsum(row["sizes"])
        self.lists = {t: (e - s, e) for t, s, e in zip(row["terms"], row["sizes"], ends.tolist())}
        starts = ends - row["sizes"]
        self.most = dict(zip(row["terms"], np.maximum.reduceat(self.worth, starts).tolist())) if len(starts) else {}
        self.edges = np.arange(0, len(self.ids) + WINDOW, WINDOW)

    def search(self, wanted: list[tuple[int, int]], best: Best) -> None:
        """Enter the block's documents for an item, (term, weight) each, into ``best``."""
        short, lists = [], []
        for term, weight in wanted:
            if term in self.lists and weight:
                first, last = self.lists[term]
                if (last - first) * SHORT <= len(self.ids):
                    short.append((first, last, weight))
                else:
                    lists.append((self.most[term] * weight, self.docs[first:last], self.worth[first:last], weight))
        if short:
            lists.append(self._accumulated(short))
        lists.sort(key=lambda x: x[0])
        upto = np.cumsum([x[0] for x in lists])
        if not lists or upto[-1] < best.beat:
            return
        cuts = [np.searchsorted(docs, self.edges) for _, docs, _, _ in lists]
        for k in range(len(self.edges) - 1):
            self._window(k, lists, upto, cuts, best)

    def _accumulated(self, short: list[tuple[int, int, int]]) -> tuple:
        """The short lists, read term at a time, as one list of sums."""
        docs = np.concatenate([self.docs[a:b] for a, b, _ in short])
        worth = np.concatenate([self.worth[a:b] * w for a, b, w in short])
        held, place = np.unique(docs, return_inverse=True)
        sums = np.zeros(len(held), np.int64)
        np.add.at(sums, place, worth)
        return int(sums.max()), held, sums, 1

    def _window(self, k: int, lists: list, upto: np.ndarray, cuts: list, best: Best) -> None:
        """The documents of a window. ``upto`` holds the summed bounds of the lists."""
        low = int(self.edges[k])
        naming = int(np.searchsorted(upto, best.beat))  # the lists before it name none
        if naming == len(lists):
            return
        scores = np.zeros(WINDOW, np.int64)
        for (_, docs, worth, weight), cut in zip(lists[naming:], cuts[naming:]):
            a, b = cut[k], cut[k + 1]
            scores[docs[a:b] - low] += worth[a:b] * weight
        found = np.flatnonzero(scores)
        scores = scores[found]
        for j in range(naming - 1, -1, -1):
            hope = scores + upto[j] >= best.beat
            found, scores = found[hope], scores[hope]
            if not len(found):
                return
            _, docs, worth, weight = lists[j]
            a, b = cuts[j][k], cuts[j][k + 1]
            at = a + np.searchsorted(docs[a:b], found + low)
            hit = at < b
            hit[hit] = docs[at[hit]] == found[hit] + low
            scores[hit] += worth[at[hit]] * weight
        good = scores >= best.beat
        if good.any():
            at = found[good] + low
            best.add(scores[good], self.named[at], self.ids[at])


def _pass(docs: DataFrame, items: list[Counter], k: int) -> DataFrame:
    """(item, doc_id, score) of the best documents of every task, for some items."""
    number = {t: i for i, t in enumerate(sorted(set().union(*items)))}
    index = keep(indexed(docs, number))
    whole = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = whole["docs"] or 0, whole["terms"] or 0
    lists = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("l"))
    held = lists.groupBy(F.col("l.terms").alias("term")).agg(F.sum("l.sizes").alias("df")).collect()
    weight = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in held}
    wanted = [[(number[t], c * weight.get(number[t], 0)) for t, c in item.items()] for item in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in wanted]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, n_docs, max(1, n_terms))
                for item, so_far in zip(wanted, best):
                    block.search(item, so_far)
        rows = [(i, d if named else None, s) for i, b in enumerate(best) for s, named, d in b.rows]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                ["item", "doc_id", "score"],
            )

    return index.mapInArrow(run, FOUND)


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item.

    ``docs`` has doc_id and text, ``items`` item_id and text. The result is exact. Null
    and empty texts have no terms: such a document is not counted, such an item has no
    row. Documents of equal score are in the order of their ids, null ids last; repeated
    rows are documents of their own. Equal items are answered once; one item_id with
    several texts is answered for each. Empty tables give an empty result.

    The items' terms go to every task; items of more than ITEM_BYTES bytes are dealt by
    hash over several passes, so what a task holds does not grow with them.
    """
    items = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    passes = max(1, -(-size // ITEM_BYTES))
    spark, found = docs.sparkSession, None
    for p in range(passes):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()
        counts = [counted(r["text"]) for r in some]
        names = spark.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(some)],
            f"item int, item_id {items.schema['item_id'].dataType.simpleString()}",
        )
        best = _pass(docs, counts, k) if some else spark.createDataFrame([], FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
