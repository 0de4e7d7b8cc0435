"""Benchmark decontamination by item-sized SimHash windows.

Words are runs of letters, digits and underscores in lower case, so punctuation does
not hide a copy. A text is cut into shingles of five words. Only a window that shares
a shingle with an item can be similar to it at all, so windows are laid where a
shingle of the benchmark occurs, aligned with its place in the item and as long as
the item. Each window's fingerprint is looked up in a multi-index: 64 bits in eight
blocks, each item stored under every block value within two flips of its own, which
finds every item within 20 bits (20 flips leave two or fewer in some block). What is
found is verified by the exact similarity of the weighted shingle sets, the weight
being the count: sum of minima over sum of maxima.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
#: The benchmark is taken in blocks of so many bytes of text, each a pass over the documents.
BLOCK_BYTES = 4 << 20
WORD = re.compile(r"\w+")
MATCH = "array<struct<item_id: long, similarity: double, distance: int, at: int, n_words: int>>"


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str], size: int = SHINGLE) -> Counter:
    """Counted shingles; fewer words than a shingle are one shingle."""
    if not words:
        return Counter()
    if len(words) < size:
        return Counter([" ".join(words)])
    return Counter(map(" ".join, zip(*(words[k:] for k in range(size)))))


def weighted_simhash(counts: Counter) -> int:
    h = np.fromiter((xxhash.xxh64_intdigest(s) for s in counts), np.uint64, len(counts))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    weight = np.fromiter(counts.values(), np.int64, len(counts))
    return int(np.packbits(2 * (weight @ bits.astype(np.int64)) > weight.sum(), bitorder="little").view(np.uint64)[0])


def similarity(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


class Index:
    """A block of benchmark items, ready for lookup."""

    def __init__(self, items: list[tuple[int, str]], size: int = SHINGLE, radius: int = RADIUS):
        self.size, self.radius = size, radius
        kept = [(i, w) for i, w in ((i, tokens(t)) for i, t in items) if w]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        self.counts = [shingles(w, size) for w in self.words]
        self.prints = np.array([weighted_simhash(c) for c in self.counts], np.uint64)
        self.vocabulary: dict[str, int] = {}
        for w in self.words:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        # Occurrences of shingles: length of the shingle -> words' numbers -> (item, place).
        self.places: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for n, w in enumerate(self.words):
            numbers, k = [self.vocabulary[x] for x in w], min(size, len(w))
            for at in range(len(w) - k + 1):
                self.places[k][tuple(numbers[at : at + k])].append((n, at))
        self.codes = {k: np.unique(self.code(np.array(list(t), np.int64).reshape(-1, k).T)) for k, t in self.places.items()}
        self.places = {k: dict(t) for k, t in self.places.items()}
        width, flips = 64 // BLOCKS, radius // BLOCKS
        masks = [sum(1 << b for b in c) for f in range(flips + 1) for c in combinations(range(width), f)]
        self.table: list[dict[int, list[int]]] = []
        for b in range(BLOCKS):
            entries: dict[int, list[int]] = defaultdict(list)
            for n, p in enumerate(self.prints.tolist()):
                for m in masks:
                    entries[(p >> (b * width)) & ((1 << width) - 1) ^ m].append(n)
            self.table.append(dict(entries))

    @staticmethod
    def code(columns: np.ndarray) -> np.ndarray:
        """One number for each sequence of word numbers, given as k rows; the exact
        sequence is looked up afterwards."""
        out = np.zeros(columns.shape[1], np.uint64)
        for row in columns:
            out = out * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64) + np.uint64(1)
        return out

    def within(self, fingerprint: int) -> list[tuple[int, int]]:
        """(item, distance) of every item within the radius."""
        width = 64 // BLOCKS
        near = {
            n for b in range(BLOCKS) for n in self.table[b].get((fingerprint >> (b * width)) & ((1 << width) - 1), ())
        }
        found = ((n, (int(self.prints[n]) ^ fingerprint).bit_count()) for n in sorted(near))
        return [(n, d) for n, d in found if d <= self.radius]

    def windows(self, words: list[str]) -> set[tuple[int, int]]:
        """(start, length) of the windows that share a shingle with an item."""
        numbers = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        out = set()
        for k, codes in self.codes.items():
            if len(words) < k:
                continue
            rows = np.lib.stride_tricks.sliding_window_view(numbers, k)
            known = np.flatnonzero((rows >= 0).all(axis=1))
            if not len(known):
                continue
            found = self.code(rows[known].T)
            at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
            for p in known[codes[at] == found].tolist():
                for n, place in self.places[k].get(tuple(numbers[p : p + k].tolist()), ()):
                    start = max(0, p - place)
                    length = min(len(self.words[n]), len(words) - start)
                    out.add((start, length))
        return out

    def matches(self, text: str | None, least: float = SIMILARITY) -> list[dict]:
        """The best window of each item that a text holds, in item order."""
        words, best = tokens(text), {}
        for start, length in sorted(self.windows(words)) if words else ():
            counts = shingles(words[start : start + length], self.size)
            for n, d in self.within(weighted_simhash(counts)):
                s = similarity(counts, self.counts[n])
                if s >= least and s > best.get(n, (0.0,))[0]:
                    best[n] = (s, d, start, length)
        return [
            {"item_id": self.ids[n], "similarity": s, "distance": d, "at": at, "n_words": k}
            for n, (s, d, at, k) in sorted(best.items())
        ]


def indexes(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes of the benchmark, block by block: the rows pass through the driver as a
    stream, and never more of them than a block is held."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        held += len(r["text"])
        if held >= block_bytes:
            yield Index(block)
            block, held = [], 0
    if block:
        yield Index(block)


def searched(shared: Broadcast, text: Column) -> Column:
    @F.pandas_udf(MATCH)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.matches(t) for t in texts], dtype=object)

    return run(text)


def found_in(docs: DataFrame, text: str, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[Column]:
    """For each block of the benchmark, the matches of a text as a column."""
    context = docs.sparkSession.sparkContext
    return [searched(context.broadcast(i), F.col(text)) for i in indexes(benchmark, block_bytes)]


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The columns of ``docs`` but the text, and ``match`` (item_id, similarity,
    distance, at, n_words), a row for each document and item it holds.

    Documents that hold none have no row; nor have null, empty or wordless texts or
    items. An item of fewer than five words is one shingle and matches only itself.
    Repeated rows are searched each; equal items are all named. Without items, or
    without documents, the result is empty.
    """
    rest = [c for c in docs.columns if c != text]
    parts = [docs.select(*rest, F.explode(m).alias("match")) for m in found_in(docs, text, benchmark, block_bytes)]
    if not parts:
        none = F.lit(None).cast(MATCH)
        return docs.select(*rest, F.explode(none).alias("match"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, as they are."""
    for m in found_in(docs, text, benchmark):
        docs = docs.filter(F.size(m) == 0)
    return docs
