"""Toxicity by a convolutional text classifier, trained in numpy.

A word has three hashed embeddings, side by side: of the word, of its first five and of
its first four letters, which inflected forms and derived words share. Filters of several widths run over the words, each filter's largest
response in the text is kept, and a dense layer makes a probability. Training starts
from embeddings whose first coordinate is the word's log odds in the training texts.
The probability is calibrated, and a threshold chosen for each language, on training
rows that were set aside.

All labelled rows take part. Those that train lie in shards of some MB of text. In an
epoch every shard goes on from the shared network, and the changes of the shards are
averaged: of an embedding over the shards that changed it, of all else over all shards.
"""

from __future__ import annotations

import copy
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from gridtrend.llm.common import new_folder

#: Bytes of labelled text in a shard, about; a task holds a shard's word buckets.
SHARD_BYTES = 12 << 20
BUCKET_BITS = 17
HALF = 8
PARTS = 3
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
BATCH = 32
CALIBRATION = 5
WORD = re.compile(r"\w+")
PART = 1 << 15
#: Words whose buckets a process remembers, and letters of such a word.
KNOWN, KNOWN_LETTERS = 200_000, 40
#: Changes are summed as whole multiples of 1 / UNIT, so their order does not matter.
UNIT = float(1 << 44)
#: Logits are counted by so many bins a unit, up to BIN_END at both sides.
BINS, BIN_END = 1024, 64
SLOT = "slot long, " + ", ".join(f"v{j} long" for j in range(HALF + 1))


class Buckets(dict):
    """The buckets of a word's parts, side by side in one number."""

    def __missing__(self, word: str) -> int:
        code, most = xxhash.xxh32_intdigest, (1 << BUCKET_BITS) - 1
        out = code(word, 0) % most + 1
        for k in range(1, PARTS):
            out |= (code(word[: 6 - k], k) % most + 1) << (k * BUCKET_BITS)
        if len(word) <= KNOWN_LETTERS:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = out
        return out


_BUCKETS = Buckets()


def word_buckets(text: str | None) -> np.ndarray:
    """A bucket for each part of every word of a text, (n, PARTS); 0 is for padding."""
    words = WORD.findall(text.lower().replace("_", " ")) if text else ()
    every = np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words))
    shift = np.arange(PARTS, dtype=np.int64) * BUCKET_BITS
    return ((every[:, None] >> shift) & ((1 << BUCKET_BITS) - 1)).astype(np.int32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.tables = [r.normal(0, 0.05, (1 << BUCKET_BITS, HALF)).astype(np.float32) for _ in range(PARTS)]
        for t in self.tables:
            t[0] = 0
        self.filters = [r.normal(0, 0.2, (w, PARTS * HALF, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = r.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.scale, self.offset = 1.0, 0.0
        self.thresholds: dict[str | None, float] = {}
        slots = self.slots()
        self.first, self.second = [np.zeros_like(s) for s in slots], [np.zeros_like(s) for s in slots]
        self.squares = [np.full(len(t), 1e-6, np.float32) for t in self.tables]
        self.step = 0

    def slots(self) -> list[np.ndarray]:
        return [*self.filters, *self.shift, self.dense]

    def words(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([t.take(ids[:, k], axis=0) for k, t in enumerate(self.tables)], axis=1)

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter, and where; texts are padded at the end and
        taken in parts that overlap by a filter's width."""
        widest = max(WIDTHS)
        ids = np.concatenate([ids, np.zeros((widest, PARTS), np.int32)])
        top = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        where = np.zeros(len(top), np.int64)
        n = len(ids) - widest
        rows = np.concatenate([f[k].T for f in self.filters for k in range(len(f))])
        for at in range(0, max(n, 1), PART):
            answers = rows @ self.words(ids[at : at + PART + widest - 1]).T
            here = max(1, min(PART, n - at))
            row = 0
            for i, f in enumerate(self.filters):
                z = answers[row : row + FILTERS, :here] + self.shift[i][:, None]
                for k in range(1, len(f)):
                    z += answers[row + k * FILTERS : row + (k + 1) * FILTERS, k : here + k]
                row += len(f) * FILTERS
                p = z.argmax(axis=1)
                s = slice(i * FILTERS, (i + 1) * FILTERS)
                best = z[np.arange(FILTERS), p]
                better = best > top[s]
                top[s] = np.where(better, best, top[s])
                where[s] = np.where(better, p + at, where[s])
        return top, where

    def raw(self, ids: np.ndarray) -> float:
        return float(np.maximum(self.pooled(ids)[0], 0) @ self.dense + self.bias[0])

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.scale * self.raw(word_buckets(text)) + self.offset))

    # Training

    def start(self, found: list[np.ndarray], hits: np.ndarray) -> None:
        """Log odds of each bucket, by texts that hold it, as its first coordinate.
        ``found`` has the texts of each class with a bucket, ``hits`` all texts."""
        hits = np.maximum(hits, 1)
        for t, n in zip(self.tables, found):
            odds = np.log((n[1] + 1) / (hits[1] + 2)) - np.log((n[0] + 1) / (hits[0] + 2))
            none = np.log(hits[0] + 2) - np.log(hits[1] + 2)  # of a bucket never seen
            t[:, 0] = np.where(n.sum(axis=0) > 0, (odds - none) / 8, 0)
            t[0] = 0
        for f in self.filters:
            f[:, ::HALF, :] += 1.0 / len(f)
        for s in self.shift:
            s -= 0.2
        self.dense = np.abs(self.dense)

    def epoch(self, texts: list[np.ndarray], labels: np.ndarray, seed) -> None:
        """One pass over the texts, from the state that the last pass has left."""
        order, rate = np.random.default_rng(seed).permutation(len(texts)), 0.01
        end = np.zeros((max(WIDTHS), PARTS), np.int32)
        for at in range(0, len(order), BATCH):
            batch = [np.concatenate([texts[i], end]) for i in order[at : at + BATCH]]
            found = [self.pooled(texts[i]) for i in order[at : at + BATCH]]
            top, where = np.stack([t for t, _ in found]), np.stack([w for _, w in found])
            base = np.cumsum([0, *(len(t) for t in batch[:-1])])
            ids, hidden = np.concatenate(batch), np.maximum(top, 0)
            logit = hidden @ self.dense + self.bias[0]
            d = ((sigmoid(logit) - labels[order[at : at + BATCH]]) / len(batch)).astype(np.float32)
            slots = self.slots()
            grads, which, by = [np.zeros_like(s) for s in slots], [], []
            grads[-1] += d @ hidden
            back = d[:, None] * self.dense * (top > 0)
            for j, f in enumerate(self.filters):
                s = slice(j * FILTERS, (j + 1) * FILTERS)
                grads[len(self.filters) + j] += back[:, s].sum(axis=0)
                text, part = np.nonzero(back[:, s])
                pull = back[:, s][text, part][:, None]
                for k in range(len(f)):
                    at_word = ids[base[text] + where[:, s][text, part] + k]
                    np.add.at(grads[j][k].T, part, self.words(at_word) * pull)
                    which.append(at_word)
                    by.append(f[k].T[part] * pull)
            self.step += 1
            self.bias -= np.float32(rate * d.sum())
            for s, g, m, v in zip(slots, grads, self.first, self.second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                s -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
            which, by = np.concatenate(which), np.concatenate(by)
            for k, t in enumerate(self.tables):
                used, to = np.unique(which[:, k], return_inverse=True)
                g = np.zeros((len(used), HALF), np.float32)
                np.add.at(g, to, by[:, k * HALF : (k + 1) * HALF])
                self.squares[k][used] += (g * g).mean(axis=1)
                t[used] -= 0.02 * g / np.sqrt(self.squares[k][used])[:, None]
                t[0] = 0

    def state(self) -> list[np.ndarray]:
        return [*self.slots(), self.bias, *self.first, *self.second]

    def changes(self, before: Network) -> tuple[np.ndarray, np.ndarray]:
        """(slot, values in UNITs): a slot is an embedding with its sum of squares, or a
        piece of all else."""
        slots, values = [], []
        for k, (t, q) in enumerate(zip(self.tables, self.squares)):
            used = np.flatnonzero((q != before.squares[k]) | (t != before.tables[k]).any(axis=1))
            slots.append((k << BUCKET_BITS) + used)
            now, then = np.column_stack([t, q])[used], np.column_stack([before.tables[k], before.squares[k]])[used]
            values.append(now.astype(np.float64) - then)
        flat = np.concatenate([(a.astype(np.float64) - b).ravel() for a, b in zip(self.state(), before.state())])
        flat = np.concatenate([flat, np.zeros(-len(flat) % (HALF + 1))]).reshape(-1, HALF + 1)
        slots.append((PARTS << BUCKET_BITS) + np.arange(len(flat)))
        values.append(flat)
        return np.concatenate(slots), np.rint(np.concatenate(values) * UNIT).astype(np.int64)

    def move(self, slots: np.ndarray, values: np.ndarray) -> None:
        """Add changes, one for each slot."""
        order = np.argsort(slots)
        slots, values = slots[order], values[order]
        for k, (t, q) in enumerate(zip(self.tables, self.squares)):
            mine = slots >> BUCKET_BITS == k
            used = slots[mine] & ((1 << BUCKET_BITS) - 1)
            t[used] += values[mine, :HALF]
            q[used] += values[mine, HALF]
        flat, at = values[slots >= PARTS << BUCKET_BITS].ravel(), 0
        for a in self.state():
            a += flat[at : at + a.size].reshape(a.shape)
            at += a.size

    def calibrate(self, x: np.ndarray, labels: np.ndarray, langs: np.ndarray, n: np.ndarray) -> None:
        """Scale and offset of the logit by Newton steps towards slightly softened
        labels, then for each language, and for all (None), the threshold with the
        best F1. A logit ``x`` of a label and language occurs ``n`` times."""
        a, b = 1.0, 0.0
        n1, n0 = (n * labels).sum(), (n * (1 - labels)).sum()
        target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(50 if n1 and n0 else 0):
            p = sigmoid(a * x + b)
            w = n * np.maximum(p * (1 - p), 1e-9)
            g = np.array([(n * (p - target) * x).sum() + 1e-3 * (a - 1), (n * (p - target)).sum()])
            h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
            move = np.linalg.solve(h + 1e-9 * np.eye(2), g)
            a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
        self.scale, self.offset = max(float(a), 1e-3), float(b)
        p = sigmoid(self.scale * x + self.offset)
        groups = {None: np.arange(len(x))} | {l: np.flatnonzero(langs == l) for l in set(langs) - {None}}
        for l, i in groups.items():
            ones, every = n[i] * labels[i], n[i]
            cuts = np.unique(np.round(p[i], 3))
            f1 = [(2 * ones[up].sum() / max(1, ones.sum() + every[up].sum()), -c) for c in cuts for up in (p[i] >= c,)]
            self.thresholds[l] = -max(f1)[1] if f1 and ones.sum() >= 10 else self.thresholds.get(None, 0.5)


class Constant:
    """What is known without both classes: the share of class 1."""

    def __init__(self, share: float):
        self.share, self.thresholds = share, {None: 0.5}

    def score(self, text: str | None) -> float:
        return self.share


@F.pandas_udf(BinaryType())
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([word_buckets(t).tobytes() for t in texts], dtype=object)


def by_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(shard, texts, labels) of rows that lie shard after shard."""
    shard, texts, labels = None, [], []
    for batch in batches:
        for s, y, b in zip(*(batch.column(c) for c in ("shard", "y", "ids"))):
            if texts and s.as_py() != shard:
                yield shard, texts, np.array(labels, np.int64)
                texts, labels = [], []
            shard = s.as_py()
            labels.append(y.as_py())
            texts.append(np.frombuffer(b.as_py(), np.int32).reshape(-1, PARTS))
    if texts:
        yield shard, texts, np.array(labels, np.int64)


def found_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class hold a bucket, by shard."""
    for _, texts, labels in by_shard(batches):
        n = np.zeros((2, PARTS << BUCKET_BITS), np.int64)
        for ids, y in zip(texts, labels):
            n[y, np.unique(ids + (np.arange(PARTS, dtype=np.int32) << BUCKET_BITS))] += 1
        slot = np.flatnonzero(n.any(axis=0))
        yield pa.record_batch([pa.array(slot), *(pa.array(c[slot]) for c in n)], ["slot", "n0", "n1"])


def shard_epoch(shared, epoch: int, seed: int = 11):
    """An epoch on each shard: the changes of the shared network there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, texts, labels in by_shard(batches):
            model = copy.deepcopy(shared.value)
            model.epoch(texts, labels, [seed, epoch, shard])
            slots, values = model.changes(shared.value)
            names = [f"v{j}" for j in range(HALF + 1)]
            yield pa.record_batch([pa.array(slots), *map(pa.array, values.T.copy())], ["slot", *names])

    return run


def learned(docs: DataFrame, labels: DataFrame, label: str = "toxic"):
    """A classifier of the rows of ``docs`` (doc_id, text, lang) that ``labels``
    (doc_id and the label 0 or 1) name; all of them take part.

    Several labels of an id count as 1 if one is. About every fifth row calibrates, by
    a hash of its id, the others train. The driver holds the network and counts by
    bucket and by logit, whose number does not grow with the rows. With one class or
    none the score is constant.
    """
    spark = docs.sparkSession
    one = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .hint("merge")  # the labels grow with the texts
    )
    aside = F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(CALIBRATION)) == CALIBRATION - 1
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    counted = sizes.join(one, "doc_id").groupBy("y", aside.alias("aside"))
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    hits = {split: np.array([sum(r["n"] for r in counted if r["y"] == y and r["aside"] in split) for y in (0, 1)])
            for split in ((False,), (True,), (False, True))}
    if not hits[False, True].all():
        counts = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
        whole = sum(counts.values())
        return Constant(counts.get(1, 0) / whole if whole else 0.0)
    parted = bool(hits[False,].all() and hits[True,].all())
    shards = math.ceil(sum(r["size"] for r in counted) / SHARD_BYTES) or 1
    rows = (
        docs.select("doc_id", "text", "lang")
        .join(one, "doc_id")
        .withColumn("aside", aside & F.lit(parted))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int"))
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "doc_id", F.xxhash64("text"))
        .select("shard", "aside", "y", "lang", _features("text").alias("ids"))
    )
    path = new_folder(spark)
    rows.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    train = table.filter("NOT aside").select("shard", "y", "ids")
    hit = hits[False,] if parted else hits[False, True]

    counts = train.mapInArrow(found_buckets, "slot long, n0 long, n1 long").groupBy("slot")
    counts = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    found = np.zeros((2, PARTS << BUCKET_BITS))
    found[:, counts["slot"].to_numpy()] = [counts["n0"].to_numpy(), counts["n1"].to_numpy()]
    model = Network()
    model.start(np.split(found, PARTS, axis=1), hit)
    names = [f"v{j}" for j in range(HALF + 1)]
    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast(model)
        sums = train.mapInArrow(shard_epoch(shared, epoch), SLOT).groupBy("slot")
        sums = sums.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
        shared.destroy()
        model = copy.deepcopy(model)
        values = np.column_stack([sums[c].to_numpy() for c in names]) / UNIT
        model.move(sums["slot"].to_numpy(), values / sums["n"].to_numpy()[:, None])
        model.step += math.ceil(hit.sum() / shards / BATCH)
    model.first, model.second, model.squares = [], [], []  # of use in training only

    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def logit(ids: pd.Series) -> pd.Series:
        return pd.Series([shared.value.raw(np.frombuffer(b, np.int32).reshape(-1, PARTS)) for b in ids], dtype=float)

    judged = table.filter("aside") if parted else table
    place = F.round(F.greatest(F.lit(-BIN_END), F.least(F.lit(BIN_END), logit("ids"))) * BINS).cast("int")
    bins = judged.select("y", "lang", place.alias("bin")).groupBy("y", "lang", "bin").count().sort("y", "lang", "bin").toArrow()
    shared.destroy()
    langs = np.array(bins["lang"].to_pylist(), object)
    model.calibrate(bins["bin"].to_numpy() / BINS, bins["y"].to_numpy().astype(np.int64), langs, bins["count"].to_numpy())
    return model


def scored(docs: DataFrame, model, text: str = "text") -> Column:
    """Probability of class 1 from the text alone; an empty or null text has the score
    of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return run(F.col(text))


def flagged(score: Column, lang: Column, model) -> Column:
    """Whether a score reaches the threshold of its language; languages without one
    of their own, and null, have the threshold of all."""
    limit = F.lit(model.thresholds[None])
    for l, t in model.thresholds.items():
        if l is not None:
            limit = F.when(lang == l, F.lit(t)).otherwise(limit)
    return score >= limit
