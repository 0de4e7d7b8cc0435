"""Nearest vectors by cosine, from randomly rotated one-bit codes.

A vector is brought to length 1, its center is subtracted, and what is left is rotated
by one random rotation and kept as its signs: one bit a component. Two scalars correct
the code: how long the remainder is and how far its signs point away from it. With them
the packed bits estimate inner products without bias, and the error is below a known
bound with high probability. Only vectors whose estimate plus bound reaches the score to
beat are ranked again, on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridtrend.llm.cells import even, placed, searched, usable

NEAREST = 5
#: Seed of the rotation; bits of a query's components; standard errors of the bound.
SEED, QUERY_BITS, ERRORS = 42, 6, 2.5
#: Estimates held at once.
ESTIMATES = 1 << 20
#: What rounding may take from a score that comes from other sums.
ROUNDING = 1e-9

CODE = StructType().add("code", "binary").add("left", "double").add("straight", "double").add("offset", "double")
FOUND = StructType().add("query", "long").add("id", "long").add("score", "double")


def rotation(dim: int) -> np.ndarray:
    """A random rotation that depends on the number of components only."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encoded(points: np.ndarray, centers: np.ndarray) -> dict[str, np.ndarray]:
    """Codes of points of length 1 around their centers: the signs of the rotated
    remainder packed in bytes, the remainder's length (``left``), the inner product of
    its direction with that of its signs (``straight``), and with the center."""
    rest = points - centers
    left = np.sqrt((rest * rest).sum(1))
    turned = (rest / np.where(left > 0, left, 1.0)[:, None]) @ rotation(points.shape[1]).T
    straight = np.abs(turned).sum(1) / np.sqrt(points.shape[1])
    width = -(-points.shape[1] // 64) * 8
    bits = np.zeros((len(points), width), np.uint8)
    packed = np.packbits(turned > 0, axis=1, bitorder="little")
    bits[:, : packed.shape[1]] = packed
    return {
        "code": np.array([b.tobytes() for b in bits], dtype=object),
        "left": left,
        "straight": np.where(left > 0, straight, 1.0),
        "offset": (rest * centers).sum(1),
    }


def planes(turned: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries as QUERY_BITS packed bit planes, with their least component and
    the step between levels."""
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / ((1 << QUERY_BITS) - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    out = np.zeros((QUERY_BITS, len(turned), words * 8), np.uint8)
    for b in range(QUERY_BITS):
        packed = np.packbits((level >> b) & 1, axis=1, bitorder="little")
        out[b, :, : packed.shape[1]] = packed
    return out.view(np.uint64), low, step


class Codes:
    """The codes of a part, and its vectors for the second ranking."""

    def __init__(self, table: pa.Table, x: np.ndarray, center: np.ndarray):
        self.x, self.center = even(x), center
        self.length = np.sqrt((self.x * self.x).sum(1))
        self.ids, self.rows = table["id"].to_numpy(), table["row"].to_numpy()
        joined = b"".join(table["code"].to_pylist())
        self.words = np.frombuffer(joined, np.uint64).reshape(len(x), -1)
        self.ones = np.bitwise_count(self.words).sum(1).astype(np.float64)
        self.left, self.offset = table["left"].to_numpy(), table["offset"].to_numpy()
        self.straight = table["straight"].to_numpy()
        self.spread = np.sqrt(np.maximum(0.0, 1 - self.straight**2)) / self.straight
        self.turn = rotation(x.shape[1])

    def estimates(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of each query (length 1) with each row, and the bound of its error."""
        dim = q.shape[1]
        rest = q - self.center
        away = np.sqrt((rest * rest).sum(1))
        turned = (rest / np.where(away > 0, away, 1.0)[:, None]) @ self.turn.T
        bits, low, step = planes(turned, self.words.shape[1])
        counted = np.zeros((len(q), len(self.words)))
        for b in range(QUERY_BITS):
            for w in range(self.words.shape[1]):
                both = np.bitwise_count(bits[b][:, w, None] & self.words[None, :, w])
                counted += both * float(1 << b)
        inside = low[:, None] * self.ones + step[:, None] * counted
        total = low * dim + step * np.rint((turned - low[:, None]) / step[:, None]).sum(1)
        signs = (2 * inside - total[:, None]) / np.sqrt(dim)
        reach = away[:, None] * self.left
        estimate = (q @ self.center)[:, None] + reach * signs / self.straight + self.offset
        rounded = step[:, None] / np.sqrt(12.0) / self.straight
        error = reach * ERRORS * (self.spread / np.sqrt(max(1, dim - 1)) + rounded)
        return estimate, error

    def cosine(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """On the original vectors, in doubles, summed in one order for every caller."""
        rows = self.x[at]
        return (rows * q).sum(1) / (self.length[at] * np.sqrt((q * q).sum()))

    def nearest(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> dict[str, np.ndarray]:
        q = even(q)
        unit = q / np.sqrt((q * q).sum(1))[:, None]
        who, ids, scores = [], [], []
        some = max(1, ESTIMATES // len(self.ids))
        for first in range(0, len(q), some):
            estimate, error = self.estimates(unit[first : first + some])
            for i, (e, d) in enumerate(zip(estimate, error), first):
                other = self.rows != own[i]
                e = np.where(other, e, -np.inf)
                tried = np.argpartition(-e, min(k, len(e) - 1))[: k + 1]
                tried = tried[other[tried]]
                sure = np.sort(self.cosine(q[i], tried))[::-1]
                beat = max(floor[i], sure[k - 1]) if len(sure) >= k else floor[i]
                at = np.flatnonzero(other & (e + d >= beat - ROUNDING))
                score = self.cosine(q[i], at)
                at, score = at[score >= beat - ROUNDING], score[score >= beat - ROUNDING]
                best = np.lexsort((self.ids[at], -score))[:k]
                who += [own[i]] * len(best)
                ids += self.ids[at[best]].tolist()
                scores += score[best].tolist()
        return {"query": np.array(who, np.int64), "id": np.array(ids, np.int64), "score": np.array(scores, np.float64)}


def nearest(rows: DataFrame, queries: Column, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``queries`` marks, the ``k``
    other rows of the largest cosine, nearest first, ties to the smaller id.

    ``rows`` has id (long) and vec (array of float or double). Every row is indexed; the
    centers come from a bounded sample. Vectors that are null, empty, zero or hold a null
    or non-finite component take no part, nor do rows without an id; only vectors of one
    length are compared. Every row is a row of its own: a repeated row finds its copies,
    and a repeated query is answered as often as it occurs. Fewer candidates than ``k``
    are all returned; a table without usable rows gives an empty result. The result is
    approximate where an estimate is off by more than its bound.
    """
    whole = rows.select("id", "vec").filter(
        F.col("id").isNotNull() & usable("vec") & F.exists("vec", lambda x: x != 0)
    )
    layout = placed(whole, "vec", "id", scaled=False, encode=(encoded, CODE))
    if layout is None:
        schema = "query_id long, rank int, vec_id long, score double"
        return rows.sparkSession.createDataFrame([], schema)

    def limits(sample, q, batch):
        low = np.full(len(q), -2.0)
        if sample is not None and len(sample["vec"]) > k:  # one of them may be the query
            x, q = even(sample["vec"]), even(q)
            cosine = (q / np.sqrt((q * q).sum(1))[:, None]) @ (x / np.sqrt((x * x).sum(1))[:, None]).T
            low = -np.partition(-cosine, k, axis=1)[:, k] - ROUNDING
        return low, np.full(len(q), 2.0)

    def answer(codes, batch, q):
        return codes.nearest(q, batch["query"].to_numpy(), batch["floor"].to_numpy(), k)

    asking = layout.rows.filter(queries).select(F.col("row").alias("query"), "vec")
    found = searched(layout, asking, "vec", limits, Codes, answer, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = layout.rows.filter(queries).select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return first.join(named, "query").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"
    )
