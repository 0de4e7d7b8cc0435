"""Hard negatives: the best-scoring rows of other labels within a window of scores.

Scores are inner products. Every candidate gets one more component that brings it to
the largest length, so all lie on a sphere, where an inner product with a query is a
cosine and a cover tree bounds it: a node covers what lies within its radius, and radii
halve from level to level. A query descends best bound first, leaves out the nodes whose
bounds lie outside its windows of scores, and computes the scores of the rows it reaches.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridtrend.llm.cells import SLACK, angles, placed, searched, sphere, usable
from gridtrend.llm.common import keep

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
LEAST, MOST = 50, 95
#: Rows of one tree, and members up to which a node is a leaf.
TREE, LEAF = 2_048, 16
#: Largest component: a hundred times the sum of 4 096 products still fits a long.
LIMIT = 1 << 21
#: No score reaches it.
EVERY = 1 << 61


def scaled(vector: str, by: int = 256) -> Column:
    """floor(by * x) of every component, as int; beyond LIMIT it counts as LIMIT. Null
    for a vector that takes no part (see ``usable``)."""

    def whole(x: Column) -> Column:
        y = F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(by) * x.cast("double"))))
        return y.cast("int")

    return F.when(usable(vector), F.transform(vector, whole))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while these hold them, else in longs."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] < 2**53:
        return (x @ q).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


class CoverTree:
    """Rows ``first`` to ``last`` of a part. A node has a row as its center, the largest
    angle to a row below it, and its children, whose centers lie within it. Its own
    center may be the first of them (``again`` 1), to cover what is near more closely."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, first: int):
        self.kids, self.radius, self.label, self.again = [], [], [], []
        self.root = first
        apart = angles(points, points)
        open_ = [(0, np.arange(1, len(points)), None)]
        while open_:
            center, members, parent = open_.pop()
            node = len(self.kids)
            if parent is not None:
                self.kids[parent[0]][1][parent[1]] = node
            radius = apart[center, members].max(initial=0.0)
            self.radius.append(radius)
            own = labels[first + np.append(members, center)]
            self.label.append(own[0] if (own == own[0]).all() else None)
            if len(members) <= LEAF or radius <= SLACK:
                self.kids.append((first + members, np.full(len(members), -1)))
                self.again.append(0)
                continue
            centers, groups = [], []
            rest = np.append(center, members)
            while len(rest):
                near = apart[rest[0], rest] <= radius / 2
                near[0] = True
                centers.append(rest[0])
                groups.append(rest[near][1:])
                rest = rest[~near]
            self.again.append(min(1, len(groups[0])))
            if not len(groups[0]):  # the center covers nobody more closely
                centers, groups = centers[1:], groups[1:]
            self.kids.append((first + np.array(centers), np.full(len(centers), -1)))
            open_ += [(c, g, (node, k)) for k, (c, g) in enumerate(zip(centers, groups)) if len(g)]


class Forest:
    """Cover trees over the candidates of a part, in runs of TREE rows."""

    def __init__(self, table: pa.Table, x: np.ndarray, scale: float):
        self.x, self.scale = x, scale
        self.ids, self.rows = table["id"].to_numpy(), table["row"].to_numpy()
        self.labels = table["label"].to_numpy()
        points = sphere(x, scale)
        self.trees = [
            CoverTree(points[k : k + TREE], self.labels, k) for k in range(0, len(x), TREE)
        ]

    def descend(self, q: np.ndarray, wanted: Wanted) -> None:
        """Offer every row that ``wanted`` may take."""
        length = float(np.sqrt(q @ q)) * self.scale
        edge = SLACK * (1 + length)
        queue = []
        for t, tree in enumerate(self.trees):
            root = np.array([tree.root])
            score = products(self.x[root], q)
            wanted.offer(score, root)
            self._push(queue, t, root * 0, score, length, edge, wanted)
        while queue and -queue[0][0] >= wanted.low:
            _, t, node = heapq.heappop(queue)
            tree = self.trees[t]
            rows, nodes = tree.kids[node]
            score = products(self.x[rows], q)
            wanted.offer(score[tree.again[node] :], rows[tree.again[node] :])
            inner = nodes >= 0
            if inner.any():
                self._push(queue, t, nodes[inner], score[inner], length, edge, wanted)

    def _push(self, queue, t, nodes, score, length, edge, wanted) -> None:
        away = np.arccos(np.clip(score / length, -1.0, 1.0)) if length else np.full(len(nodes), np.pi / 2)
        radius = np.array([self.trees[t].radius[n] for n in nodes])
        top = length * np.cos(np.maximum(0.0, away - radius - SLACK)) + edge
        bottom = length * np.cos(np.minimum(np.pi, away + radius + SLACK)) - edge
        for k in np.flatnonzero((top >= wanted.low) & (bottom <= wanted.high)):
            label = self.trees[t].label[nodes[k]]
            if label is None or (label == wanted.label) == wanted.same:
                heapq.heappush(queue, (-top[k], t, int(nodes[k])))


class Wanted:
    """The ``k`` first rows of each window of scores, of the query's label or of other
    labels. ``low`` and ``high`` bound the scores that could still enter one."""

    def __init__(self, forest: Forest, row: int, label: int, same: bool, k: int, low, high):
        self.forest, self.row, self.label, self.same, self.k = forest, row, label, same, k
        self.lows, self.highs = list(low), list(high)
        none = np.empty(0, np.int64)
        self.found = [(none, none)] * len(self.lows)
        self.low, self.high = min(self.lows, default=np.inf), max(self.highs, default=-np.inf)

    def offer(self, score: np.ndarray, at: np.ndarray) -> None:
        fits = (score >= self.low) & (score <= self.high)
        fits &= (self.forest.labels[at] == self.label) == self.same
        fits &= self.forest.rows[at] != self.row
        if not fits.any():
            return
        score, at = score[fits], at[fits]
        for j, (low, high) in enumerate(zip(self.lows, self.highs)):
            inside = (score >= low) & (score <= high)
            if inside.any():
                s = np.append(self.found[j][0], score[inside])
                a = np.append(self.found[j][1], at[inside])
                first = np.lexsort((self.forest.ids[a], -s))[: self.k]
                self.found[j] = s[first], a[first]
                if len(first) == self.k:
                    self.lows[j] = max(low, s[first[-1]])
        self.low = min(self.lows)


def _answered(forest: Forest, batch: pa.RecordBatch, q: np.ndarray, same: bool, k: int) -> dict:
    lows, highs = batch["low"].to_pylist(), batch["high"].to_pylist()
    out = {"anchor": [], "window": [], "id": [], "score": []}
    for i, (row, label) in enumerate(zip(batch["anchor"].to_pylist(), batch["label"].to_pylist())):
        wanted = Wanted(forest, row, label, same, k, lows[i], highs[i])
        forest.descend(q[i], wanted)
        for j, (score, at) in enumerate(wanted.found):
            out["anchor"] += [row] * len(at)
            out["window"] += [j] * len(at)
            out["id"] += forest.ids[at].tolist()
            out["score"] += score.tolist()
    kinds = {"anchor": np.int64, "window": np.int32, "id": np.int64, "score": np.int64}
    return {c: np.array(v, kinds[c]) for c, v in out.items()}


FOUND = StructType().add("anchor", "long").add("window", "integer").add("id", "long").add("score", "long")


def _search(layout, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows (anchor, window, id, score, rank) in each window."""
    scale = layout.scale

    def limits(sample, q, batch):
        """A row that is not in a window's first ``k`` of the sample is not wanted."""
        low, high = np.empty(len(q)), np.empty(len(q))
        labels = batch["label"].to_pylist()
        score = products(sample["vec"], q.T) if sample is not None else None
        for i, (lows, highs) in enumerate(zip(batch["low"].to_pylist(), batch["high"].to_pylist())):
            if score is not None:
                fits = np.sort(score[(sample["label"] == labels[i]) == same, i])[::-1]
                for j in range(len(lows)):
                    inside = fits[(fits >= lows[j]) & (fits <= highs[j])]
                    if len(inside) > k:  # one of them may be the query itself
                        lows[j] = max(lows[j], inside[k])
            low[i], high[i] = min(lows, default=np.inf), max(highs, default=-np.inf)
        return low, high

    def answer(forest, batch, q):
        return _answered(forest, batch, q, same, k)

    found = searched(layout, queries, "vec", limits, lambda t, x, _: Forest(t, x, scale), answer, FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has id (long), label (long) and vec (array of int); ``anchors`` tells which
    rows are queries. An anchor's positives are its best other rows of the same label.
    For each, the first ``negatives`` rows of other labels with a score between ``least``
    and ``most`` hundredths of the positive's are returned; higher scores come first,
    ties by smaller id.

    Rows with a null id, label, vector or component, or an empty vector, take no part;
    only vectors of one length are compared. Every row is a row of its own: repeated rows
    are each other's positives, and a repeated anchor is answered as often as it occurs.
    An anchor without positives, or a positive without negatives in its window, gives no
    row; a table without usable rows gives an empty result.
    """
    whole = rows.select("id", F.col("label").cast("long").alias("label"), "vec").filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vec")
    )
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    layout = placed(whole, "vec", "id", scaled=True)
    if layout is None:
        return rows.sparkSession.createDataFrame([], schema)
    asking = layout.rows.filter(anchors).select(F.col("row").alias("anchor"), "id", "label", "vec")
    everything = {"low": F.array(F.lit(-EVERY)), "high": F.array(F.lit(EVERY))}
    best = _search(layout, asking.drop("id").withColumns(everything), True, positives)
    best = keep(best.select("anchor", "id", "score", F.col("rank").cast("int").alias("place")))
    windows = best.groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("positives")  # at most five
    )
    whole_share = "transform(positives, p -> (p.score * {0}L - pmod(p.score * {0}L, 100L)) div 100L{1})"
    below = F.expr(whole_share.format(least, f" + if(pmod(p.score * {least}L, 100L) > 0, 1L, 0L)"))
    above = F.expr(whole_share.format(most, ""))
    windowed = asking.join(windows, "anchor").select(
        "anchor", "label", "vec", below.alias("low"), above.alias("high")
    )
    found = _search(layout, windowed, False, negatives)
    named = best.withColumn("window", F.col("place") - 1).select(
        "anchor", "window", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return (
        found.join(named, ["anchor", "window"])
        .join(asking.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        )
    )
