"""Cells of vectors on a sphere: how the two vector searches deal their candidates.

Candidates are placed with the nearest of some centers, which are spread-out rows of a
bounded sample, and the largest angle between a center and its candidates is its reach.
A query goes to the centers whose reach allows a score of interest; the candidates of a
center are cut into parts that fit a task. Candidates and the queries sent to them then
meet in a sorted stream: a task holds one part, and answers its queries batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridtrend.llm.common import keep

#: Rows and numbers of the sample that centers and first thresholds come from.
SAMPLE_ROWS, SAMPLE_NUMBERS = 4_096, 1 << 18
#: Centers: one for so many rows, at least and at most so many.
CENTER_ROWS, LEAST_CENTERS, MOST_CENTERS = 1 << 16, 32, 1_024
#: Rows and numbers of a part.
PART_ROWS, PART_NUMBERS = 1 << 17, 1 << 23
#: Queries that are routed at once, and what rounding may add to an angle.
ROUTED = 256
SLACK = 1e-7


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, not empty, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & ~F.exists(vector, lambda x: F.isnan(x.cast("double")))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of vectors of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def even(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest component near 1: cosines
    stay the same to the last bit, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def sphere(x: np.ndarray, scale: float | None) -> np.ndarray:
    """Points of length 1. Without a scale the vectors are normalised; with one, the
    largest length, a component is added that brings every vector to that length."""
    if scale is None:
        x = even(x)
        return x / np.sqrt((x * x).sum(1))[:, None]
    rest = np.sqrt(np.maximum(0.0, scale * scale - (x * x).sum(1)))
    return np.column_stack([x, rest]) / scale


def directions(q: np.ndarray, scale: float | None) -> np.ndarray:
    """Queries as points of the same sphere; their added component is 0."""
    q = even(q)
    length = np.sqrt((q * q).sum(1))
    unit = q / np.where(length > 0, length, 1.0)[:, None]
    return unit if scale is None else np.column_stack([unit, np.zeros(len(q))])


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of the points, each the one farthest from those before."""
    chosen = [0]
    far = angles(points, points[:1])[:, 0]
    while len(chosen) < n and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, angles(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


@dataclass
class Layout:
    """Placed candidates: ``rows`` (the candidates' columns, row, dim, center, angle),
    the centers and the sample by dimension, and reach and parts by center."""

    rows: DataFrame
    scale: float | None
    centers: dict[int, np.ndarray]
    sample: dict[int, dict[str, np.ndarray]]
    reach: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def cells(self) -> int:
        return int(sum(parts.sum() for _, _, parts in self.reach.values()))


def placed(
    rows: DataFrame, vector: str, key: str, scaled: bool,
    encode: tuple[Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], StructType] | None = None,
) -> Layout | None:
    """Lay out candidates (all of ``rows``, whose vectors are usable); None if there
    are none. The sample is of the rows whose key has the smallest hash. ``encode``
    makes more columns (of its schema) from points of the sphere and their centers."""
    sized = rows.withColumn("dim", F.size(vector))
    norm = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = sized.agg(
        F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim"), F.max(norm).alias("norm")
    ).first()
    if not facts["n"]:
        return None
    scale = max(1.0, float(np.sqrt(facts["norm"])) * (1 + 1e-12)) if scaled else None
    limit = max(LEAST_CENTERS, min(SAMPLE_ROWS, SAMPLE_NUMBERS // facts["dim"]))
    some = sized.orderBy(F.xxhash64(key), key).limit(limit).toArrow()
    sample, centers = {}, {}
    wanted = min(MOST_CENTERS, max(LEAST_CENTERS, facts["n"] // CENTER_ROWS))
    for dim in np.unique(some["dim"].to_numpy()):
        part = some.filter(pa.compute.equal(some["dim"], int(dim)))
        x = matrix(part[vector], int(dim))
        others = [c for c in rows.columns if c != vector]
        sample[int(dim)] = {c: part[c].to_numpy() for c in others} | {vector: x}
        centers[int(dim)] = spread_out(sphere(x, scale), wanted)

    code, coded = encode or (None, StructType())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                points = sphere(matrix(some[vector], int(dim)), scale)
                center, angle = np.full(len(points), -1), np.full(len(points), np.pi)
                of = np.zeros_like(points)
                if dim in centers:
                    away = angles(points, centers[int(dim)])
                    center, angle = away.argmin(1), away.min(1)
                    of = centers[int(dim)][center]
                columns = [*some.columns, pa.array(center.astype(np.int32)), pa.array(angle)]
                if code is not None:
                    columns += [pa.array(v) for v in code(points, of).values()]
                yield pa.RecordBatch.from_arrays(columns, [*some.schema.names, "center", "angle", *coded.names])

    schema = StructType([*sized.schema.fields]).add("center", "integer").add("angle", "double")
    schema = StructType([*schema.fields, *coded.fields])
    out = keep(sized.mapInArrow(place, schema).withColumn("row", F.monotonically_increasing_id()))
    held = out.groupBy("dim", "center").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach")).collect()
    reach = {}
    for dim in {r["dim"] for r in held}:
        of = [r for r in held if r["dim"] == dim]
        most = max(256, min(PART_ROWS, PART_NUMBERS // dim))
        reach[dim] = (
            np.array([r["center"] for r in of]),
            np.array([r["reach"] for r in of]),
            np.array([-(-r["n"] // most) for r in of]),
        )
    return Layout(out, scale, centers, sample, reach)


def searched(
    layout: Layout,
    queries: DataFrame,
    vector: str,
    limits: Callable[[dict[str, np.ndarray], np.ndarray, pa.RecordBatch], tuple[np.ndarray, np.ndarray]],
    build: Callable[[pa.Table, np.ndarray, np.ndarray], object],
    answer: Callable[[object, pa.RecordBatch, np.ndarray], dict[str, np.ndarray]],
    result: StructType,
) -> DataFrame:
    """Rows of ``answer`` over all parts that a query may find something in.

    ``limits`` gives, from the sample and queries of one dimension, the least and the
    largest score of interest of each query; scores are cosines, times both lengths on
    a scaled layout. ``build`` prepares the candidates of a part (rows, vectors, center),
    ``answer`` finds what a batch of queries wants there; ``floor`` is their least score.
    """
    scale, reach, centers, sample = layout.scale, layout.reach, layout.centers, layout.sample
    parts_of = F.create_map(
        *[F.lit(x) for dim, (c, _, p) in reach.items() for k, v in zip(c, p) for x in (f"{dim}:{k}", int(v))]
    )
    parts = F.element_at(parts_of, F.concat_ws(":", "dim", "center"))
    held = layout.rows.drop("angle").withColumns(
        {"part": F.pmod(F.xxhash64("row"), parts).cast("int"), "tag": F.lit(0)}
    )
    asked = queries.withColumn("dim", F.size(vector))
    added = StructType().add("center", "integer").add("part", "integer").add("tag", "integer").add("floor", "double")
    sent = StructType([*asked.schema.fields, *added.fields])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.intersect1d(dims, list(reach)):
                at = np.flatnonzero(dims == dim)
                for first in range(0, len(at), ROUTED):
                    some = batch.take(pa.array(at[first : first + ROUTED]))
                    q = matrix(some[vector], int(dim))
                    low, high = limits(sample.get(int(dim)), q, some)
                    number, most, n_parts = reach[int(dim)]
                    away = np.full((len(q), len(number)), np.pi / 2)
                    known = number >= 0
                    if known.any():
                        away[:, known] = angles(directions(q, scale), centers[int(dim)][number[known]])
                    length = np.ones(len(q)) if scale is None else np.sqrt((q * q).sum(1)) * scale
                    top = length[:, None] * np.cos(np.maximum(0.0, away - most - SLACK))
                    bottom = length[:, None] * np.cos(np.minimum(np.pi, away + most + SLACK))
                    edge = SLACK * (1 + length)[:, None]
                    who, where = np.nonzero((top + edge >= low[:, None]) & (bottom - edge <= high[:, None]))
                    times = n_parts[where]
                    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    rows = some.take(pa.array(np.repeat(who, times)))
                    columns = [
                        *rows.columns,
                        pa.array(np.repeat(number[where], times).astype(np.int32)),
                        pa.array(part.astype(np.int32)),
                        pa.array(np.ones(len(part), np.int32)),
                        pa.array(np.repeat(low[who].astype(np.float64), times)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, *added.names])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, kept, built = None, [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("dim", "center", "part", "tag")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for first, last in zip([0, *edges], [*edges, batch.num_rows]):
                if first == last:
                    continue
                piece, key = batch.slice(first, last - first), tuple(keys[:3, first].tolist())
                if key != cell:
                    cell, kept, built = key, [], None
                if keys[3, first] == 0:
                    kept.append(piece)
                    continue
                if built is None:
                    whole = pa.Table.from_batches(kept)
                    x = matrix(whole[vector], int(key[0]))
                    center = centers[key[0]][key[1]] if key[1] >= 0 else np.zeros(x.shape[1])
                    built, kept = build(whole, x, center), []
                found = answer(built, piece, matrix(piece[vector], int(key[0])))
                if len(next(iter(found.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array(found[n]) for n in result.names], result.names)

    both = held.unionByName(asked.mapInArrow(route, sent), allowMissingColumns=True)
    cell = ["dim", "center", "part"]
    dealt = both.repartition(max(1, min(10_000, layout.cells())), *cell).sortWithinPartitions(*cell, "tag")
    return dealt.mapInArrow(meet, result)
