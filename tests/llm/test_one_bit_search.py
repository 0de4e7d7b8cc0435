import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrend.llm import cells
from gridtrend.llm import one_bit_search as O

SCHEMA = "id long, vec array<double>"


def cosine(a, b):
    return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b))


def plain(rows, every=50, k=5):
    """{(query place): [(id, score)]} over all pairs; rows are told apart by place."""
    usable = [(i, v) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = []
    for a, (i, q) in enumerate(usable):
        if i % every == 0:
            scored = [(cosine(q, v), j) for b, (j, v) in enumerate(usable) if a != b and len(v) == len(q)]
            out += [(i, n, s, j) for n, (s, j) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return out


def found(df, every=50, **options):
    return [tuple(r) for r in O.nearest(df, F.col("id") % every == 0, **options).select("query_id", "rank", "score", "vec_id").collect()]


def recall(got, want):
    pairs = {(q, j) for q, _, _, j in want}
    return len(pairs & {(q, j) for q, _, _, j in got}) / len(pairs)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, folder):
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    got, want = found(df), plain([(r["id"], list(r["vec"])) for r in df.collect()])
    assert len(got) == len(want) and recall(got, want) >= 0.99
    exact = {(q, j): s for q, _, s, j in want}
    assert all(abs(s - exact[q, j]) < 1e-12 for q, _, s, j in got if (q, j) in exact)
    by_query = {}
    for q, n, s, j in sorted(got):
        by_query.setdefault(q, []).append((n, -s, j))
    for rows in by_query.values():
        assert [n for n, _, _ in rows] == list(range(1, len(rows) + 1)) and rows == sorted(rows, key=lambda r: r[1:])


def odd_rows():
    r = random.Random(2)
    middle = [[r.gauss(0, 1) for _ in range(70)] for _ in range(5)]  # more than one word of bits
    rows = [(i, [x + r.gauss(0, 0.3) for x in r.choice(middle)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(2000, [2 * x for x in rows[1][1]]), (2050, [1e200 * x for x in rows[2][1]]), (2100, [1e-200 * x for x in rows[2][1]])]
    rows += [rows[50], rows[50], rows[51]]  # repeated rows, a query among them
    rows += [(3000, None), (3050, []), (3100, [0.0] * 70), (3150, [math.nan] * 70), (3200, [math.inf] + [1.0] * 69), (3250, [None] + [1.0] * 69), (None, rows[3][1])]
    rows += [(4000 + i, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(3)]  # fewer than five to find
    rows += [(5000, [1.0])]
    return rows


def test_odd_rows(spark, monkeypatch):
    rows = odd_rows()
    want = plain([(i, v if not v or i not in (2050, 2100) else [x * (1e-200 if i == 2050 else 1e200) for x in v]) for i, v in rows])
    for shrunk in (False, True):
        if shrunk:  # many parts, few centers
            monkeypatch.setattr(cells, "PART_ROWS", 1)
            monkeypatch.setattr(cells, "LEAST_CENTERS", 2)
            monkeypatch.setattr(cells, "SAMPLE_NUMBERS", 1)
        got = found(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert len(got) == len(want) and recall(got, want) >= 0.97
        ties = [(n, j) for q, n, _, j in sorted(got) if q == 0]
        assert ties == [(n, 999 + n) for n in range(1, 6)]
        assert len([1 for q, *_ in got if q == 50]) == 15  # three rows, five each
        assert {j for q, _, _, j in got if q == 4000} == {4001, 4002}
        assert {j for q, _, _, j in got if q == 2050} >= {2, 2100}
        assert not {q for q, *_ in got} & {3000, 3050, 3100, 3150, 3200, 3250, 5000}


def test_clashing_names_and_empty_tables(spark, clash):
    rows = odd_rows()[:120]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = clash(df, "row", "dim", "center", "part", "tag", "query", "code", "left", "floor")
    assert sorted(found(extra)) == sorted(found(df))
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(0, [1.0, 2.0])], SCHEMA)) == []


def test_estimates_stay_within_their_bounds():
    r = np.random.default_rng(5)
    for dim in (3, 64, 100):
        x = cells.sphere(r.normal(size=(3000, dim)) + 0.4, None)
        center = cells.sphere(x.mean(0)[None], None)
        import pyarrow as pa

        code = O.encoded(x, np.repeat(center, len(x), 0))
        table = pa.table({"id": np.arange(3000), "row": np.arange(3000), **{k: pa.array(v) for k, v in code.items()}})
        codes = O.Codes(table, x, center[0])
        estimate, error = codes.estimates(x[:40])
        off = np.abs(estimate - x[:40] @ x.T)
        assert (off <= error).mean() > 0.98
        assert dim < 64 or off.mean() < 0.12 and abs((estimate - x[:40] @ x.T).mean()) < 0.02  # without bias


def test_rotation_keeps_lengths():
    turn = O.rotation(48)
    assert np.allclose(turn @ turn.T, np.eye(48)) and np.array_equal(turn, O.rotation(48))
