import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrend.llm import cells
from gridtrend.llm import hard_negatives as H

SCHEMA = "id long, label long, vec array<int>"


def plain(rows, every=5, positives=5, negatives=3, least=50, most=95):
    """Over all pairs; rows are told apart by their place."""
    usable = [r for r in rows if None not in r[:3] and len(r[2]) and None not in r[2]]
    out = []
    for a, (i, label, q) in enumerate(usable):
        if i % every:
            continue
        scored = [
            (sum(x * y for x, y in zip(q, v)), j, other)
            for b, (j, other, v) in enumerate(usable)
            if a != b and len(v) == len(q)
        ]
        best = sorted(((s, j) for s, j, o in scored if o == label), key=lambda x: (-x[0], x[1]))[:positives]
        for ps, p in best:
            fit = sorted(
                ((s, j) for s, j, o in scored if o != label and least * ps <= 100 * s <= most * ps),
                key=lambda x: (-x[0], x[1]),
            )[:negatives]
            out += [(i, p, k, j, ps, s) for k, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def mined(df, every=5, **options):
    return sorted(tuple(r) for r in H.mine(df, F.col("id") % every == 0, **options).collect())


def vectors(r, n, dim, labels=4, centers=6):
    middle = [[r.randint(-90, 90) for _ in range(dim)] for _ in range(centers)]
    return [(i, r.randrange(labels), [x + r.randint(-25, 25) for x in r.choice(middle)]) for i in range(n)]


def odd_rows():
    r = random.Random(4)
    rows = vectors(r, 300, 8)
    rows += [(1000 + i, 1, rows[5][2]) for i in range(40)]  # copies with one label: ties
    rows += [(1100 + i, 2, rows[5][2]) for i in range(40)]  # and with another
    rows += [rows[10], rows[10], rows[11]]  # repeated rows, an anchor among them
    rows += [(2000, 1, [0] * 8), (2001, 2, [0] * 8), (2005, 1, [0] * 8)]
    rows += [(2010, None, rows[3][2]), (None, 1, rows[3][2]), (2015, 1, None), (2020, 1, []), (2025, 1, [1, None] * 4)]
    rows += [(3000 + i, i % 3, [r.randint(-50, 50) for _ in range(3)]) for i in range(30)]  # another length
    rows += [(4000, 9, [1, 2, 3, 4, 5])]  # alone with its length and label
    rows += [(5000, -3, [-x for x in rows[0][2]]), (5005, 7, [H.LIMIT] * 8), (5010, 7, [H.LIMIT] * 8), (5011, 8, [H.LIMIT // 2] * 8)]
    return rows


def test_equals_all_pairs(spark):
    rows = odd_rows()
    got = mined(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows) and len(got) > 300


def test_small_trees_and_parts(spark, monkeypatch):
    """The result does not depend on how rows are dealt to trees and parts."""
    rows = odd_rows()
    monkeypatch.setattr(H, "TREE", 32)
    monkeypatch.setattr(H, "LEAF", 2)
    monkeypatch.setattr(cells, "PART_ROWS", 1)  # 256 rows a part at least
    monkeypatch.setattr(cells, "LEAST_CENTERS", 2)
    monkeypatch.setattr(cells, "SAMPLE_NUMBERS", 1)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)
    assert mined(spark.createDataFrame(rows, SCHEMA), positives=2, negatives=1, least=10, most=120) == plain(
        rows, positives=2, negatives=1, least=10, most=120
    )


def test_clashing_names_and_empty_tables(spark, clash):
    rows = vectors(random.Random(1), 60, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    extra = clash(df, "row", "dim", "center", "part", "tag", "anchor", "score", "low")
    assert mined(extra) == mined(df) == plain(rows)
    empty = H.mine(spark.createDataFrame([], SCHEMA), F.col("id") % 5 == 0)
    assert empty.collect() == [] and empty.columns == H.mine(df, F.col("id") % 5 == 0).columns
    assert mined(spark.createDataFrame([(1, 1, [1, 2])], SCHEMA)) == []


def test_scaled(spark):
    rows = [([0.5, -0.001, 1.0],), ([float("nan"), 1.0, 1.0],), ([float("inf"), 0.0, 0.0],), (None,), ([],), ([1e300, -1e300, 0.0],), ([None, 1.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    got = [r[0] for r in df.select(H.scaled("v")).collect()]
    assert got == [[128, -1, 256], None, None, None, None, [H.LIMIT, -H.LIMIT, 0], None]


@pytest.mark.parametrize("clustered", [True, False])
def test_tree_covers_and_skips(clustered):
    """Every row below a node lies within its radius, radii halve, every row is met
    once, and a descent for the best rows leaves nodes of clustered rows out."""
    r = np.random.default_rng(3)
    middle = r.normal(size=(12, 16))
    x = middle[r.integers(0, 12, 600)] + (0.05 if clustered else 3.0) * r.normal(size=(600, 16))
    x = np.floor(256 * x)
    scale = float(np.sqrt((x * x).sum(1)).max())
    points = cells.sphere(x, scale)
    tree = H.CoverTree(points, np.zeros(600, np.int64), 0)

    def below(node):
        rows, nodes = tree.kids[node]
        out = set(rows.tolist())
        for n, row in zip(nodes.tolist(), rows.tolist()):
            if n >= 0:
                under = below(n)
                assert all(cells.angles(points[[row]], points[[u]])[0, 0] <= tree.radius[n] + 1e-9 for u in under)
                assert tree.radius[n] <= tree.radius[node] / 2 + 1e-9
                out |= under
        return out

    assert below(0) | {tree.root} == set(range(600))

    class Counted(H.Wanted):
        seen = 0

        def offer(self, score, at):
            Counted.seen += len(at)
            super().offer(score, at)

    import pyarrow as pa

    table = pa.table({"id": np.arange(600), "row": np.arange(600), "label": np.zeros(600, np.int64)})
    forest = H.Forest(table, x, scale)
    for q in (x[0], x[17], -x[5]):
        wanted = Counted(forest, -1, 0, True, 5, [-H.EVERY], [H.EVERY])
        Counted.seen = 0
        forest.descend(q, wanted)
        best = sorted(((int(s), i) for i, s in enumerate((x @ q).tolist())), key=lambda t: (-t[0], t[1]))[:5]
        assert [(int(s), int(i)) for s, i in zip(*wanted.found[0])] == best
        assert not clustered or Counted.seen < 400
        low, high = 0.3 * best[0][0], 0.5 * best[0][0]
        low, high = math.ceil(min(low, high)), math.floor(max(low, high))
        wanted = Counted(forest, -1, 1, False, 3, [low], [high])
        forest.descend(q, wanted)
        inside = sorted(((int(s), i) for i, s in enumerate((x @ q).tolist()) if low <= s <= high), key=lambda t: (-t[0], t[1]))[:3]
        assert [(int(s), int(i)) for s, i in zip(*wanted.found[0])] == inside
