"""Simulated counts of packed rows, and what is drawn from them."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrend.models import counts, draws
from gridtrend.session import cut


def predictions(spark, packed, size=100):
    """900 draws in 9 blocks; six rows of a site share their predictor, one key comes twice."""
    wide = spark.range(900).selectExpr("0 AS chain", "id AS iter", "id / 150.0D - 3 AS a")
    rows = [(i, 1 + i % 2, n, n // 2, 0.3 * (i % 3)) for i, n in enumerate([0, 1, 2, 5, 25, 400, 1, 2, 3, 3, 3, 2])]
    rows += [(3, 2, 5, 2, 0.0), (99, None, 4, 1, 0.3), (100, 1, 4, 1, None)]
    rows = spark.createDataFrame(rows, "id int, part int, n int, k int, x double")
    rows = draws.pack_rows(rows, ["x"], 4) if packed else rows
    return draws.predict_draws(rows, draws.draw_blocks(wide, ["a"], size), "d.a + x")


def test_overdispersion_moves_no_draws(spark):
    keys = ["id", "part"]
    arrays = cut(draws.predictive_counts(predictions(spark, False), keys, "n"))
    out = draws.overdispersion(arrays, keys, "k")
    assert "draws" not in out._jdf.queryExecution().sparkPlan().toString()
    groups = {}
    for r in arrays.orderBy("block").collect():
        groups.setdefault((r["id"], r["part"], r["k"]), {}).setdefault(r["block"], []).append(r["y_sim"])
    means = {g: np.mean([y for b in v.values() for a in b for y in a]) for g, v in groups.items()}
    seen = np.var([g[2] - means[g] for g in groups], ddof=1)
    by_draw = [[a[i] - means[g] for g, v in groups.items() for a in v[b]] for b in range(9) for i in range(100)]
    drawn = np.mean([np.var(v, ddof=1) for v in by_draw])
    want = pytest.approx((seen, drawn, seen / drawn))
    assert tuple(out.first()) == want
    for most, kind in ((400, "array<smallint>"), (10**6, "array<int>")):
        small = draws.packed_counts(predictions(spark, True), keys, "n", 1, ["k"], most)
        assert dict(small.dtypes)["y_sim"] == kind
        assert tuple(draws.overdispersion(small, keys, "k").first()) == want


def test_uniforms_are_those_of_the_plan(monkeypatch):
    texts = ["", "ä€" * 20, *("x" * i for i in range(0, 140, 3))]
    numbers = np.array([1, 9, 10, 600, 12345, 10**12, 2**62])
    want = [[int(hashlib.md5(f"{t}|{d}".encode()).hexdigest()[:13], 16) / 2**52 for d in numbers] for t in texts]
    for tile in (counts.TILE, 5):
        monkeypatch.setattr(counts, "TILE", tile)
        assert (counts.hashed_uniforms(texts, numbers) == want).all()


def test_bounds_of_packed_rows(spark):
    """A predictor is worked out once for the rows that share it, in as many tasks as the
    session has shuffle partitions; bounds, also at a null p and of equal keys, are those of
    every row's own arrays."""
    keys = ["id", "part"]
    packed = predictions(spark, True)
    assert packed.count() < 15 * 9 / 2
    assert packed.agg(F.sum(F.size("members"))).first()[0] == 15 * 9
    arrays = draws.predictive_counts(predictions(spark, False), keys, "n")
    want = sorted(map(str, draws.residual_bounds(arrays, keys, "k").collect()))
    held = draws.predictive_histograms(packed, keys, "n", 1, ["k"], null_as_zero=True)
    assert sorted(map(str, draws.residual_bounds(held, keys, "k").collect())) == want


def test_draws_meet_the_rows_in_many_tasks(spark):
    wide = spark.range(4).selectExpr("0 AS chain", "id AS iter", "0.1D AS a")
    rows = spark.range(64).coalesce(1)
    out = draws.predict_draws(rows, draws.draw_blocks(wide, ["a"], 2), "d.a")
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_bins_of_packed_rows(spark):
    keys = ["id", "part"]
    arrays = draws.predictive_counts(predictions(spark, False), keys, "n")
    held = draws.predictive_histograms(predictions(spark, True), keys, "n", 1, ["k"], null_as_zero=True)
    seen = [
        sorted(map(tuple, draws.residual_bins(draws.quantile_residuals(draws.residual_bounds(x, keys, "k"), keys)).collect()))
        for x in (arrays, held)
    ]
    assert seen[0] == seen[1] and sum(n for _, n in seen[0]) == 14


def test_uniformity_of_packed_rows(spark):
    keys = ["id", "part"]
    arrays = draws.predictive_counts(predictions(spark, False), keys, "n")
    held = draws.predictive_histograms(predictions(spark, True), keys, "n", 1, ["k"], null_as_zero=True)
    residuals = [draws.quantile_residuals(draws.residual_bounds(x, keys, "k"), keys) for x in (arrays, held)]
    seen = [tuple(draws.uniformity(x, keys).first()) for x in residuals]
    assert seen[0] == seen[1] and seen[0][0] == 14


def test_medians_of_packed_rows(spark):
    keys = ["id", "part"]
    seen = []
    for packed in (True, False):
        held = draws.predictive_histograms(predictions(spark, packed, 100 if packed else 2000), keys, "n")
        seen.append([sorted(map(str, x.collect())) for x in (held, draws.histogram_median(held, keys))])
    assert seen[0] == seen[1]
