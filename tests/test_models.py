"""Closed forms, hand-worked cases and recovery of known coefficients."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtrend.session import cut
from gridtrend.models import conjugate, draws, glm, gradients, grouped, mixed, response, sweep, tails, zero_inflated
from gridtrend.operators.quantiles import exact_quantiles

YEARS = [(2011, 1, 5), (2011, 3, 10), (2012, 6, 10), (2012, 2, 4), (2013, 1, 9), (2013, 0, 4)]


@pytest.fixture(scope="module")
def years(spark):
    df = spark.createDataFrame(YEARS, "year int, k int, n int")
    return df.withColumn("p", F.col("k") / F.col("n"))


def test_closed_form_and_fit_agree(spark, years):
    cells = {r["year"]: r for r in glm.cell_estimates(years, ["year"], "p", "n").collect()}
    assert [round(cells[y]["fitted"], 6) for y in (2011, 2012, 2013)] == [-1.011601, 0.287682, -2.484907]
    assert [round(cells[y]["se_fit"], 6) for y in (2011, 2012, 2013)] == [0.583874, 0.540062, 1.040833]
    fit = glm.fit_binomial(years, "p", ["year"], ["year"], "n")
    assert fit.names == ("(Intercept)", "year2012", "year2013") and fit.df_residual == 3
    assert np.allclose(fit.beta, [-1.011601, 1.299283, -1.473306], atol=1e-6)
    assert np.allclose(fit.std_errors[1:], [0.795346, 1.193416], atol=1e-6)
    assert fit.deviance == pytest.approx(1.064107, abs=1e-6)
    for r in glm.fitted_cells(fit).collect():
        assert r["fitted"] == pytest.approx(cells[r["year"]]["fitted"], abs=1e-6)
        assert r["se_fit"] == pytest.approx(cells[r["year"]]["se_fit"], abs=1e-6)


def test_boundary_cell_is_flagged(spark):
    df = spark.createDataFrame([("a", 0.0, 4), ("b", 0.5, 4)], "g string, p double, n int")
    got = {r["g"]: r for r in glm.cell_estimates(df, ["g"], "p", "n").collect()}
    assert got["a"]["at_bound"] and got["a"]["se_fit"] is None and not got["b"]["at_bound"]


def test_quasi_dispersion(spark):
    df = spark.createDataFrame([("A", 0.2), ("A", 0.3), ("B", 0.6), ("B", 0.5)], "g string, p double")
    got = {r["g"]: r for r in glm.quasi_cell_estimates(df, ["g"], "p").collect()}
    assert got["A"]["dispersion"] == pytest.approx(0.0234343, abs=1e-7)
    assert got["A"]["se_fit"] == pytest.approx(0.249983, abs=1e-6)
    assert got["B"]["se_fit"] == pytest.approx(0.217582, abs=1e-6)
    fit = glm.fit_binomial(df, "p", ["g"], ["g"], quasi=True)
    assert fit.dispersion == pytest.approx(0.0234343, abs=1e-7)


def test_tails():
    assert tails.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_tail(1.0, 7, 7) == pytest.approx(0.5, abs=1e-12)


def test_holm_and_contrasts(spark):
    table = glm.contrasts(spark, ["a", "b", "c"], np.array([0.0, 1.0, 3.0]), np.eye(3) * 0.5)
    got = table.orderBy("p_value").collect()
    assert [r["z"] for r in got] == pytest.approx([3.0, 2.0, 1.0])
    p = [math.erfc(z / math.sqrt(2)) for z in (3, 2, 1)]
    assert [r["p_holm"] for r in got] == pytest.approx([3 * p[0], 2 * p[1], p[2]])


def test_interaction_deviance_and_average(spark, years):
    rows = years.withColumn("g", F.when(F.col("n") > 8, "x").otherwise("y"))
    steps = {"g": ["g"], "year": ["year"]}
    table = glm.deviance_table(spark, rows, "p", steps, ["g", "year"], "n").orderBy("step").collect()
    assert [r["df"] for r in table] == [None, 1, 2]
    assert sum(r["deviance"] for r in table[1:]) == pytest.approx(
        table[0]["resid_dev"] - table[2]["resid_dev"])
    fit = glm.fit_binomial(rows, "p", ["g", "year"], ["g", "year"], "n")
    link = glm.average_link(glm.fitted_cells(fit), ["g"]).collect()
    direct = glm.average_response(glm.fitted_cells(fit), ["g"], ["response"], "n_rows").collect()
    assert len(link) == len(direct) == 2
    grid = spark.createDataFrame([("x", 2012)], "g string, year int")
    r = glm.predict_grid(grid, fit, 0.5).first()
    assert r["tlo"] < r["plo"] < r["response"] < r["phi"] < r["thi"]
    assert glm.coefficient_table(spark, {"m": fit}, labels={"gy": "G"}).count() == 3


def counts(spark, zero_inflation=0.0):
    rng = np.random.default_rng(7)
    size = 4000
    species, block = rng.integers(0, 80, size), rng.integers(0, 30, size)
    x = rng.normal(size=size).round(2)
    effect, site = rng.normal(0, 0.8, 80), rng.normal(0, 0.4, 30)
    n = rng.integers(8, 26, size)
    linear = -0.5 + 0.6 * x
    if not zero_inflation:
        linear = linear + effect[species] + site[block]
    k = rng.binomial(n, 1 / (1 + np.exp(-linear))) * (rng.random(size) >= zero_inflation)
    pdf = pd.DataFrame({"species": [f"s{i}" for i in species], "block": block, "x": x, "k": k, "n": n})
    return spark.createDataFrame(pdf).withColumn("p", F.col("k") / F.col("n")), effect, site


def test_mixed_recovers_slope_and_variances(spark):
    df, effect, site = counts(spark)
    fit = mixed.fit_mixed(
        df, "k", "n", ["x"], [mixed.Random("species"), mixed.Random("block")], max_iter=4
    )
    assert fit.beta[1] == pytest.approx(0.6, abs=0.04)
    assert fit.variances["species"] == pytest.approx(effect.var(), rel=0.25)
    assert fit.variances["block"] == pytest.approx(site.var(), rel=0.35)
    got = {r["species"]: r["effect"] for r in fit.effects["species"].collect()}
    assert np.corrcoef([got[f"s{i}"] for i in range(80)], effect)[0, 1] > 0.97


def test_ridge_prior_shrinks_a_flat_direction(spark):
    df = counts(spark)[0].withColumn("unused", F.lit(0.0))
    fit = mixed.fit_mixed(
        df, "k", "n", ["x", "unused"], [mixed.Random("species")], prior_precision=0.001, max_iter=2
    )
    assert fit.beta[2] == 0.0 and fit.std_errors[2] == pytest.approx(math.sqrt(1000))


def test_zero_inflated_recovers(spark):
    df = counts(spark, zero_inflation=0.3)[0]
    fit = zero_inflated.fit_zero_inflated(df, "k", "n", ["x"])
    assert fit.converged and fit.inclusion == pytest.approx(0.7, abs=0.03)
    assert np.allclose(fit.beta, [-0.5, 0.6], atol=0.06)


def test_zero_inflated_errors_are_the_observed_information(spark):
    df = counts(spark, zero_inflation=0.3)[0].withColumn("n", F.lit(3)).withColumn("k", F.least("k", F.lit(3)))
    fit = zero_inflated.fit_zero_inflated(df, "k", "n", ["x"], tol=1e-13)
    pdf = df.select("x", "k", "n").toPandas()

    def ll(v):
        p, pi = 1 / (1 + np.exp(-(v[0] + v[1] * pdf["x"]))), v[2]
        full = np.log(pi) + pdf["k"] * np.log(p) + (pdf["n"] - pdf["k"]) * np.log(1 - p)
        return np.where(pdf["k"] == 0, np.log(1 - pi + pi * (1 - p) ** pdf["n"]), full).sum()

    at, h = np.array([*fit.beta, fit.inclusion]), 1e-4
    hess = np.zeros((3, 3))
    for i in range(3):
        for j in range(3):
            e, f = np.eye(3)[i] * h, np.eye(3)[j] * h
            hess[i, j] = (ll(at + e + f) - ll(at + e - f) - ll(at - e + f) + ll(at - e - f)) / (4 * h * h)
    assert np.allclose(fit.std_errors, np.sqrt(np.diag(np.linalg.inv(-hess)))[:2], rtol=1e-3)
    assert fit.converged


def test_likelihoods_at_probability_zero_and_one(spark):
    df = spark.createDataFrame([(5, 5, 1.0), (0, 5, 0.0), (2, 5, 0.0), (2, 5, 1.0)], "k int, n int, p double")
    got = [r["ll"] for r in df.withColumn("ll", zero_inflated.log_likelihood("k", "n", "p", 1.0)).collect()]
    assert got == [0.0, 0.0, -math.inf, -math.inf]


def test_a_separated_level_has_a_finite_deviance(spark):
    rows = [("a", i % 2) for i in range(20)] + [("b", 1)] * 20
    df = spark.createDataFrame(rows, "g string, y int").withColumn("p", F.col("y").cast("double"))
    fit = glm.fit_binomial(df, "p", ["g"], ["g"], quasi=True)
    assert fit.deviance == pytest.approx(40 * math.log(2), abs=1e-6)
    assert math.isfinite(fit.dispersion)


def test_zero_inflated_likelihood_cases(spark):
    df = spark.createDataFrame([(0, 5), (2, 5)], "k int, n int")
    ll = zero_inflated.log_likelihood("k", "n", F.lit(0.3), 0.8)
    got = [r["ll"] for r in df.withColumn("ll", ll).orderBy("k").collect()]
    assert got == pytest.approx([-1.095250, -1.398529], abs=1e-6)


def test_beta_posterior(spark):
    df = spark.createDataFrame([(3, 10), (4, 10)], "k int, n int")
    r = conjugate.beta_posterior(df, [], "k", "n").first()
    assert (r["alpha"], r["beta"], r["mean"]) == (9, 15, 0.375)
    assert r["variance"] == pytest.approx(0.009375)


def test_group_fits_match_single_fits(spark):
    df = counts(spark)[0].withColumn("g", F.when(F.col("block") < 10, "a").otherwise("b"))
    many = grouped.fit_by_group(df, "g", "p", ["x"], [], "n")
    got = {(r["g"], r["term"]): (r["estimate"], r["std_error"]) for r in many.collect()}
    one = glm.fit_binomial(df.filter("g = 'a'"), "p", ["x"], [], "n")
    for name, b, s in zip(one.names, one.beta, one.std_errors):
        assert got["a", name] == pytest.approx((b, s), rel=1e-5)


def test_exact_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("a", 10.0), ("b", 4.0)],
                               "g string, v double")
    got = {(r["g"], r["prob"]): r["quantile"]
           for r in exact_quantiles(df, ["g"], "v", [0.25, 1.0]).collect()}
    assert got == {("a", 0.25): 1.5, ("a", 1.0): 10.0, ("b", 0.25): 4.0, ("b", 1.0): 4.0}
    big = spark.range(20000).selectExpr("id % 3 AS g", "IF(id % 2 = 0, 5D, id * 0.37D) AS v")
    want = big.groupBy("g").agg(F.expr("percentile(v, array(0.1, 0.5, 0.975)) AS q"))
    want = {r["g"]: r["q"] for r in want.collect()}
    for r in exact_quantiles(big, ["g"], "v", [0.1, 0.5, 0.975]).collect():
        assert r["quantile"] == pytest.approx(want[r["g"]][[0.1, 0.5, 0.975].index(r["prob"])])


def test_scale_reduction_and_thinning(spark):
    rows = [(c, i, "p", float(i + c - 1)) for c in (1, 2) for i in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "chain int, iter int, param string, value double")
    r = draws.scale_reduction(df).first()
    assert (r["within"], r["between"]) == (pytest.approx(1.666667, abs=1e-6), pytest.approx(2.0))
    assert r["r_hat"] == pytest.approx(1.024695, abs=1e-6)
    last = draws.scale_reduction_running(df, 2).orderBy("block").collect()[-1]
    assert last["r_hat"] == pytest.approx(1.024695, abs=1e-6)
    six = spark.range(1, 7).selectExpr("1 AS chain", "id AS iter")
    assert sorted(r["iter"] for r in draws.thin(six, 2, 2).collect()) == [4, 6]


def test_residual_bounds_and_median(spark):
    df = spark.createDataFrame([(1, 2, 0, [0, 5]), (1, 2, 1, [1, 2, 2])], "id int, k int, block int, y_sim array<int>")
    r = draws.residual_bounds(df, ["id"], "k").first()
    assert (r["lo"], r["hi"]) == (0.4, 0.8)
    assert draws.predictive_median(df, ["id"]).first()["median"] == 2.0


def test_any_number_of_blocks_gives_the_same(spark):
    """1 200 draws in one block, in blocks of 7 and of 1 024, broadcast or sliced."""
    wide = spark.range(1200).selectExpr("id % 2 AS chain", "id AS iter", "id / 600.0D - 1 AS a")
    rows = spark.range(12).selectExpr("id", "id / 30.0D AS x", "int(id % 9) + 1 AS n", "int(id % 4) AS k", "id % 3 + 1 AS site")
    effects = spark.range(1, 1201).selectExpr("id AS draw", "explode(array(1L, 2L, 3L)) AS site", "id / 900D AS e")
    seen = []
    for size, limit in ((2000, 10**6), (1024, 10**6), (7, 10**6), (1024, 0)):
        blocks = draws.draw_blocks(wide, ["a"], size, limit)
        packed = draws.effect_blocks(effects, "site", "e", size, limit)
        counts_ = cut(
            draws.predictive_counts(
                draws.predict_draws(rows, blocks, "d.a + x", [packed]), ["id"], "n", seed=3
            )
        )
        bounds = draws.residual_bounds(counts_, ["id"], "k")
        residuals = draws.quantile_residuals(bounds, ["id"])
        out = [
            draws.long_predictions(counts_, ["id"], ["p", "y_sim"]),
            draws.predictive_median(counts_, ["id"]),
            bounds,
            draws.residual_bins(residuals),
            draws.uniformity(residuals, ["id"]),
            draws.qq_points(residuals, ["id"]),
            draws.overdispersion(counts_, ["id"], "k").selectExpr("round(ratio, 9)"),
            draws.draw_deviance(counts_, "k", "n").selectExpr("chain", "iter", "round(deviance, 8)"),
        ]
        seen.append([sorted(map(str, x.collect())) for x in out])
        assert counts_.count() == 12 * blocks.blocks
    assert [len(x) for x in seen[0][:3]] == [14400, 12, 12] and len(seen[0][7]) == 1200
    assert all(s == seen[0] for s in seen[1:])


def test_a_missing_effect_of_a_draw_is_an_error(spark):
    wide = spark.range(5).selectExpr("1 AS chain", "id AS iter", "0D AS a")
    effects = spark.createDataFrame([(d, 1, 0.1) for d in (1, 2, 4, 5)], "draw long, site int, e double")
    blocks = draws.draw_blocks(wide, ["a"])
    packed = draws.effect_blocks(effects, "site", "e")
    rows = spark.createDataFrame([(1, 1)], "id int, site int")
    with pytest.raises(Exception, match="a draw is missing"):
        draws.predict_draws(rows, blocks, "d.a", [packed]).collect()


def test_counts_and_deviance_at_the_bounds(spark):
    wide = spark.createDataFrame([(1, 1, -800.0), (1, 2, 0.8472978603872034), (1, 3, 800.0), (1, 4, 40.0)], "chain int, iter int, a double")
    rows = spark.createDataFrame([(i, 2000, k) for i, k in enumerate((0, 700, 2000))], "id int, n int, k int")
    predicted = draws.predict_draws(rows, draws.draw_blocks(wide, ["a"]), "d.a")
    for r in draws.predictive_counts(predicted, ["id"], "n").collect():
        assert r["y_sim"][0] == 0 and r["y_sim"][2:] == [2000, 2000]
        assert abs(r["y_sim"][1] - 1400) < 120  # n p with p = 0.7
    one = draws.predict_draws(rows.filter("k = 2000"), draws.draw_blocks(wide, ["a"]), "d.a")
    got = {r["iter"]: r["deviance"] for r in draws.draw_deviance(one, "k", "n").collect()}
    assert got[1] == pytest.approx(2 * 2000 * 800) and got[3] == 0
    whole = {r["iter"]: r["deviance"] for r in draws.draw_deviance(predicted, "k", "n").collect()}
    assert all(math.isfinite(v) for v in whole.values()) and whole[4] > 2 * 40 * 1300


def test_simulated_counts_follow_the_binomial(spark):
    wide = spark.range(4000).selectExpr("0 AS chain", "id AS iter", "0.4D AS a")
    rows = spark.range(1).selectExpr("id", "10 AS n")
    blocks = draws.draw_blocks(wide, ["a"], 5000)
    out = draws.predictive_counts(draws.predict_draws(rows, blocks, "d.a"), ["id"], "n")
    y = np.array(out.first()["y_sim"])
    p = 1 / (1 + math.exp(-0.4))
    assert y.mean() == pytest.approx(10 * p, abs=0.1)
    assert y.var() == pytest.approx(10 * p * (1 - p), rel=0.1)


# mixed models


def dense(pdf, x, z, k, n, g, prior=0.0, steps=60):
    """Penalised quasi-likelihood by one dense matrix; ``z`` are (columns, term number)."""
    design, random = np.column_stack(x), np.column_stack([c for c, _ in z])
    term = np.concatenate([np.full(c.shape[1], t) for c, t in z])
    beta, u = np.zeros(design.shape[1]), np.zeros(random.shape[1])
    p = len(beta)
    beta[0] = math.log((k.sum() + 0.5) / (n.sum() - k.sum() + 0.5))
    g = np.array(g, float)
    for _ in range(steps):
        eta = design @ beta + random @ u
        mu = 1 / (1 + np.exp(-eta))
        w = n * mu * (1 - mu)
        whole = np.column_stack([design, random])
        a = (whole * w[:, None]).T @ whole + np.diag(np.concatenate([np.full(p, prior), 1 / g[term]]))
        c = np.linalg.inv(a)
        s = c @ (whole.T @ (w * eta + k - n * mu))
        beta, u = s[:p], s[p:]
        d = np.diag(c)[p:]
        g = np.array([
            max((u[term == t] ** 2).sum() / ((term == t).sum() - d[term == t].sum() / g[t]), 1e-6)
            for t in range(len(g))
        ])
    return beta, c[:p, :p], g


def test_joint_covariance_equals_a_dense_solve(spark):
    df, _, _ = counts(spark)
    df = df.limit(3000)
    df = cut(df)
    pdf = df.toPandas()
    terms = [mixed.Random("species"), mixed.Random("block")]
    s, b = pd.get_dummies(pdf["species"]).to_numpy(float), pd.get_dummies(pdf["block"]).to_numpy(float)
    x = pdf["x"].to_numpy()
    beta, vcov, g = dense(pdf, [np.ones(3000), x], [(s, 0), (b, 1)], pdf["k"].to_numpy(float),
                          pdf["n"].to_numpy(float), [1.0, 1.0])
    found = []
    for order in (terms, terms[::-1]):
        fit = mixed.fit_mixed(df, "k", "n", ["x"], order, tol=1e-6)
        assert fit.converged
        assert np.allclose(fit.beta, beta, atol=1e-5) and np.allclose(fit.vcov, vcov, rtol=1e-3, atol=1e-8)
        assert [fit.variances[r.name] for r in terms] == pytest.approx(g, rel=1e-3, abs=1e-5)
        found.append(fit)
    assert np.allclose(found[0].vcov, found[1].vcov, rtol=1e-9)
    assert np.allclose(found[0].beta, found[1].beta, rtol=1e-9)


def test_gradients_equal_the_dense_solve(spark):
    """One solve on the tables, two crossed terms and a slope, against the solver in a task."""
    df, _, _ = counts(spark)
    terms = [mixed.Random("species", "x", intercept=True), mixed.Random("block")]
    problem, _ = mixed._prepared(df.limit(1500), [], "k", "n", ["x"], terms, (), 0.001, False, False)
    state = cut(mixed._start(problem))
    problem.fits, problem.levels = 1, [100, 100]
    sums = problem.sums(state, False)
    one = mixed._Sums(sums.toPandas(), problem.groups, problem.layout, False)
    want = one.solved([1.0, 0.0, 0.0, 1.0, 1.0], 0.001)
    fits = state.filter("h = -1").select("f0", "beta", "g", "tau", "pi", "iterations", "converged")
    got = cut(gradients.solved(problem, sums, fits, 1e-3))
    fit = got.filter("h = -1").first()
    assert np.allclose(fit["beta"], want["beta"], atol=1e-7)
    assert np.allclose(np.reshape(fit["vcov"], (2, 2)), want["vcov"], rtol=1e-6)
    for h, (table, name) in enumerate(zip(one.tables, problem.groups)):
        u = {r[name]: r["u"] for r in got.filter(f"h = {h}").collect()}
        for i, level in enumerate(table[name]):
            assert np.allclose(u[level], want["u"][one.at[h][i]], atol=1e-7)
    exact = mixed.updated(np.eye(1), np.array([[float(want["u"][one.at[1]].ravel() @ want["u"][one.at[1]].ravel())]]),
                          one.spread(want, 1).sum(axis=0), len(one.tables[1]))
    assert fit["g"][4] == pytest.approx(exact[0, 0], rel=0.05)  # a trace by random vectors


def test_correlated_intercept_and_slope(spark):
    rng = np.random.default_rng(5)
    size, groups = 6000, 120
    cov = np.array([[0.6, -0.25], [-0.25, 0.3]])
    effect = rng.multivariate_normal([0, 0], cov, groups)
    g, x, n = rng.integers(0, groups, size), rng.normal(size=size).round(2), rng.integers(5, 20, size)
    k = rng.binomial(n, 1 / (1 + np.exp(-(0.3 + 0.5 * x + effect[g, 0] + effect[g, 1] * x))))
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "k": k, "n": n}))
    term = mixed.Random("g", "x", intercept=True)
    fit = mixed.fit_mixed(df, "k", "n", ["x"], [term])
    seen = np.cov(effect.T)
    assert fit.converged and fit.beta[1] == pytest.approx(0.5, abs=0.15)
    assert fit.variances["g"] == pytest.approx(seen[0, 0], rel=0.15)
    assert fit.variances["x|g"] == pytest.approx(seen[1, 1], rel=0.15)
    assert fit.correlations[term.name] == pytest.approx(seen[0, 1] / math.sqrt(seen[0, 0] * seen[1, 1]), abs=0.08)
    got = {r["g"]: (r["effect_intercept"], r["effect_slope"]) for r in fit.effects[term.name].collect()}
    assert np.corrcoef([got[i][1] for i in range(groups)], effect[:, 1])[0, 1] > 0.9
    alone = mixed.fit_mixed(df, "k", "n", ["x"], [mixed.Random("g"), mixed.Random("g", "x")])
    assert alone.variances["g"] == pytest.approx(fit.variances["g"], rel=0.1) and not alone.correlations


def test_many_mixed_fits_equal_separate_ones(spark):
    df = cut(counts(spark)[0].withColumn("part", F.expr("CASE WHEN block < 12 THEN 'a' WHEN block < 24 THEN 'b' ELSE 'c' END")))
    terms = [mixed.Random("species"), mixed.Random("block")]
    many = mixed.fit_mixed_by(df, ["part"], "k", "n", ["x"], terms, tol=1e-5)
    got = {(r["part"], r["term"]): (r["estimate"], r["std_error"]) for r in many.coefficients.collect()}
    variances = {(r["part"], r["part_"]): r["value"] for r in many.variances.toDF("part", "part_", "value").collect()}
    assert len(got) == 6
    for part in ("a", "c"):
        one = mixed.fit_mixed(df.filter(F.col("part") == part), "k", "n", ["x"], terms, tol=1e-5)
        for name, b, s in zip(one.names, one.beta, one.std_errors):
            assert got[part, name] == pytest.approx((b, s), rel=1e-6)
        assert variances[part, "species"] == pytest.approx(one.variances["species"], rel=1e-6)


def test_columns_that_others_determine_are_left_out(spark):
    df = counts(spark)[0].withColumns({"twice": F.col("x") * 2, "part": F.when(F.col("block") < 9, "a").otherwise("b")})
    df = df.withColumn("own", F.when(F.col("part") == "a", F.lit(0.0)).otherwise(F.col("n") * 1.0))
    fits = mixed.fit_mixed_by(df, ["part"], "k", "n", ["x", "twice", "own"], [mixed.Random("species")])
    got = {(r["part"], r["term"]): r["estimate"] for r in fits.coefficients.collect()}
    assert got["a", "twice"] is None and got["a", "own"] is None and got["b", "own"] is not None
    assert got["a", "x"] == pytest.approx(0.6, abs=0.06)


def simulated(size=6000, tau=0.0, inclusion=1.0, seed=11):
    rng = np.random.default_rng(seed)
    species, x, n = rng.integers(0, 60, size), rng.normal(size=size).round(1), rng.integers(6, 26, size)
    a, b = rng.normal(0, 0.6, 60), rng.normal(0, 0.4, 60)
    eta = -0.4 + 0.5 * x + a[species] + b[species] * x + tau * rng.normal(size=size)
    k = rng.binomial(n, 1 / (1 + np.exp(-eta))) * (rng.random(size) < inclusion)
    return pd.DataFrame({"species": species, "x": x, "k": k, "n": n}), a, b


def test_overdispersion_against_quadrature(spark):
    """Without groups that matter, the row effect's deviation maximises the likelihood
    that a fine grid integrates."""
    pdf, _, _ = simulated(tau=0.7, size=4000)
    pdf["species"] = 0  # one group, whose variance falls to nothing
    df = spark.createDataFrame(pdf)
    fit = mixed.fit_mixed(df, "k", "n", ["x"], [mixed.Random("species")], overdispersed=True, tol=1e-5)
    assert fit.converged
    z = np.linspace(-6, 6, 301)
    weight = np.exp(-z * z / 2) / np.exp(-z * z / 2).sum()
    k, n, x = (pdf[c].to_numpy(float)[:, None] for c in ("k", "n", "x"))
    choose = np.array([math.lgamma(b + 1) - math.lgamma(a + 1) - math.lgamma(b - a + 1) for a, b in zip(pdf["k"], pdf["n"])])

    def ll(b0, b1, tau):
        eta = b0 + b1 * x + tau * z
        terms = choose[:, None] - k * np.log1p(np.exp(-eta)) - (n - k) * np.log1p(np.exp(eta))
        return np.log(np.exp(terms) @ weight).sum()

    u = fit.effects["species"].first()["effect"]
    at, h = np.array([fit.beta[0] + u, fit.beta[1], fit.overdispersion]), 1e-3
    gradient = [(ll(*(at + h * e)) - ll(*(at - h * e))) / (2 * h) for e in np.eye(3)]
    curve = [(ll(*(at + h * e)) - 2 * ll(*at) + ll(*(at - h * e))) / h**2 for e in np.eye(3)]
    assert all(abs(g / c) < 2e-3 for g, c in zip(gradient, curve))  # within a Newton step of the maximum
    assert fit.overdispersion > 0.7


def test_zero_inflated_hierarchy_recovers(spark):
    pdf, a, b = simulated(tau=0.5, inclusion=0.75)
    fit = mixed.fit_mixed(spark.createDataFrame(pdf), "k", "n", ["x"], [mixed.Random("species"), mixed.Random("species", "x")],
                          overdispersed=True, zero_inflated=True)
    assert fit.converged and fit.inclusion == pytest.approx(0.75, abs=0.03)
    assert fit.beta[1] == pytest.approx(0.5 + b.mean(), abs=0.12)
    assert fit.variances["species"] == pytest.approx(a.var(), rel=0.3)
    assert fit.variances["x|species"] == pytest.approx(b.var(), rel=0.35)
    assert fit.overdispersion == pytest.approx(0.5, abs=0.1)


def test_terms_of_a_row_are_derivatives(spark):
    """Scores and curvatures of an overdispersed, zero-inflated row against differences."""
    rows = [(k, n, eta, tau, pi) for k, n in ((0, 4), (3, 9), (7, 7)) for eta in (-1.5, 0.4) for tau, pi in ((0.6, 0.7), (1.2, 0.95))]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "k double, n double, eta double, tau double, pi double")
    at = response.with_terms(df.withColumn("m", F.lit(1.0)), True, True).orderBy("k", "eta", "tau").collect()
    z, w = response.nodes()

    def ll(k, n, eta, tau, pi):
        p = 1 / (1 + np.exp(-(eta + tau * z)))
        like = (w * p**k * (1 - p) ** (n - k)).sum()
        return math.log((1 - pi) * (k == 0) + pi * like)

    h = 1e-4
    for r in at:
        v = (r["k"], r["n"], r["eta"], r["tau"], r["pi"])
        step = lambda i, d: tuple(x + d * (j == i) for j, x in enumerate(v))
        first = lambda i: (ll(*step(i, h)) - ll(*step(i, -h))) / (2 * h)
        second = lambda i: (ll(*step(i, h)) - 2 * ll(*v) + ll(*step(i, -h))) / h**2
        assert r["score"] == pytest.approx(first(2), abs=1e-5)
        assert r["observed"] == pytest.approx(-second(2), abs=1e-4)
        assert r["tau_1"] == pytest.approx(first(3), abs=1e-5)
        assert r["pi_pi"] == pytest.approx(-second(4), abs=1e-3)
        corner = [ll(v[0], v[1], v[2] + a * h, v[3], v[4] + b * h) for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
        assert r["eta_pi"] == pytest.approx(-(corner[0] - corner[1] - corner[2] + corner[3]) / (4 * h * h), abs=1e-3)
        assert r["curve"] >= 0


def test_sweep_leaves_out_what_is_determined():
    x = np.random.default_rng(0).normal(size=(50, 5))
    x[:, 3] = x[:, 0] + 2 * x[:, 1]
    a = np.column_stack([x, np.zeros(50)])
    inverse, used = sweep.swept(a.T @ a)
    assert used.tolist() == [True, True, True, False, True, False]
    kept = a[:, used]
    assert np.allclose(inverse[np.ix_(used, used)], np.linalg.inv(kept.T @ kept))


def test_deviance_by_group_equals_single_tables(spark):
    df = counts(spark)[0].withColumns({"g": F.when(F.col("block") < 10, "a").otherwise("b"), "level": F.col("block") % 3})
    steps = {"x": ["x"], "level": ["level"], "both": ["x:level"]}
    for quasi in (False, True):
        many = grouped.deviance_by_group(df, "g", "p", steps, ["level"], "n", quasi)
        for g in ("a", "b"):
            one = glm.deviance_table(spark, df.filter(F.col("g") == g), "p", steps, ["level"], "n", quasi).orderBy("step").collect()
            for r, q in zip(many.filter(F.col("g") == g).orderBy("step").collect(), one):
                assert (r["term"], r["df"], r["resid_df"]) == (q["term"], q["df"], q["resid_df"])
                for c in ("deviance", "resid_dev", "f", "p"):
                    assert r[c] == (None if q[c] is None else pytest.approx(q[c], rel=1e-6, abs=1e-8))


def test_contrasts_of_two_thousand_levels(spark):
    size = 2_000
    rng = np.random.default_rng(4)
    estimates, half = rng.normal(size=size), rng.normal(size=(size, 3))
    vcov = half @ half.T + np.eye(size)
    table = cut(glm.contrasts(spark, [f"{i:04d}" for i in range(size)], estimates, vcov))
    assert table.count() == size * (size - 1) // 2
    some = table.filter("level_a = '0003' AND level_b < '0050'").collect()
    for r in some:
        b = int(r["level_b"])
        assert r["z"] == pytest.approx((estimates[b] - estimates[3]) / math.sqrt(vcov[3, 3] + vcov[b, b] - 2 * vcov[3, b]))
    pdf = table.select("level_a", "level_b", "p_value", "p_holm").toPandas().sort_values(["p_value", "level_a", "level_b"])
    m = len(pdf)
    want = np.maximum.accumulate(np.minimum((m - np.arange(m)) * pdf["p_value"].to_numpy(), 1.0))
    assert np.allclose(pdf["p_holm"], want)
    plan = glm.holm(table.drop("p_holm"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0]


def test_sparse_sums_equal_dense_ones(spark, monkeypatch):
    df = counts(spark)[0].withColumn("level", F.col("block") % 7)
    terms, random = ["level", "x", "level:x"], [mixed.Random("species"), mixed.Random("block")]
    found = []
    for wide in (10_000, 0):
        monkeypatch.setattr(mixed, "WIDE", wide)
        found.append(mixed.fit_mixed(df, "k", "n", terms, random, ["level"], max_iter=2))
    assert np.allclose(found[0].beta, found[1].beta, atol=1e-10)
    assert np.allclose(found[0].vcov, found[1].vcov, rtol=1e-8, atol=1e-12)


def test_histograms_have_the_counts_of_the_arrays(spark):
    """Medians over 900 draws, in one block and in many, against the draws themselves."""
    wide = spark.range(900).selectExpr("0 AS chain", "id AS iter", "id / 150.0D - 3 AS a")
    rows = spark.createDataFrame([(i, n, 0.3 * i - 1) for i, n in enumerate([0, 1, 2, 5, 25, 400, 3000])], "id int, n int, x double")
    want = None
    for size in (2000, 100):
        blocks = draws.draw_blocks(wide, ["a"], size)
        predicted = cut(draws.predict_draws(rows, blocks, "d.a + x"))
        arrays = draws.predictive_counts(predicted, ["id"], "n", seed=5)
        held = draws.predictive_histograms(predicted, ["id"], "n", seed=5)
        long = draws.long_predictions(arrays, ["id"], ["y_sim"]).groupBy("id", F.col("y_sim").alias("y")).count()
        assert sorted(map(tuple, held.collect())) == sorted(map(tuple, long.collect()))
        got = sorted(map(tuple, draws.histogram_median(held, ["id"]).collect()))
        assert got == sorted(map(tuple, draws.predictive_median(arrays, ["id"]).collect()))
        assert want is None or got == want
        want = got
    nothing = rows.limit(1).select("id", F.lit(3).alias("n"), F.lit(None).cast("double").alias("x"))
    held = draws.predictive_histograms(draws.predict_draws(nothing, blocks, "d.a + x"), ["id"], "n")
    assert [tuple(r) for r in draws.histogram_median(held, ["id"]).collect()] == [(0, None)]
