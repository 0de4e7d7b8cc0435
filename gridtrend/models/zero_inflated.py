"""Zero-inflated binomial: k = 0 always with probability 1 - pi, else Binomial(n, p)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtrend.functions.nulls import as_column
from gridtrend.functions.scalars import log_choose
from gridtrend.models.design import Design, factor_levels, treatment_design, variables
from gridtrend.models.grouped import square, upper_sums
from gridtrend.session import cut


def log_likelihood(
    k: Column | str, n: Column | str, p: Column | str, pi: Column | str | float
) -> Column:
    """Per-row log-likelihood with the inclusion indicator summed out."""
    kk, nn, pp = as_column(k), as_column(n), as_column(p)
    inc = F.lit(pi) if isinstance(pi, float) else as_column(pi)
    zero = F.ln(F.lit(1.0) - inc + inc * F.pow(F.lit(1.0) - pp, nn))
    rest = F.ln(inc) + log_choose(nn, kk) + times_log(kk, pp) + times_log(nn - kk, F.lit(1.0) - pp)
    return F.when(kk == 0, zero).otherwise(rest)


def times_log(count: Column, p: Column) -> Column:
    """count * ln(p), which is 0 for a count of 0 and minus infinity for p = 0 (where
    Spark's ln is null and a sum would pass over it)."""
    return F.when(count == 0, F.lit(0.0)).when(p <= 0, F.lit(float("-inf"))).otherwise(count * F.ln(p))


@dataclass
class ZeroInflatedFit:
    design: Design
    beta: np.ndarray
    std_errors: np.ndarray
    inclusion: float
    log_likelihood: float
    iterations: int
    converged: bool

    @property
    def names(self) -> tuple[str, ...]:
        return self.design.names


def fit_zero_inflated(
    df: DataFrame,
    k: str,
    n: str,
    terms: Sequence[str],
    factors: Sequence[str] = (),
    max_iter: int = 500,
    tol: float = 1e-8,
) -> ZeroInflatedFit:
    """EM: each round is one aggregation over the distinct (covariates, k, n) rows."""
    columns = variables(terms)
    rows = df.select(*columns, F.col(k).alias("k"), F.col(n).alias("n")).na.drop().filter("n > 0")
    cells = cut(
        rows.groupBy(*columns, "k", "n")
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn("choose", log_choose("n", "k"))
    )
    design = treatment_design(factor_levels(cells, factors), terms)
    size = len(design.columns)
    xs = [f"x{i}" for i in range(size)]
    data = cells.selectExpr(
        "k", "n", "m", "choose", *[f"{c} AS {x}" for c, x in zip(design.columns, xs)]
    )
    p0 = data.agg(F.expr("(sum(m * k) + 0.5) / (sum(m * n) + 1) AS p")).first()["p"]
    beta, pi = np.zeros(size), 0.9
    beta[0] = math.log(p0 / (1 - p0))
    previous, converged, iteration = -math.inf, False, 0
    def at_estimate() -> DataFrame:
        """Terms on the scale of the predictor: no log of a rounded 0 or 1."""
        eta = " + ".join(f"({float(b)!r}D) * {x}" for b, x in zip(beta, xs))
        return (
            data.withColumn("eta", F.expr(eta))
            .withColumn("p", F.expr("1 / (1 + exp(-eta))"))
            .withColumn("lp", F.expr("-(greatest(-eta, 0D) + log1p(exp(-abs(eta))))"))
            .withColumn("lq", F.expr("-(greatest(eta, 0D) + log1p(exp(-abs(eta))))"))
            .withColumn("none", F.expr(f"{pi!r}D * exp(n * lq)"))
            .withColumn("any", F.expr(f"1 - {pi!r}D + none"))
            .withColumn("tau", F.expr("IF(k = 0, none / any, 1D)"))
        )

    for iteration in range(1, max_iter + 1):
        scores = ", ".join(f"sum(m * tau * (k - n * p) * {x})" for x in xs)
        row = at_estimate().agg(
            F.expr(upper_sums(xs, "m * tau * n * p * (1 - p)")).alias("info"),
            F.expr(f"array({scores})").alias("score"),
            F.expr("sum(m * tau) / sum(m)").alias("pi"),
            F.expr(
                f"sum(m * IF(k = 0, ln(any), ln({pi!r}D) + choose + k * lp + (n - k) * lq))"
            ).alias("ll"),
        ).first()
        info = square(np.array(row["info"]), size)
        done = abs(row["ll"] - previous) <= tol * (abs(row["ll"]) + 1)
        previous = row["ll"]
        if done:
            converged = True
            break
        beta = beta + np.linalg.solve(info, np.array(row["score"]))
        pi = min(max(row["pi"], 1e-9), 1 - 1e-9)
    errors = observed_errors(at_estimate(), xs, pi)
    return ZeroInflatedFit(design, beta, errors, pi, previous, iteration, converged)


def observed_errors(at: DataFrame, xs: list[str], pi: float) -> np.ndarray:
    """Standard errors of the coefficients from the observed information of
    coefficients and inclusion together: minus the second derivatives of the
    log-likelihood itself, in which a zero does not tell where it comes from."""
    curve = "IF(k = 0, n * p * (1 - p) * tau - n * n * p * p * tau * (1 - tau), n * p * (1 - p))"
    mixed = ", ".join(f"sum(IF(k = 0, m * {x} * n * p * exp(n * lq) / (any * any), 0D))" for x in xs)
    row = at.agg(
        F.expr(upper_sums(xs, f"m * ({curve})")).alias("bb"),
        F.expr(f"array({mixed})").alias("bp"),
        F.expr(f"sum(m * IF(k = 0, pow((exp(n * lq) - 1) / any, 2), {1.0 / pi**2!r}D))").alias("pp"),
    ).first()
    size = len(xs)
    whole = np.zeros((size + 1, size + 1))
    whole[:size, :size] = square(np.array(row["bb"]), size)
    whole[:size, size] = whole[size, :size] = row["bp"]
    whole[size, size] = row["pp"]
    return np.sqrt(np.maximum(np.diag(np.linalg.pinv(whole, hermitian=True))[:size], 0.0))
