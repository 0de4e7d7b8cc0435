"""Binomial GLMs and their analysis of deviance per group, all groups at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtrend.models.design import (
    Design,
    collapse,
    factor_levels,
    model_frame,
    treatment_design,
    variables,
)
from gridtrend.models.sweep import swept
from gridtrend.models.tails import chi_square_tail, f_tail
from gridtrend.operators.groups import attach
from gridtrend.session import cut

ETA_LIMIT = 30.0


def upper_sums(columns: Sequence[str], weight: str) -> str:
    """SQL array of sum(weight * xi * xj) over the upper triangle."""
    cells = [
        f"sum({weight} * {columns[i]} * {columns[j]})"
        for i in range(len(columns))
        for j in range(i, len(columns))
    ]
    return f"array({', '.join(cells)})"


def square(packed: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrix from its packed upper triangle."""
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = packed
    return out + np.triu(out, 1).T


def _solver(size: int):
    """Solve each fit's normal equations over the columns that enter it: those that the
    columns before do not determine, found at the first step, when all weights are alike."""
    upper = np.triu_indices(size)

    @F.pandas_udf("beta array<double>, se array<double>, used array<boolean>")
    def solve(packed: pd.Series, score: pd.Series, beta: pd.Series, used: pd.Series) -> pd.DataFrame:
        out = {"beta": [], "se": [], "used": []}
        for a, s, b, known in zip(packed, score, beta, used):
            info = np.zeros((size, size))
            info[upper] = a
            info = info + np.triu(info, 1).T
            if known is None:
                known = swept(info)[1]
            known = np.asarray(known, bool)
            inverse, _ = swept(np.where(np.outer(known, known), info, 0.0))
            out["beta"].append(np.asarray(b, float) + inverse @ np.where(known, s, 0.0))
            out["se"].append(np.where(known, np.sqrt(np.maximum(np.diag(inverse), 0.0)), np.nan))
            out["used"].append(known)
        return pd.DataFrame(out)

    return solve


def _newton(data: DataFrame, keys: list[str], size: int, max_iter: int, tol: float) -> DataFrame:
    """One fit per combination of ``keys``: coefficients, errors, which columns entered,
    ``deviance``, ``pearson``, ``n_rows`` and ``converged``.

    ``data`` has the collapsed sums and x0, x1, ... Each Newton step is one aggregation
    over the counts of all open fits (partial sums first, so a large group is no heavier
    than a small one) and one small solve per fit; a fit whose deviance has settled takes
    no part in later steps. Logs are on the scale of the predictor, so a rounded 0 or 1
    costs nothing.
    """
    xs = [f"x{i}" for i in range(size)]
    start = data.groupBy(*keys).agg(
        F.expr("ln((sum(wy) + 0.5) / (sum(w) - sum(wy) + 0.5)) AS b0"),
        F.expr("sum(n_rows) AS n_rows"),
        F.expr("count(1) AS cells"),
    )
    state = cut(
        start.selectExpr(
            *keys, f"concat(array(b0), array_repeat(0D, {size - 1})) AS beta",
            "CAST(NULL AS array<double>) AS se", "CAST(NULL AS array<boolean>) AS used",
            "double('inf') AS deviance", "double('nan') AS pearson", "n_rows", "false AS converged", "cells",
        )
    )
    fits, solve = state.count(), _solver(size)
    for _ in range(max_iter):
        open_ = state.filter("NOT converged")
        at = attach(data, open_.select(*keys, "beta", "cells"), keys, "cells", written=True, size=fits)
        eta = " + ".join(f"beta[{i}] * {x}" for i, x in enumerate(xs))
        at = (
            at.filter("beta IS NOT NULL")
            .withColumn("eta", F.expr(f"greatest(least({eta}, {ETA_LIMIT}D), -{ETA_LIMIT}D)"))
            .withColumn("mu", F.expr("1 / (1 + exp(-eta))"))
            .withColumn("lp", F.expr("-(greatest(-eta, 0D) + log1p(exp(-abs(eta))))"))
            .withColumn("lq", F.expr("-(greatest(eta, 0D) + log1p(exp(-abs(eta))))"))
        )
        scores = ", ".join(f"sum((wy - w * mu) * {x})" for x in xs)
        sums = at.groupBy(*keys).agg(
            F.expr(upper_sums(xs, "w * mu * (1 - mu)")).alias("info"),
            F.expr(f"array({scores})").alias("score"),
            F.expr("2 * sum(saturated - wy * lp - (w - wy) * lq)").alias("new_deviance"),
            F.expr("sum((wyy - 2 * mu * wy + mu * mu * w) / (mu * (1 - mu)))").alias("new_pearson"),
        )
        solved = open_.join(sums, keys).withColumn("__found", solve("info", "score", "beta", "used"))
        settled = f"abs(new_deviance - deviance) <= {tol} * (abs(new_deviance) + 0.1)"
        after = solved.select(
            *keys, "__found.beta", "__found.se", "__found.used", F.col("new_deviance").alias("deviance"),
            F.col("new_pearson").alias("pearson"), "n_rows", F.expr(settled).alias("converged"), "cells",
        )
        state = cut(after.unionByName(state.filter("converged")))
        if not state.filter("NOT converged").take(1):
            break
    return state


def _data(
    df: DataFrame, group: str, response: str, terms: Sequence[str], factors: Sequence[str], weight: str | None
) -> tuple[DataFrame, Design]:
    columns = variables(terms)
    cells = collapse(model_frame(df, response, weight, [group, *columns]), [group, *columns])
    design = treatment_design(factor_levels(cells, factors), terms)
    xs = [f"{c} AS x{i}" for i, c in enumerate(design.columns)]
    return cells.selectExpr(f"`{group}`", "w", "wy", "wyy", "saturated", "n_rows", *xs), design


def fit_by_group(
    df: DataFrame,
    group: str,
    response: str,
    terms: Sequence[str],
    factors: Sequence[str],
    weight: str | None = None,
    max_iter: int = 25,
    tol: float = 1e-8,
) -> DataFrame:
    """``response ~ terms`` in every group: (group, term, estimate, std_error, ...).

    A column that a group's earlier columns determine has a null estimate. ``converged``
    marks the groups whose deviance has settled.
    """
    data, design = _data(df, group, response, terms, factors, weight)
    state = _newton(data, [group], len(design.columns), max_iter, tol)
    names = F.array(*[F.lit(n) for n in design.names])
    long = state.select(
        group, "deviance", "converged", F.explode(F.arrays_zip(names.alias("term"), "beta", "se", "used"))
    )
    return long.select(
        group,
        F.col("col.term").alias("term"),
        F.expr("IF(col.used, col.beta, NULL)").alias("estimate"),
        F.expr("IF(col.used, col.se, NULL)").alias("std_error"),
        "deviance",
        "converged",
    )


def deviance_by_group(
    df: DataFrame,
    group: str,
    response: str,
    steps: Mapping[str, Sequence[str]],
    factors: Sequence[str],
    weight: str | None = None,
    quasi: bool = False,
    max_iter: int = 50,
    tol: float = 1e-9,
) -> DataFrame:
    """Sequential analysis of deviance in every group; ``steps`` adds terms in order.

    All nested models of all groups are fitted at once: a model is a group and a step,
    whose later columns are 0. Degrees of freedom count the columns that entered a
    group's model. The F ratio has the dispersion 1 and the chi-square tail, or with
    ``quasi`` the Pearson dispersion of the group's full model and the F tail. A step
    that adds no column to a group has no ratio; a full model without residual degrees of
    freedom has no dispersion.
    """
    sizes, terms = [1], []
    data, design = _data(df, group, response, [t for s in steps.values() for t in s], factors, weight)
    for added in steps.values():
        terms += added
        sizes.append(len(treatment_design(design.levels, terms).columns))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("n")) for i, n in enumerate(sizes)]))
    masked = data.withColumn("__s", step).select(
        group, F.col("__s.step").alias("step"), "w", "wy", "wyy", "saturated", "n_rows",
        *[F.when(F.col("__s.n") > i, F.col(f"x{i}")).otherwise(0.0).alias(f"x{i}") for i in range(sizes[-1])],
    )
    state = _newton(masked, [group, "step"], sizes[-1], max_iter, tol)
    rank = F.size(F.filter("used", lambda x: x))
    fits = state.select(group, "step", "deviance", "pearson", "n_rows", "converged", rank.alias("rank"))
    last = len(sizes) - 1
    # a group has one row per step: the window's partitions are bounded
    order = Window.partitionBy(group).orderBy("step")
    whole = Window.partitionBy(group)
    full = [F.max(F.when(F.col("step") == last, F.col(c))).over(whole) for c in ("pearson", "rank")]
    told = fits.withColumns(
        {
            "df": (F.col("rank") - F.lag("rank").over(order)).cast("int"),
            "drop": F.lag("deviance").over(order) - F.col("deviance"),
            "resid_df": (F.col("n_rows") - F.col("rank")).cast("int"),
            "df2": (F.col("n_rows") - full[1]).cast("int"),
            "phi": full[0] / (F.col("n_rows") - full[1]) if quasi else F.lit(1.0),
        }
    )

    @F.pandas_udf("double")
    def tail(f: pd.Series, drop: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        found = [
            None if not (a > 0) or not np.isfinite(x) else
            (f_tail(x, a, b) if b > 0 else None) if quasi else chi_square_tail(d, a)
            for x, d, a, b in zip(f, drop, df1, df2)
        ]
        return pd.Series(found, dtype="float64")

    names = F.array(F.lit("NULL"), *[F.lit(s) for s in steps])
    ratio = F.when((F.col("df") > 0) & (F.col("phi") > 0), F.col("drop") / F.col("df") / F.col("phi"))
    return told.withColumn("f", ratio).withColumn("p", tail("f", "drop", "df", "df2")).select(
        group, "step", F.element_at(names, F.col("step") + 1).alias("term"), "df",
        F.col("drop").alias("deviance"), "resid_df", F.col("deviance").alias("resid_dev"), "f", "p", "converged",
    )
