"""Weighted and quasi-binomial GLMs on collapsed counts, and inference on them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrend.functions.scalars import expit, label_order, logit, map_values
from gridtrend.models.design import (
    Design,
    collapse,
    factor_levels,
    model_frame,
    treatment_design,
    variables,
)
from gridtrend.models.grouped import ETA_LIMIT, square, upper_sums
from gridtrend.models.sweep import swept
from gridtrend.models.tails import chi_square_tail, f_tail
from gridtrend.operators.keys import row_id, running_max
from gridtrend.operators.reshape import stack
from gridtrend.session import cut

Z95 = 1.96


@dataclass
class Fit:
    """Coefficients with their covariance; small (p and p x p)."""

    design: Design
    beta: np.ndarray
    vcov: np.ndarray
    dispersion: float
    deviance: float
    df_residual: int
    cells: DataFrame = field(repr=False)
    variances: dict[str, float] = field(default_factory=dict)
    used: np.ndarray | None = None

    @property
    def names(self) -> tuple[str, ...]:
        return self.design.names

    @property
    def std_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.vcov))


def fit_cells(
    cells: DataFrame, design: Design, quasi: bool = False, max_iter: int = 50, tol: float = 1e-10
) -> Fit:
    """Fit on a collapsed table; the same table serves nested models.

    Newton steps of one aggregation each; only p x p sums reach the driver. A column that
    those before it determine does not enter: its coefficient and variance are 0 and it
    counts no degree of freedom. Logs of mu and 1 - mu are on the scale of the predictor,
    so neither vanishes when mu rounds to 0 or 1.
    """
    size = len(design.columns)
    xs = [f"x{i}" for i in range(size)]
    data = cells.selectExpr("*", *[f"{c} AS {x}" for c, x in zip(design.columns, xs)])
    share = data.agg(F.expr("(sum(wy) + 0.5) / (sum(w) + 1) AS p")).first()["p"]
    beta, used, deviance = np.zeros(size), None, math.inf
    beta[0] = math.log(share / (1.0 - share))
    for _ in range(max_iter):
        eta = " + ".join(f"({float(b)!r}D) * {x}" for b, x in zip(beta, xs))
        at = (
            data.withColumn("eta", F.expr(f"greatest(least({eta}, {ETA_LIMIT}D), -{ETA_LIMIT}D)"))
            .withColumn("mu", F.expr("1 / (1 + exp(-eta))"))
            .withColumn("lp", F.expr("-(greatest(-eta, 0D) + log1p(exp(-abs(eta))))"))
            .withColumn("lq", F.expr("-(greatest(eta, 0D) + log1p(exp(-abs(eta))))"))
        )
        scores = ", ".join(f"sum((wy - w * mu) * {x})" for x in xs)
        row = at.agg(
            F.expr("2 * sum(saturated - wy * lp - (w - wy) * lq)").alias("deviance"),
            F.expr("sum((wyy - 2 * mu * wy + mu * mu * w) / (mu * (1 - mu)))").alias("pearson"),
            F.expr("sum(n_rows) AS n"),
            F.expr(f"array({scores})").alias("score"),
            F.expr(upper_sums(xs, "w * mu * (1 - mu)")).alias("information"),
        ).first()
        information = square(np.array(row["information"]), size)
        used = swept(information)[1] if used is None else used
        inverse, _ = swept(np.where(np.outer(used, used), information, 0.0))
        beta = beta + inverse @ np.where(used, row["score"], 0.0)
        done = abs(row["deviance"] - deviance) <= tol * (abs(row["deviance"]) + 0.1)
        deviance = row["deviance"]
        if done:
            break
    df_residual = int(row["n"]) - int(used.sum())
    dispersion = 1.0
    if quasi:
        dispersion = row["pearson"] / df_residual if df_residual else math.nan
    return Fit(design, beta, inverse * dispersion, dispersion, deviance, df_residual, cells, used=used)


def fit_binomial(
    df: DataFrame,
    response: str,
    terms: Sequence[str],
    factors: Sequence[str] = (),
    weight: str | None = None,
    quasi: bool = False,
) -> Fit:
    """``response ~ terms`` with a logit link.

    ``response`` is a proportion and ``weight`` its number of trials; without a
    weight every row counts once (the quasi-binomial use).
    """
    columns = variables(terms)
    cells = collapse(model_frame(df, response, weight, columns), columns)
    design = treatment_design(factor_levels(cells, factors), terms)
    return fit_cells(cells, design, quasi)


def deviance_table(
    spark: SparkSession,
    df: DataFrame,
    response: str,
    steps: Mapping[str, Sequence[str]],
    factors: Sequence[str],
    weight: str | None = None,
    quasi: bool = False,
) -> DataFrame:
    """Sequential analysis of deviance; ``steps`` adds terms in order.

    With ``quasi`` the F ratio uses the Pearson dispersion of the full model;
    otherwise the dispersion is 1 and the tail is the chi-square one. A step that adds
    no column that the earlier ones leave open has no ratio.
    """
    all_terms = [t for terms in steps.values() for t in terms]
    columns = variables(all_terms)
    cells = collapse(model_frame(df, response, weight, columns), columns)
    levels = factor_levels(cells, factors)
    fits, used = [fit_cells(cells, treatment_design(levels, []))], []
    for i, terms in enumerate(steps.values()):
        used = used + list(terms)
        last = i == len(steps) - 1
        fits.append(fit_cells(cells, treatment_design(levels, used), quasi and last))
    phi, df2 = fits[-1].dispersion, fits[-1].df_residual
    rows = [(0, "NULL", None, None, fits[0].df_residual, fits[0].deviance, None, None)]
    for i, name in enumerate(steps, start=1):
        before, after = fits[i - 1], fits[i]
        df1 = before.df_residual - after.df_residual
        drop = before.deviance - after.deviance
        f = drop / df1 / phi if df1 and phi > 0 else None
        p = None if f is None else f_tail(f, df1, df2) if quasi else chi_square_tail(drop, df1)
        rows.append((i, name, df1, drop, after.df_residual, after.deviance, f, p))
    return spark.createDataFrame(
        rows,
        "step int, term string, df int, deviance double, resid_df int, resid_dev double,"
        " f double, p double",
    )


def quadratic_form(vcov: np.ndarray, x: Column) -> Column:
    """Square root of x'Vx for an array column; columns that are not in a fit (null
    variance) add nothing."""
    vcov = np.nan_to_num(vcov)

    @F.pandas_udf("double")
    def se(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="float64")
        rows = np.stack(v.to_numpy())
        return pd.Series(np.sqrt(np.maximum(((rows @ vcov) * rows).sum(axis=1), 0.0)))

    return se(x)


def with_prediction(df: DataFrame, fit: Fit) -> DataFrame:
    """Linear predictor ``fitted`` and its standard error ``se_fit`` for design rows."""
    return df.withColumns(
        {
            "fitted": F.expr(fit.design.linear(fit.beta)),
            "se_fit": quadratic_form(fit.vcov, fit.design.x()),
        }
    )


def response_interval(df: DataFrame, estimate: str = "fitted", se: str = "se_fit") -> DataFrame:
    """Response scale with a 95 % interval built on the logit scale."""
    e, s = F.col(estimate), F.col(se)
    return df.withColumns(
        {
            "response": expit(e),
            "ci_low": expit(e - Z95 * s),
            "ci_high": expit(e + Z95 * s),
        }
    )


def fitted_cells(fit: Fit) -> DataFrame:
    """Fitted values of the distinct design rows, with the rows each stands for."""
    keys = [c for c in fit.cells.columns if c not in _CELL_SUMS]
    return response_interval(with_prediction(fit.cells, fit)).select(
        *keys, "fitted", "se_fit", "response", "ci_low", "ci_high", "n_rows"
    )


_CELL_SUMS = ("w", "wy", "wyy", "saturated", "n_rows")


def average_link(fitted: DataFrame, keys: Sequence[str], rows: str | None = "n_rows") -> DataFrame:
    """Mean over cells on the logit scale, then back-transformed."""
    w = F.lit(1.0) if rows is None else F.col(rows)
    means = fitted.groupBy(*keys).agg(
        *[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in ("fitted", "se_fit")]
    )
    return response_interval(means)


def average_response(
    fitted: DataFrame, keys: Sequence[str], columns: Sequence[str], rows: str | None = None
) -> DataFrame:
    """Mean over cells of values that are already back-transformed."""
    w = F.lit(1.0) if rows is None else F.col(rows)
    return fitted.groupBy(*keys).agg(
        *[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in columns]
    )


def predict_grid(grid: DataFrame, fit: Fit, random_variance: float | None = None) -> DataFrame:
    """Fixed-effect prediction with its interval; ``tlo``/``thi`` add random variance."""
    total = sum(fit.variances.values()) if random_variance is None else random_variance
    out = with_prediction(grid, fit)
    e, s = F.col("fitted"), F.col("se_fit")
    t = F.sqrt(s * s + F.lit(float(total)))
    return out.withColumns(
        {
            "response": expit(e),
            "plo": expit(e - Z95 * s),
            "phi": expit(e + Z95 * s),
            "tlo": expit(e - Z95 * t),
            "thi": expit(e + Z95 * t),
        }
    )


def cell_estimates(
    df: DataFrame, keys: Sequence[str], response: str, weight: str | None = None
) -> DataFrame:
    """Closed form of a model with one parameter per cell.

    The fitted value is the weighted cell mean with SE 1 / sqrt(W p (1 - p)) on
    the logit scale. A cell at 0 or 1 has no finite logit: its SE is null and
    it is flagged.
    """
    frame = model_frame(df, response, weight, keys)
    cells = frame.groupBy(*keys).agg(
        F.expr("sum(w) AS w"), F.expr("sum(w * y) / sum(w) AS p"), F.expr("count(1) AS n_rows")
    )
    at_bound = (F.col("p") <= 0) | (F.col("p") >= 1)
    return cells.withColumns(
        {
            "at_bound": at_bound,
            "fitted": F.when(~at_bound, logit("p")),
            "se_fit": F.when(~at_bound, F.expr("1 / sqrt(w * nullif(p * (1 - p), 0D))")),
        }
    ).withColumnRenamed("p", "response")


def quasi_cell_estimates(df: DataFrame, keys: Sequence[str], response: str) -> DataFrame:
    """Closed form of the quasi-binomial cell model: SEs scaled by sqrt(dispersion)."""
    frame = model_frame(df, response, None, keys)
    cells = frame.groupBy(*keys).agg(
        F.expr("avg(y) AS p"), F.expr("sum(y * y) AS yy"), F.expr("count(1) AS n_rows")
    )
    pearson = "sum((yy - n_rows * p * p) / nullif(p * (1 - p), 0D))"
    phi = cells.agg(F.expr(f"{pearson} / (sum(n_rows) - count(1)) AS phi")).scalar()
    scaled = cells.withColumn("dispersion", phi).withColumns(
        {
            "fitted": F.when((F.col("p") > 0) & (F.col("p") < 1), logit("p")),
            "se_fit": F.expr("sqrt(dispersion / nullif(n_rows * p * (1 - p), 0D))"),
        }
    )
    return response_interval(scaled).select(
        *keys, "n_rows", "fitted", "se_fit", "response", "ci_low", "ci_high", "dispersion"
    )


def two_sided_p(z: Column | str) -> Column:
    """Normal tail on both sides; Spark SQL has no erfc."""

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        scaled = values.abs() / math.sqrt(2.0)
        return scaled.map(math.erfc, na_action="ignore").astype("float64")

    return tail(z)


def holm(df: DataFrame, p: str = "p_value", name: str = "p_holm") -> DataFrame:
    """Holm step-down adjustment over a written contrast table (a row per pair of levels).

    Rows are range-sorted by p once; a row's rank and the largest step before it come
    from its place in its partition and from one row of sums for each partition.
    """
    steps = row_id(df, [p, "level_a", "level_b"], "__rank")
    stepped = steps.withColumn(
        "__step", F.least((F.lit(df.count() + 1) - F.col("__rank")) * F.col(p), F.lit(1.0))
    )
    return running_max(stepped, "__rank", "__step", name).select(*df.columns, name)


def contrasts(
    spark: SparkSession, levels: Sequence, estimates: np.ndarray, vcov: np.ndarray
) -> DataFrame:
    """All pairwise level differences with z, two-sided p and Holm p.

    The covariances become a long table (a task writes the rows of some levels), whose
    entries above the diagonal are the pairs; each meets the table of levels twice.
    """
    names = [str(v) for v in levels]
    estimates, vcov = np.asarray(estimates, float), np.asarray(vcov, float)
    size = len(names)
    table = spark.createDataFrame(
        [(i, n, float(e), float(v)) for i, (n, e, v) in enumerate(zip(names, estimates, np.diag(vcov)))],
        "i int, level string, estimate double, variance double",
    )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                j = np.arange(i + 1, size)
                yield pd.DataFrame({"i": np.full(len(j), i), "j": j, "covariance": vcov[i, i + 1 :]})

    parts = max(1, min(size, 200, size * size // 50_000))
    long = spark.range(0, size, 1, parts).mapInPandas(rows, "i int, j int, covariance double")
    a = table.select("i", F.col("level").alias("level_a"), F.col("estimate").alias("ea"), F.col("variance").alias("va"))
    b = table.select(F.col("i").alias("j"), F.col("level").alias("level_b"), F.col("estimate").alias("eb"), F.col("variance").alias("vb"))
    scored = long.join(a, "i").join(b, "j").select(
        "level_a", "level_b", (F.col("eb") - F.col("ea")).alias("estimate"),
        F.expr("sqrt(va + vb - 2 * covariance)").alias("se"),
    )
    scored = scored.withColumn("z", F.col("estimate") / F.col("se"))
    return holm(cut(scored.withColumn("p_value", two_sided_p("z"))))


def pairwise_contrasts(spark: SparkSession, fit: Fit, factor: str) -> DataFrame:
    """Contrasts of a factor's main effect; the baseline level has effect 0."""
    levels = fit.design.levels[factor]
    pick = np.zeros((len(levels), len(fit.names)))
    for row, level in enumerate(levels[1:], start=1):
        pick[row, fit.names.index(f"{factor}{level}")] = 1.0
    return contrasts(spark, levels, pick @ fit.beta, pick @ fit.vcov @ pick.T)


def coefficient_table(
    spark: SparkSession,
    fits: Mapping[str, Fit],
    group_name: str = "model",
    labels: Mapping[str, str] | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Slopes of one or more fits with +-1.96 SE, relabelled and stacked; a coefficient
    that a fit could not tell from others is null."""
    tables = [
        spark.createDataFrame(
            [
                (name, float(b), float(s)) if s > 0 else (name, None, None)
                for name, b, s in zip(fit.names, fit.beta, fit.std_errors)
                if name != "(Intercept)"
            ],
            "term string, estimate double, std_error double",
        ).withColumn(group_name, F.lit(label))
        for label, fit in fits.items()
    ]
    out = stack(*tables).withColumns(
        {
            "ci_low": F.col("estimate") - Z95 * F.col("std_error"),
            "ci_high": F.col("estimate") + Z95 * F.col("std_error"),
            "term": map_values("term", labels or {}),
        }
    )
    return out if order is None else out.withColumn("term_order", label_order("term", list(order)))
