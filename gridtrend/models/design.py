"""Model frames and treatment-coded design columns.

The first level of a factor is the baseline. Contrasts are written as plain
SQL columns because ``RFormula`` one-hot encodes every level inside an
interaction, which makes ``a + b + a:b`` singular.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtrend.operators.keys import distinct_levels
from gridtrend.session import cut


def variables(terms: Sequence[str]) -> list[str]:
    """Columns named in terms such as ``["year", "a:b"]``, in first-use order."""
    return list(dict.fromkeys(v for term in terms for v in term.split(":")))


@dataclass(frozen=True)
class Design:
    """Names and SQL expressions of the design columns; the first is the intercept."""

    names: tuple[str, ...]
    columns: tuple[str, ...]
    levels: dict[str, list]

    def x(self) -> Column:
        return F.expr(f"array({', '.join(self.columns)})")

    def linear(self, beta: Sequence[float]) -> str:
        """SQL of the linear predictor at given coefficients."""
        return " + ".join(f"({float(b)!r}D) * {c}" for b, c in zip(beta, self.columns))


def _literal(value) -> str:
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return repr(value)


def treatment_design(levels: dict[str, list], terms: Sequence[str]) -> Design:
    """Intercept plus the columns of each term; a variable without levels is numeric."""

    def parts(variable: str) -> list[tuple[str, str]]:
        if variable not in levels:
            return [(variable, f"CAST(`{variable}` AS DOUBLE)")]
        return [
            (f"{variable}{v}", f"CAST(`{variable}` = {_literal(v)} AS DOUBLE)")
            for v in levels[variable][1:]
        ]

    names, columns = ["(Intercept)"], ["1.0D"]
    for term in terms:
        for combination in product(*[parts(v) for v in term.split(":")]):
            names.append(":".join(name for name, _ in combination))
            columns.append("(" + " * ".join(sql for _, sql in combination) + ")")
    return Design(tuple(names), tuple(columns), dict(levels))


def model_frame(
    df: DataFrame, response: str, weight: str | None, columns: Sequence[str]
) -> DataFrame:
    """Complete cases of the model columns, with response ``y`` and weight ``w``."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    frame = df.select(*columns, F.col(response).cast("double").alias("y"), w.alias("w"))
    return frame.na.drop().filter(F.col("w") > 0)


def collapse(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per distinct combination, with the sums a binomial fit needs.

    Sum(w), Sum(wy) are sufficient for the coefficients; Sum(wyy) and the
    saturated log-likelihood keep the row-level Pearson statistic and deviance
    exact. Written once, since the fit scans it many times.
    """
    saturated = "w * (if(y > 0, y * ln(y), 0D) + if(y < 1, (1 - y) * ln(1 - y), 0D))"
    cells = frame.groupBy(*columns).agg(
        F.expr("sum(w) AS w"),
        F.expr("sum(w * y) AS wy"),
        F.expr("sum(w * y * y) AS wyy"),
        F.expr(f"sum({saturated}) AS saturated"),
        F.expr("count(1) AS n_rows"),
    )
    return cut(cells)


def factor_levels(cells: DataFrame, factors: Sequence[str]) -> dict[str, list]:
    return {f: distinct_levels(cells, f) for f in factors}
