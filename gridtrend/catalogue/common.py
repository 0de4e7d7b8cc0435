"""Helpers for catalogue queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtrend.functions.nulls import as_column


def near(value: Column | str, digits: int) -> Column:
    """Round for comparison with an engine that sums in another order.

    The shift moves exact decimal ties, which the last bit of a sum would
    decide, off the rounding boundary; the oracles apply the same shift.
    """
    return F.round(F.lit(float(f"1.23e-{digits + 3}")) + as_column(value), digits)


def rnd(column: str, digits: int) -> Column:
    return near(column, digits).alias(column)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: near(c, digits) for c in columns})
