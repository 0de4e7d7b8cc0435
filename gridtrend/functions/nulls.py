"""Null, NaN and zero rules.

``strict_*`` aggregates give null as soon as one value of the group is null;
``skipna_*`` aggregates ignore nulls, with sum of nothing 0 and mean of nothing
NaN. Plain Spark aggregates follow neither rule completely.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def all_present(x: Column | str) -> Column:
    return F.count(as_column(x)) == F.count(F.lit(1))


def strict_sum(x: Column | str) -> Column:
    return F.when(all_present(x), F.sum(as_column(x)))


def strict_mean(x: Column | str) -> Column:
    return F.when(all_present(x), F.avg(as_column(x)))


def strict_sd(x: Column | str) -> Column:
    """Sample standard deviation; null for one value or any null."""
    return F.when(all_present(x), F.stddev_samp(as_column(x)))


def skipna_sum(x: Column | str) -> Column:
    return F.coalesce(F.sum(as_column(x)), F.lit(0.0))


def skipna_mean(x: Column | str) -> Column:
    return F.coalesce(F.avg(as_column(x)), F.lit(NAN))


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division with 0/0 = NaN and x/0 = +-Inf instead of an ANSI error."""
    n = as_column(num).cast("double")
    d = as_column(den).cast("double")
    signed = F.when(n > 0, F.lit(INF)).when(n < 0, F.lit(-INF)).otherwise(n * F.lit(NAN))
    return F.when(d == 0, signed).otherwise(n / F.nullif(d, F.lit(0.0)))


def zero_for_nan(x: Column | str) -> Column:
    """NaN becomes 0 and null stays null."""
    c = as_column(x)
    return F.when(F.isnan(c), F.lit(0.0)).otherwise(c)


def not_in(x: Column | str, values: Iterable) -> Column:
    """Negated membership that keeps null rows."""
    return ~F.coalesce(as_column(x).isin(list(values)), F.lit(False))


def standard_error(x: Column | str, strict: bool = True) -> Column:
    """sd / sqrt(rows); rows include the nulls when they are skipped."""
    sd = strict_sd(x) if strict else F.stddev_samp(as_column(x))
    return sd / F.sqrt(F.count(F.lit(1)))
