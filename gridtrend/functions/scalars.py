"""Scalar functions on columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtrend.functions.nulls import INF, as_column


def map_values(x: Column | str, mapping: Mapping) -> Column:
    """Replace listed values; anything else passes through unchanged."""
    c = as_column(x)
    if not mapping:
        return c
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.coalesce(F.create_map(*pairs)[c], c)


def label_order(x: Column | str, levels: list[str]) -> Column:
    """1-based display position of a label; null for an unknown label."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), as_column(x))
    return F.when(pos > 0, pos).cast("int")


def year_to_date(x: Column | str) -> Column:
    return F.make_date(as_column(x), F.lit(1), F.lit(1))


def mid_month(x: Column | str) -> Column:
    """The 15th of the month of a date."""
    return F.date_add(F.trunc(as_column(x).cast("date"), "MM"), 14)


def hydrological_year(x: Column | str, last_month: int = 7) -> Column:
    """Year that ends with ``last_month``; later months count to the next one."""
    d = as_column(x)
    return F.year(d) + F.when(F.month(d) > last_month, 1).otherwise(0)


def natural_log(x: Column | str) -> Column:
    """ln with ln(0) = -Inf."""
    c = as_column(x)
    return F.when(c == 0, F.lit(-INF)).otherwise(F.ln(c))


def neg_log(x: Column | str) -> Column:
    return natural_log(x) * F.lit(-1.0)


def logit(p: Column | str) -> Column:
    c = as_column(p)
    return (
        F.when(c == 0, F.lit(-INF))
        .when(c == 1, F.lit(INF))
        .otherwise(F.ln(c) - F.ln(F.lit(1.0) - c))
    )


def expit(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_column(x)))


def log_choose(n: Column | str, k: Column | str) -> Column:
    """ln of the binomial coefficient, as a sum of k logs."""
    nn, kk = as_column(n).cast("int"), as_column(k).cast("int")
    terms = F.aggregate(
        F.sequence(F.lit(1), kk),
        F.lit(0.0),
        lambda acc, i: acc + F.ln((nn - kk + i).cast("double") / i.cast("double")),
    )
    return F.when(kk <= 0, F.lit(0.0)).otherwise(terms)


def hashed_uniform(*parts: Column | str) -> Column:
    """Uniform in [0, 1) that depends on the given values only.

    The first 13 hex digits (52 bits) of an MD5 over the joined values: the
    same row gives the same number at any partitioning, after a retry, and in
    any other engine that has MD5.
    """
    text = F.concat_ws("|", *[as_column(p).cast("string") for p in parts])
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10)
    return digits.cast("double") / F.lit(float(2**52))


def month_in(x: Column | str, months) -> Column:
    return F.month(as_column(x)).isin(list(months))
