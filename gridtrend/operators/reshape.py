"""Wide to long, long to wide, and stacking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrend.operators.keys import distinct_levels


def melt(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], key: str, value: str
) -> DataFrame:
    return df.unpivot(list(ids), list(values), key, value)


def melt_outside_range(df: DataFrame, first: str, last: str, key: str, value: str) -> DataFrame:
    """Melt every column except the positional range ``first``..``last``."""
    names = df.columns
    kept = names[names.index(first) : names.index(last) + 1]
    return melt(df, kept, [c for c in names if c not in kept], key, value)


def pivot_unique(
    df: DataFrame, ids: Sequence[str], key: str, value: str, keys: Sequence[str]
) -> DataFrame:
    """One column per listed key in one shuffle; a repeated key is an error."""
    columns = []
    for k in keys:
        here = F.col(key) == F.lit(k)
        repeated = F.raise_error(F.lit(f"duplicate rows for {key}={k}"))
        columns.append(
            F.when(F.count(F.when(here, F.lit(1))) > 1, repeated)
            .otherwise(F.max(F.when(here, F.col(value))))
            .alias(k)
        )
    return df.groupBy(*ids).agg(*columns)


def pivot_found(
    df: DataFrame, ids: Sequence[str], key: str, value: str, limit: int = 1_000
) -> DataFrame:
    """``pivot_unique`` over the keys present in the data, sorted."""
    return pivot_unique(df, ids, key, value, distinct_levels(df, key, limit))


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
