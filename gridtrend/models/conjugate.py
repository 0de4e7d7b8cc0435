"""Exact beta-binomial posterior per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrend.functions.nulls import strict_sum


def beta_posterior(
    df: DataFrame, keys: Sequence[str], k: str, n: str, a: float = 2.0, b: float = 2.0
) -> DataFrame:
    """Beta(a + sum k, b + sum(n - k)) with its mean and variance; () is one group."""
    out = df.groupBy(*keys).agg(
        (F.lit(a) + strict_sum(k)).alias("alpha"),
        (F.lit(b) + strict_sum(F.col(n) - F.col(k))).alias("beta"),
    )
    total = F.col("alpha") + F.col("beta")
    return out.withColumns(
        {
            "mean": F.col("alpha") / total,
            "variance": F.col("alpha") * F.col("beta") / (total * total * (total + 1)),
        }
    )
