"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtrend.session import cut


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: Sequence[float]
) -> DataFrame:
    """(keys, prob, quantile) by linear interpolation between order statistics.

    The ``percentile`` aggregate keeps a whole group in one task. Here equal
    values are counted first, the counts are range-sorted over all tasks, and
    the running totals of the range partitions tell which of them hold the
    wanted ranks; only those partitions are looked at again.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    placed = cut(
        counted.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id())
    )
    # one row per key and range partition
    parts = placed.groupBy(*keys, "__part").agg(F.sum("__c").alias("__size"))
    along = Window.partitionBy(*keys).orderBy("__part")
    whole = Window.partitionBy(*keys)
    bounds = parts.select(
        *keys,
        "__part",
        (F.sum("__size").over(along) - F.col("__size")).alias("__first"),
        F.col("__size"),
        F.sum("__size").over(whole).alias("__n"),
    )
    wanted = bounds.select(
        "*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    ).withColumn("__rank", F.col("prob") * (F.col("__n") - 1))
    ranks = wanted.select(
        *keys,
        "__part",
        "__first",
        "__size",
        "prob",
        "__rank",
        F.explode(F.array_distinct(F.array(F.floor("__rank"), F.ceil("__rank")))).alias("__at"),
    ).filter((F.col("__at") >= F.col("__first")) & (F.col("__at") < F.col("__first") + F.col("__size")))

    involved = placed.join(ranks.select(*keys, "__part").distinct(), [*keys, "__part"], "left_semi")
    within = Window.partitionBy(*keys, "__part").orderBy(value)
    numbered = involved.select(
        *keys, "__part", value, "__c", (F.sum("__c").over(within) - F.col("__c")).alias("__before")
    )
    local = F.col("__at") - F.col("__first")
    hits = numbered.join(ranks, [*keys, "__part"]).filter(
        (local >= F.col("__before")) & (local < F.col("__before") + F.col("__c"))
    )
    low, high = F.min(value), F.max(value)
    part = F.max(F.col("__rank") - F.floor("__rank"))
    return hits.groupBy(*keys, "prob").agg((low + (high - low) * part).alias("quantile"))
