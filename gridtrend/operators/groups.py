"""Group statistics brought back to the rows, and filters on them.

A window over the group would put one whole group into one task, which fails
when a group holds a large share of the rows. Here the statistics are
aggregated first (partial aggregation on the map side), written once, and
joined back in one of two ways, chosen by their counted size:

* few groups: broadcast join, the rows are not shuffled at all;
* many groups: the ``HOT_GROUPS`` largest groups are broadcast and their rows
  are spread over slices, so the shuffle join only ever co-locates groups that
  each hold less than 1 / HOT_GROUPS of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtrend.functions.nulls import ratio, strict_mean, strict_sum, zero_for_nan
from gridtrend.session import cut

BROADCAST_ROWS = 500_000
HOT_GROUPS = 1_000
SLICES = 4_096


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _renamed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(
        *[F.col(k).alias(f"{prefix}{k}") for k in keys],
        F.col("__stat").alias(f"{prefix}stat"),
    )


def attach(
    df: DataFrame,
    stats: DataFrame,
    keys: list[str],
    weight: str,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_groups: int = HOT_GROUPS,
    written: bool = False,
    size: int | None = None,
) -> DataFrame:
    """Left-join ``stats`` (one row per group) to ``df``; null keys match.

    ``weight`` is the column of ``stats`` with the number of rows of ``df`` per
    group; it only ranks the groups and is not part of the result. ``written``
    says that ``stats`` already reads from a checkpoint, ``size`` its row count
    where that is known.
    """
    wanted = [c for c in stats.columns if c not in keys and c != weight]
    stats = stats if written else cut(stats)
    packed = stats.select(*keys, F.struct(*wanted).alias("__stat"), weight)
    fields = [F.col(f"__stat.{c}").alias(c) for c in wanted]

    if (stats.count() if size is None else size) <= broadcast_rows:
        right = F.broadcast(_renamed(packed, keys, "__k_"))
        same = _all([F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
        joined = df.join(right, same, "left").withColumn("__stat", F.col("__k_stat"))
        return joined.select(*df.columns, *fields)

    largest = packed.orderBy(F.col(weight).desc(), *keys).limit(hot_groups)
    hot = F.broadcast(_renamed(largest, keys, "__h_"))
    on_hot = _all([F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys])
    spread = F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), F.lit(SLICES)) + 1
    left = df.join(hot, on_hot, "left").select(
        *df.columns,
        F.col("__h_stat"),
        F.when(F.col("__h_stat").isNull(), F.lit(0)).otherwise(spread).alias("__slice"),
    )
    right = _renamed(packed, keys, "__k_").withColumn("__k_slice", F.lit(0))
    same = _all(
        [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
        + [F.col("__slice") == F.col("__k_slice")]
    )
    joined = left.join(right, same, "left").withColumn(
        "__stat", F.coalesce(F.col("__h_stat"), F.col("__k_stat"))
    )
    return joined.select(*df.columns, *fields)


def attach_group_stats(
    df: DataFrame, keys: list[str], aggregates: dict[str, Column], **sizes: int
) -> DataFrame:
    """Add aggregates of each row's group as columns."""
    stats = df.groupBy(*keys).agg(
        *[agg.alias(name) for name, agg in aggregates.items()],
        F.count(F.lit(1)).alias("__rows"),
    )
    return attach(df, stats, keys, "__rows", **sizes)


def group_count_filter(
    df: DataFrame, keys: list[str], more_than: int, name: str = "n", small_groups: bool = False
) -> DataFrame:
    """Keep rows whose group has more than ``more_than`` rows; adds the count.

    ``small_groups`` is for inputs whose groups are bounded by construction
    (one row per year); a window then needs one shuffle and no second pass.
    """
    if small_groups:
        counted = df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    else:
        counted = attach_group_stats(df, keys, {name: F.count(F.lit(1))})
    return counted.filter(F.col(name) > more_than)


def group_sum_filter(
    df: DataFrame, keys: list[str], value: str, name: str = "group_sum"
) -> DataFrame:
    """Drop groups whose strict sum is 0 or null; adds the sum."""
    return attach_group_stats(df, keys, {name: strict_sum(value)}).filter(F.col(name) != 0)


def ratio_to_group_mean(
    df: DataFrame, keys: list[str], value: str, mean_name: str, ratio_name: str
) -> DataFrame:
    """Value over the strict group mean; 0/0 gives 0 and null stays null."""
    out = attach_group_stats(df, keys, {mean_name: strict_mean(value)})
    return out.withColumn(ratio_name, zero_for_nan(ratio(value, mean_name)))


def longest_runs(df: DataFrame, keys: list[str], year: str) -> DataFrame:
    """Longest run of consecutive years per group, with the group's row count.

    Rows collapse to one per group and year before the window, so a window
    partition holds at most one row per calendar year.
    """
    years = df.groupBy(*keys, year).agg(F.count(F.lit(1)).alias("__rows"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(year).asc_nulls_last()))
    islands = years.withColumn("__island", F.col(year) - rank)
    runs = islands.groupBy(*keys, "__island").agg(
        F.count(F.col(year)).alias("__run"), F.sum("__rows").alias("__rows")
    )
    return runs.groupBy(*keys).agg(
        F.max("__run").cast("int").alias("longest_run"), F.sum("__rows").alias("__rows")
    )


def consecutive_run(df: DataFrame, keys: list[str], year: str, at_least: int) -> DataFrame:
    """Keep rows of groups seen in ``at_least`` consecutive years."""
    runs = longest_runs(df, keys, year)
    return attach(df, runs, keys, "__rows").filter(F.col("longest_run") >= at_least)
