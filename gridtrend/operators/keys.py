"""Row ids, dense category indexes and level grids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtrend.operators.groups import attach
from gridtrend.session import cut, cut_ordered

LEVEL_LIMIT = 10_000


def row_id(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """1..n in the given total order, without a single-partition window.

    The rows are range-sorted and written once; a row's number is its position
    in its partition plus the sizes of the partitions before it. Only those
    sizes (one number per partition) meet in one place.
    """
    ordered = cut_ordered(df.orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    at = F.monotonically_increasing_id()
    placed = ordered.withColumn("__at", at).select(
        *df.columns,
        F.shiftright("__at", 33).alias("__part"),
        F.col("__at").bitwiseAND(F.lit(2**33 - 1)).alias("__pos"),
    )
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before")
    )
    return placed.join(F.broadcast(offsets), "__part").select(
        (F.col("__before") + F.col("__pos") + 1).alias(name), *df.columns
    )


def running_max(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Add the largest ``value`` up to each row in the order of a unique column.

    Rows are range-sorted and written once; a window reaches over a partition, and one
    row of maxima per partition tells what lies before it.
    """
    ordered = cut_ordered(df.orderBy(order))
    at = F.monotonically_increasing_id()
    placed = ordered.withColumn("__part", F.shiftright(at, 33))
    here = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy("__part").agg(F.max(value).alias("m"))
    packed = parts.agg(F.sort_array(F.collect_list(F.struct("__part", "m"))).alias("all"))
    before = packed.select(F.explode(F.expr(
        "transform(all, (x, i) -> struct(x.__part AS __part, array_max(transform(slice(all, 1, i), y -> y.m)) AS __before))"
    )).alias("x")).select("x.*")
    joined = placed.join(F.broadcast(before), "__part")
    return joined.withColumn(name, F.greatest(F.max(value).over(here), "__before")).select(*df.columns, name)


def level_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct non-null values of a column with their rank 1..K and row count."""
    levels = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("__rows"))
    )
    return row_id(levels, [column], name).withColumn(name, F.col(name).cast("int"))


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the 1..K code-point rank of a category; null stays null."""
    return attach(df, level_index(df, column, name), [column], "__rows")


def distinct_levels(df: DataFrame, column: str, limit: int = LEVEL_LIMIT) -> list:
    """Sorted levels of a factor. Levels become columns or grid rows, so more
    than ``limit`` of them is an error, never a cut."""
    found = df.filter(F.col(column).isNotNull()).select(column).distinct().take(limit + 1)
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels")
    return sorted(r[0] for r in found)


def level_grid(spark: SparkSession, levels: dict[str, Sequence]) -> DataFrame:
    """Every combination of the given level lists."""
    grid = spark.range(1).select()
    for name, values in levels.items():
        options = F.array(*[F.lit(v) for v in values])
        grid = grid.select(*grid.columns, F.explode(options).alias(name))
    return grid


def level_product(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every combination of the non-null levels of some columns.

    Each column's levels are numbered 0..K-1 in order; the grid is a range of as many
    numbers as there are combinations, whose digits (in the mixed base of the level
    counts) are joined to the level tables. Only the counts come to the driver. A column
    without levels gives an empty grid.
    """
    tables, counts = [], []
    for c in columns:
        tables.append(cut(level_index(df, c, "__at").select(c, (F.col("__at") - 1).cast("long").alias(f"__{c}"))))
        counts.append(tables[-1].count())
    size, below = math.prod(counts), F.col("id")
    digits = []
    for c, n in zip(columns, counts):
        digits.append((below % F.lit(max(1, n))).alias(f"__{c}"))
        below = F.floor((below - below % F.lit(max(1, n))) / F.lit(max(1, n)))  # exact: no remainder
    grid = df.sparkSession.range(size).select(*digits)
    for c, t in zip(columns, tables):
        grid = grid.join(t, f"__{c}")
    return grid.select(*columns)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Raise if a dimension key repeats (a join on it would fan out)."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1)
    if repeated:
        raise ValueError(f"duplicate key {repeated[0].asDict()}")
    return df
