"""Columns taken from other rows of the same time line, and whole-table scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtrend.functions.nulls import ratio


def prev_year(
    df: DataFrame, keys: list[str], year: str, columns: dict[str, str]
) -> DataFrame:
    """Value of exactly the year before (``columns``: new name -> column).

    A range frame, so a gap in the years gives null. The input is one row per
    key and year, which bounds a window partition by the number of years.
    """
    before = Window.partitionBy(*keys).orderBy(year).rangeBetween(-1, -1)
    return df.withColumns({new: F.first(old).over(before) for new, old in columns.items()})


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with a struct (mean, sd) per column."""
    return df.agg(
        F.struct(
            *[
                F.struct(
                    F.avg(c).alias("mean"),
                    F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd"),
                ).alias(c)
                for c in columns
            ]
        ).alias("moments")
    )


def scale_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Centre and scale over all rows (``columns``: new name -> column).

    One aggregation gives every mean and sd; it comes back as a scalar
    subquery. A constant or single value scales to NaN; null stays null.
    """
    m = moments(df, list(dict.fromkeys(columns.values()))).scalar()
    with_moments = df.withColumn("__moments", m)
    return with_moments.withColumns(
        {
            new: ratio(F.col(old) - F.col(f"__moments.{old}.mean"), F.col(f"__moments.{old}.sd"))
            for new, old in columns.items()
        }
    ).drop("__moments")
