"""Joins survey, climate and traits, and keeps the rows fit for modelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrend.functions import labels
from gridtrend.functions.nulls import ratio, zero_for_nan
from gridtrend.operators.groups import attach, group_count_filter
from gridtrend.session import cut


def join_climate(fertile: DataFrame, climate: DataFrame) -> DataFrame:
    """Left join on site, year and the two normals; nulls match, rows stay.

    The doubles match because both sides carry the same stored value.
    """
    pairs = {
        "site_id": "site",
        "year": "year",
        "summer_temperature_gridded": "summer_temperature_gridded",
        "annual_precipitation_gridded": "annual_precipitation_gridded",
    }
    right = climate.withColumnsRenamed({c: f"__c_{c}" for c in pairs.values()})
    same = F.lit(True)
    for left_name, right_name in pairs.items():
        same = same & F.col(left_name).eqNullSafe(F.col(f"__c_{right_name}"))
    return fertile.join(right, same, "left").drop(*[f"__c_{c}" for c in pairs.values()])


def join_traits(fertile: DataFrame, traits: DataFrame) -> DataFrame:
    right = traits.withColumnRenamed("species", "__species")
    return fertile.join(right, F.col("species").eqNullSafe(F.col("__species")), "left").drop(
        "__species"
    )


def with_relative_fertility(rows: DataFrame) -> DataFrame:
    """Species mean, relative fertility and site-by-species fertile sum.

    Both groupings come from one aggregation at site x species grain: the
    species totals are sums of that small table, and one join brings
    everything back. Strict: a null in the group makes its statistic null.
    """
    cells = cut(
        rows.groupBy("site_id", "species").agg(
            F.sum("prop_fertile").alias("p_sum"),
            F.count("prop_fertile").alias("p_n"),
            F.sum("sum_fertile").alias("f_sum"),
            F.count("sum_fertile").alias("f_n"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    species = cells.groupBy("species").agg(
        F.when(F.sum("p_n") == F.sum("rows"), F.sum("p_sum") / F.sum("rows")).alias("mean_fertile")
    )
    species = species.withColumnRenamed("species", "__species")
    stats = cells.join(species, F.col("species").eqNullSafe(F.col("__species")), "left").select(
        "site_id",
        "species",
        "mean_fertile",
        F.when(F.col("f_n") == F.col("rows"), F.col("f_sum")).alias("site_species_fertile"),
        F.col("rows").alias("__rows"),
    )
    out = attach(rows, stats, ["site_id", "species"], "__rows", written=True)
    return out.withColumn("rel_fertile", zero_for_nan(ratio("prop_fertile", "mean_fertile")))


def curate(
    fertile_raw: DataFrame,
    climate: DataFrame,
    traits: DataFrame,
    excluded_years: Sequence[int] = (2010,),
    min_rows: int = 3,
    groups: Sequence[str] = tuple(labels.KEPT_GROUPS),
) -> DataFrame:
    """Year, group-size, functional-group and never-fertile filters, in this order.

    Each step sees only the survivors of the one before. The climate join adds
    columns but neither rows nor filters, so it comes last, on what is left.
    """
    rows = join_traits(fertile_raw, traits)
    for year in excluded_years:
        rows = rows.filter(F.col("year") != year)
    # one row per turf, species and year: a group is bounded by the years
    rows = group_count_filter(rows, ["turf_id", "species"], min_rows, "n_years", small_groups=True)
    rows = cut(rows.filter(F.col("functional_group").isin(list(groups))))
    kept = with_relative_fertility(rows).filter(F.col("site_species_fertile") != 0)
    return join_climate(kept, climate)


def common_species(
    fertile: DataFrame, min_occurrence: int = 20, min_rows: int = 7
) -> DataFrame:
    """Rows of species seen often somewhere, in species-years with enough rows."""
    common = fertile.filter(F.col("n_occurrence") > min_occurrence).select("species").distinct()
    rows = fertile.join(common, "species", "left_semi")
    return group_count_filter(rows, ["year", "species"], min_rows)
