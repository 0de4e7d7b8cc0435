"""Summary tables and the data under the figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrend.functions import labels
from gridtrend.functions.nulls import skipna_mean, standard_error, strict_mean
from gridtrend.functions.scalars import label_order, map_values, neg_log, year_to_date
from gridtrend.operators.groups import group_count_filter
from gridtrend.operators.reshape import stack


def mean_se(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Strict mean, row count and standard error per group."""
    return df.groupBy(*keys).agg(
        strict_mean(value).alias("mean"),
        F.count(F.lit(1)).alias("n"),
        standard_error(value).alias("se"),
    )


def proportion_over_time(fertile: DataFrame) -> DataFrame:
    """Mean proportion with its error bar per year and grid cell."""
    out = mean_se(fertile, ["year", "temperature_level", "precipitation_level"], "prop_fertile")
    return out.withColumns(
        {"lower": F.col("mean") - F.col("se"), "upper": F.col("mean") + F.col("se")}
    )


def level_label(column: str, mapping: Mapping[int, str]):
    """Label of an integer level; a level that is not listed keeps its digits."""
    return map_values(F.col(column).cast("string"), {str(k): v for k, v in mapping.items()})


def single_species(
    fertile: DataFrame,
    species_names: Mapping[str, str],
    min_rows: int = 2,
    temperature: Mapping[int, str] | None = None,
    precipitation: Mapping[int, str] | None = None,
) -> DataFrame:
    """Time series of chosen species by grid cell, for site-years with enough rows."""
    temperature = temperature or labels.TEMPERATURE_LABELS
    precipitation = precipitation or labels.PRECIPITATION_MM_LABELS
    chosen = fertile.filter(F.col("species").isin(list(species_names)))
    chosen = group_count_filter(chosen, ["year", "species", "site_id"], min_rows, "n_block")
    out = mean_se(
        chosen, ["year", "temperature_level", "precipitation_level", "species"], "prop_fertile"
    )
    return out.select(
        F.year(year_to_date("year")).alias("year"),
        level_label("temperature_level", temperature).alias("temperature_label"),
        level_label("precipitation_level", precipitation).alias("prec_mm"),
        map_values("species", species_names).alias("species_name"),
        "mean",
        "n",
        "se",
    ).withColumns(
        {
            "temperature_order": label_order("temperature_label", list(temperature.values())),
            "prec_order": label_order("prec_mm", list(precipitation.values())),
        }
    )


def response_and_climate(
    df: DataFrame, keys: Sequence[str], response: str, climate: str
) -> DataFrame:
    """Means that skip nulls, with errors over all rows of the group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        skipna_mean(response).alias("mean_response"),
        standard_error(response, strict=False).alias("se_response"),
        skipna_mean(climate).alias("mean_climate"),
        standard_error(climate, strict=False).alias("se_climate"),
    )


def space_time(df: DataFrame, response: str, climate: str) -> DataFrame:
    """Site means (space) stacked on year-by-site means (time)."""
    space = response_and_climate(df, ["site_id"], response, climate)
    time = response_and_climate(df, ["year", "site_id"], response, climate)
    return stack(
        space.withColumn("model", F.lit("space")), time.withColumn("model", F.lit("time"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts, one row, from one pass over the input.

    Grouping sets, one for each column, give its distinct values; a second aggregation
    counts the rows of each set. No task sees the whole set of values.
    """
    named = [f"__c{i}" for i in range(len(columns))]
    plain = df.select(*[F.col(c).alias(n) for c, n in zip(columns, named)])
    seen = plain.groupingSets([[F.col(n)] for n in named], *named).agg(F.count(F.lit(1)).alias("__rows"))
    return seen.agg(*[F.count(n).alias(f"n_{c}") for c, n in zip(columns, named)])


def turf_series(fertile: DataFrame, min_rows: int = 2) -> DataFrame:
    """One ordered (year, proportion) series per turf and species.

    The input has one row per turf, species and year, which bounds a series by
    the number of survey years.
    """
    return (
        fertile.groupBy("turf_id", "species", "functional_group")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sort_array(F.collect_list(F.struct("year", "prop_fertile"))).alias("series"),
        )
        .filter(F.col("n") > min_rows)
    )


def treatment_points(
    fertile: DataFrame,
    groups: Mapping[str, str] | None = None,
    order: Sequence[str] = tuple(labels.TREATMENT_ORDER),
) -> DataFrame:
    groups = labels.TREATMENT_GROUPS if groups is None else groups
    return fertile.select(
        "turf_id",
        "year",
        "species",
        "functional_group",
        "temperature_level",
        map_values("treatment", groups).alias("treatment_group"),
        "prop_fertile",
    ).withColumn("treatment_order", label_order("treatment_group", list(order)))


def climate_points(climate: DataFrame, rain_factor: float = 1.0) -> DataFrame:
    """Temperature and rain of each site-year with its level labels."""
    return climate.select(
        "site",
        "year",
        "mean_summer_temp",
        (F.col("ann_prec") * rain_factor).alias("ann_prec"),
        "temp_level",
        "prec_level",
        "prec_order",
    )


def panel_points(fertile: DataFrame, min_years: int = 3, min_rows: int = 1) -> DataFrame:
    """Proportion against summer temperature, with the older filters."""
    kept = group_count_filter(fertile, ["turf_id", "species"], min_years - 1, "n_panel_years", True)
    kept = group_count_filter(kept, ["site_id", "species", "year"], min_rows, "n_plots")
    return kept.withColumns(
        {"neg_log_prop": neg_log("prop_fertile"), "year_start": year_to_date("year")}
    )


def line_fit(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares line per group over rows that have both values."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def pixel_box(
    pixels: DataFrame, x_range: tuple[float, float], y_range: tuple[float, float]
) -> DataFrame:
    return pixels.filter(F.col("x").between(*x_range) & F.col("y").between(*y_range))
