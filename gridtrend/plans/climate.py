"""Daily weather to months, years, previous years, anomalies and z-scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrend.functions import labels
from gridtrend.functions.nulls import skipna_mean, skipna_sum, strict_mean, strict_sum
from gridtrend.functions.scalars import (
    hydrological_year,
    label_order,
    map_values,
    mid_month,
    month_in,
)
from gridtrend.operators.reshape import melt, pivot_unique, stack
from gridtrend.operators.timeline import prev_year, scale_columns
from gridtrend.session import cut

RAIN, TEMP = "precipitation", "temperature"
SUMMER_MONTHS = (6, 7, 8, 9)

ANOMALIES = {
    "ann_prec_anomaly": ("ann_prec", "annual_precipitation_gridded"),
    "ann_prec_prev_anomaly": ("ann_prec_prev", "annual_precipitation_gridded"),
    "summer_temp_anomaly": ("mean_summer_temp", "summer_temperature_gridded"),
    "summer_temp_prev_anomaly": ("mean_summer_temp_prev", "summer_temperature_gridded"),
}
SCALED = {
    "prec_grid_sc": "annual_precipitation_gridded",
    "temp_grid_sc": "summer_temperature_gridded",
    "ann_prec_sc": "ann_prec",
    "mean_summer_temp_sc": "mean_summer_temp",
    "ann_prec_prev_sc": "ann_prec_prev",
    "mean_summer_temp_prev_sc": "mean_summer_temp_prev",
    "ann_prec_anomaly_sc": "ann_prec_anomaly",
    "summer_temp_anomaly_sc": "summer_temp_anomaly",
    "ann_prec_prev_anomaly_sc": "ann_prec_prev_anomaly",
    "summer_temp_prev_anomaly_sc": "summer_temp_prev_anomaly",
}


def sum_or_mean(variable: str, value: str, summed: str = RAIN) -> Column:
    """Aggregate for a long table: a strict sum for one variable, else a mean."""
    is_sum = F.max(F.col(variable) == summed)
    return F.when(is_sum, strict_sum(value)).otherwise(strict_mean(value)).alias(value)


def monthly_climate(daily: DataFrame) -> DataFrame:
    """(date = 15th, site, logger, value): summed rain and mean temperature.

    The wide daily rows are aggregated before they are melted, so the shuffle
    carries one row per site and month of each task instead of two per day.
    """
    months = daily.groupBy(mid_month("date").alias("date"), "site").agg(
        strict_mean(TEMP).alias(TEMP), strict_sum(RAIN).alias(RAIN)
    )
    return melt(months, ["date", "site"], [TEMP, RAIN], "logger", "value")


def monthly_from_long(daily_long: DataFrame) -> DataFrame:
    """The same from rows that are already (date, site, logger, value)."""
    value = sum_or_mean("logger", "value")
    return daily_long.groupBy(mid_month("date").alias("date"), "site", "logger").agg(value)


def summer_mean(
    monthly: DataFrame, months: Sequence[int] = SUMMER_MONTHS, skipna: bool = False
) -> DataFrame:
    """Mean of the monthly means of the summer months, per calendar year."""
    mean = skipna_mean if skipna else strict_mean
    return (
        monthly.filter((F.col("logger") == TEMP) & month_in("date", months))
        .groupBy(F.year("date").alias("year"), "site")
        .agg(mean("value").alias("value"))
        .withColumn("logger", F.lit("mean_summer_temp"))
    )


def hydrological_rain(monthly: DataFrame) -> DataFrame:
    """August to July sums; incomplete first and last years are kept."""
    return (
        monthly.filter(F.col("logger") == RAIN)
        .groupBy(hydrological_year("date").alias("year"), "site", "logger")
        .agg(strict_sum("value").alias("value"))
    )


def annual_climate(monthly: DataFrame, site_names: Mapping[str, str] | None = None) -> DataFrame:
    """(year, site, ann_prec, mean_summer_temp) with full site names."""
    names = labels.SITE_NAMES if site_names is None else site_names
    long = stack(hydrological_rain(monthly), summer_mean(monthly))
    return pivot_unique(long, ["year", "site"], "logger", "value", ["mean_summer_temp", RAIN]).select(
        "year",
        map_values("site", names).alias("site"),
        F.col(RAIN).alias("ann_prec"),
        "mean_summer_temp",
    )


def with_prev_year(annual: DataFrame) -> DataFrame:
    return prev_year(
        annual,
        ["site"],
        "year",
        {"ann_prec_prev": "ann_prec", "mean_summer_temp_prev": "mean_summer_temp"},
    )


def climate_table(
    annual: DataFrame, meta: DataFrame, site_levels: DataFrame | None = None
) -> DataFrame:
    """Annual table with previous year, anomalies, z-scores and level labels.

    z-scores are taken over the joined site-year rows: a site counts once per
    year, and they are not recomputed after the join to the survey. The small
    site-year table is written once, because the scaling reads it twice.
    """
    normals = meta.withColumnRenamed("site_id", "__site")
    joined = (
        with_prev_year(annual)
        .join(normals, F.col("site").eqNullSafe(F.col("__site")), "left")
        .drop("__site")
    )
    with_anomalies = cut(
        joined.withColumns(
            {new: F.col(value) - F.col(normal) for new, (value, normal) in ANOMALIES.items()}
        )
    )
    scaled = scale_columns(with_anomalies, SCALED)
    return scaled if site_levels is None else with_site_levels(scaled, site_levels)


def fixed_site_levels(spark: SparkSession) -> DataFrame:
    """The grid's twelve sites as (site, temperature_level, precipitation_level)."""
    return spark.createDataFrame(
        labels.SITE_LEVELS, "site string, temperature_level int, precipitation_level int"
    )


def with_site_levels(
    climate: DataFrame,
    site_levels: DataFrame,
    temperature: Mapping[int, str] | None = None,
    precipitation: Mapping[int, str] | None = None,
) -> DataFrame:
    """Level labels and display order by site; an unknown site has none."""
    temperature = temperature or labels.TEMPERATURE_LABELS
    precipitation = precipitation or labels.PRECIPITATION_MM_LABELS

    def label(column: str, mapping: Mapping[int, str]) -> Column:
        return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])[F.col(column)]

    classes = site_levels.select(
        "site",
        label("temperature_level", temperature).alias("temp_level"),
        label("precipitation_level", precipitation).alias("prec_level"),
    ).withColumns(
        {
            "temp_order": label_order("temp_level", list(temperature.values())),
            "prec_order": label_order("prec_level", list(precipitation.values())),
        }
    )
    return climate.join(classes, "site", "left")


def calendar_climate(monthly: DataFrame) -> DataFrame:
    """Older variant: calendar-year rain, mean temperature and summer mean, nulls skipped."""
    year = F.year("date").alias("year")
    annual = (
        monthly.filter(F.col("logger").isin(RAIN, TEMP))
        .groupBy("site", year)
        .agg(
            skipna_sum(F.when(F.col("logger") == RAIN, F.col("value"))).alias("ann_prec"),
            skipna_mean(F.when(F.col("logger") == TEMP, F.col("value"))).alias("mean_temp"),
        )
    )
    long = melt(annual, ["site", "year"], ["mean_temp", "ann_prec"], "variable", "value")
    summer = summer_mean(monthly, skipna=True).withColumnRenamed("logger", "variable")
    return pivot_unique(
        stack(long, summer),
        ["site", "year"],
        "variable",
        "value",
        ["ann_prec", "mean_temp", "mean_summer_temp"],
    )


def calendar_points(monthly: DataFrame, months: Sequence[int] = SUMMER_MONTHS) -> DataFrame:
    """Calendar-year rain of all months beside the mean of the summer months."""
    in_scope = ((F.col("logger") == TEMP) & month_in("date", months)) | (
        F.col("logger") == RAIN
    )
    value = sum_or_mean("logger", "value")
    long = monthly.filter(in_scope).groupBy(F.year("date").alias("year"), "site", "logger").agg(value)
    return pivot_unique(long, ["year", "site"], "logger", "value", [RAIN, TEMP])
