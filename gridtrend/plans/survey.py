"""Sub-plot records to one row per turf, year and species, and the dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtrend.functions import labels
from gridtrend.functions.nulls import ratio, strict_sum
from gridtrend.functions.scalars import label_order, map_values
from gridtrend.operators.reshape import pivot_found

SITE_COLUMNS = [
    "site_id",
    "temperature_level",
    "precipitation_level",
    "annual_precipitation_gridded",
    "summer_temperature_gridded",
]
FERTILE_COLUMNS = [
    "turf_id",
    "year",
    "species",
    "site_id",
    "block_id",
    "origin_plot_id",
    "treatment",
    *SITE_COLUMNS[1:],
]


def fertility_rollup(
    community: DataFrame,
    turfs: DataFrame,
    plots: DataFrame,
    blocks: DataFrame,
    sites: DataFrame,
    treatments: Sequence[str] | None = tuple(labels.CONTROL_TREATMENTS),
) -> DataFrame:
    """Fertile count, occurrence count and proportion per turf, year, species.

    The records are aggregated on their own keys before any join, so the big
    table is shuffled once, already reduced, and a turf that holds a large
    share of the records is one row per year and species when it is joined.
    Dimension keys must be unique (``require_unique``). The treatment
    predicate makes the turf join an inner join; without it the join is left.
    """
    counted = community.groupBy("turf_id", "year", "species").agg(
        strict_sum("fertile").alias("sum_fertile"),
        F.count(F.lit(1)).alias("n_occurrence"),
    )
    turf = turfs.select("turf_id", "treatment", "origin_plot_id")
    if treatments is None:
        located = counted.join(turf, "turf_id", "left")
    else:
        located = counted.join(turf.filter(F.col("treatment").isin(list(treatments))), "turf_id")
    plot = plots.select(F.col("plot_id").alias("origin_plot_id"), "block_id")
    return (
        located.join(plot, "origin_plot_id", "left")
        .join(blocks.select("block_id", "site_id"), "block_id", "left")
        .join(sites.select(*SITE_COLUMNS), "site_id", "left")
        .select(
            *FERTILE_COLUMNS,
            "sum_fertile",
            "n_occurrence",
            ratio("sum_fertile", "n_occurrence").alias("prop_fertile"),
            F.when(F.col("treatment").isNull(), "removal").otherwise("gradient").alias("experiment"),
        )
    )


def site_meta(fertile_raw: DataFrame) -> DataFrame:
    return fertile_raw.select(
        "site_id", "summer_temperature_gridded", "annual_precipitation_gridded"
    ).distinct()


def trait_table(
    character_traits: DataFrame,
    taxon: DataFrame,
    dropped: Sequence[str] = tuple(labels.DROPPED_TRAITS),
    renamed: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per species: taxon columns, one column per trait, repaired codes."""
    renamed = labels.RENAMED_TRAITS if renamed is None else renamed
    wide = pivot_found(character_traits, ["species"], "trait", "value")
    wide = wide.drop(*dropped).withColumnsRenamed(dict(renamed))
    repairs = {
        "season_finish": labels.FINISH_REPAIRS,
        "season_start": labels.START_REPAIRS,
    }
    fixed = {c: map_values(c, m) for c, m in repairs.items() if c in wide.columns}
    return wide.withColumns(fixed).join(taxon, "species", "left")


def _level_label(column: str, mapping: Mapping) -> Column:
    chain = None
    for level, label in mapping.items():
        test = F.col(column) == F.lit(level)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain


def site_labels(
    sites: DataFrame,
    temperature: Mapping[int, str] | None = None,
    precipitation: Mapping[int, str] | None = None,
) -> DataFrame:
    """Level labels and their display order; an unlisted level has no label."""
    temperature = temperature or labels.TEMPERATURE_LABELS
    precipitation = precipitation or labels.PRECIPITATION_LABELS
    return sites.withColumns(
        {
            "temperature_level2": _level_label("temperature_level", temperature),
            "precipitation_level2": _level_label("precipitation_level", precipitation),
        }
    ).withColumns(
        {
            "temperature_order": label_order("temperature_level2", list(temperature.values())),
            "precipitation_order": label_order(
                "precipitation_level2", list(precipitation.values())
            ),
        }
    )


def site_table(sites: DataFrame) -> DataFrame:
    """Presentation table of the sites, by level, nulls last."""
    return sites.orderBy(
        F.asc_nulls_last("temperature_level"), F.asc_nulls_last("precipitation_level"), "site_id"
    ).select(
        "site_id",
        F.col("latitude").alias("latitude_°N"),
        F.col("longitude").alias("longitude_°E"),
        "elevation_masl",
        F.col("temperature_level2").alias("Temperature level"),
        F.col("precipitation_level2").alias("Precipitation level in mm"),
    )


def survey_extract_columns(extract: DataFrame) -> DataFrame:
    """Derived columns of the survey extract, whose fertile counts are stored negative."""
    return extract.withColumn("sum_fertile", F.col("sum_fertile") * -1).withColumns(
        {
            "prop_fertile": ratio("sum_fertile", "count_species"),
            "cover_fertile": ratio("sum_fertile", "cover"),
            "biomass": F.col("cover") * F.col("vegetation_height"),
            "temperature_label": map_values(
                F.col("temperature_level").cast("string"),
                {str(k): v for k, v in labels.TEMPERATURE_LABELS.items()},
            ),
            "treatment_group": map_values("treatment", labels.TREATMENT_GROUPS),
        }
    )


def season_and_zone(flags: DataFrame) -> DataFrame:
    """Elevation class and season class from 0/1 flags.

    Each flag is cleaned on its own (``zero_flags``) before the rules apply.
    """

    def none_of(*names: str) -> Column:
        test = F.lit(True)
        for name in names:
            test = test & (F.col(name) == 0)
        return test

    return flags.withColumns(
        {
            "zone": F.when(none_of("nem", "bnem", "sbor") & (F.col("lalp") == 1), "alpine")
            .when(none_of("halp", "malp", "lalp") & (F.col("nem") == 1), "lowland")
            .otherwise("general"),
            "season": F.when(none_of("f_mso", "f_sso", "f_ho"), "early")
            .when(none_of("f_var", "f_fso", "f_mso"), "late")
            .otherwise("none"),
        }
    )
