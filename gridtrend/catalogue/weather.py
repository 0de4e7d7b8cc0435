"""Climate queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrend.bindings import Tables
from gridtrend.catalogue.common import rounded
from gridtrend.catalogue.ctes import with_climate
from gridtrend.plans import climate, summaries
from gridtrend.session import scratch_path
from gridtrend.sources.tables import read_daily_climate, read_table, write_csv, write_table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query(
    "daily_text_round_trip",
    with_climate(
        """SELECT 'Site, "' || nation || '"' AS site, date, CASE WHEN day(date) <> 13 THEN rain END AS precipitation,
             heat AS temperature FROM daily"""
    ),
)
def daily_text_round_trip(t: Tables) -> DataFrame:
    """The daily table written as typed text and read again: separators and quotes in a
    field, nulls as "NA"."""
    rows = t.daily().select(
        F.concat(F.lit('Site, "'), "site", F.lit('"')).alias("site"), "date",
        F.when(F.dayofmonth("date") != 13, F.col("precipitation")).alias("precipitation"), "temperature",
    )
    path = scratch_path(t.spark)
    write_csv(rows, path)
    return read_daily_climate(t.spark, path, "raise")


@query(
    "site_table_round_trip",
    with_climate(
        "SELECT site_id, temperature_level, precipitation_level, round(1.23e-7 + summer_temperature_gridded, 4)"
        " AS summer_temperature FROM sites"
    ),
)
def site_table_round_trip(t: Tables) -> DataFrame:
    """Sites written in partitions by level, and one column set read back with its schema."""
    path = scratch_path(t.spark)
    write_table(t.sites(), path, ["temperature_level"])
    schema = "site_id string, summer_temperature_gridded double, precipitation_level bigint, temperature_level bigint"
    columns = ["site_id", "temperature_level", "precipitation_level", "summer_temperature_gridded"]
    out = read_table(t.spark, path, columns, schema)
    return rounded(out.withColumnRenamed("summer_temperature_gridded", "summer_temperature"), 4, "summer_temperature")


MONTHLY_SQL = with_climate(
    "SELECT date, nation::VARCHAR AS site, 'temperature' AS logger, round(1.23e-7 + temperature, 4) AS value"
    " FROM monthly UNION ALL SELECT date, nation::VARCHAR, 'precipitation',"
    " round(1.23e-7 + precipitation, 4) FROM monthly"
)


@query("climate_monthly", MONTHLY_SQL)
def climate_monthly(t: Tables) -> DataFrame:
    return rounded(t.monthly(), 4, "value")


@query("climate_monthly_long", MONTHLY_SQL)
def climate_monthly_long(t: Tables) -> DataFrame:
    from gridtrend.operators.reshape import melt

    long = melt(t.daily(), ["date", "site"], ["temperature", "precipitation"], "logger", "value")
    return rounded(climate.monthly_from_long(long), 4, "value")


@query(
    "climate_annual",
    with_climate("SELECT year, site, round(1.23e-5 + ann_prec, 2) AS ann_prec,"
                 " round(1.23e-7 + mean_summer_temp, 4) AS mean_summer_temp FROM annual"),
)
def climate_annual(t: Tables) -> DataFrame:
    return rounded(rounded(t.annual(), 2, "ann_prec"), 4, "mean_summer_temp")


@query(
    "climate_calendar",
    with_climate(
        "SELECT nation::VARCHAR AS site, year(date)::INTEGER AS year,"
        " round(1.23e-5 + sum(precipitation), 2) AS ann_prec, round(1.23e-7 + avg(temperature), 4) AS mean_temp,"
        " round(1.23e-7 + avg(temperature) FILTER (WHERE month(date) IN (6,7,8,9)), 4) AS mean_summer_temp"
        " FROM monthly GROUP BY ALL"
    ),
)
def climate_calendar(t: Tables) -> DataFrame:
    out = climate.calendar_climate(t.monthly())
    return rounded(rounded(out, 2, "ann_prec"), 4, "mean_temp", "mean_summer_temp")


@query(
    "climate_calendar_points",
    with_climate(
        "SELECT nation::VARCHAR AS site, year(date)::INTEGER AS year,"
        " round(1.23e-5 + sum(precipitation), 2) AS precipitation,"
        " round(1.23e-7 + avg(temperature) FILTER (WHERE month(date) IN (6,7,8,9)), 4) AS temperature"
        " FROM monthly GROUP BY ALL"
    ),
)
def climate_calendar_points(t: Tables) -> DataFrame:
    out = climate.calendar_points(t.monthly())
    return rounded(rounded(out, 2, "precipitation"), 4, "temperature")


@query(
    "climate_prev_year",
    with_climate(
        "SELECT year, site, round(1.23e-5 + ann_prec, 2) AS ann_prec,"
        " round(1.23e-7 + mean_summer_temp, 4) AS mean_summer_temp,"
        " round(1.23e-5 + ann_prec_prev, 2) AS ann_prec_prev,"
        " round(1.23e-7 + mean_summer_temp_prev, 4) AS mean_summer_temp_prev FROM with_prev"
    ),
)
def climate_prev_year(t: Tables) -> DataFrame:
    out = climate.with_prev_year(t.annual())
    out = rounded(out, 2, "ann_prec", "ann_prec_prev")
    return rounded(out, 4, "mean_summer_temp", "mean_summer_temp_prev")


_RAIN = ["ann_prec", "ann_prec_prev", "ann_prec_anomaly", "ann_prec_prev_anomaly",
         "annual_precipitation_gridded"]
_HEAT = ["mean_summer_temp", "mean_summer_temp_prev", "summer_temp_anomaly",
         "summer_temp_prev_anomaly", "summer_temperature_gridded"]


@query(
    "climate_scaled",
    with_climate(
        "SELECT year, site, temp_level, prec_level, CASE temp_level WHEN 'alpine' THEN 1"
        " WHEN 'subalpine' THEN 2 ELSE 3 END AS temp_order, CASE prec_level WHEN '600mm' THEN 1"
        " WHEN '1200mm' THEN 2 WHEN '2000mm' THEN 3 ELSE 4 END AS prec_order, "
        + ", ".join(f"round(1.23e-5 + {c}, 2) AS {c}" for c in _RAIN)
        + ", "
        + ", ".join(f"round(1.23e-7 + {c}, 4) AS {c}" for c in _HEAT)
        + ", "
        + ", ".join(f"round(1.23e-9 + {c}, 6) AS {c}" for c in climate.SCALED)
        + " FROM climate"
    ),
)
def climate_scaled(t: Tables) -> DataFrame:
    out = rounded(rounded(t.climate(), 2, *_RAIN), 4, *_HEAT)
    return rounded(out, 6, *climate.SCALED)


@query(
    "climate_points",
    with_climate(
        "SELECT site, year, round(1.23e-7 + mean_summer_temp, 4) AS mean_summer_temp,"
        " round(1.23e-5 + ann_prec * 10, 2) AS ann_prec, temp_level, prec_level,"
        " CASE prec_level WHEN '600mm' THEN 1 WHEN '1200mm' THEN 2 WHEN '2000mm' THEN 3 ELSE 4 END"
        " AS prec_order FROM climate"
    ),
)
def climate_points(t: Tables) -> DataFrame:
    out = summaries.climate_points(t.climate(), 10.0)
    return rounded(rounded(out, 2, "ann_prec"), 4, "mean_summer_temp")
