"""Explicit schemas of the file sources."""

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


I, D, S, DATE = T.IntegerType(), T.DoubleType(), T.StringType(), T.DateType()

SUBTURF_COMMUNITY = _schema(
    turf_id=S, sub_turf=I, year=I, species=S, fertile=I, dominant=I
)
TURFS = _schema(
    turf_id=S, treatment=S, rt_treat=S, gr_treat=S, origin_plot_id=I, destination_plot_id=I
)
PLOTS = _schema(plot_id=I, block_id=S)
BLOCKS = _schema(block_id=S, site_id=S)
SITES = _schema(
    site_id=S,
    latitude=D,
    longitude=D,
    elevation_masl=D,
    annual_precipitation_gridded=D,
    summer_temperature_gridded=D,
    temperature_level=I,
    precipitation_level=I,
)
CHARACTER_TRAITS = _schema(species=S, trait=S, value=S)
TAXON = _schema(species=S, functional_group=S, life_span=S)
DAILY_CLIMATE = _schema(site=S, date=DATE, precipitation=D, temperature=D)
MONTHLY_TEMPERATURE = _schema(date=DATE, site=S, logger=S, value=D)
PIXELS = _schema(x=D, y=D, value=D)

SEASON_FLAGS = ["f_var", "f_fso", "f_mso", "f_sso", "f_ho"]
ZONE_FLAGS = ["nem", "bnem", "sbor", "mbor", "nbor", "lalp", "malp", "halp"]
SURVEY_EXTRACT = _schema(
    turf_id=S,
    site_id=S,
    year=I,
    species=S,
    functional_group=S,
    treatment=S,
    temperature_level=I,
    sum_fertile=I,
    count_species=I,
    cover=D,
    vegetation_height=D,
    **{flag: S for flag in SEASON_FLAGS + ZONE_FLAGS},
)
