"""Survey, curation and summary queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrend.bindings import PRECIPITATION, TEMPERATURE, Tables
from gridtrend.catalogue.common import near, rnd, rounded
from gridtrend.catalogue.ctes import with_climate, with_curated, with_survey, with_traits
from gridtrend.functions.nulls import not_in
from gridtrend.functions.scalars import expit, logit, neg_log, year_to_date
from gridtrend.operators import groups, keys
from gridtrend.plans import curation, summaries, survey
from gridtrend.session import cut
from gridtrend.sources.tables import zero_flags

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


RAW = [
    "turf_id", "year", "species", "site_id", "block_id", "origin_plot_id", "treatment",
    "temperature_level", "precipitation_level",
]
RAW_SQL = ", ".join(RAW)


@query(
    "fertility_summary",
    with_survey(
        f"SELECT {RAW_SQL}, round(1.23e-5 + annual_precipitation_gridded, 2) AS annual_precipitation_gridded,"
        " round(1.23e-7 + summer_temperature_gridded, 4) AS summer_temperature_gridded, sum_fertile,"
        " n_occurrence, round(1.23e-11 + prop_fertile, 8) AS prop_fertile, experiment FROM fertile_raw",
        fertile="fertile_with_nulls",
    ),
)
def fertility_summary(t: Tables) -> DataFrame:
    out = t.fertile_raw(with_nulls=True)
    out = rounded(out, 2, "annual_precipitation_gridded")
    return rounded(rounded(out, 4, "summer_temperature_gridded"), 8, "prop_fertile")


@query(
    "fertility_all_treatments",
    with_survey(
        "SELECT treatment, experiment, year, sum(sum_fertile)::BIGINT AS sum_fertile,"
        " sum(n_occurrence)::BIGINT AS n_occurrence, count(*) AS n_rows"
        " FROM fertile_raw GROUP BY ALL",
        where="true",
    ),
)
def fertility_all_treatments(t: Tables) -> DataFrame:
    return (
        t.fertile_raw(treatments=None)
        .groupBy("treatment", "experiment", "year")
        .agg(
            F.sum("sum_fertile").alias("sum_fertile"),
            F.sum("n_occurrence").alias("n_occurrence"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )


@query(
    "site_meta",
    with_survey(
        "SELECT DISTINCT site_id, round(1.23e-7 + summer_temperature_gridded, 4) AS summer_temperature_gridded,"
        " round(1.23e-5 + annual_precipitation_gridded, 2) AS annual_precipitation_gridded FROM fertile_raw"
    ),
)
def site_meta(t: Tables) -> DataFrame:
    out = survey.site_meta(t.fertile_raw())
    return rounded(
        rounded(out, 4, "summer_temperature_gridded"), 2, "annual_precipitation_gridded"
    )


@query(
    "trait_pivot",
    with_traits('SELECT species, "Height", season_start, season_finish, functional_group,'
                " life_span FROM traits"),
)
def trait_pivot(t: Tables) -> DataFrame:
    return t.traits()


SITE_LABEL_SQL = """SELECT site_id, latitude, longitude, elevation_masl, temperature_level,
  precipitation_level,
  CASE temperature_level WHEN 1 THEN 'alpine' WHEN 2 THEN 'subalpine' WHEN 3 THEN 'boreal' END
    AS temperature_level2,
  CASE precipitation_level WHEN 1 THEN '600' WHEN 2 THEN '1200' WHEN 3 THEN '2000'
    WHEN 4 THEN '2700' END AS precipitation_level2,
  temperature_level AS temperature_order, precipitation_level AS precipitation_order FROM sites"""


@query("site_labels", with_climate(SITE_LABEL_SQL))
def site_labels(t: Tables) -> DataFrame:
    return survey.site_labels(t.site_attributes(), TEMPERATURE, PRECIPITATION)


@query(
    "table1",
    with_climate(
        'SELECT site_id, latitude AS "latitude_°N", longitude AS "longitude_°E", elevation_masl,'
        ' temperature_level2 AS "Temperature level",'
        ' precipitation_level2 AS "Precipitation level in mm"'
        f" FROM ({SITE_LABEL_SQL}) ORDER BY temperature_level, precipitation_level, site_id"
    ),
)
def table1(t: Tables) -> DataFrame:
    return survey.site_table(site_labels(t))


CURATED_COLUMNS = [
    *RAW, "sum_fertile", "n_occurrence", "functional_group", "life_span", "season_start",
    "n_years", "site_species_fertile", "temp_level", "prec_level",
]
CURATED_ROUNDED = {
    "prop_fertile": 8, "mean_fertile": 8, "rel_fertile": 6, "ann_prec": 2, "ann_prec_prev": 2,
    "mean_summer_temp": 4, "mean_summer_temp_prev": 4, "ann_prec_anomaly": 2,
    "summer_temp_anomaly": 4, "ann_prec_anomaly_sc": 6, "summer_temp_anomaly_sc": 6,
    "ann_prec_prev_anomaly_sc": 6, "summer_temp_prev_anomaly_sc": 6, "prec_grid_sc": 6,
    "temp_grid_sc": 6,
}


@query(
    "curated",
    with_curated(
        "SELECT "
        + ", ".join(CURATED_COLUMNS).replace(
            "site_species_fertile", "site_species_fertile::BIGINT AS site_species_fertile"
        )
        + ", "
        + ", ".join(f"round(1.23e-{d + 3} + {c}, {d}) AS {c}" for c, d in CURATED_ROUNDED.items())
        + " FROM curated"
    ),
)
def curated(t: Tables) -> DataFrame:
    return t.curated().select(
        *CURATED_COLUMNS, *[rnd(c, d) for c, d in CURATED_ROUNDED.items()]
    )


@query(
    "common_species",
    with_curated(
        "SELECT turf_id, year, species, n_occurrence, sum_fertile, count(*) OVER"
        " (PARTITION BY year, species) AS n FROM curated WHERE species IN"
        " (SELECT species FROM curated WHERE n_occurrence > 3) QUALIFY n > 7"
    ),
)
def common_species(t: Tables) -> DataFrame:
    out = curation.common_species(t.curated(), 3, 7)
    return out.select("turf_id", "year", "species", "n_occurrence", "sum_fertile", "n")


@query(
    "group_count_filter",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, n FROM (
         SELECT *, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS n FROM lineitem)
       WHERE n > 1""",
)
def group_count_filter(t: Tables) -> DataFrame:
    lines = t.read("lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return groups.group_count_filter(lines, ["l_suppkey", "l_partkey"], 1)


@query(
    "group_sum_filter",
    """SELECT l_orderkey, l_linenumber, s::BIGINT AS group_sum FROM (
         SELECT *, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)
           OVER (PARTITION BY l_partkey, year(l_shipdate)) AS s FROM lineitem)
       WHERE s <> 0""",
)
def group_sum_filter(t: Tables) -> DataFrame:
    lines = t.read(
        "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate"
    ).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("fertile"),
    )
    out = groups.group_sum_filter(lines, ["l_partkey", "year"], "fertile")
    return out.select("l_orderkey", "l_linenumber", "group_sum")


@query(
    "relative_fertility",
    with_survey(
        "SELECT turf_id, year, species, round(1.23e-11 + m, 8) AS mean_fertile,"
        " round(1.23e-9 + CASE WHEN m = 0 THEN 0 ELSE prop_fertile / m END, 6) AS rel_fertile FROM"
        " (SELECT *, avg(prop_fertile) OVER (PARTITION BY species) AS m FROM fertile_raw)"
    ),
)
def relative_fertility(t: Tables) -> DataFrame:
    rows = t.fertile_raw().select("turf_id", "year", "species", "prop_fertile")
    out = groups.ratio_to_group_mean(
        rows, ["species"], "prop_fertile", "mean_fertile", "rel_fertile"
    )
    return rounded(rounded(out, 8, "mean_fertile"), 6, "rel_fertile").drop("prop_fertile")


@query(
    "consecutive_runs",
    with_survey(
        """, years AS (SELECT DISTINCT turf_id, species, year FROM fertile_raw),
        islands AS (SELECT *, year - row_number() OVER (PARTITION BY turf_id, species ORDER BY year)
          AS island FROM years),
        runs AS (SELECT turf_id, species, count(*) AS run FROM islands
          GROUP BY turf_id, species, island),
        longest AS (SELECT turf_id, species, max(run)::INTEGER AS longest_run FROM runs GROUP BY ALL)
        SELECT turf_id, species, year, sum_fertile, longest_run FROM fertile_raw
        JOIN longest USING (turf_id, species) WHERE longest_run >= 3"""
    ).replace("\n, years AS", ",\nyears AS"),
)
def consecutive_runs(t: Tables) -> DataFrame:
    rows = t.fertile_raw().select("turf_id", "species", "year", "sum_fertile")
    return groups.consecutive_run(rows, ["turf_id", "species"], "year", 3)


SEASON_FLAGS = ["f_var", "f_fso", "f_mso", "f_sso", "f_ho"]
ZONE_FLAGS = ["nem", "bnem", "sbor", "lalp", "malp", "halp"]
ALL_FLAGS = SEASON_FLAGS + ZONE_FLAGS


def _flag_sql(i: int, name: str) -> str:
    return f"CASE WHEN (p_size + {i}) % {i + 2} = 0 THEN 1 ELSE 0 END AS {name}"


@query(
    "season_class",
    "WITH f AS (SELECT p_partkey, "
    + ", ".join(_flag_sql(i, name) for i, name in enumerate(ALL_FLAGS))
    + """ FROM part)
    SELECT p_partkey,
      CASE WHEN nem = 0 AND bnem = 0 AND sbor = 0 AND lalp = 1 THEN 'alpine'
        WHEN halp = 0 AND malp = 0 AND lalp = 0 AND nem = 1 THEN 'lowland' ELSE 'general' END AS zone,
      CASE WHEN f_mso = 0 AND f_sso = 0 AND f_ho = 0 THEN 'early'
        WHEN f_var = 0 AND f_fso = 0 AND f_mso = 0 THEN 'late' ELSE 'none' END AS season
    FROM f""",
)
def season_class(t: Tables) -> DataFrame:
    part = t.read("part", "p_partkey", "p_size")
    flags = part.select(
        "p_partkey",
        *[
            F.when((F.col("p_size") + i) % (i + 2) == 0, "1")
            .otherwise(F.when(F.col("p_size") % 2 == 0, "0").otherwise("NA"))
            .alias(name)
            for i, name in enumerate(ALL_FLAGS)
        ],
    )
    return survey.season_and_zone(zero_flags(flags, ALL_FLAGS)).select(
        "p_partkey", "zone", "season"
    )


@query(
    "survey_extract",
    """SELECT l_orderkey, l_linenumber, l_linenumber AS sum_fertile,
         round(1.23e-11 + l_linenumber / l_quantity, 8) AS prop_fertile,
         CASE WHEN l_discount = 0 THEN NULL ELSE round(1.23e-9 + l_linenumber / l_discount, 6) END
           AS cover_fertile,
         round(1.23e-6 + l_discount * l_extendedprice, 3) AS biomass FROM lineitem""",
)
def survey_extract(t: Tables) -> DataFrame:
    lines = t.read(
        "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"
    )
    extract = lines.select(
        "l_orderkey",
        "l_linenumber",
        (-F.col("l_linenumber")).alias("sum_fertile"),
        F.col("l_quantity").alias("count_species"),
        F.col("l_discount").alias("cover"),
        F.col("l_extendedprice").alias("vegetation_height"),
        F.lit(1).alias("temperature_level"),
        F.lit("TTC").alias("treatment"),
    )
    out = survey.survey_extract_columns(extract)
    finite = F.when(F.col("cover") != 0, near("cover_fertile", 6))
    return out.select(
        "l_orderkey", "l_linenumber", "sum_fertile", rnd("prop_fertile", 8),
        finite.alias("cover_fertile"), rnd("biomass", 3),
    )


@query(
    "negated_membership",
    """SELECT l_orderkey, l_linenumber, y AS year FROM (
         SELECT *, nullif(year(l_shipdate), 1998)::INTEGER AS y FROM lineitem)
       WHERE y IS NULL OR y NOT IN (1995, 1999)""",
)
def negated_membership(t: Tables) -> DataFrame:
    lines = t.read("lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    years = lines.select(
        "l_orderkey", "l_linenumber", F.nullif(F.year("l_shipdate"), F.lit(1998)).alias("year")
    )
    return years.filter(not_in("year", (1995, 1999)))


@query(
    "mean_se_by_grid",
    with_curated(
        "SELECT year, temperature_level, precipitation_level, round(1.23e-11 + avg(prop_fertile), 8) AS mean,"
        " count(*) AS n, round(1.23e-11 + stddev_samp(prop_fertile) / sqrt(count(*)), 8) AS se,"
        " round(1.23e-11 + avg(prop_fertile) - stddev_samp(prop_fertile) / sqrt(count(*)), 8) AS lower,"
        " round(1.23e-11 + avg(prop_fertile) + stddev_samp(prop_fertile) / sqrt(count(*)), 8) AS upper"
        " FROM curated GROUP BY year, temperature_level, precipitation_level"
    ),
)
def mean_se_by_grid(t: Tables) -> DataFrame:
    return rounded(summaries.proportion_over_time(t.curated()), 8, "mean", "se", "lower", "upper")


CHOSEN = {
    "Brand#2|ECONOMY": "Second economy",
    "Brand#17|ECONOMY": "Seventeenth economy",
    "Brand#4|SMALL": "Fourth small",
}


@query(
    "single_species_grid",
    with_curated(
        """SELECT year, CASE temperature_level WHEN 1 THEN 'alpine' WHEN 2 THEN 'subalpine'
             ELSE 'boreal' END AS temperature_label,
           CASE precipitation_level WHEN 1 THEN '600mm' WHEN 2 THEN '1200mm' WHEN 3 THEN '2000mm'
             ELSE '2700mm' END AS prec_mm,
           CASE species WHEN 'Brand#2|ECONOMY' THEN 'Second economy' WHEN 'Brand#17|ECONOMY'
             THEN 'Seventeenth economy' ELSE 'Fourth small' END AS species_name,
           round(1.23e-11 + avg(prop_fertile), 8) AS mean, count(*) AS n,
           round(1.23e-11 + stddev_samp(prop_fertile) / sqrt(count(*)), 8) AS se,
           temperature_level AS temperature_order, precipitation_level AS prec_order
           FROM (SELECT * FROM curated
             WHERE species IN ('Brand#2|ECONOMY', 'Brand#17|ECONOMY', 'Brand#4|SMALL')
             QUALIFY count(*) OVER (PARTITION BY year, species, site_id) > 0)
           GROUP BY year, temperature_level, precipitation_level, species"""
    ),
)
def single_species_grid(t: Tables) -> DataFrame:
    out = summaries.single_species(t.curated(), CHOSEN, 0, TEMPERATURE)
    return rounded(out, 8, "mean", "se")


_RESPONSE = (
    "count(*) AS n, round(1.23e-11 + avg(prop_fertile), 8) AS mean_response,"
    " round(1.23e-11 + stddev_samp(prop_fertile) / sqrt(count(*)), 8) AS se_response,"
    " round(1.23e-7 + avg(mean_summer_temp), 4) AS mean_climate,"
    " round(1.23e-7 + stddev_samp(mean_summer_temp) / sqrt(count(*)), 4) AS se_climate"
)


@query(
    "space_time_summary",
    with_curated(
        f"SELECT 'space' AS model, NULL::INTEGER AS year, site_id, {_RESPONSE} FROM curated"
        f" GROUP BY site_id UNION ALL SELECT 'time', year, site_id, {_RESPONSE}"
        " FROM curated GROUP BY year, site_id"
    ),
)
def space_time_summary(t: Tables) -> DataFrame:
    out = summaries.space_time(t.curated(), "prop_fertile", "mean_summer_temp")
    out = rounded(out, 8, "mean_response", "se_response")
    return rounded(out, 4, "mean_climate", "se_climate")


@query(
    "distinct_counts",
    with_curated("SELECT count(DISTINCT species) AS n_species, count(DISTINCT turf_id) AS n_turf_id"
                 " FROM curated"),
)
def distinct_counts(t: Tables) -> DataFrame:
    return summaries.distinct_counts(t.curated(), ["species", "turf_id"])


@query(
    "turf_series",
    with_curated(
        "SELECT turf_id, species, functional_group, count(*) OVER (PARTITION BY turf_id, species)"
        " AS n, row_number() OVER (PARTITION BY turf_id, species ORDER BY year)::INTEGER AS pos,"
        " year, round(1.23e-11 + prop_fertile, 8) AS prop_fertile FROM curated QUALIFY n > 2"
    ),
)
def turf_series(t: Tables) -> DataFrame:
    series = summaries.turf_series(t.curated(), 2)
    points = series.select("turf_id", "species", "functional_group", "n", F.posexplode("series"))
    return points.select(
        "turf_id", "species", "functional_group", "n", (F.col("pos") + 1).alias("pos"),
        "col.year", near("col.prop_fertile", 8).alias("prop_fertile"),
    )


@query(
    "treatment_points",
    with_survey(
        """SELECT turf_id, year, species, temperature_level,
           CASE treatment WHEN 'TTC' THEN 'Control' WHEN 'TT1' THEN 'Control' WHEN 'TT2' THEN 'Warm'
             WHEN 'TT3' THEN 'Wet' WHEN 'TT4' THEN 'WarmWet' END AS treatment_group,
           CASE treatment WHEN 'TTC' THEN 1 WHEN 'TT1' THEN 1 WHEN 'TT2' THEN 2 WHEN 'TT3' THEN 3
             WHEN 'TT4' THEN 4 END AS treatment_order,
           split_part(species, '|', 2) AS functional_group, round(1.23e-11 + prop_fertile, 8) AS prop_fertile
           FROM fertile_raw""",
        where="true",
    ),
)
def treatment_points(t: Tables) -> DataFrame:
    rows = curation.join_traits(t.fertile_raw(treatments=None), t.taxon())
    return rounded(summaries.treatment_points(rows), 8, "prop_fertile")


@query(
    "panel_points",
    with_curated(
        """SELECT turf_id, species, year, functional_group, precipitation_level,
           round(1.23e-7 + mean_summer_temp, 4) AS mean_summer_temp, round(1.23e-11 + prop_fertile, 8) AS prop_fertile,
           n_panel_years, n_plots, make_date(year, 1, 1) AS year_start FROM (
             SELECT *, count(*) OVER (PARTITION BY temperature_level, species, year) AS n_plots FROM (
               SELECT *, count(*) OVER (PARTITION BY turf_id, species) AS n_panel_years FROM curated)
             WHERE n_panel_years > 2) WHERE n_plots > 1"""
    ),
)
def panel_points(t: Tables) -> DataFrame:
    rows = t.curated().withColumn("site_id", F.col("temperature_level"))
    out = summaries.panel_points(rows, 3, 1)
    return out.select(
        "turf_id", "species", "year", "functional_group", "precipitation_level",
        rnd("mean_summer_temp", 4), rnd("prop_fertile", 8), "n_panel_years", "n_plots", "year_start",
    )


@query(
    "line_fit_by_panel",
    with_curated(
        "SELECT site_id, precipitation_level,"
        " round(1.23e-13 + regr_slope(prop_fertile, mean_summer_temp), 10) AS slope,"
        " round(1.23e-9 + regr_intercept(prop_fertile, mean_summer_temp), 6) AS intercept,"
        " round(1.23e-9 + regr_r2(prop_fertile, mean_summer_temp), 6) AS r2,"
        " regr_count(prop_fertile, mean_summer_temp)::BIGINT AS n"
        " FROM curated GROUP BY site_id, precipitation_level"
    ),
)
def line_fit_by_panel(t: Tables) -> DataFrame:
    out = summaries.line_fit(
        t.curated(), ["site_id", "precipitation_level"], "prop_fertile", "mean_summer_temp"
    )
    return rounded(rounded(out, 10, "slope"), 6, "intercept", "r2")


@query(
    "pixel_box",
    "SELECT p_size::DOUBLE AS x, p_retailprice AS y, p_partkey AS value FROM part"
    " WHERE p_size BETWEEN 4.5 AND 10 AND p_retailprice BETWEEN 905 AND 1000",
)
def pixel_box(t: Tables) -> DataFrame:
    return summaries.pixel_box(t.pixels(), (4.5, 10.0), (905.0, 1000.0))


@query(
    "dense_index",
    """SELECT l_orderkey, l_linenumber, species, dense_rank() OVER (ORDER BY species)::INTEGER
       AS species_index FROM (SELECT l_orderkey, l_linenumber, p_brand || '|' || p_type AS species
       FROM lineitem JOIN part ON l_partkey = p_partkey)""",
)
def dense_index(t: Tables) -> DataFrame:
    lines = t.read("lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    species = t.species().select("p_partkey", "species")
    rows = lines.join(species, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "species"
    )
    return keys.dense_index(rows, "species", "species_index")


@query(
    "level_grid",
    with_curated(
        "SELECT * FROM (SELECT DISTINCT year FROM curated), (SELECT DISTINCT temperature_level"
        " FROM curated), (SELECT DISTINCT functional_group FROM curated)"
    ),
)
def level_grid(t: Tables) -> DataFrame:
    names = ["year", "temperature_level", "functional_group"]
    return keys.level_product(cut(t.curated().select(*names)), names)


@query(
    "row_id",
    "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " l_shipdate, l_extendedprice) AS id, l_orderkey, l_linenumber, l_partkey, l_suppkey"
    " FROM lineitem",
)
def row_id(t: Tables) -> DataFrame:
    order = [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
    ]
    return keys.row_id(t.read("lineitem", *order), order).drop("l_shipdate", "l_extendedprice")


@query(
    "neg_log_proportion",
    with_survey(
        "SELECT turf_id, species, year, prop_fertile = 0 AS is_zero,"
        " CASE WHEN prop_fertile > 0 THEN round(1.23e-11 + -ln(prop_fertile), 8) END AS neg_log_prop"
        " FROM fertile_raw"
    ),
)
def neg_log_proportion(t: Tables) -> DataFrame:
    infinite = F.col("v") == float("inf")
    return (
        t.fertile_raw()
        .withColumn("v", neg_log("prop_fertile"))
        .select(
            "turf_id", "species", "year", infinite.alias("is_zero"),
            F.when(~infinite, near("v", 8)).alias("neg_log_prop"),
        )
    )


@query(
    "logit_columns",
    """SELECT l_orderkey, l_linenumber, round(1.23e-11 + ln(p / (1 - p)), 8) AS logit_p,
         round(1.23e-11 + 1 / (1 + exp(-(l_quantity - 25))), 8) AS prob, make_date(y, 1, 1) AS year_start,
         substr(l_returnflag || l_linestatus, 1, 3) AS code
       FROM (SELECT *, (l_linenumber / 8.0)::DOUBLE AS p, year(l_shipdate)::INTEGER AS y
             FROM lineitem)""",
)
def logit_columns(t: Tables) -> DataFrame:
    lines = t.read(
        "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag",
        "l_linestatus",
    )
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        near(logit(F.col("l_linenumber") / 8.0), 8).alias("logit_p"),
        near(expit(F.col("l_quantity") - 25.0), 8).alias("prob"),
        year_to_date(F.year("l_shipdate")).alias("year_start"),
        F.substring(F.concat("l_returnflag", "l_linestatus"), 1, 3).alias("code"),
    )
