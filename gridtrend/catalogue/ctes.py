"""SQL building blocks for the oracles: the bindings, written a second time."""

COMMUNITY = """community AS (
  SELECT l_suppkey AS turf_id, l_linenumber AS sub_turf, year(l_shipdate)::INTEGER AS year,
         p_brand || '|' || p_type AS species,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS fertile,
         CASE WHEN l_orderkey % 50 <> 0 THEN CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END END
           AS fertile_with_nulls
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

DAILY = """daily AS (
  SELECT c_nationkey AS nation, o_orderdate::DATE AS date, o_totalprice AS rain, c_acctbal AS heat,
         (year(o_orderdate) + CASE WHEN month(o_orderdate) > 7 THEN 1 ELSE 0 END)::INTEGER AS hyear
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

NORMALS = """normals AS (
  SELECT 'NATION_' || nation AS site_id,
         sum(rain::DECIMAL(18,2))::DOUBLE / count(DISTINCT hyear) AS annual_precipitation_gridded,
         sum(heat::DECIMAL(18,2)) FILTER (WHERE month(date) IN (6,7,8,9))::DOUBLE
           / count(*) FILTER (WHERE month(date) IN (6,7,8,9)) AS summer_temperature_gridded
  FROM daily GROUP BY nation)"""

SITES = """sites AS (
  SELECT n_name AS site_id, 60.0 + n_nationkey / 10.0 AS latitude,
         5.0 + n_nationkey / 5.0 AS longitude, n_nationkey * 100.0 AS elevation_masl,
         n_regionkey % 3 + 1 AS temperature_level, n_nationkey % 4 + 1 AS precipitation_level,
         annual_precipitation_gridded, summer_temperature_gridded
  FROM nation LEFT JOIN normals ON n_name = normals.site_id)"""

TURFS = """turfs AS (
  SELECT s_suppkey AS turf_id, s_suppkey AS origin_plot_id,
         CASE s_suppkey % 6 WHEN 0 THEN 'TTC' WHEN 1 THEN 'TT1' WHEN 2 THEN 'TT2'
           WHEN 3 THEN 'TT3' WHEN 4 THEN 'TT4' END AS treatment,
         s_nationkey || '_' || s_suppkey % 3 AS block_id, 'NATION_' || s_nationkey AS site_id
  FROM supplier)"""


def fertile_raw(fertile: str = "fertile", where: str = "treatment IN ('TTC', 'TT1')") -> str:
    return f"""fertile_raw AS (
  SELECT turf_id, year, species, turfs.site_id, block_id, origin_plot_id, treatment,
         temperature_level, precipitation_level, annual_precipitation_gridded,
         summer_temperature_gridded,
         CASE WHEN count({fertile}) = count(*) THEN sum({fertile})::BIGINT END AS sum_fertile,
         count(*) AS n_occurrence,
         CASE WHEN count({fertile}) = count(*) THEN sum({fertile})::DOUBLE / count(*) END
           AS prop_fertile,
         CASE WHEN treatment IS NULL THEN 'removal' ELSE 'gradient' END AS experiment
  FROM community LEFT JOIN turfs USING (turf_id) LEFT JOIN sites ON sites.site_id = turfs.site_id
  WHERE {where}
  GROUP BY ALL)"""


MONTHLY = """monthly AS (
  SELECT date_trunc('month', date)::DATE + 14 AS date, nation, avg(heat) AS temperature,
         sum(rain) AS precipitation
  FROM daily GROUP BY ALL)"""

ANNUAL = """rain_years AS (
  SELECT (year(date) + CASE WHEN month(date) > 7 THEN 1 ELSE 0 END)::INTEGER AS year, nation,
         sum(precipitation) AS ann_prec FROM monthly GROUP BY ALL),
summers AS (
  SELECT year(date)::INTEGER AS year, nation, avg(temperature) AS mean_summer_temp
  FROM monthly WHERE month(date) IN (6,7,8,9) GROUP BY ALL),
annual AS (
  SELECT year, 'NATION_' || nation AS site, ann_prec, mean_summer_temp
  FROM rain_years FULL JOIN summers USING (year, nation))"""

_SCALED = {
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

CLIMATE = f"""with_prev AS (
  SELECT a.*, p.ann_prec AS ann_prec_prev, p.mean_summer_temp AS mean_summer_temp_prev
  FROM annual a LEFT JOIN annual p ON p.site = a.site AND p.year = a.year - 1),
anomalies AS (
  SELECT w.*, annual_precipitation_gridded, summer_temperature_gridded,
         ann_prec - annual_precipitation_gridded AS ann_prec_anomaly,
         ann_prec_prev - annual_precipitation_gridded AS ann_prec_prev_anomaly,
         mean_summer_temp - summer_temperature_gridded AS summer_temp_anomaly,
         mean_summer_temp_prev - summer_temperature_gridded AS summer_temp_prev_anomaly
  FROM with_prev w LEFT JOIN normals ON w.site = normals.site_id),
climate AS (
  SELECT anomalies.*,
         {', '.join(f'({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () AS {n}' for n, x in _SCALED.items())},
         CASE temperature_level WHEN 1 THEN 'alpine' WHEN 2 THEN 'subalpine' WHEN 3 THEN 'boreal' END
           AS temp_level,
         CASE precipitation_level WHEN 1 THEN '600mm' WHEN 2 THEN '1200mm' WHEN 3 THEN '2000mm'
           WHEN 4 THEN '2700mm' END AS prec_level
  FROM anomalies LEFT JOIN (SELECT site_id AS level_site, temperature_level, precipitation_level
    FROM sites) ON anomalies.site = level_site)"""

SPECIES = """species_sizes AS (
  SELECT p_brand || '|' || p_type AS species, p_type AS functional_group, min(p_size) AS size
  FROM part GROUP BY ALL),
traits AS (
  SELECT species, size::VARCHAR AS "Height",
         CASE size % 5 WHEN 0 THEN 'Host' WHEN 1 THEN 'MSo' WHEN 2 THEN 'SSo' WHEN 3 THEN 'FSo'
           ELSE 'Var' END AS season_finish,
         CASE size % 4 WHEN 0 THEN 'MSo' WHEN 1 THEN 'SSo' WHEN 2 THEN 'FSo' ELSE 'Var' END
           AS season_start,
         functional_group, CASE WHEN size % 4 = 0 THEN 'annual' ELSE 'perennial' END AS life_span
  FROM species_sizes)"""

CURATED = """counted AS (
  SELECT fertile_raw.*, functional_group, life_span, season_start,
         count(*) OVER (PARTITION BY turf_id, species) AS n_years
  FROM fertile_raw LEFT JOIN traits USING (species) WHERE year <> 1996),
grouped AS (
  SELECT *, avg(prop_fertile) OVER (PARTITION BY species) AS mean_fertile,
         sum(sum_fertile) OVER (PARTITION BY site_id, species) AS site_species_fertile
  FROM counted WHERE n_years > 3 AND functional_group IN ('ECONOMY', 'PROMO', 'SMALL')),
curated AS (
  SELECT grouped.*, CASE WHEN mean_fertile = 0 THEN 0 ELSE prop_fertile / mean_fertile END
           AS rel_fertile,
         climate.* EXCLUDE (site, year, annual_precipitation_gridded, summer_temperature_gridded)
  FROM grouped LEFT JOIN climate ON grouped.site_id = climate.site AND grouped.year = climate.year
  WHERE site_species_fertile <> 0)"""

_BASE = [COMMUNITY, DAILY, NORMALS, SITES, TURFS]
_CLIMATE = [DAILY, NORMALS, SITES, MONTHLY, ANNUAL, CLIMATE]


def with_survey(query: str, **raw: str) -> str:
    return "WITH " + ",\n".join([*_BASE, fertile_raw(**raw)]) + "\n" + query


def with_climate(query: str) -> str:
    return "WITH " + ",\n".join(_CLIMATE) + "\n" + query


def with_traits(query: str) -> str:
    return "WITH " + SPECIES + "\n" + query


def with_curated(query: str, *more: str) -> str:
    parts = [*_BASE, fertile_raw(), MONTHLY, ANNUAL, CLIMATE, SPECIES, CURATED, *more]
    return "WITH " + ",\n".join(parts) + "\n" + query
