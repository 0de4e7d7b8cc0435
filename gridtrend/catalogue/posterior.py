"""Posterior-draw queries with their oracles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrend.bindings import CHAINS, COEFFICIENTS, ITERATIONS, PRECIPITATION, TEMPERATURE, Tables
from gridtrend.catalogue.common import rounded
from gridtrend.catalogue.ctes import with_curated
from gridtrend.models import draws
from gridtrend.operators.groups import attach
from gridtrend.operators.keys import level_index
from gridtrend.operators.reshape import melt_outside_range
from gridtrend.session import cut

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


_MEANS = ", ".join(
    f"avg(value) FILTER (WHERE event_id % 5 = {i}) / 100.0 - 0.5 AS {c}"
    for i, c in enumerate(COEFFICIENTS)
)
WIDE = f"""wide AS (
  SELECT event_id // 5 % {CHAINS * ITERATIONS} % {CHAINS} AS chain,
         event_id // 5 % {CHAINS * ITERATIONS} // {CHAINS} + 1 AS iter, {_MEANS}
  FROM events GROUP BY ALL),
draws AS (SELECT *, row_number() OVER (ORDER BY chain, iter) AS draw FROM wide)"""


@query(
    "draws_long",
    f"WITH {WIDE} SELECT (chain + 1)::INTEGER AS chain, iter, param, round(1.23e-11 + value, 8) AS value"
    f" FROM (UNPIVOT wide ON {', '.join(COEFFICIENTS)} INTO NAME param VALUE value)",
)
def draws_long(t: Tables) -> DataFrame:
    wide = cut(t.draws_wide())
    chains = [wide.filter(F.col("chain") == c).drop("chain") for c in range(3)]
    return rounded(draws.stack_chains(chains), 8, "value")


@query(
    "draws_melt_range",
    f"WITH {WIDE} SELECT error, purchase, signup, param, value FROM (SELECT"
    " round(1.23e-11 + error, 8) AS error, round(1.23e-11 + purchase, 8) AS purchase,"
    " round(1.23e-11 + signup, 8) AS signup, unnest(['click', 'view']) AS param,"
    " unnest([round(1.23e-11 + click, 8), round(1.23e-11 + view, 8)]) AS value FROM wide)",
)
def draws_melt_range(t: Tables) -> DataFrame:
    wide = t.draws_wide().drop("chain", "iter")
    out = melt_outside_range(wide, "error", "signup", "param", "value")
    return rounded(out, 8, "error", "purchase", "signup", "value")


@query(
    "draws_thinned",
    "SELECT user_id % 3 AS chain, event_id AS iter, event_type AS param, value FROM events"
    " WHERE event_id > 100 AND (event_id - 100) % 5 = 0",
)
def draws_thinned(t: Tables) -> DataFrame:
    return draws.thin(t.draws_long(), 100, 5)


@query(
    "posterior_summary",
    """SELECT event_type AS param, count(*) AS n, round(1.23e-9 + avg(value), 6) AS mean,
         round(1.23e-9 + stddev_samp(value), 6) AS sd,
         round(1.23e-11 + CASE WHEN avg(value) >= 0 THEN count(*) FILTER (WHERE value >= 0)
           ELSE count(*) FILTER (WHERE value < 0) END / count(*), 8) AS same_sign,
         round(1.23e-9 + quantile_cont(value, 0.025), 6) AS q2_5,
         round(1.23e-9 + quantile_cont(value, 0.25), 6) AS q25,
         round(1.23e-9 + quantile_cont(value, 0.5), 6) AS q50,
         round(1.23e-9 + quantile_cont(value, 0.75), 6) AS q75,
         round(1.23e-9 + quantile_cont(value, 0.975), 6) AS q97_5
       FROM events GROUP BY event_type""",
)
def posterior_summary(t: Tables) -> DataFrame:
    out = draws.posterior_summary(t.draws_long())
    out = rounded(out, 6, "mean", "sd", "q2_5", "q25", "q50", "q75", "q97_5")
    return rounded(out, 8, "same_sign")


_PSRF = (
    "count(*) AS chains, round(1.23e-7 + avg(v), 4) AS within,"
    " round(1.23e-7 + avg(n) * var_samp(m), 4) AS between,"
    " round(1.23e-9 + sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 6) AS r_hat"
)


@query(
    "scale_reduction",
    f"""SELECT param, {_PSRF} FROM (
          SELECT event_type AS param, user_id % 3 AS chain, count(value) AS n, avg(value) AS m,
                 var_samp(value) AS v FROM events GROUP BY ALL) GROUP BY param""",
)
def scale_reduction(t: Tables) -> DataFrame:
    out = draws.scale_reduction(t.draws_long())
    return rounded(rounded(out, 4, "within", "between"), 6, "r_hat")


@query(
    "scale_reduction_running",
    f"""WITH span AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events),
        placed AS (SELECT event_type AS param, user_id % 3 AS chain, value,
          (floor((event_id - lo) * 8 / (hi - lo + 1)) + 1)::INTEGER AS block FROM events, span)
        SELECT param, block, {_PSRF} FROM (
          SELECT b.param, b.block, chain, count(value) AS n, avg(value) AS m, var_samp(value) AS v
          FROM (SELECT DISTINCT param, block FROM placed) b
          JOIN placed ON placed.param = b.param AND placed.block <= b.block GROUP BY ALL)
        GROUP BY ALL""",
)
def scale_reduction_running(t: Tables) -> DataFrame:
    out = draws.scale_reduction_running(t.draws_long(), 8)
    return rounded(rounded(out, 4, "within", "between"), 6, "r_hat")


# prediction ---------------------------------------------------------------
ROW_KEYS = ["turf_id", "species", "year"]
#: Draws in a block: several blocks at the bound sampler setting.
BLOCK = 150
PREDICTOR = (
    "d.click + d.error * temp_grid_sc + d.purchase * summer_temp_anomaly_sc"
    " + d.signup * prec_grid_sc + d.view * temp_grid_sc * prec_grid_sc"
)
PREDICTED = [
    WIDE,
    """obs AS (
  SELECT turf_id, species, year, n_occurrence AS n, sum_fertile AS k, temp_grid_sc, prec_grid_sc,
         summer_temp_anomaly_sc, dense_rank() OVER (ORDER BY site_id) AS site_index
  FROM curated WHERE summer_temp_anomaly_sc IS NOT NULL),
predicted AS (
  SELECT turf_id, species, year, n, k, draw, chain, iter,
         1 / (1 + exp(-(click + error * temp_grid_sc + purchase * summer_temp_anomaly_sc
           + signup * prec_grid_sc + view * temp_grid_sc * prec_grid_sc
           + view * (site_index % 7 - 3) / 10.0))) AS p,
         click + error * temp_grid_sc + purchase * summer_temp_anomaly_sc + signup * prec_grid_sc
           + view * temp_grid_sc * prec_grid_sc + view * (site_index % 7 - 3) / 10.0 AS eta
  FROM obs, draws)""",
]
SIMULATED = """hashed AS (
  SELECT *, ('0x' || substr(md5(turf_id || '|' || species || '|' || year || '|1|' || draw), 1, 13))
    ::BIGINT / 4503599627370496.0::DOUBLE AS u FROM predicted),
terms AS (
  SELECT *, [factorial(n::INTEGER) / (factorial(b::INTEGER) * factorial((n - b)::INTEGER))
      * p ** b * (1 - p) ** (n - b) FOR b IN range(0, n)] AS pmf FROM hashed),
simulated AS (
  SELECT * EXCLUDE (pmf), len([a FOR a IN range(1, n + 1) IF u >= list_sum(pmf[1:a])]) AS y FROM terms)"""


SHARED = ("site_index", "temp_grid_sc", "prec_grid_sc", "summer_temp_anomaly_sc")


def _rows(t: Tables) -> DataFrame:
    rows = t.curated().select(
        *ROW_KEYS,
        "site_id",
        F.col("n_occurrence").alias("n"),
        F.col("sum_fertile").alias("k"),
        "temp_grid_sc",
        "prec_grid_sc",
        "summer_temp_anomaly_sc",
    )
    # Complete cases: a row without a climate value has no prediction.
    return cut(rows.filter(F.col("summer_temp_anomaly_sc").isNotNull()))


def _predicted(t: Tables) -> DataFrame:
    return _predict(t, _rows(t))


def _packed(t: Tables, rows: DataFrame) -> DataFrame:
    """Predictions for packed rows: a site's rows of a year share theirs."""
    return _predict(t, rows, SHARED)


def _predict(t: Tables, rows: DataFrame, shared: Sequence[str] = ()) -> DataFrame:
    """Predictions for written rows; the sites and their number come from the rows."""
    sites = cut(level_index(rows, "site_id", "site_index"))
    rows = attach(rows, sites, ["site_id"], "__rows", written=True).drop("__rows")
    if shared:
        rows = draws.pack_rows(rows.drop("site_id"), shared)
    blocks = draws.draw_blocks(t.draws_wide(), COEFFICIENTS, BLOCK)
    levels = max(1, sites.count())
    # site effects of every draw: one row per draw and site
    effects = blocks.table.selectExpr("inline(draws)").select(
        "draw",
        F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("site_index"),
        "view",
    ).withColumn("site_effect", F.expr("view * (site_index % 7 - 3) / 10D"))
    packed = draws.effect_blocks(effects, "site_index", "site_effect", BLOCK)
    return draws.predict_draws(rows, blocks, PREDICTOR, [packed])


def _simulated(t: Tables) -> DataFrame:
    return draws.predictive_counts(_predicted(t), ROW_KEYS, "n", seed=1)


@query(
    "predicted_probability",
    with_curated(
        "SELECT turf_id, species, year, draw, chain, iter, round(1.23e-11 + p, 8) AS p"
        " FROM predicted",
        *PREDICTED,
    ),
)
def predicted_probability(t: Tables) -> DataFrame:
    return rounded(draws.long_predictions(_predicted(t), ROW_KEYS, ["p"]), 8, "p")


@query(
    "predictive_counts",
    with_curated(
        "SELECT turf_id, species, year, draw, chain, iter, y AS y_sim FROM simulated",
        *PREDICTED, SIMULATED,
    ),
)
def predictive_counts(t: Tables) -> DataFrame:
    out = draws.long_predictions(_simulated(t), ROW_KEYS, ["y_sim"])
    return out.withColumn("y_sim", F.col("y_sim").cast("bigint"))


@query(
    "predictive_median",
    with_curated(
        "SELECT turf_id, species, year, median(y)::DOUBLE AS median FROM simulated"
        " GROUP BY turf_id, species, year",
        *PREDICTED, SIMULATED,
    ),
)
def predictive_median(t: Tables) -> DataFrame:
    held = draws.predictive_histograms(_packed(t, _rows(t)), ROW_KEYS, "n", seed=1)
    return draws.histogram_median(held, ROW_KEYS)


BOUNDS = """bounds AS (
  SELECT turf_id, species, year, count(*) FILTER (WHERE y < k) / count(*) AS lo,
         count(*) FILTER (WHERE y <= k) / count(*) AS hi,
         any_value(('0x' || substr(md5(turf_id || '|' || species || '|' || year || '|2'), 1, 13))
           ::BIGINT / 4503599627370496.0::DOUBLE) AS u
  FROM simulated GROUP BY turf_id, species, year),
residuals AS (SELECT *, lo + u * (hi - lo) AS residual FROM bounds)"""


def _residuals(t: Tables) -> DataFrame:
    held = draws.predictive_histograms(_packed(t, _rows(t)), ROW_KEYS, "n", 1, ["k"], null_as_zero=True)
    return draws.quantile_residuals(draws.residual_bounds(held, ROW_KEYS, "k"), ROW_KEYS, seed=2)


@query(
    "quantile_residual_bounds",
    with_curated(
        "SELECT turf_id, species, year, round(1.23e-11 + lo, 8) AS lo, round(1.23e-11 + hi, 8) AS hi,"
        " round(1.23e-11 + residual, 8) AS residual FROM residuals",
        *PREDICTED, SIMULATED, BOUNDS,
    ),
)
def quantile_residual_bounds(t: Tables) -> DataFrame:
    out = _residuals(t).select(*ROW_KEYS, "lo", "hi", "residual")
    return rounded(out, 8, "lo", "hi", "residual")


@query(
    "residual_bins",
    with_curated(
        "SELECT (least(floor(residual * 20), 19) + 1)::INTEGER AS bin, count(*) AS n"
        " FROM residuals GROUP BY ALL",
        *PREDICTED, SIMULATED, BOUNDS,
    ),
)
def residual_bins(t: Tables) -> DataFrame:
    return draws.residual_bins(_residuals(t), 20)


@query(
    "residual_uniformity",
    with_curated(
        "SELECT count(*) AS n, round(1.23e-11 + max(greatest(r / n - residual,"
        " residual - (r - 1) / n)), 8) AS max_gap FROM (SELECT residual, count(*) OVER () AS n,"
        " row_number() OVER (ORDER BY residual, turf_id, species, year) AS r FROM residuals)",
        *PREDICTED, SIMULATED, BOUNDS,
    ),
)
def residual_uniformity(t: Tables) -> DataFrame:
    return rounded(draws.uniformity(_residuals(t), ROW_KEYS), 8, "max_gap")


@query(
    "residual_qq",
    with_curated(
        "SELECT turf_id, species, year, round(1.23e-11 + residual, 8) AS residual,"
        " round(1.23e-11 + row_number() OVER (ORDER BY residual, turf_id, species, year)"
        " / (count(*) OVER () + 1), 8) AS expected FROM residuals",
        *PREDICTED, SIMULATED, BOUNDS,
    ),
)
def residual_qq(t: Tables) -> DataFrame:
    return rounded(draws.qq_points(_residuals(t), ROW_KEYS), 8, "residual", "expected")


@query(
    "overdispersion",
    with_curated(
        """SELECT round(1.23e-11 + o, 8) AS observed, round(1.23e-11 + s, 8) AS simulated,
             round(1.23e-9 + o / s, 6) AS ratio FROM (
           SELECT (SELECT var_samp(k - m) FROM (SELECT any_value(k) AS k, avg(y) AS m FROM simulated
                     GROUP BY turf_id, species, year)) AS o,
                  (SELECT avg(v) FROM (SELECT draw, var_samp(y - m) AS v FROM (
                     SELECT draw, y, avg(y) OVER (PARTITION BY turf_id, species, year) AS m
                     FROM simulated) GROUP BY draw)) AS s)""",
        *PREDICTED, SIMULATED,
    ),
)
def overdispersion(t: Tables) -> DataFrame:
    rows = _rows(t)
    most = rows.agg(F.max("n")).first()[0] or 0
    counts = draws.packed_counts(_packed(t, rows), ROW_KEYS, "n", 1, ["k"], most)
    out = draws.overdispersion(counts, ROW_KEYS, "k")
    return rounded(rounded(out, 8, "observed", "simulated"), 6, "ratio")


@query(
    "draw_deviance",
    with_curated(
        """SELECT chain, iter, round(1.23e-7 - 2 * sum(lgamma(n + 1) - lgamma(k + 1)
             - lgamma(n - k + 1) - k * (greatest(-eta, 0) + ln(1 + exp(-abs(eta))))
             - (n - k) * (greatest(eta, 0) + ln(1 + exp(-abs(eta))))), 4) AS deviance
           FROM predicted GROUP BY chain, iter""",
        *PREDICTED,
    ),
)
def draw_deviance(t: Tables) -> DataFrame:
    cells = [
        "site_id", "temp_grid_sc", "prec_grid_sc", "summer_temp_anomaly_sc",
        F.col("n_occurrence").alias("n"), F.col("sum_fertile").alias("k"),
    ]
    rows = t.curated().filter(F.col("summer_temp_anomaly_sc").isNotNull()).select(*cells)
    equal = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("m")))
    return rounded(draws.draw_deviance(_predict(t, equal), "k", "n"), 4, "deviance")


@query(
    "draws_by_site",
    """SELECT user_id % 3 AS chain, event_id AS iter, 'beta2[' || (user_id % 30 + 1) || ']' AS param,
         value, n_name AS site_id,
         CASE n_regionkey % 3 + 1 WHEN 1 THEN 'alpine' WHEN 2 THEN 'subalpine' WHEN 3 THEN 'boreal'
           END AS temperature_label,
         CASE n_nationkey % 4 + 1 WHEN 1 THEN '600' WHEN 2 THEN '1200' WHEN 3 THEN '2000'
           WHEN 4 THEN '2700' END AS prec_mm,
         n_regionkey % 3 + 1 AS temperature_order, n_nationkey % 4 + 1 AS prec_order
       FROM events LEFT JOIN nation ON user_id % 30 = n_nationkey""",
)
def draws_by_site(t: Tables) -> DataFrame:
    index = (F.col("user_id") % 30 + 1).cast("string")
    events = t.read("events", "event_id", "user_id", "value").select(
        (F.col("user_id") % 3).alias("chain"),
        F.col("event_id").alias("iter"),
        F.concat(F.lit("beta2["), index, F.lit("]")).alias("param"),
        "value",
    )
    key = F.substring_index("site_id", "_", -1).cast("int") + 1
    sites = t.site_attributes().select(
        key.alias("site_index"), "site_id", "temperature_level", "precipitation_level"
    )
    return draws.draws_by_site(events, sites, TEMPERATURE, PRECIPITATION)
