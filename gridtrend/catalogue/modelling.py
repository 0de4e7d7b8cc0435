"""Model queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrend.bindings import KEPT_TYPES, PRECIPITATION, TEMPERATURE, Tables
from gridtrend.catalogue.common import rounded
from gridtrend.catalogue import solving
from gridtrend.catalogue.ctes import with_curated, with_survey
from gridtrend.functions.scalars import label_order, map_values
from gridtrend.models import conjugate, glm, grouped, mixed, zero_inflated
from gridtrend.operators.keys import level_product
from gridtrend.plans.summaries import level_label
from gridtrend.session import cut

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


INTERVAL = ("response", "ci_low", "ci_high")


def _interval_sql(e: str = "fitted", s: str = "se_fit") -> str:
    return (
        f"round(1.23e-9 + 1 / (1 + exp(-({e}))), 6) AS response,"
        f" round(1.23e-9 + 1 / (1 + exp(-({e} - 1.96 * {s}))), 6) AS ci_low,"
        f" round(1.23e-9 + 1 / (1 + exp(-({e} + 1.96 * {s}))), 6) AS ci_high"
    )


def _cells_sql(keys: str) -> str:
    return f"""cells AS (
  SELECT {keys}, w, p, n_rows, CASE WHEN p > 0 AND p < 1 THEN ln(p / (1 - p)) END AS fitted,
         CASE WHEN p > 0 AND p < 1 THEN 1 / sqrt(w * p * (1 - p)) END AS se_fit
  FROM (SELECT {keys}, sum(n_occurrence) AS w, sum(sum_fertile)::DOUBLE / sum(n_occurrence) AS p,
               count(*) AS n_rows FROM curated GROUP BY ALL))"""


QUASI_CELLS = """base AS (
  SELECT year, avg(prop_fertile) AS p, sum(prop_fertile * prop_fertile) AS yy, count(*) AS n_rows
  FROM curated GROUP BY year),
phi AS (SELECT sum((yy - n_rows * p * p) / (p * (1 - p))) / (sum(n_rows) - count(*)) AS phi FROM base),
quasi AS (
  SELECT year, n_rows, ln(p / (1 - p)) AS fitted, sqrt(phi / (n_rows * p * (1 - p))) AS se_fit, phi
  FROM base, phi)"""

_FIT_SQL = "round(1.23e-9 + fitted, 6) AS fitted, round(1.23e-9 + se_fit, 6) AS se_fit, "
YEAR_GLM_SQL = with_curated(
    f"SELECT year, n_rows, {_FIT_SQL}{_interval_sql()} FROM cells", _cells_sql("year")
)
YEAR_QUASI_SQL = with_curated(
    f"SELECT year, n_rows, {_FIT_SQL}{_interval_sql()}, round(1.23e-9 + phi, 6) AS dispersion"
    " FROM quasi",
    QUASI_CELLS,
)


@query("year_glm_closed_form", YEAR_GLM_SQL)
def year_glm_closed_form(t: Tables) -> DataFrame:
    cells = glm.cell_estimates(t.curated(), ["year"], "prop_fertile", "n_occurrence")
    out = glm.response_interval(cells.drop("response")).drop("w", "at_bound")
    return rounded(out, 6, "fitted", "se_fit", *INTERVAL)


@query("year_glm_fitted", YEAR_GLM_SQL)
def year_glm_fitted(t: Tables) -> DataFrame:
    fit = glm.fit_binomial(t.curated(), "prop_fertile", ["year"], ["year"], "n_occurrence")
    return rounded(glm.fitted_cells(fit), 6, "fitted", "se_fit", *INTERVAL)


@query("year_quasi_glm", YEAR_QUASI_SQL)
def year_quasi_glm(t: Tables) -> DataFrame:
    out = glm.quasi_cell_estimates(t.curated(), ["year"], "prop_fertile")
    return rounded(out, 6, "fitted", "se_fit", *INTERVAL, "dispersion")


@query("year_quasi_glm_fitted", YEAR_QUASI_SQL)
def year_quasi_glm_fitted(t: Tables) -> DataFrame:
    fit = glm.fit_binomial(t.curated(), "prop_fertile", ["year"], ["year"], quasi=True)
    out = glm.fitted_cells(fit).withColumn("dispersion", F.lit(float(fit.dispersion)))
    return rounded(out, 6, "fitted", "se_fit", *INTERVAL, "dispersion")


@query(
    "means_vs_fitted",
    with_curated(
        "SELECT m.year, round(1.23e-9 + mean, 6) AS mean,"
        " round(1.23e-9 + 1 / (1 + exp(-cells.fitted)), 6) AS weighted_fitted,"
        " round(1.23e-9 + 1 / (1 + exp(-quasi.fitted)), 6) AS quasi_fitted"
        " FROM (SELECT year, avg(prop_fertile) AS mean FROM curated GROUP BY year) m"
        " LEFT JOIN cells ON cells.year = m.year LEFT JOIN quasi ON quasi.year = m.year",
        _cells_sql("year"),
        QUASI_CELLS,
    ),
)
def means_vs_fitted(t: Tables) -> DataFrame:
    rows = cut(t.curated().select("year", "prop_fertile", "n_occurrence"))
    weighted = glm.fit_binomial(rows, "prop_fertile", ["year"], ["year"], "n_occurrence")
    quasi = glm.fit_binomial(rows, "prop_fertile", ["year"], ["year"], quasi=True)
    out = (
        rows.groupBy("year")
        .agg(F.avg("prop_fertile").alias("mean"))
        .join(
            glm.fitted_cells(weighted).select("year", F.col("response").alias("weighted_fitted")),
            "year",
            "left",
        )
        .join(
            glm.fitted_cells(quasi).select("year", F.col("response").alias("quasi_fitted")),
            "year",
            "left",
        )
    )
    return rounded(out, 6, "mean", "weighted_fitted", "quasi_fitted")


@query(
    "three_way_glm",
    with_curated(
        "SELECT year, functional_group, temperature_level, n_rows, fitted IS NULL AS at_bound, "
        f"{_FIT_SQL}{_interval_sql()} FROM cells",
        _cells_sql("year, functional_group, temperature_level"),
    ),
)
def three_way_glm(t: Tables) -> DataFrame:
    keys = ["year", "functional_group", "temperature_level"]
    cells = glm.cell_estimates(t.curated(), keys, "prop_fertile", "n_occurrence")
    out = glm.response_interval(cells.drop("response")).drop("w")
    return rounded(out, 6, "fitted", "se_fit", *INTERVAL)


_SIMPSON = (
    "list_sum(list_transform(range(0, 2001), lambda i: exp(-((i * abs(z) / 2000) ** 2) / 2)"
    " * CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END))"
    " * abs(z) / 6000"
)


@query(
    "pairwise_years_holm",
    with_curated(
        """SELECT level_a, level_b, round(1.23e-9 + estimate, 6) AS estimate,
             round(1.23e-9 + se, 6) AS se, round(1.23e-9 + z, 6) AS z,
             round(1.23e-9 + p, 6) AS p_value,
             round(1.23e-9 + max(least(1, (m - r + 1) * p)) OVER (ORDER BY r), 6) AS p_holm
           FROM (SELECT *, row_number() OVER (ORDER BY p, level_a, level_b) AS r,
                        count(*) OVER () AS m FROM scored)""",
        QUASI_CELLS,
        """pairs AS (
  SELECT a.year::VARCHAR AS level_a, b.year::VARCHAR AS level_b, b.fitted - a.fitted AS estimate,
         sqrt(a.se_fit ** 2 + b.se_fit ** 2) AS se, (b.fitted - a.fitted)
           / sqrt(a.se_fit ** 2 + b.se_fit ** 2) AS z
  FROM quasi a JOIN quasi b ON a.year < b.year)""",
        f"scored AS (SELECT *, 1 - 2 / sqrt(2 * pi()) * {_SIMPSON} AS p FROM pairs)",
    ),
)
def pairwise_years_holm(t: Tables) -> DataFrame:
    fit = glm.fit_binomial(t.curated(), "prop_fertile", ["year"], ["year"], quasi=True)
    out = glm.pairwise_contrasts(t.spark, fit, "year")
    return rounded(out, 6, "estimate", "se", "z", "p_value", "p_holm")


def _r(expression: str, digits: int, name: str) -> str:
    return f"round(1.23e-{digits + 3} + {expression}, {digits}) AS {name}"


LEVELS = """lv AS (SELECT
  (SELECT list(DISTINCT year ORDER BY year) FROM curated) AS ys,
  (SELECT list(DISTINCT temperature_level ORDER BY temperature_level) FROM curated) AS ts,
  (SELECT list(DISTINCT precipitation_level ORDER BY precipitation_level) FROM curated) AS ps,
  (SELECT list(DISTINCT functional_group ORDER BY functional_group) FROM curated) AS gs)"""
_YEAR = solving.dummies("year", "ys")
_TEMP, _PREC = solving.dummies("temperature_level", "ts"), solving.dummies("precipitation_level", "ps")
_GROUP = solving.dummies("functional_group", "gs")
_GRID_XS = f"list_concat([1.0::DOUBLE], {_YEAR}, {_TEMP}, {_PREC}, {solving.crossed(_TEMP, _PREC)})"
_YEAR_XS = f"list_concat([1.0::DOUBLE], {_YEAR})"
_RANK = "len(list_filter(used, lambda x: x))"


GRID_TERMS = [
    "year", "temperature_level", "precipitation_level", "temperature_level:precipitation_level",
]
GRID_FACTORS = ["year", "temperature_level", "precipitation_level"]


@query(
    "additive_glm",
    with_curated(
        f"""SELECT temperature_level, precipitation_level, {_r('fitted', 6, 'fitted')}, {_r('se_fit', 6, 'se_fit')},
             {_interval_sql()}, CASE temperature_level WHEN 1 THEN 'alpine' WHEN 2 THEN 'subalpine'
               ELSE 'boreal' END AS temperature_label,
             CASE precipitation_level WHEN 1 THEN '600' WHEN 2 THEN '1200' WHEN 3 THEN '2000' ELSE '2700' END AS prec_mm
           FROM (SELECT temperature_level, precipitation_level, avg(list_dot_product(xs, beta)) AS fitted,
                   avg(sqrt(pearson / (n - {_RANK}) * {solving.variance('xs')})) AS se_fit
                 FROM (SELECT *, {_GRID_XS} AS xs FROM curated, lv), fit GROUP BY ALL)""",
        LEVELS,
        solving.collapsed("cells", "curated, lv", "0", _GRID_XS, "prop_fertile", "1"),
        solving.newton("cells", tol=1e-10, most=50),
    ),
)
def additive_glm(t: Tables) -> DataFrame:
    fit = glm.fit_binomial(t.curated(), "prop_fertile", GRID_TERMS, GRID_FACTORS, quasi=True)
    out = glm.average_link(glm.fitted_cells(fit), ["temperature_level", "precipitation_level"])
    return rounded(out, 6, "fitted", "se_fit", *INTERVAL).withColumns(
        {
            "temperature_label": level_label("temperature_level", TEMPERATURE),
            "prec_mm": level_label("precipitation_level", PRECIPITATION),
        }
    )


def _dev(keys: str) -> str:
    """Deviance of the model with one probability per cell."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT 2 * sum(n_occurrence * (
      CASE WHEN prop_fertile > 0 THEN prop_fertile * ln(prop_fertile / mu) ELSE 0 END
      + CASE WHEN prop_fertile < 1 THEN (1 - prop_fertile) * ln((1 - prop_fertile) / (1 - mu))
        ELSE 0 END)) AS dev, count(*) AS n, count(DISTINCT cell) AS cells
    FROM (SELECT *, sum(sum_fertile) OVER ({part}) / sum(n_occurrence) OVER ({part}) AS mu,
                 ({keys or "''"}) AS cell FROM curated)"""


@query(
    "deviance_table",
    with_curated(
        """SELECT 0 AS step, 'NULL' AS term, NULL::INTEGER AS df, NULL::DOUBLE AS deviance,
             (n - 1)::INTEGER AS resid_df, round(1.23e-7 + dev, 4) AS resid_dev FROM d0
           UNION ALL SELECT 1, 'year', (d1.cells - 1)::INTEGER, round(1.23e-7 + d0.dev - d1.dev, 4),
             (d1.n - d1.cells)::INTEGER, round(1.23e-7 + d1.dev, 4) FROM d0, d1
           UNION ALL SELECT 2, 'functional_group in year', (d2.cells - d1.cells)::INTEGER,
             round(1.23e-7 + d1.dev - d2.dev, 4), (d2.n - d2.cells)::INTEGER,
             round(1.23e-7 + d2.dev, 4) FROM d1, d2""",
        f"d0 AS ({_dev('')})",
        f"d1 AS ({_dev('year')})",
        f"d2 AS ({_dev('year, functional_group')})",
    ),
)
def deviance_table(t: Tables) -> DataFrame:
    steps = {
        "year": ["year"],
        "functional_group in year": ["functional_group", "year:functional_group"],
    }
    out = glm.deviance_table(
        t.spark, t.curated(), "prop_fertile", steps, ["year", "functional_group"], "n_occurrence"
    )
    return rounded(out.drop("f", "p"), 4, "deviance", "resid_dev")


_STEPS = """steps AS (
  SELECT unnest(range(5)) AS step, unnest([1, len(ys), len(ys) + len(ts) - 1, len(ys) + len(ts) + len(ps) - 2,
    len(ys) + len(ts) + len(ps) - 2 + (len(ts) - 1) * (len(ps) - 1)]) AS size,
    unnest(['NULL', 'year', 'temperature_level', 'precipitation_level', 'temperature_level:precipitation_level']) AS term
  FROM lv)"""


def _masked(grp: str) -> str:
    """Cells of all nested models: a step's later columns are 0."""
    return f"""masked AS (
  SELECT {grp} AS grp, list_transform(range(len(xs)), lambda j: CASE WHEN j < size THEN xs[j + 1] ELSE 0 END) AS xs,
         w, wy, wyy, saturated, n_rows FROM cells, steps)"""


@query(
    "deviance_table_quasi",
    with_curated(
        f"""SELECT step::INTEGER AS step, term, df, {_r('deviance', 6, 'deviance')}, resid_df,
             {_r('resid_dev', 6, 'resid_dev')}, {_r('f', 6, 'f')},
             {_r(solving.f_tail('f', 'df', 'resid'), 6, 'p')}
           FROM (SELECT *, drop_ / nullif(df, 0) / phi AS f FROM (
             SELECT step, term, (rank - lag(rank) OVER o)::INTEGER AS df, lag(dev) OVER o - dev AS drop_,
                    lag(dev) OVER o - dev AS deviance, (n - rank)::INTEGER AS resid_df, dev AS resid_dev,
                    max(CASE WHEN step = 4 THEN pearson / (n - rank) END) OVER () AS phi,
                    max(CASE WHEN step = 4 THEN n - rank END) OVER () AS resid
             FROM (SELECT steps.step AS step, term, n, dev, pearson, {_RANK} AS rank FROM fit JOIN steps ON steps.step = grp) WINDOW o AS (ORDER BY step)))""",
        LEVELS,
        _STEPS,
        solving.collapsed("cells", "curated, lv", "0", _GRID_XS, "prop_fertile", "1"),
        _masked("step"),
        solving.newton("masked", tol=1e-10, most=50),
    ),
)
def deviance_table_quasi(t: Tables) -> DataFrame:
    steps = {term: [term] for term in GRID_TERMS}
    out = glm.deviance_table(
        t.spark, t.curated(), "prop_fertile", steps, GRID_FACTORS, quasi=True
    )
    return rounded(out, 6, "deviance", "resid_dev", "f", "p")


@query(
    "species_deviance",
    with_curated(
        f"""SELECT species, step::INTEGER AS step, term, df, {_r('drop_', 5, 'deviance')}, resid_df,
             {_r('resid_dev', 5, 'resid_dev')}, {_r('CASE WHEN df > 0 THEN drop_ / df END', 5, 'f')},
             {_r('CASE WHEN df > 0 THEN ' + solving.chi_square_tail('greatest(drop_, 0)', 'df') + ' END', 5, 'p')}, converged
           FROM (SELECT grp.species AS species, step, term, (rank - lag(rank) OVER o)::INTEGER AS df,
                   lag(dev) OVER o - dev AS drop_, (n - rank)::INTEGER AS resid_df, dev AS resid_dev, done AS converged
                 FROM (SELECT grp, steps.step AS step, term, n, dev, done, {_RANK} AS rank FROM fit JOIN steps ON steps.step = grp.step)
                 WINDOW o AS (PARTITION BY grp.species ORDER BY step))""",
        LEVELS,
        _STEPS,
        solving.collapsed("cells", "curated, lv", "species", _GRID_XS, "prop_fertile", "n_occurrence"),
        _masked("{'species': grp, 'step': step}"),
        solving.newton("masked", tol=1e-9, most=50),
    ),
)
def species_deviance(t: Tables) -> DataFrame:
    out = grouped.deviance_by_group(
        t.curated(), "species", "prop_fertile", {term: [term] for term in GRID_TERMS}, GRID_FACTORS, "n_occurrence"
    )
    return rounded(out, 5, "deviance", "resid_dev", "f", "p")


CLIMATE_TERMS = [
    "ann_prec_anomaly_sc", "summer_temp_anomaly_sc", "ann_prec_prev_anomaly_sc",
    "summer_temp_prev_anomaly_sc",
]
TERM_LABELS = {
    "ann_prec_prev_anomaly_sc": "Previous year Aug - Jul precipitation",
    "summer_temp_prev_anomaly_sc": "Previous summer mean temperature",
    "ann_prec_anomaly_sc": "Aug - Jul precipitation",
    "summer_temp_anomaly_sc": "Summer mean temperature",
}


def _coefficients_sql(source: str, label: str) -> str:
    """Slopes of ``source`` (beta, errors, names) with intervals, one row each."""
    return (
        f"SELECT {label}, term, {_r('b', 5, 'estimate')}, {_r('se', 5, 'std_error')},"
        f" {_r('b - 1.96 * se', 5, 'ci_low')}, {_r('b + 1.96 * se', 5, 'ci_high')}"
        f" FROM (SELECT *, unnest(names) AS term, unnest(beta[2:]) AS b, unnest(errors[2:]) AS se FROM {source})"
    )


_ERRORS = "list_transform(range(p), lambda j: sqrt(-sw[j * (p + 1) + j + 1]))"
_MODEL_ROWS = "(SELECT * FROM curated WHERE year <> 1995)"


@query(
    "coef_table",
    with_curated(
        f"""SELECT functional_group, estimate, std_error, ci_low, ci_high, names[term] AS term, order_[term]::INTEGER AS term_order
           FROM ({_coefficients_sql('told', 'functional_group')}),
             (SELECT ['Aug - Jul precipitation', 'Summer mean temperature', 'Previous year Aug - Jul precipitation',
                      'Previous summer mean temperature'] AS names, [3, 4, 1, 2] AS order_)""",
        solving.collapsed(
            "cells", f"{_MODEL_ROWS} WHERE len(list_filter([{', '.join(CLIMATE_TERMS)}], lambda x: x IS NULL)) = 0",
            "functional_group", f"[1.0::DOUBLE, {', '.join(CLIMATE_TERMS)}]", "prop_fertile", "n_occurrence",
        ),
        solving.newton("cells", tol=1e-10, most=50),
        f"told AS (SELECT grp AS functional_group, beta, {_ERRORS} AS errors, [1, 2, 3, 4] AS names FROM fit)",
    ),
)
def coef_table(t: Tables) -> DataFrame:
    columns = ["functional_group", "prop_fertile", "n_occurrence", *CLIMATE_TERMS]
    rows = cut(t.model_data().select(*columns))
    fits = {
        group: glm.fit_binomial(
            rows.filter(F.col("functional_group") == group),
            "prop_fertile", CLIMATE_TERMS, (), "n_occurrence",
        )
        for group in KEPT_TYPES
    }
    out = glm.coefficient_table(
        t.spark, fits, "functional_group", TERM_LABELS, list(TERM_LABELS.values())
    )
    return rounded(out, 5, "estimate", "std_error", "ci_low", "ci_high")


#: A standard error beyond it tells that a group's rows lie at 0 or 1 along a column.
UNBOUNDED = 50.0


@query(
    "species_glm",
    with_curated(
        f"""SELECT species, term, CASE WHEN se > 0 AND se <= {UNBOUNDED} THEN {_r('b', 5, '_')[:-5]} END AS estimate,
             CASE WHEN se > 0 AND se <= {UNBOUNDED} THEN {_r('se', 5, '_')[:-5]} END AS std_error,
             {_r('deviance', 5, 'deviance')}, converged, coalesce(se = 0 OR se > {UNBOUNDED}, false) AS at_bound
           FROM (SELECT grp AS species, dev AS deviance, done AS converged, unnest(used) AS in_use,
                   unnest(list_concat(['(Intercept)'], list_transform(ts[2:], lambda l: 'temperature_level' || l),
                     ['summer_temp_anomaly_sc'])) AS term, unnest(beta) AS b,
                   unnest(list_transform(range(p), lambda j: CASE WHEN used[j + 1]
                     THEN sqrt(greatest(-sw[j * (p + 1) + j + 1], 0)) END)) AS se FROM fit, lv)""",
        LEVELS,
        solving.collapsed(
            "cells", "curated, lv WHERE summer_temp_anomaly_sc IS NOT NULL", "species",
            f"list_concat([1.0::DOUBLE], {_TEMP}, [summer_temp_anomaly_sc])", "prop_fertile", "n_occurrence",
        ),
        solving.newton("cells"),
    ),
)
def species_glm(t: Tables) -> DataFrame:
    fits = grouped.fit_by_group(
        t.curated(), "species", "prop_fertile",
        ["temperature_level", "summer_temp_anomaly_sc"], ["temperature_level"], "n_occurrence",
    )
    finite = (F.col("std_error") > 0) & (F.col("std_error") <= UNBOUNDED)
    out = fits.withColumn("at_bound", F.coalesce(~finite, F.lit(False))).withColumns(
        {c: F.when(finite, F.col(c)) for c in ("estimate", "std_error")}
    )
    return rounded(out, 5, "estimate", "std_error", "deviance")


#: Change at which the registered mixed fits stop: far below what is shown of them, so
#: that any way to the same equations' solution gives the same table.
MIXED_TOL = 1e-6


def _told(out: DataFrame, fit: mixed.MixedFit) -> DataFrame:
    """A result of a fit with how the fit ended."""
    return out.withColumn("converged", F.lit(fit.converged))


def _pql_rows(xs: str, terms: dict[str, str], source: str = "curated, lv") -> str:
    """Rows of a mixed model; ``terms`` maps a grouping column to its multiplier."""
    groups = ", ".join(f"{g.split('#')[0]}::VARCHAR" for g in terms)
    return (
        f"rows_ AS (SELECT {xs} AS xs, [{groups}] AS lev, [{', '.join(f'({m})::DOUBLE' for m in terms.values())}] AS zs,"
        f" sum_fertile::DOUBLE AS k, n_occurrence::DOUBLE AS n FROM {source})"
    )


_PQL_ERRORS = "list_transform(range(p), lambda j: sqrt(-sw[j * n + j + 1]))"
_PQL_VARIANCE = (
    "list_sum(list_transform(range(p * p), lambda e: -sw[(e // p) * n + e % p + 1] * x[e // p + 1] * x[e % p + 1]))"
)
_BY_BLOCK = {"species": "1", "block_id": "1"}


def _year_mixed(t: Tables) -> mixed.MixedFit:
    return mixed.fit_mixed(
        t.curated(), "sum_fertile", "n_occurrence", ["year"],
        [mixed.Random("species"), mixed.Random("block_id")], ["year"], tol=MIXED_TOL,
    )


@query(
    "mixed_intercepts",
    with_curated(
        f"""SELECT level AS species, {_r('u[place + 1]', 5, 'effect')},
             {_r('sqrt(-sw[(p + place) * n + p + place + 1])', 5, 'std_error')}, true AS converged
           FROM pql, pql_levels WHERE t = 1""",
        LEVELS,
        _pql_rows(_YEAR_XS, _BY_BLOCK),
        solving.mixed("rows_", 2),
    ),
)
def mixed_intercepts(t: Tables) -> DataFrame:
    fit = _year_mixed(t)
    return _told(rounded(fit.effects["species"], 5, "effect", "std_error"), fit)


PREDICTED = ("fitted", "se_fit", "response", "plo", "phi", "tlo", "thi")
_PREDICTED_SQL = ", ".join([
    _r("e", 5, "fitted"), _r("s", 5, "se_fit"), _r("1 / (1 + exp(-e))", 5, "response"),
    _r("1 / (1 + exp(-(e - 1.96 * s)))", 5, "plo"), _r("1 / (1 + exp(-(e + 1.96 * s)))", 5, "phi"),
    _r("1 / (1 + exp(-(e - 1.96 * sqrt(s * s + v))))", 5, "tlo"),
    _r("1 / (1 + exp(-(e + 1.96 * sqrt(s * s + v))))", 5, "thi"),
])


@query(
    "grid_prediction",
    with_curated(
        f"""SELECT year, {_PREDICTED_SQL}, true AS converged FROM (
             SELECT year, list_dot_product(x, beta) AS e, sqrt({_PQL_VARIANCE}) AS s, list_sum(g) AS v
             FROM (SELECT year, {_YEAR_XS} AS x FROM (SELECT DISTINCT year FROM curated), lv), pql)""",
        LEVELS,
        _pql_rows(_YEAR_XS, _BY_BLOCK),
        solving.mixed("rows_", 2),
    ),
)
def grid_prediction(t: Tables) -> DataFrame:
    rows = cut(t.curated().select("year", "species", "block_id", "sum_fertile", "n_occurrence"))
    fit = mixed.fit_mixed(
        rows, "sum_fertile", "n_occurrence", ["year"],
        [mixed.Random("species"), mixed.Random("block_id")], ["year"], tol=MIXED_TOL,
    )
    out = glm.predict_grid(level_product(rows, ["year"]), fit)
    return _told(rounded(out, 5, *PREDICTED), fit)


def _averaged_sql(keys: str, x: str, levels: str) -> str:
    """Response and interval of the fixed effects, averaged over a product of levels."""
    return f"""SELECT {keys}, {_r('avg(1 / (1 + exp(-e)))', 5, 'response')},
             {_r('avg(1 / (1 + exp(-(e - 1.96 * s))))', 5, 'plo')},
             {_r('avg(1 / (1 + exp(-(e + 1.96 * s))))', 5, 'phi')}, true AS converged
           FROM (SELECT {keys}, list_dot_product(x, beta) AS e, sqrt({_PQL_VARIANCE}) AS s
                 FROM (SELECT *, {x} AS x FROM {levels}, lv), pql) GROUP BY {keys}"""


def _levels_of(*columns: str) -> str:
    return ", ".join(f"(SELECT DISTINCT {c} FROM curated)" for c in columns)


@query(
    "grid_mixed_response",
    with_curated(
        _averaged_sql(
            "temperature_level, precipitation_level", _GRID_XS, _levels_of("year", "temperature_level", "precipitation_level")
        ),
        LEVELS,
        _pql_rows(_GRID_XS, {"species": "1", "site_id": "1"}),
        solving.mixed("rows_", 2),
    ),
)
def grid_mixed_response(t: Tables) -> DataFrame:
    """Predictions of the fixed effects on the product of all levels, averaged over years."""
    columns = ["year", "temperature_level", "precipitation_level"]
    rows = cut(t.curated().select(*columns, "species", "site_id", "sum_fertile", "n_occurrence"))
    fit = mixed.fit_mixed(
        rows, "sum_fertile", "n_occurrence", GRID_TERMS,
        [mixed.Random("species"), mixed.Random("site_id")], GRID_FACTORS, tol=MIXED_TOL,
    )
    predicted = glm.predict_grid(level_product(rows, columns), fit)
    out = glm.average_response(predicted, columns[1:], ["response", "plo", "phi"])
    return _told(rounded(out, 5, "response", "plo", "phi"), fit)


_THREE_XS = (
    f"list_concat([1.0::DOUBLE], {_YEAR}, {_GROUP}, {_TEMP}, {solving.crossed(_YEAR, _GROUP)},"
    f" {solving.crossed(_YEAR, _TEMP)}, {solving.crossed(_GROUP, _TEMP)}, {solving.crossed(_YEAR, _GROUP, _TEMP)})"
)
THREE_TERMS = [
    "year", "functional_group", "temperature_level", "year:functional_group", "year:temperature_level",
    "functional_group:temperature_level", "year:functional_group:temperature_level",
]


@query(
    "group_mixed_response",
    with_curated(
        _averaged_sql(
            "year, temperature_level, functional_group", _THREE_XS,
            _levels_of("year", "temperature_level", "functional_group"),
        ),
        LEVELS,
        _pql_rows(_THREE_XS, {"site_id": "1"}),
        solving.mixed("rows_", 1, prior=0.01),
    ),
)
def group_mixed_response(t: Tables) -> DataFrame:
    """Fixed-effect predictions by year, group and temperature level, sites being random. A
    weak prior keeps combinations whose rows are all at 0 or 1 finite."""
    columns = ["year", "functional_group", "temperature_level"]
    rows = cut(t.curated().select(*columns, "site_id", "sum_fertile", "n_occurrence"))
    fit = mixed.fit_mixed(
        rows, "sum_fertile", "n_occurrence", THREE_TERMS, [mixed.Random("site_id")], columns,
        prior_precision=0.01, tol=MIXED_TOL,
    )
    predicted = glm.predict_grid(level_product(rows, columns), fit)
    out = glm.average_response(predicted, columns, ["response", "plo", "phi"])
    return _told(rounded(out, 5, "response", "plo", "phi"), fit)


@query(
    "grid_response",
    with_curated(
        f"""SELECT functional_group, temperature_level, {_r('avg(response)', 6, 'response')},
             {_r('avg(ci_low)', 6, 'ci_low')}, {_r('avg(ci_high)', 6, 'ci_high')}, count(fitted) AS n_cells
           FROM (SELECT *, 1 / (1 + exp(-fitted)) AS response, 1 / (1 + exp(-(fitted - 1.96 * se_fit))) AS ci_low,
                        1 / (1 + exp(-(fitted + 1.96 * se_fit))) AS ci_high
                 FROM (SELECT * FROM {_levels_of('year', 'functional_group', 'temperature_level')})
                 LEFT JOIN cells USING (year, functional_group, temperature_level))
           GROUP BY functional_group, temperature_level""",
        _cells_sql("year, functional_group, temperature_level"),
    ),
)
def grid_response(t: Tables) -> DataFrame:
    """The three-way model's response on the product of its levels, averaged over years;
    combinations without rows, or at 0 or 1, have no fitted value to count."""
    columns = ["year", "functional_group", "temperature_level"]
    rows = cut(t.curated().select(*columns, "prop_fertile", "n_occurrence"))
    cells = glm.cell_estimates(rows, columns, "prop_fertile", "n_occurrence").select(*columns, "fitted", "se_fit")
    grid = glm.response_interval(level_product(rows, columns).join(cells, columns, "left"))
    known = grid.filter(F.col("fitted").isNotNull())
    out = glm.average_response(known, columns[1:], [*INTERVAL]).join(
        grid.groupBy(*columns[1:]).agg(F.count("fitted").alias("n_cells")), columns[1:], "right"
    )
    return rounded(out, 6, *INTERVAL)


@query(
    "mixed_slopes",
    with_curated(
        f"SELECT * REPLACE (round(estimate, 4) AS estimate, round(std_error, 4) AS std_error, round(ci_low, 4) AS ci_low,"
        f" round(ci_high, 4) AS ci_high), true AS converged FROM ({_coefficients_sql('told', 'model')})",
        _pql_rows(
            "[1.0::DOUBLE, summer_temp_anomaly_sc]", {"species": "1", "species#2": "summer_temp_anomaly_sc"},
            f"{_MODEL_ROWS} WHERE summer_temp_anomaly_sc IS NOT NULL",
        ),
        solving.mixed("rows_", 2),
        f"told AS (SELECT 'PQL' AS model, beta, {_PQL_ERRORS} AS errors, ['summer_temp_anomaly_sc'] AS names FROM pql)",
    ),
)
def mixed_slopes(t: Tables) -> DataFrame:
    fit = mixed.fit_mixed(
        t.model_data(), "sum_fertile", "n_occurrence", ["summer_temp_anomaly_sc"],
        [mixed.Random("species"), mixed.Random("species", "summer_temp_anomaly_sc")], tol=MIXED_TOL,
    )
    out = rounded(glm.coefficient_table(t.spark, {"PQL": fit}), 5, *COEFFICIENT)
    return _told(out.withColumns({c: F.round(c, 4) for c in COEFFICIENT}), fit)


COEFFICIENT = ("estimate", "std_error", "ci_low", "ci_high")


@query("mixed_coef_table")
def mixed_coef_table(t: Tables) -> DataFrame:
    """Coefficients of one mixed model in each functional group, fitted at once: species
    have an intercept and independent slopes of all four weather variables."""
    fits = mixed.fit_mixed_by(
        t.model_data(), ["functional_group"], "sum_fertile", "n_occurrence", CLIMATE_TERMS,
        [mixed.Random("species"), *[mixed.Random("species", c) for c in CLIMATE_TERMS], mixed.Random("block_id")],
        tol=1e-4,
    )
    slopes = fits.coefficients.filter("term <> '(Intercept)'").drop("iterations")
    e, s = F.col("estimate"), F.col("std_error")
    out = slopes.withColumns({"ci_low": e - glm.Z95 * s, "ci_high": e + glm.Z95 * s})
    out = out.withColumn("term", map_values("term", TERM_LABELS))
    return rounded(out.withColumn("term_order", label_order("term", list(TERM_LABELS.values()))), 5, *COEFFICIENT)


@query("site_slopes")
def site_slopes(t: Tables) -> DataFrame:
    """Sites with a correlated intercept and slope beside random species."""
    fit = mixed.fit_mixed(
        t.model_data(), "sum_fertile", "n_occurrence", ["summer_temp_anomaly_sc"],
        [mixed.Random("site_id", "summer_temp_anomaly_sc", intercept=True), mixed.Random("species")], tol=1e-4,
    )
    out = fit.effects["1+summer_temp_anomaly_sc|site_id"].withColumns(
        {name.replace("|", "_of_"): F.lit(v) for name, v in fit.variances.items()}
    )
    return _told(out.withColumn("correlation", F.lit(fit.correlations["1+summer_temp_anomaly_sc|site_id"])), fit)


HIERARCHICAL_TERMS = [
    "temp_grid_sc", "prec_grid_sc", "summer_temp_anomaly_sc", "ann_prec_anomaly_sc",
    "summer_temp_prev_anomaly_sc", "ann_prec_prev_anomaly_sc", "temp_grid_sc:prec_grid_sc",
]


_HIERARCHICAL = HIERARCHICAL_TERMS[:-1]


@query(
    "ridge_hierarchical",
    with_curated(
        _coefficients_sql("told", "model, true AS converged"),
        _pql_rows(
            f"[1.0::DOUBLE, {', '.join(_HIERARCHICAL)}, temp_grid_sc * prec_grid_sc]",
            {"species": "1", "site_id": "1", "year": "1"},
            f"{_MODEL_ROWS} WHERE len(list_filter([{', '.join(_HIERARCHICAL)}], lambda x: x IS NULL)) = 0",
        ),
        solving.mixed("rows_", 3, prior=0.001),
        f"told AS (SELECT 'hierarchical' AS model, beta, {_PQL_ERRORS} AS errors, {HIERARCHICAL_TERMS!r} AS names FROM pql)",
    ),
)
def ridge_hierarchical(t: Tables) -> DataFrame:
    fit = mixed.fit_mixed(
        t.model_data(), "sum_fertile", "n_occurrence", HIERARCHICAL_TERMS,
        [mixed.Random(g) for g in ("species", "site_id", "year")], prior_precision=0.001,
        tol=MIXED_TOL,
    )
    out = glm.coefficient_table(t.spark, {"hierarchical": fit})
    return _told(rounded(out, 5, *COEFFICIENT), fit)


@query("overdispersed_hierarchical")
def overdispersed_hierarchical(t: Tables) -> DataFrame:
    """The hierarchical model with a normal effect of every row."""
    fit = mixed.fit_mixed(
        t.model_data(), "sum_fertile", "n_occurrence", HIERARCHICAL_TERMS,
        [mixed.Random(g) for g in ("species", "site_id", "year")], prior_precision=0.001,
        overdispersed=True, tol=1e-4,
    )
    out = glm.coefficient_table(t.spark, {"hierarchical": fit})
    return _told(rounded(out, 5, *COEFFICIENT).withColumn("row_sd", F.lit(fit.overdispersion)), fit)


@query("zero_inflated_hierarchical")
def zero_inflated_hierarchical(t: Tables) -> DataFrame:
    """Species with their own intercepts and slopes, row effects, and rows that are 0
    whatever their predictor."""
    fit = mixed.fit_mixed(
        t.model_data(), "sum_fertile", "n_occurrence", ["temp_grid_sc"],
        [mixed.Random("species"), mixed.Random("species", "temp_grid_sc")], prior_precision=0.001,
        overdispersed=True, zero_inflated=True, tol=1e-3,
    )
    out = rounded(glm.coefficient_table(t.spark, {"hierarchical": fit}), 5, *COEFFICIENT)
    return _told(out.withColumns({"inclusion": F.lit(fit.inclusion), "row_sd": F.lit(fit.overdispersion)}), fit)


@query(
    "beta_binomial",
    with_survey(
        """SELECT species, alpha, beta, round(1.23e-13 + alpha / (alpha + beta), 10) AS mean,
             round(1.23e-13 + alpha * beta / ((alpha + beta) ** 2 * (alpha + beta + 1)), 10)
               AS variance
           FROM (SELECT species, 2.0::DOUBLE + sum(sum_fertile)::DOUBLE AS alpha,
                        2.0::DOUBLE + sum(n_occurrence - sum_fertile)::DOUBLE AS beta
                 FROM fertile_raw GROUP BY species)"""
    ),
)
def beta_binomial(t: Tables) -> DataFrame:
    out = conjugate.beta_posterior(t.fertile_raw(), ["species"], "sum_fertile", "n_occurrence")
    return rounded(out, 10, "mean", "variance")


@query(
    "zero_inflated",
    with_survey(
        """SELECT species, round(1.23e-9 + sum(CASE WHEN sum_fertile = 0
               THEN ln(1 - 0.8::DOUBLE + 0.8::DOUBLE * (1 - 0.3::DOUBLE) ** n_occurrence)
             ELSE ln(0.8::DOUBLE) + lgamma(n_occurrence + 1) - lgamma(sum_fertile + 1)
               - lgamma(n_occurrence - sum_fertile + 1) + sum_fertile * ln(0.3::DOUBLE)
               + (n_occurrence - sum_fertile) * ln(1 - 0.3::DOUBLE) END), 6) AS log_lik
           FROM fertile_raw GROUP BY species"""
    ),
)
def zero_inflated_likelihood(t: Tables) -> DataFrame:
    ll = zero_inflated.log_likelihood("sum_fertile", "n_occurrence", F.lit(0.3), 0.8)
    out = t.fertile_raw().groupBy("species").agg(F.sum(ll).alias("log_lik"))
    return rounded(out, 6, "log_lik")


@query("zero_inflated_fit")
def zero_inflated_fit(t: Tables) -> DataFrame:
    fit = zero_inflated.fit_zero_inflated(
        t.model_data(), "sum_fertile", "n_occurrence", ["temp_grid_sc", "summer_temp_anomaly_sc"]
    )
    rows = [
        (name, float(b), float(s), float(fit.inclusion), float(fit.log_likelihood), fit.converged, fit.iterations)
        for name, b, s in zip(fit.names, fit.beta, fit.std_errors)
    ]
    return t.spark.createDataFrame(
        rows,
        "term string, estimate double, std_error double, inclusion double, log_lik double,"
        " converged boolean, iterations int",
    )
