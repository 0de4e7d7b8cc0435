"""The driver's test tables seen as survey, climate, trait, pixel and draw tables.

Only names, keys and simple expressions live here; the operators are the same
ones a real survey uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrend.functions.nulls import not_in
from gridtrend.functions.scalars import hydrological_year, month_in
from gridtrend.operators.reshape import melt
from gridtrend.plans import climate as climate_plans
from gridtrend.plans import curation, survey
from gridtrend.session import cut
from gridtrend.sources.tables import read_table

KEPT_TYPES = ("ECONOMY", "PROMO", "SMALL")
EXCLUDED_YEARS = (1996,)
TEMPERATURE = {1: "alpine", 2: "subalpine", 3: "boreal"}
PRECIPITATION = {1: "600", 2: "1200", 3: "2000", 4: "2700"}
SITE_NAMES = {str(i): f"NATION_{i}" for i in range(25)}
COEFFICIENTS = ("click", "error", "purchase", "signup", "view")
#: Sampler setting of the draw tables: chains, and kept iterations of each.
CHAINS, ITERATIONS = 3, 200


SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
}


class Tables:
    """Bound tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._normals = None

    def read(self, name: str, *columns: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet", columns, SCHEMAS[name])

    # survey ---------------------------------------------------------------
    def species(self) -> DataFrame:
        return self.read("part", "p_partkey", "p_brand", "p_type", "p_size").select(
            "p_partkey",
            F.concat_ws("|", "p_brand", "p_type").alias("species"),
            F.col("p_type").alias("functional_group"),
            "p_size",
        )

    def community(self, with_nulls: bool = False) -> DataFrame:
        fertile = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
        if with_nulls:
            fertile = F.when(F.col("l_orderkey") % 50 != 0, fertile)
        lines = self.read(
            "lineitem",
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate",
        )
        species = self.species().select("p_partkey", "species")
        return lines.join(species, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_suppkey").alias("turf_id"),
            F.col("l_linenumber").alias("sub_turf"),
            F.year("l_shipdate").alias("year"),
            "species",
            fertile.alias("fertile"),
        )

    def turfs(self) -> DataFrame:
        codes = F.array(*[F.lit(t) for t in ("TTC", "TT1", "TT2", "TT3", "TT4", None)])
        return self.read("supplier", "s_suppkey").select(
            F.col("s_suppkey").alias("turf_id"),
            F.get(codes, (F.col("s_suppkey") % 6).cast("int")).alias("treatment"),
            F.col("s_suppkey").alias("origin_plot_id"),
        )

    def plots(self) -> DataFrame:
        block = F.concat_ws("_", F.col("s_nationkey"), F.col("s_suppkey") % 3)
        return self.read("supplier", "s_suppkey", "s_nationkey").select(
            F.col("s_suppkey").alias("plot_id"), block.alias("block_id"), "s_nationkey"
        )

    def blocks(self) -> DataFrame:
        nation = self.read("nation", "n_nationkey", "n_name")
        return (
            self.plots()
            .select("block_id", "s_nationkey")
            .distinct()
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("block_id", F.col("n_name").alias("site_id"))
        )

    def site_attributes(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.read("nation").select(
            F.col("n_name").alias("site_id"),
            (F.lit(60.0) + key / 10.0).alias("latitude"),
            (F.lit(5.0) + key / 5.0).alias("longitude"),
            (key * 100.0).alias("elevation_masl"),
            (F.col("n_regionkey") % 3 + 1).alias("temperature_level"),
            (key % 4 + 1).alias("precipitation_level"),
        )

    def sites(self) -> DataFrame:
        return self.site_attributes().join(self.normals(), "site_id", "left")

    def fertile_raw(self, treatments=("TTC", "TT1"), with_nulls: bool = False) -> DataFrame:
        return survey.fertility_rollup(
            self.community(with_nulls), self.turfs(), self.plots(), self.blocks(), self.sites(),
            treatments,
        )

    # traits ---------------------------------------------------------------
    def species_sizes(self) -> DataFrame:
        return self.species().groupBy("species", "functional_group").agg(
            F.min("p_size").alias("size")
        )

    def character_traits(self) -> DataFrame:
        def pick(*codes: str):
            position = (F.col("size") % len(codes)).cast("int")
            return F.get(F.array(*[F.lit(c) for c in codes]), position)

        wide = self.species_sizes().select(
            "species",
            pick("MSo", "SSo", "FSo", "V<e5>r").alias("Season start"),
            pick("H<f8>st", "MSo", "SSo", "FSo", "V<e5>r").alias("Season finish"),
            pick("meadow", "mire").alias("Habitat"),
            pick("common", "rare").alias("Common-rear"),
            pick("dry", "moist", "wet").alias("Soil type"),
            F.col("size").cast("string").alias("Height"),
        )
        return melt(wide, ["species"], wide.columns[1:], "trait", "value")

    def taxon(self) -> DataFrame:
        return self.species_sizes().select(
            "species",
            "functional_group",
            F.when(F.col("size") % 4 == 0, "annual").otherwise("perennial").alias("life_span"),
        )

    def traits(self) -> DataFrame:
        return survey.trait_table(self.character_traits(), self.taxon())

    # climate --------------------------------------------------------------
    def daily(self) -> DataFrame:
        orders = self.read("orders", "o_custkey", "o_orderdate", "o_totalprice")
        customer = self.read("customer", "c_custkey", "c_nationkey", "c_acctbal")
        return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_nationkey").cast("string").alias("site"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_totalprice").alias("precipitation"),
            F.col("c_acctbal").alias("temperature"),
        )

    def monthly(self) -> DataFrame:
        return climate_plans.monthly_climate(self.daily())

    def annual(self) -> DataFrame:
        return climate_plans.annual_climate(self.monthly(), SITE_NAMES)

    def normals(self) -> DataFrame:
        """Per-site normals, a stored table in a real survey, so written once here."""
        if self._normals is None:
            self._normals = cut(self._site_normals())
        return self._normals

    def _site_normals(self) -> DataFrame:
        """Exact decimal sums make the doubles reproducible."""
        summer = month_in("date", climate_plans.SUMMER_MONTHS)
        exact = "decimal(18,2)"
        per_year = self.daily().groupBy("site", hydrological_year("date").alias("year")).agg(
            F.sum(F.col("precipitation").cast(exact)).alias("rain"),
            F.sum(F.when(summer, F.col("temperature").cast(exact))).alias("heat"),
            F.count(F.when(summer, F.lit(1))).alias("days"),
        )
        per_site = per_year.groupBy("site").agg(
            (F.sum("rain").cast("double") / F.count(F.lit(1))).alias(
                "annual_precipitation_gridded"
            ),
            (F.sum("heat").cast("double") / F.sum("days")).alias("summer_temperature_gridded"),
        )
        return per_site.withColumn("site_id", F.concat(F.lit("NATION_"), "site")).drop("site")

    def climate(self) -> DataFrame:
        levels = self.site_attributes().select(
            F.col("site_id").alias("site"), "temperature_level", "precipitation_level"
        )
        return climate_plans.climate_table(self.annual(), self.normals(), levels)

    # curated --------------------------------------------------------------
    def curated(self) -> DataFrame:
        return curation.curate(
            self.fertile_raw(), self.climate(), self.traits(), EXCLUDED_YEARS, 3, KEPT_TYPES
        )

    def model_data(self) -> DataFrame:
        """Curated rows of the model years, with the columns the models use."""
        return self.curated().filter(not_in("year", (1995,)))

    # posterior draws ------------------------------------------------------
    def draws_long(self) -> DataFrame:
        return self.read("events", "event_id", "user_id", "event_type", "value").select(
            (F.col("user_id") % CHAINS).alias("chain"),
            F.col("event_id").alias("iter"),
            F.col("event_type").alias("param"),
            "value",
        )

    def draws_wide(self) -> DataFrame:
        """One row per (chain, iter) with a small value for each coefficient.

        Five consecutive events are one draw, an event's place among them is its
        coefficient, and draws beyond the sampler's number are averaged into it, so
        every event counts and no draw lacks a coefficient.
        """
        draw = F.floor(F.col("event_id") / 5) % (CHAINS * ITERATIONS)
        place = F.col("event_id") % len(COEFFICIENTS)
        return (
            self.read("events", "event_id", "value")
            .groupBy((draw % CHAINS).alias("chain"), (F.floor(draw / CHAINS) + 1).alias("iter"))
            .agg(
                *[
                    (F.avg(F.when(place == i, F.col("value"))) / 100.0 - 0.5).alias(c)
                    for i, c in enumerate(COEFFICIENTS)
                ]
            )
        )

    def pixels(self) -> DataFrame:
        return self.read("part", "p_partkey", "p_size", "p_retailprice").select(
            F.col("p_size").cast("double").alias("x"),
            F.col("p_retailprice").alias("y"),
            F.col("p_partkey").alias("value"),
        )
