"""Survey hierarchy, curation order, sources, and plan shape."""

import pytest
from pyspark.sql import functions as F

from gridtrend import schemas
from gridtrend.bindings import Tables
from gridtrend.catalogue import QUERIES
from gridtrend.catalogue.field import CHOSEN
from gridtrend.plans import curation, survey
from gridtrend.sources import tables

SF = "/root/testdata/sf0.001"


def hierarchy(spark):
    turfs = spark.createDataFrame([("t1", "TTC", 1), ("t2", "TT2", 1), ("t3", None, 2), ("t4", "TT1", 9)],
                                  "turf_id string, treatment string, origin_plot_id int")
    plots = spark.createDataFrame([(1, "b1"), (2, "b1")], schemas.PLOTS)
    blocks = spark.createDataFrame([("b1", "s1")], schemas.BLOCKS)
    sites = spark.createDataFrame([("s1", 60.0, 6.0, 100.0, 600.0, 6.5, 1, 2)], schemas.SITES)
    return turfs, plots, blocks, sites


def test_fertility_rollup(spark):
    community = spark.createDataFrame(
        [("t1", i, 2011, "sp", f, 0) for i, f in enumerate((1, 0, 1, 1))]
        + [("t2", 1, 2011, "sp", 1, 0), ("t3", 1, 2011, "sp", 1, 0), ("t4", 1, 2011, "sp", None, 0)],
        schemas.SUBTURF_COMMUNITY,
    )
    out = {r["turf_id"]: r for r in survey.fertility_rollup(community, *hierarchy(spark)).collect()}
    assert set(out) == {"t1", "t4"}
    assert (out["t1"]["sum_fertile"], out["t1"]["n_occurrence"], out["t1"]["prop_fertile"]) == (3, 4, 0.75)
    assert out["t1"]["site_id"] == "s1" and out["t4"]["site_id"] is None
    assert out["t4"]["prop_fertile"] is None and out["t1"]["experiment"] == "gradient"
    everything = survey.fertility_rollup(community, *hierarchy(spark), treatments=None)
    assert everything.agg(F.sum("n_occurrence")).first()[0] == community.count()
    assert everything.filter("experiment = 'removal'").count() == 1


def fertile(spark, rows):
    """rows: (turf, species, year, k, n)."""
    df = spark.createDataFrame(rows, "turf_id string, species string, year int, sum_fertile int,"
                                     " n_occurrence int")  # fmt: skip
    return df.withColumns(
        {
            "site_id": F.lit("s1"),
            "prop_fertile": F.col("sum_fertile") / F.col("n_occurrence"),
            "annual_precipitation_gridded": F.lit(600.0),
            "summer_temperature_gridded": F.lit(None).cast("double"),
        }
    )


def test_curation_order_and_null_matching_join(spark):
    rows = [("t", "herb", y, 1, 4) for y in range(2011, 2016)]
    rows += [("t", "never", y, 0, 4) for y in range(2011, 2016)]
    rows += [("t", "shrub", y, 4, 4) for y in range(2011, 2016)]
    rows += [("t", "rare", y, 4, 4) for y in range(2011, 2014)]
    rows += [("u", "herb", y, 4, 4) for y in range(2011, 2014)] + [("t", "herb", 2010, 4, 4)]
    traits = spark.createDataFrame(
        [("herb", "forb"), ("never", "graminoid"), ("shrub", "woody"), ("rare", "forb")],
        "species string, functional_group string",
    )
    climate = spark.createDataFrame(
        [("s1", 2011, 600.0, None, 9.0)],
        "site string, year int, annual_precipitation_gridded double,"
        " summer_temperature_gridded double, ann_prec double",
    )
    out = curation.curate(fertile(spark, rows), climate, traits).collect()
    assert {(r["species"], r["turf_id"]) for r in out} == {("herb", "t")} and len(out) == 5
    # the short group on turf u and the dropped year do not enter the species mean
    assert all(r["mean_fertile"] == 0.25 and r["rel_fertile"] == 1.0 for r in out)
    assert {r["year"]: r["ann_prec"] for r in out}[2011] == 9.0
    assert {r["year"]: r["ann_prec"] for r in out}[2012] is None


def test_common_species(spark):
    rows = [("t%d" % i, "many", 2011, 1, 25) for i in range(9)]
    rows += [("t%d" % i, "few", 2011, 1, 25) for i in range(3)]
    rows += [("t%d" % i, "small", 2011, 1, 5) for i in range(9)]
    out = curation.common_species(fertile(spark, rows))
    assert {r["species"] for r in out.collect()} == {"many"}


def test_traits_drop_rename_repair(spark):
    traits = spark.createDataFrame(
        [("sp", "Season start", "V<e5>r"), ("sp", "Season finish", "H<f8>st"),
         ("sp", "Habitat", "x"), ("sp", "Height", "3")], schemas.CHARACTER_TRAITS)
    taxon = spark.createDataFrame([("sp", "forb", "perennial")], schemas.TAXON)
    r = survey.trait_table(traits, taxon).first().asDict()
    assert r == {"species": "sp", "Height": "3", "season_start": "Var", "season_finish": "Host",
                 "functional_group": "forb", "life_span": "perennial"}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "climate.csv").write_text(
        "Site,Date,Precipitation,Temperature\nUlv,2011-01-02,1.5,NA\n"
    )
    r = tables.read_daily_climate(spark, str(tmp_path / "climate.csv")).first()
    assert (r["site"], r["precipitation"], r["temperature"]) == ("Ulv", 1.5, None)
    header = ",".join(schemas.SURVEY_EXTRACT.fieldNames())
    flags = ",".join(["NA", "1"] + ["0"] * 11)
    (tmp_path / "extract.csv").write_text(f"{header}\nt,s,2011,sp,forb,TT2,1,-2,4,2.0,3.0,{flags}\n")
    extract = tables.read_survey_extract(spark, str(tmp_path / "extract.csv"))
    r = survey.survey_extract_columns(extract).first()
    assert (r["f_var"], r["f_fso"], r["sum_fertile"], r["prop_fertile"]) == (0, 1, 2, 0.5)
    assert (r["biomass"], r["treatment_group"], r["temperature_label"]) == (6.0, "Warm", "alpine")
    tables.write_table(extract, str(tmp_path / "saved"), ["year"])
    assert tables.read_table(spark, str(tmp_path / "saved"), ["turf_id"]).count() == 1


def test_scan_is_pruned_and_filtered(spark):
    plan = QUERIES["negated_membership"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", ["fertility_summary", "climate_scaled", "predictive_counts"])
def test_same_rows_at_any_partitioning(spark, name):
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        seen.add(str(sorted(map(str, QUERIES[name](spark, SF).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_single_species_grid_keeps_every_row_of_its_species(spark):
    folder = "/root/testdata/sf0.01"
    rows = Tables(spark, folder).curated().filter(F.col("species").isin(list(CHOSEN))).count()
    got = QUERIES["single_species_grid"](spark, folder).agg(F.sum("n")).first()[0]
    assert got == rows > 0
