"""Hand-worked cases for null, NaN, zero and scalar rules."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from gridtrend.functions import nulls, scalars
from gridtrend.functions.labels import SITE_LEVELS, SITE_NAMES
from gridtrend.operators import groups, keys, reshape, timeline
from gridtrend.plans import climate, summaries, survey
from gridtrend.sources import tables


def one(df):
    return df.collect()[0]


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


def test_strict_sum_and_proportion(spark):
    rows = [("a", 1), ("a", 0), ("a", 1), ("a", 1), ("b", 1), ("b", None), ("b", 1)]
    df = spark.createDataFrame(rows, "g string, fertile int")
    out = df.groupBy("g").agg(
        nulls.strict_sum("fertile").alias("s"), F.count(F.lit(1)).alias("n")
    ).withColumn("p", nulls.ratio("s", "n"))
    got = {r["g"]: (r["s"], r["n"], r["p"]) for r in out.collect()}
    assert got == {"a": (3, 4, 0.75), "b": (None, 3, None)}


def test_skipna_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    r = one(df.agg(nulls.skipna_sum("v").alias("s"), nulls.skipna_mean("v").alias("m")))
    assert r["s"] == 0.0 and math.isnan(r["m"])


def test_standard_error_counts_null_rows(spark):
    df = spark.createDataFrame([("s", 1.0, 1.0), ("s", 3.0, 2.0), ("s", None, 3.0)],
                               "site_id string, v double, c double")
    r = one(summaries.response_and_climate(df, ["site_id"], "v", "c"))
    assert r["mean_response"] == 2 and r["n"] == 3
    assert r["se_response"] == pytest.approx(math.sqrt(2) / math.sqrt(3))


@pytest.mark.parametrize(
    "values, expected",
    [([0.0, 0.0], [0.0, 0.0]), ([0.2, 0.6], [0.5, 1.5]), ([0.2, None], [None, None])],
)
def test_ratio_to_group_mean(spark, values, expected):
    df = spark.createDataFrame(list(enumerate(values)), "i int, p double").withColumn("g", F.lit("s"))
    out = groups.ratio_to_group_mean(df, ["g"], "p", "m", "rel")
    assert column(out, "rel", "i") == [pytest.approx(e) if e is not None else None for e in expected]


def test_ratio_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, -2.0, 0.0), (3, 1.0, 4.0)],
                               "i int, a double, b double")
    got = column(df.withColumn("r", nulls.ratio("a", "b")), "r", "i")
    assert math.isnan(got[0]) and got[1:] == [math.inf, -math.inf, 0.25]


def test_scale(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (3, None)], "i int, v double")
    assert column(timeline.scale_columns(df, {"z": "v"}), "z", "i") == [-1.0, 0.0, 1.0, None]
    for rows in ([(0, 5.0), (1, 5.0)], [(0, 5.0)]):
        df = spark.createDataFrame(rows, "i int, v double")
        assert all(math.isnan(z) for z in column(timeline.scale_columns(df, {"z": "v"}), "z", "i"))


def test_prev_year_respects_gaps(spark):
    df = spark.createDataFrame([("s", 2009, 1.0), ("s", 2011, 2.0), ("s", 2012, 3.0)],
                               "site string, year int, v double")
    out = timeline.prev_year(df, ["site"], "year", {"p": "v"})
    assert column(out, "p", "year") == [None, None, 2.0]


def daily(spark, rows):
    return spark.createDataFrame(
        [("Ulv", datetime.date.fromisoformat(d), p, t) for d, p, t in rows],
        "site string, date date, precipitation double, temperature double",
    )


def test_month_stamp_and_summer_mean_of_months(spark):
    rows = [("2024-06-01", 0.0, 10.0), ("2024-06-02", 0.0, 20.0), ("2024-06-03", 0.0, 30.0),
            ("2024-07-31", 0.0, 40.0)]
    monthly = climate.monthly_climate(daily(spark, rows))
    assert {r["date"] for r in monthly.collect()} == {
        datetime.date(2024, 6, 15), datetime.date(2024, 7, 15)
    }
    assert one(climate.summer_mean(monthly))["value"] == 30.0


def test_hydrological_year_and_annual_table(spark):
    rows = [("2010-07-31", 5.0, 1.0), ("2010-08-01", 7.0, 1.0), ("2011-01-10", 2.0, 1.0)]
    annual = climate.annual_climate(climate.monthly_climate(daily(spark, rows)))
    got = {r["year"]: (r["site"], r["ann_prec"], r["mean_summer_temp"]) for r in annual.collect()}
    assert got == {2010: ("Ulvhaugen", 5.0, 1.0), 2011: ("Ulvhaugen", 9.0, None)}


def test_fixed_site_levels_label_every_site(spark):
    sites = climate.fixed_site_levels(spark)
    assert {s for s, _, _ in SITE_LEVELS} == set(SITE_NAMES.values())
    rows = spark.createDataFrame([(s,) for s in [*SITE_NAMES.values(), "Nowhere"]], "site string")
    out = climate.with_site_levels(rows, sites).collect()
    got = {r["site"]: (r["temp_level"], r["prec_level"]) for r in out}
    assert got["Ulvhaugen"] == ("alpine", "600mm") and got["Nowhere"] == (None, None)


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([(2009,), (2011,), (None,)], "y int")
    got = df.filter(nulls.not_in("y", [2009])).collect()
    assert sorted(str(r["y"]) for r in got) == ["2011", "None"]


def test_group_count_filter_both_paths(spark):
    rows = [(g, i) for g, n in (("a", 3), ("b", 4), ("c", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int")
    for small in (True, False):
        kept = groups.group_count_filter(df, ["g"], 3, small_groups=small)
        assert {r["g"] for r in kept.collect()} == {"b", "c"} and kept.count() == 9


def test_attach_shuffle_path_equals_broadcast_path(spark):
    """A third of the rows in one group and exact copies; nothing is lost."""
    df = spark.range(6000).selectExpr(
        "IF(id % 3 = 0, NULL, int(id % 50)) AS g", "id % 7 AS v", "1 AS copy"
    )
    aggregates = {"s": F.sum("v"), "n": F.count(F.lit(1))}
    wide = groups.attach_group_stats(df, ["g"], aggregates)
    split = groups.attach_group_stats(df, ["g"], aggregates, broadcast_rows=0, hot_groups=2)
    assert sorted(map(str, wide.collect())) == sorted(map(str, split.collect()))
    assert split.count() == 6000 and split.filter("n IS NULL").count() == 0


def test_consecutive_runs(spark):
    rows = [("a", y) for y in (2009, 2011, 2012, 2013)] + [("b", y) for y in (2009, 2011, 2013)]
    df = spark.createDataFrame(rows, "t string, year int")
    assert {r["t"] for r in groups.consecutive_run(df, ["t"], "year", 3).collect()} == {"a"}


def test_pivot_duplicate_key_fails_and_round_trips(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)],
                               "i int, k string, v double")
    wide = reshape.pivot_found(df, ["i"], "k", "v")
    back = reshape.melt(wide, ["i"], ["a", "b"], "k", "v").na.drop()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    twice = df.union(df)
    with pytest.raises(Exception, match="duplicate rows"):
        reshape.pivot_unique(twice, ["i"], "k", "v", ["a", "b"]).collect()


def test_melt_outside_range_and_stack(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    out = reshape.melt_outside_range(df, "b", "c", "k", "v").collect()
    assert sorted((r["b"], r["c"], r["k"], r["v"]) for r in out) == [(2, 3, "a", 1), (2, 3, "d", 4)]
    both = reshape.stack(df.select("a"), df.select("b"))
    assert both.columns == ["a", "b"] and both.filter("a IS NULL").count() == 1


def test_map_values_passes_through(spark):
    df = spark.createDataFrame([(0, "Ulv"), (1, "Xyz"), (2, None)], "i int, s string")
    assert column(df.withColumn("m", scalars.map_values("s", {"Ulv": "Ulvhaugen"})), "m", "i") == [
        "Ulvhaugen", "Xyz", None
    ]


def test_logs_and_logistic(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.5, 800.0), (2, 0.0, -800.0)],
                               "i int, p double, x double")
    out = df.withColumns({"nl": scalars.neg_log("p"), "e": scalars.expit("x"), "l": scalars.logit("p")})
    assert column(out, "nl", "i") == [0.0, pytest.approx(0.693147, abs=1e-6), math.inf]
    assert column(out, "e", "i") == [0.5, 1.0, 0.0]
    assert column(out, "l", "i") == [math.inf, 0.0, -math.inf]


def test_dense_index_row_id_grid(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "i int, s string")
    assert column(keys.dense_index(df, "s", "k"), "k", "i") == [2, 1, None, 2]
    many = spark.range(5000).repartition(7)
    ids = keys.row_id(many.withColumnRenamed("id", "v"), ["v"])
    assert ids.filter("id <> v + 1").count() == 0
    assert keys.level_grid(spark, {"year": [2009, 2011], "level": [1, 2, 3]}).count() == 6
    with pytest.raises(ValueError):
        keys.distinct_levels(many, "id", 100)
    with pytest.raises(ValueError):
        keys.require_unique(df, ["s"])


def test_season_and_zone(spark):
    flags = {f: 0 for f in ("f_var", "f_fso", "f_mso", "f_sso", "f_ho", "nem", "bnem", "sbor",
                            "lalp", "malp", "halp")}
    rows = [{**flags, "i": 0, "lalp": 1}, {**flags, "i": 1, "nem": 1, "f_ho": 1},
            {**flags, "i": 2, "nem": 1, "lalp": 1, "f_mso": 1}]
    out = survey.season_and_zone(spark.createDataFrame(rows))
    assert column(out, "zone", "i") == ["alpine", "lowland", "general"]
    assert column(out, "season", "i") == ["early", "late", "none"]


def test_level_product_and_running_max(spark):
    rows = [(y, lv, g) for y in (2009, 2011) for lv in ("a", "b", None) for g in (1, 2, 3)]
    df = spark.createDataFrame(rows, "year int, level string, g int")
    got = sorted(map(tuple, keys.level_product(df, ["year", "level", "g"]).collect()))
    assert got == [(y, lv, g) for y in (2009, 2011) for lv in ("a", "b") for g in (1, 2, 3)]
    assert keys.level_product(df.filter("year > 3000"), ["year", "g"]).collect() == []
    values = [(i, (i * 7919) % 1009) for i in range(3000)]
    out = keys.running_max(spark.createDataFrame(values, "i int, v int").repartition(9), "i", "v", "top").orderBy("i").collect()
    top = 0
    for r, (_, v) in zip(out, values):
        top = max(top, v)
        assert r["top"] == top


def test_damaged_text_rows(spark, tmp_path):
    path = tmp_path / "daily.csv"
    path.write_text('site,date,precipitation,temperature\n"A, ""b""",2010-06-01,1.5,NA\nUlv,2010-06-02,wet,3\nUlv,NA,,4\n')
    kept = [tuple(r) for r in tables.read_daily_climate(spark, str(path)).collect()]
    assert kept[0][0] == 'A, "b"' and kept[0][3] is None and kept[1][2:] == (None, 3.0) and kept[2][1:] == (None, None, 4.0)
    assert len(tables.read_daily_climate(spark, str(path), "drop").collect()) == 2
    with pytest.raises(Exception, match="(?i)malformed|parse|cast"):
        tables.read_daily_climate(spark, str(path), "raise").collect()


def test_distinct_counts_scan_the_input_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id % 7 AS a", "IF(id % 11 = 0, NULL, id % 11) AS b", "id AS c").write.parquet(path)
    out = summaries.distinct_counts(spark.read.parquet(path), ["a", "b", "c"])
    assert tuple(out.first()) == (7, 10, 1000)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
