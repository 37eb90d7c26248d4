import pytest
from pyspark.sql import functions as F

from arealens import presets
from arealens.operators import profiles as P
from arealens.plans import cleaning as C
from arealens.plans.adhoc import adhoc_select
from arealens.plans.features import output_columns
from arealens.sources import tables


def csv(tmp_path, name, lines, encoding="utf-8"):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding=encoding)
    return str(path)


def test_first_station_in_file_order_wins(spark, tmp_path):
    path = csv(tmp_path, "s.csv", [
        "Stop Name,Borough,GTFS Latitude,GTFS Longitude,Daytime Routes",
        "A St,M,40.5,-73.5,1 2",
        "A St,Q,40.5,-73.5,9",
        "B St,,40.5,-73.5,9",
        "C St,Bk,0,-73.5,9",
    ])
    rows = C.clean_stations(tables.scan_csv(spark, path)).collect()
    assert [tuple(r) for r in rows] == [("A St", "MANHATTAN", 40.5, -73.5, "1 2")]


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([("x",)], "`Stop Name` string")
    with pytest.raises(ValueError, match="borough"):
        C.clean_stations(df)
    with pytest.raises(ValueError, match="Reporting Year"):
        C.clean_storefronts(df)
    assert C.clean_health_index(df) is None
    empty, found = tables.require_or_empty(df, ["cd"], "cd string")
    assert not found and empty.count() == 0


def test_pedestrian_without_period_columns_is_empty(spark):
    df = spark.createDataFrame([("POINT (-73.5 40.5)", "m", "5")], "the_geom string, Borough string, May19_AM string")
    assert C.clean_pedestrian(df).count() == 0
    assert C.clean_pedestrian(df, 2019).first().avg_pedestrian == 5.0
    assert C.clean_pedestrian(df, 2020, "upto").first().peak_pedestrian == 5.0


def test_health_index_takes_the_first_present_score(spark, tmp_path):
    head = "CD,Median_Income,NYC_Poverty_Rate,Perc_White,Perc_Black,Perc_Asian,Perc_Hispanic,Goal,IndexScore,GoalRank"
    path = csv(tmp_path, "i.csv", [
        head,
        'BX Community Districts 3 & 6,"$15,510",29%,1,2,3,4,Overall Index,,55',
        'BX Community Districts 3 & 6,"$99,999",29%,1,2,3,4,Overall Index,0.5,56',
        "café,1,1,1,1,1,1,Overall Index,1,1",
    ], "latin-1")
    row = C.clean_health_index(tables.scan_csv(spark, path, encoding="ISO-8859-1")).first()
    assert (row.cd, row.nfh_median_income, row.nfh_overall_score, row.nfh_overall_rank) == ("BX03", 15510.0, 0.5, 55.0)


def test_column_order_of_the_feature_table():
    names = ["cd", "pop_black", "x", "pop_asian", "median_household_income", "total_population_proxy", "nfh_median_income", "nfh_overall_rank"]
    assert output_columns(names) == ["cd", "pop_black", "pop_asian", "total_population_proxy", "x", "nfh_median_income"]
    assert output_columns(["a", "median_household_income"]) == ["a", "median_household_income"]


@pytest.mark.parametrize("sql", ["DROP VIEW neighborhoods", "CREATE TABLE t AS SELECT 1", "INSERT INTO neighborhoods VALUES (1)", "SELECT 1; SELECT 2"])
def test_adhoc_sql_is_read_only(spark, sql):
    df = spark.range(5).withColumnRenamed("id", "n")
    with pytest.raises(Exception):
        adhoc_select(df, sql).collect()
    assert adhoc_select(df, "SELECT max(n) AS m FROM neighborhoods").first().m == 4


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM neighborhoods",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM neighborhoods",
        "SELECT * FROM csv.`/etc/hosts`",
        "SELECT * FROM other",
        "SELECT * FROM neighborhoods JOIN other USING (n)",
        "SELECT * FROM neighborhoods WHERE n IN (SELECT n FROM other)",
        "SELECT * FROM range(10)",
        "SELECT * FROM IDENTIFIER('csv.`/etc/hosts`')",
        "SELECT * FROM IDENTIFIER('other')",
        "SELECT * FROM global_temp.shared",
        "SELECT * FROM stored",
        "SELECT * FROM IDENTIFIER('stored')",
        "SELECT (SELECT max(id) FROM stored) AS m FROM neighborhoods",
        "WITH a AS (SELECT * FROM stored) SELECT n FROM neighborhoods WHERE EXISTS (SELECT 1 FROM a WHERE a.id = n)",
        "SELECT current_user() FROM neighborhoods",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') FROM neighborhoods",
        "SELECT input_file_name() FROM neighborhoods",
        "SELECT own_function(n) FROM neighborhoods",
    ],
)
def test_adhoc_sql_sees_only_its_view(spark, sql, tmp_path):
    spark.range(5).withColumnRenamed("id", "n").createOrReplaceTempView("other")
    spark.range(5).createOrReplaceGlobalTempView("shared")
    if not spark.catalog.tableExists("stored"):
        spark.range(5).write.saveAsTable("stored", path=f"{tmp_path}/stored")
    spark.udf.register("own_function", lambda n: n, "long")
    with pytest.raises(Exception):
        adhoc_select(spark.range(5).withColumnRenamed("id", "n"), sql).collect()


def test_adhoc_leaves_a_view_of_the_same_name_alone(spark):
    spark.range(3).createOrReplaceTempView("neighborhoods")
    assert adhoc_select(spark.range(7), "SELECT count(*) AS c FROM neighborhoods").first().c == 7
    assert spark.table("neighborhoods").count() == 3


def test_adhoc_leaves_literals_as_they_are(spark):
    df = spark.createDataFrame([("all neighborhoods here",), ("neighborhoods",)], "name string")
    assert adhoc_select(df, "SELECT name FROM neighborhoods WHERE name = 'all neighborhoods here'").count() == 1
    assert adhoc_select(df, "SELECT n.name FROM Neighborhoods n WHERE n.name = :v", {"v": "neighborhoods"}).count() == 1
    assert adhoc_select(df, "SELECT x FROM VALUES (1), (2) AS t(x) WHERE x IN (SELECT length(left(name, 1)) FROM neighborhoods)").count() == 1
    assert adhoc_select(df.limit(1), "SELECT a.name FROM neighborhoods a JOIN IDENTIFIER('neighborhoods') b ON a.name = b.name").count() == 1


def test_adhoc_returns_all_rows_unless_asked(spark):
    assert adhoc_select(spark.range(1000), "WITH a AS (SELECT * FROM neighborhoods) SELECT id FROM a -- all").count() == 1000
    assert adhoc_select(spark.range(1000), "SELECT id FROM neighborhoods", rows=150).count() == 150


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([("z", 2), ("y", 3)], "v string, k int")
    assert sorted(map(tuple, tables.upsert_snapshot(old, new, "k").collect())) == [(1, "a"), (2, "z"), (3, "y")]


def test_store_columns_must_not_collide(spark):
    with pytest.raises(ValueError, match="collide"):
        tables.to_store_columns(spark.range(1).select(F.lit(1).alias("act_A"), F.lit(2).alias("ACT_a").alias("Act_A2"), F.lit(3).alias("act_a2")))


def test_profile_text_of_a_sparse_row(spark):
    df = spark.createDataFrame([("Mill", "BRONX", 12.25, 3, 2)], "neighborhood string, borough string, area_km2 double, storefront_filing_count int, act_FOOD_SERVICES_storefront int")
    text = P.text_profile(df).first().text
    assert text.startswith("Mill in BRONX. CDTA area about 12.2 km2. 3 non-vacant storefront filings; sparse filing density (0.0/km2).")
    assert text.endswith(" Non-vacant storefront filings by primary business activity: 3 total. Counts by activity: FOOD SERVICES (2).")
    assert "Community socioeconomic" not in text and "commute" not in text
    lines = P.labelled_profile(df).first().profile.split("\n")
    assert lines[:3] == ["Mill (BRONX)", "------------", "Area (km2): 12.25"]
    assert lines[-4:-2] == ["Storefront activity counts:", "  - FOOD SERVICES: 2"]


def test_titles_follow_the_first_rule(spark):
    rows = [(0, 0, "storefront_density_per_km2", 0.9), (0, 1, "avg_pedestrian", 0.5), (0, 2, "category_entropy", -0.1),
            (1, 0, "transit_activity_score", 0.9), (1, 1, "storefront_density_per_km2", 0.0),
            (2, 0, "total_jobs", 0.8), (3, 0, "nfh_overall_score", 0.7), (4, 0, "x", 0.0), (5, 0, "storefront_density_per_km2", 0.1)]
    df = spark.createDataFrame(rows, "cluster int, position int, feature string, z double")
    got = {r.cluster: r.title for r in P.cluster_title(df).collect()}
    assert got == {
        0: "High-Traffic Commercial Core",
        1: "Transit-Oriented Commercial District",
        2: "Employment-Heavy Business District",
        3: "Stable Lower-Density Neighborhood Market",
        4: "Lower-Density Local Commercial Area",
        5: "Balanced Neighborhood Market",
    }
