"""A: scans, sources, sinks."""

from pyspark.sql import functions as F

from arealens.operators.spatial import polygon_edges
from arealens.session import scratch_path
from arealens.sources import geojson, tables, vectors
from checks.base import check, r6, s6
from checks.derived import POLYGON_SQL, area_table, AREA_SQL, polygons


@check("a1_scan_csv", f"SELECT s_suppkey, s_name, s_nationkey, {s6('s_acctbal')} AS s_acctbal FROM supplier")
def a1(t):
    path = scratch_path(t.spark, "csv")
    tables.write_table(t("supplier"), path, "csv")
    return tables.scan_csv(t.spark, path, t("supplier").schema).select("s_suppkey", "s_name", "s_nationkey", r6("s_acctbal"))


@check("a2_scan_csv_latin1", "SELECT c_custkey, 'é, \"' || c_mktsegment || '\" ñ' AS label FROM customer")
def a2(t):
    path = scratch_path(t.spark, "latin1")
    label = F.concat(F.lit('é, "'), "c_mktsegment", F.lit('" ñ'))
    out = t("customer").select("c_custkey", label.alias("label"))
    out.write.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    return tables.scan_csv(t.spark, path, "c_custkey long, label string", encoding="ISO-8859-1")


@check("a3_require_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def a3(t):
    needed = ["o_orderkey", "o_orderstatus"]
    return tables.require_columns(t("orders"), needed, "orders").select(*needed)


@check(
    "a4_rename_keep",
    "SELECT event_type AS kind, event_id AS id, value FROM events",
)
def a4(t):
    renames = {"event_id": "id", "event_type": "kind", "user_id": "who"}
    return tables.rename_keep(t("events"), renames, ["kind", "id", "absent", "value"])


@check("a5_optional_source", "SELECT c_custkey, c_nationkey, 0 AS n_points FROM customer")
def a5(t):
    return tables.optional_source(None, t("customer"), ["c_custkey", "c_nationkey"], ["n_points"])


def _feature_lines(t):
    shape = F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json(F.struct(
            F.concat(F.lit("  "), "neighborhood", F.lit(" ")).alias("CDTAName"),
            F.col("cd").alias("CDTA2020"),
            F.lower("borough").alias("BoroName"),
        )),
        F.lit(',"geometry":'),
        geojson.geometry_json("rings"),
        F.lit("}"),
    )
    path = scratch_path(t.spark, "geojson")
    polygons(t).select(shape.alias("value")).write.text(path)
    return path


_SCANNED_SQL = (
    POLYGON_SQL
    + """
    SELECT p.neighborhood, p.cd, p.borough, count(*) AS n_edges, count(DISTINCT e.hole) AS n_kinds,
           round(min(least(e.x1, e.x2)), 6) AS minx, round(max(greatest(e.y1, e.y2)), 6) AS maxy
    FROM poly p JOIN edge e USING (cd) GROUP BY 1, 2, 3"""
)


@check("a6_scan_polygons", _SCANNED_SQL)
def a6(t):
    return _scanned(geojson.scan_polygons(t.spark, _feature_lines(t), lines=True))


@check("a6_scan_feature_collection", _SCANNED_SQL)
def a6_collection(t):
    """The same polygons as one document, written in parts."""
    lines = t.spark.read.text(_feature_lines(t)).select("value", F.monotonically_increasing_id().alias("n"))
    first = lines.agg(F.min("n")).first()[0]
    features = lines.select(F.concat(F.when(F.col("n") == F.lit(first), F.lit("")).otherwise(F.lit(",")), "value").alias("value"))

    def line(text):
        return t.spark.range(0, 1, 1, 1).select(F.lit(text).alias("value"))

    path = scratch_path(t.spark, "geojson")
    line('{"type":"FeatureCollection","features":[').union(features).union(line("]}")).write.text(path)
    return _scanned(geojson.scan_polygons(t.spark, path, parts=True))


def _scanned(read):
    edges = polygon_edges(read, "cd").join(read.select("cd", "neighborhood", "borough"), "cd")
    return edges.groupBy("neighborhood", "cd", "borough").agg(
        F.count("*").alias("n_edges"),
        F.count_distinct("hole").alias("n_kinds"),
        r6(F.min(F.least("x1", "x2")), "minx"),
        r6(F.max(F.greatest("y1", "y2")), "maxy"),
    )


@check(
    "a7_export_scored_polygons",
    POLYGON_SQL
    + """
    SELECT 'Feature' AS type, p.cd || ' | ' || p.borough AS map_key, round(s.s_acctbal, 6) AS score,
           'MultiPolygon' AS kind
    FROM poly p JOIN supplier s ON p.cd = 'S' || s.s_suppkey""",
)
def a7(t):
    read = geojson.scan_polygons(t.spark, _feature_lines(t), lines=True)
    scores = t("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("cd"), r6("s_acctbal", "score"))
    scored = read.join(scores, "cd").withColumn("map_key", F.concat("cd", F.lit(" | "), "borough"))
    path = scratch_path(t.spark, "export")
    geojson.export_scored_polygons(scored, ["map_key", "score"], path)
    back = t.spark.read.schema(
        "type string, properties struct<map_key:string,score:double>, geometry struct<type:string,coordinates:string>"
    ).json(path)
    return back.select("type", "properties.map_key", r6("properties.score", "score"), F.col("geometry.type").alias("kind"))


@check(
    "a8_write_table",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2",
)
def a8(t):
    path = scratch_path(t.spark, "table")
    tables.write_table(t("lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@check(
    "a9_vector_store",
    """
    SELECT CAST(d.doc_id AS VARCHAR) AS entity,
           CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 0 THEN 'changed' ELSE 'stored' END AS state
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def a9(t):
    # Documents with a label were stored before; those of quality 0 have another text since.
    texts = t("documents").select(F.col("doc_id").cast("string").alias("entity"), "text")
    known = t("labels").select(F.col("doc_id").cast("string").alias("entity"), "quality")
    size = F.length("text").cast("float")
    old = texts.join(known, "entity").select(
        "entity", F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text")
    )
    path = scratch_path(t.spark, "vectors")
    vectors.save_vectors(old.withColumn("embedding", F.array(size)), path, "hash", "past")
    vectors.save_vectors(old.withColumn("embedding", F.array(-size)), path, "other", "past")
    stored = vectors.load_vectors(t.spark, path, "hash", "past")
    fresh = vectors.refresh_vectors(texts, stored, lambda df: df.withColumn("embedding", F.array(F.lit(-1.0).cast("float"))))
    was = stored.select("entity", F.lit(True).alias("was"))
    return fresh.join(was, "entity", "left").select(
        "entity",
        F.when(F.col("embedding")[0] == size, "stored").when(F.col("was"), "changed").otherwise("new").alias("state"),
    )


@check(
    "a10_upsert_snapshot",
    """
    SELECT c_custkey, 'a' AS version, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL
    SELECT o_custkey, 'b', max(o_totalprice) FROM orders GROUP BY o_custkey""",
)
def a10(t):
    old = t("customer").select("c_custkey", F.lit("a").alias("version"), "c_acctbal")
    new = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.lit("b").alias("version"), F.max("o_totalprice").alias("c_acctbal")
    )
    return tables.upsert_snapshot(old, new, "c_custkey")


@check(
    "a11_to_store_columns",
    AREA_SQL
    + f"""
    SELECT neighborhood, cd, borough, {s6('area_km2')} AS area_km2, {s6('avg_pedestrian')} AS avg_pedestrian,
           CAST(storefront_filing_count AS BIGINT) AS storefront_filing_count,
           CAST(subway_station_count AS BIGINT) AS subway_station_count,
           {s6('competitive_score')} AS competitive_score
    FROM feat""",
)
def a11(t):
    df = area_table(t).select(
        "neighborhood", "cd", "borough", r6("area_km2"), r6("avg_pedestrian"),
        F.col("storefront_filing_count").cast("double").alias("Storefront_Filing_Count"),
        "subway_station_count", "act_A_AND_F_storefront", r6("competitive_score"),
    )
    return tables.to_store_columns(df)


@check(
    "a12_json_safe",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN l_discount = 0 OR l_tax = 0 THEN NULL ELSE l_quantity END AS measure
    FROM lineitem""",
)
def a12(t):
    measure = (
        F.when(F.col("l_discount") == 0, F.lit(float("inf")))
        .when(F.col("l_tax") == 0, F.lit(float("nan")))
        .otherwise(F.col("l_quantity"))
    )
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", measure.alias("measure"))
    return tables.json_safe(df)
