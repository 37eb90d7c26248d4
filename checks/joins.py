"""D: joins, with the spatial operators E16 and E17 that share their polygons."""

from pyspark.sql import functions as F

from arealens.functions import geometry as G
from arealens.functions.predicates import valid_coordinates
from arealens.functions import scalars as S
from arealens.operators import joins as J
from arealens.operators import spatial as SP
from checks.base import check, r6, s6
from checks.derived import POINT_SQL, POLYGON_SQL, points, polygons

ATTRIBUTES = ["neighborhood", "cd", "borough"]


@check(
    "d1_spatial_join_within",
    POINT_SQL
    + """SELECT v.o_orderkey, p.neighborhood, p.cd, p.borough FROM valid v LEFT JOIN inside i USING (o_orderkey)
         LEFT JOIN poly p ON p.cd = i.cd""",
)
def d1(t):
    return SP.spatial_join_within(points(t), polygons(t)).select("o_orderkey", *ATTRIBUTES)


@check(
    "d1_far_and_missing_points",
    POINT_SQL
    + """SELECT v.o_orderkey, CASE WHEN v.o_orderkey % 13 <> 0 THEN i.cd END AS cd FROM valid v LEFT JOIN inside i USING (o_orderkey)
         WHERE v.o_orderkey % 17 <> 0""",
)
def d1_far(t):
    """Coordinates far outside every grid lie in no area; NaN is no coordinate."""
    # only points that are valid by themselves move far away: an invalid one would become valid
    k, valid = F.col("o_orderkey"), valid_coordinates("latitude", "longitude")
    odd = points(t).withColumn(
        "longitude", F.when(k % 17 == 0, F.lit(float("nan"))).when((k % 13 == 0) & valid, F.lit(1e12)).otherwise(F.col("longitude"))
    )
    return SP.spatial_join_within(odd, polygons(t), attributes=["cd"]).select("o_orderkey", "cd")


@check(
    "d2_nearest_area",
    POINT_SQL
    + """SELECT n.o_orderkey, n.cd FROM near n LEFT JOIN inside i USING (o_orderkey) WHERE i.cd IS NULL""",
)
def d2(t):
    tagged = SP.spatial_join_within(points(t), polygons(t), attributes=["cd"])
    outside = tagged.filter(F.col("cd").isNull())
    return SP.nearest_area(outside, polygons(t), attributes=["cd"]).select("o_orderkey", "cd")


@check(
    "d3_assign_area",
    POINT_SQL
    + """SELECT v.o_orderkey, p.neighborhood, p.cd, p.borough FROM valid v JOIN near n USING (o_orderkey)
         LEFT JOIN inside i USING (o_orderkey) JOIN poly p ON p.cd = coalesce(i.cd, n.cd)""",
)
def d3(t):
    return SP.assign_area(points(t), polygons(t)).select("o_orderkey", *ATTRIBUTES)


@check(
    "d3_assign_area_by_descent",
    POINT_SQL
    + """SELECT coalesce(i.cd, n.cd) AS cd, count(*) AS n_points FROM near n LEFT JOIN inside i USING (o_orderkey) GROUP BY 1""",
)
def d3_descent(t):
    # No broadcast at all: cells join by shuffle and the nearest search walks the cell tree.
    out = SP.assign_area(points(t), polygons(t), attributes=["cd"], broadcast_edges=0)
    return out.groupBy("cd").agg(F.count("*").alias("n_points"))


@check(
    "d4_star_left_join",
    f"""
    SELECT s.s_suppkey, l.n_lines, c.n_customers, {s6('c.balance')} AS balance
    FROM supplier s LEFT JOIN (SELECT l_suppkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON l.l_suppkey = s.s_suppkey
    LEFT JOIN (SELECT c_custkey, count(*) AS n_customers, sum(c_acctbal) AS balance FROM customer WHERE c_acctbal > 0 GROUP BY 1) c
      ON c.c_custkey = s.s_suppkey""",
)
def d4(t):
    lines = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_lines"))
    people = t("customer").filter("c_acctbal > 0").groupBy(F.col("c_custkey").alias("s_suppkey")).agg(
        F.count("*").alias("n_customers"), F.sum("c_acctbal").alias("balance")
    )
    out = J.star_left_join(t("supplier").select("s_suppkey"), [lines, people], ["s_suppkey"])
    return out.withColumn("balance", r6("balance"))


@check(
    "d5_join_on_normalized_key",
    f"""
    SELECT c.c_custkey, s.s_suppkey, {s6('s.s_acctbal')} AS s_acctbal FROM customer c LEFT JOIN
      (SELECT s_nationkey, min(s_suppkey) AS s_suppkey, arg_min(s_acctbal, s_suppkey) AS s_acctbal FROM supplier
       WHERE s_nationkey > 0 GROUP BY 1) s ON s.s_nationkey = c.c_nationkey""",
)
def d5(t):
    left = t("customer").select("c_custkey", F.concat(F.lit("BK"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("code"))
    # 300 is no valid district, so nation 0 has no key on this side.
    right = t("supplier").select(
        F.concat(F.lit("3"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("label"), "s_suppkey", "s_acctbal"
    )
    out = J.join_on_normalized_key(left, right, "code", "label", ["s_suppkey"])
    return out.select("c_custkey", "s_suppkey", r6("s_acctbal"))


@check(
    "d5_match_report",
    """
    SELECT count(*) FILTER (WHERE c_nationkey % 2 = 1) AS n_with_key, count(s.n) AS n_matched,
           count(s.n) < 0.5 * count(*) FILTER (WHERE c_nationkey % 2 = 1) AS under_half
    FROM customer c LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s
      ON s.s_nationkey = c.c_nationkey AND c.c_nationkey % 2 = 1 AND c.c_nationkey < 8""",
)
def d5_report(t):
    n = F.col("c_nationkey")
    code = F.when(n % 2 == 1, F.concat(F.lit("SI"), n)).otherwise("none")
    left = t("customer").select("c_custkey", code.alias("code"))
    right = t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).filter("s_nationkey < 8")
    right = right.select(F.concat(F.lit("SI"), "s_nationkey").alias("label"), "n")
    return J.match_report(J.join_on_normalized_key(left, right, "code", "label", ["n"]), "code", "n")


@check(
    "d6_wide_assemble",
    """
    SELECT p_partkey, p_brand, a.n_returned, b.n_open FROM part
    LEFT JOIN (SELECT l_partkey, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_partkey = p_partkey
    LEFT JOIN (SELECT l_partkey, count(*) AS n_open FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b ON b.l_partkey = p_partkey""",
)
def d6(t):
    line = t("lineitem").withColumnRenamed("l_partkey", "p_partkey")
    returned = line.filter("l_returnflag = 'R'").groupBy("p_partkey").agg(F.count("*").alias("n_returned"))
    open_ = line.filter("l_linestatus = 'O'").groupBy("p_partkey").agg(F.count("*").alias("n_open"))
    return J.wide_assemble(t("part").select("p_partkey", "p_brand"), [returned, open_], "p_partkey")


@check(
    "d7_vintage_join",
    """
    SELECT a.o_custkey, a.n AS n_1996, b.n AS n_1998
    FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) a
    JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1) b USING (o_custkey)""",
)
def d7(t):
    def year(y):
        return t("orders").filter(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.count("*").alias(f"n_{y}"))

    return J.vintage_join(year(1996), year(1998), ["o_custkey"])


@check(
    "d8_attach_lookup",
    """
    SELECT p_partkey, label AS cluster, CASE WHEN label < 5 THEN 'brief ' || label ELSE '' END AS cluster_description
    FROM part LEFT JOIN embeddings ON vec_id = p_partkey""",
)
def d8(t):
    labels = t("embeddings").select(F.col("vec_id").alias("p_partkey"), F.col("label").alias("cluster"))
    briefs = labels.select("cluster").distinct().filter("cluster < 5").withColumn("description", F.concat(F.lit("brief "), "cluster"))
    return J.attach_lookup(t("part").select("p_partkey"), "p_partkey", labels, briefs)


@check(
    "d9_align_vectors",
    f"""
    SELECT p_partkey, {s6('CAST(embedding[1] AS DOUBLE) + CASE WHEN label > 4 THEN 1 ELSE 0 END')} AS first_value
    FROM part JOIN embeddings ON vec_id = p_partkey""",
)
def d9(t):
    one = t("embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding", F.lit(1).alias("version"), "label")
    # Some keys carry a second, later vector that must win.
    later = one.filter("label > 4").select(
        "p_partkey", F.transform("embedding", lambda v: v + 1).alias("embedding"), F.lit(2).alias("version"), "label"
    )
    both = one.unionByName(later).withColumn("embedding", F.col("embedding").cast("array<double>"))
    out = J.align_vectors(t("part").select("p_partkey"), both, "p_partkey", "embedding", ["version"])
    exact = F.col("embedding")[0]
    return out.select("p_partkey", r6(exact, "first_value"))


@check(
    "d10_attach_geometry",
    POLYGON_SQL
    + """SELECT c_custkey, p.cd || ' | ' || p.borough AS map_key FROM customer JOIN poly p ON p.cd = 'S' || (c_custkey % 400)""",
)
def d10(t):
    shapes = polygons(t).select(S.map_key("cd", "borough").alias("map_key"), F.to_json("rings").alias("geometry"), "cd", "borough")
    keyed = t("customer").select("c_custkey", F.concat(F.lit("S"), F.col("c_custkey") % 400).alias("cd"))
    keyed = keyed.join(shapes.select("cd", "borough"), "cd", "left").select("c_custkey", S.map_key("cd", "borough").alias("map_key"))
    return J.attach_geometry(keyed, shapes).select("c_custkey", "map_key")


@check(
    "d10_geometry_report",
    "SELECT count(*) AS n_rows, count(*) FILTER (WHERE s_suppkey IS NULL) AS n_unmatched FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
)
def d10_report(t):
    shapes = t("supplier").select(F.col("s_suppkey").alias("map_key"), F.lit("{}").alias("geometry"))
    return J.geometry_report(t("customer").select(F.col("c_custkey").alias("map_key")), shapes)


_INCIDENT_SQL = "(SELECT user_id, count(*) AS shooting_incident_count FROM events WHERE event_type = 'error' GROUP BY 1)"


@check(
    "d11_density_from_area",
    f"""
    SELECT p_partkey, CAST(p_size AS DOUBLE) AS area_km2, coalesce(shooting_incident_count, 0) AS shooting_incident_count,
           {s6('coalesce(shooting_incident_count, 0) / nullif(p_size, 0)')} AS shooting_density_per_km2
    FROM part LEFT JOIN {_INCIDENT_SQL} ON user_id = p_partkey""",
)
def d11(t):
    areas = t("part").select("p_partkey", F.col("p_size").cast("double").alias("area_km2"))
    errors = t("events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("p_partkey")).agg(
        F.count("*").alias("shooting_incident_count")
    )
    out = J.density_from_area(areas, errors, ["p_partkey"])
    return out.withColumn("shooting_density_per_km2", r6("shooting_density_per_km2"))


@check(
    "d11_density_matched_only",
    f"""
    SELECT user_id AS p_partkey, {s6('shooting_incident_count / nullif(p_size, 0)')} AS shooting_density_per_km2
    FROM {_INCIDENT_SQL} LEFT JOIN part ON user_id = p_partkey""",
)
def d11_matched(t):
    areas = t("part").select("p_partkey", F.col("p_size").cast("double").alias("area_km2"))
    errors = t("events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("p_partkey")).agg(
        F.count("*").alias("shooting_incident_count")
    )
    out = J.density_from_area(areas, errors, ["p_partkey"], keep_all=False)
    return out.select("p_partkey", r6("shooting_density_per_km2"))


@check(
    "e16_polygon_area",
    POLYGON_SQL
    + f"""
    SELECT cd, {s6('abs(sum(x1 * y2 - x2 * y1) FILTER (WHERE NOT hole)) / 2 - coalesce(abs(sum(x1 * y2 - x2 * y1) FILTER (WHERE hole)) / 2, 0)')} AS area_km2
    FROM edge GROUP BY cd""",
)
def e16(t):
    return SP.polygon_area(polygons(t), "cd").select("cd", r6("area_km2"))


@check(
    "e16_projected_area",
    POLYGON_SQL
    + f""",
    ll AS (SELECT cd, hole, radians(-74.5 + x1 / 1000) AS a1, radians(40.3 + y1 / 1000) AS b1,
                  radians(-74.5 + x2 / 1000) AS a2, radians(40.3 + y2 / 1000) AS b2 FROM edge),
    c AS (SELECT 6378137.0 AS a, sqrt((1 / 298.257222101) * (2 - 1 / 298.257222101)) AS e,
                 radians(41.03333333333333) AS p1, radians(40.66666666666666) AS p2, radians(40.16666666666666) AS p0,
                 radians(-74.0) AS l0, 0.3048006096012192 AS ft),
    c2 AS (SELECT *, cos(p1) / sqrt(1 - pow(e * sin(p1), 2)) AS m1, cos(p2) / sqrt(1 - pow(e * sin(p2), 2)) AS m2,
                  tan(pi() / 4 - p1 / 2) / pow((1 - e * sin(p1)) / (1 + e * sin(p1)), e / 2) AS t1,
                  tan(pi() / 4 - p2 / 2) / pow((1 - e * sin(p2)) / (1 + e * sin(p2)), e / 2) AS t2,
                  tan(pi() / 4 - p0 / 2) / pow((1 - e * sin(p0)) / (1 + e * sin(p0)), e / 2) AS t0 FROM c),
    c3 AS (SELECT *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) AS n FROM c2),
    c4 AS (SELECT *, m1 / (n * pow(t1, n)) AS f FROM c3),
    rho AS (SELECT ll.*, n, l0, a, ft, a * f * pow(t0, n) AS r0,
        a * f * pow(tan(pi() / 4 - b1 / 2) / pow((1 - e * sin(b1)) / (1 + e * sin(b1)), e / 2), n) AS r1,
        a * f * pow(tan(pi() / 4 - b2 / 2) / pow((1 - e * sin(b2)) / (1 + e * sin(b2)), e / 2), n) AS r2 FROM ll, c4),
    xy AS (SELECT cd, hole, (r1 * sin(n * (a1 - l0)) + 300000) / ft AS x1, (r0 - r1 * cos(n * (a1 - l0))) / ft AS y1,
                  (r2 * sin(n * (a2 - l0)) + 300000) / ft AS x2, (r0 - r2 * cos(n * (a2 - l0))) / ft AS y2 FROM rho),
    sized AS (SELECT cd, abs(sum(x1 * y2 - x2 * y1) FILTER (WHERE NOT hole)) / 2
                - coalesce(abs(sum(x1 * y2 - x2 * y1) FILTER (WHERE hole)) / 2, 0) AS sq FROM xy GROUP BY cd)
    SELECT cd, round(sq * 0.3048 * 0.3048 / 1000000, 4) AS area_km2 FROM sized""",
)
def e16_projected(t):
    scale = F.transform(
        "rings",
        lambda r: F.struct(
            r.hole.alias("hole"),
            F.transform(r.points, lambda p: F.struct((p.x / 1000 - 74.5).alias("x"), (p.y / 1000 + 40.3).alias("y"))).alias("points"),
        ),
    )
    shapes = polygons(t).withColumn("rings", scale)
    out = SP.polygon_area(shapes, "cd", project=G.lambert_conformal, to_km2=0.3048**2 / 1e6)
    return out.select("cd", F.round("area_km2", 4).alias("area_km2"))


@check(
    "e17_total_bounds",
    POLYGON_SQL
    + """SELECT min(least(x1, x2)) AS minx, min(least(y1, y2)) AS miny, max(greatest(x1, x2)) AS maxx, max(greatest(y1, y2)) AS maxy,
         (min(least(x1, x2)) + max(greatest(x1, x2))) / 2 AS center_x, (min(least(y1, y2)) + max(greatest(y1, y2))) / 2 AS center_y FROM edge""",
)
def e17(t):
    return SP.total_bounds(polygons(t))
