"""Raw text feeds written from the given tables, and SQL twins of their cleaned forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arealens import presets
from arealens.session import scratch_path
from arealens.sources.geojson import geometry_json
from arealens.sources.tables import write_table
from checks.derived import PREFIXES, polygons

GROUP_FORMS = [" mn ", "BX", "East River Bridges", "si", None]
GROUP_NAMES = ["MANHATTAN", "BRONX", "EAST RIVER BRIDGES", "STATEN ISLAND", None]


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def write_csv(t, df: DataFrame, name: str) -> str:
    path = scratch_path(t.spark, name)
    write_table(df, path, "csv")
    return path


def _x(k):
    return (k * 37) % 1009 / 10.0


def _y(k):
    return (k * 91) % 1013 / 10.0


def pedestrian_csv(t) -> str:
    k, bal, n = F.col("c_custkey"), F.col("c_acctbal"), F.col("c_nationkey")
    raw = t("customer").select(
        F.concat(F.lit("POINT ("), _x(k).cast("string"), F.lit(" "), _y(k).cast("string"), F.lit(")")).alias("the_geom"),
        pick(GROUP_FORMS, k).alias("Borough"),
        F.concat(F.lit("Street, "), k).alias("Street"),
        F.lit("A").alias("From"),
        F.lit("B").alias("To"),
        F.when(bal > 0, bal).alias("May24_AM"),
        F.when(n > 3, n * 100).cast("string").alias("May24_PM"),
        F.when(k % 4 != 0, (n * 7).cast("string")).otherwise("n/a").alias("Oct24_MD"),
        F.when(bal > 5000, bal / 4).alias("May22_AM"),
        (n * 3).alias("Oct22_PM"),
        F.lit(1).alias("Note_AM_x"),
    )
    return write_csv(t, raw, "pedestrian")


_POINT = "({k} * 37) % 1009 / 10.0 AS longitude, ({k} * 91) % 1013 / 10.0 AS latitude"


def pedestrian_sql(year: int = 24) -> str:
    values = (
        "[CASE WHEN c_acctbal > 0 THEN c_acctbal END, CASE WHEN c_nationkey > 3 THEN c_nationkey * 100.0 END, "
        "CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey * 7.0 END]"
        if year == 24
        else "[CASE WHEN c_acctbal > 5000 THEN c_acctbal / 4 END, c_nationkey * 3.0]"
    )
    return f"""
ped AS (SELECT * FROM (SELECT c_custkey AS id, ({sql_list(GROUP_NAMES)})[1 + c_custkey % 5] AS borough, 'Street, ' || c_custkey AS street,
    'A' AS from_street, 'B' AS to_street, {_POINT.format(k='c_custkey')},
    list_avg(list_filter(v, lambda x: x IS NOT NULL)) AS avg_pedestrian, list_max(v) AS peak_pedestrian
  FROM (SELECT *, {values} AS v FROM customer))
  WHERE borough IS NOT NULL AND borough <> 'EAST RIVER BRIDGES' AND longitude <> 0 AND latitude <> 0 AND avg_pedestrian > 0)"""


def stations_csv(t) -> str:
    k = F.col("p_partkey")
    raw = t("part").select(
        F.col("p_name").alias("Stop Name"),
        F.substring("p_name", 1, 1).alias("Borough"),
        F.when(k % 11 == 0, "?").otherwise(_y(F.col("p_size") * 13).cast("string")).alias("GTFS Latitude"),
        _x(F.col("p_size") * 17).alias("GTFS Longitude"),
        F.concat(F.lit("line "), F.length("p_name")).alias("Daytime Routes"),
        F.lit("x").alias("Other"),
    )
    return write_csv(t, raw, "stations")


STATIONS_SQL = f"""
sta AS (SELECT DISTINCT p_name AS station_name,
    CASE upper(p_name[1]) WHEN 'M' THEN 'MANHATTAN' WHEN 'X' THEN 'BRONX' WHEN 'B' THEN 'BROOKLYN' WHEN 'Q' THEN 'QUEENS'
      WHEN 'S' THEN 'STATEN ISLAND' ELSE upper(p_name[1]) END AS borough,
    p_size * 13 * 91 % 1013 / 10.0 AS latitude, p_size * 17 * 37 % 1009 / 10.0 AS longitude, 'line ' || length(p_name) AS routes
  FROM part WHERE p_partkey % 11 <> 0 AND p_size * 13 * 91 % 1013 <> 0 AND p_size * 17 * 37 % 1009 <> 0)"""


def storefronts_csv(t) -> str:
    k, year, low = F.col("o_orderkey"), F.year("o_orderdate"), F.col("o_orderpriority")
    text_point = k % 3 == 0
    made = {
        "Filing Due Date": F.lit("06/01"),
        "Reporting Year": F.when(k % 4 == 0, F.concat(year - 1, F.lit(" and "), year)).otherwise(year.cast("string")),
        "Borough1": pick(GROUP_FORMS, k),
        "Vacant on 12/31": F.when(F.col("o_orderstatus") == "P", "YES").otherwise("NO"),
        "Vacant 6/30 or Date Sold": F.when(low == "5-LOW", " yes "),
        "Construction Reported": F.when(k % 2 == 0, "Yes"),
        "Primary Business Activity": (
            F.when(low == "1-URGENT", "Food Services")
            .when(low == "2-HIGH", "RETAIL")
            .when(low == "3-MEDIUM", "Miscellaneous Other Service")
        ),
        "Latitude": F.when(~text_point, _y(k)),
        "Longitude": F.when(~text_point, _x(k)),
        "Lat/Long": F.concat(F.lit("POINT ("), _x(k).cast("string"), F.lit("  "), _y(k).cast("string"), F.lit(")")),
        "BBL": k,
    }
    raw = t("orders").select(*[made.get(c, F.lit("-")).alias(c) for c in presets.STOREFRONT_RENAMES])
    return write_csv(t, raw, "storefronts")


def storefronts_sql(max_year: int | None = None) -> str:
    cap = f" AND year(o_orderdate) <= {max_year}" if max_year else ""
    return f"""
sf AS (SELECT * FROM (SELECT o_orderkey AS id, ({sql_list(GROUP_NAMES)})[1 + o_orderkey % 5] AS borough, {_POINT.format(k='o_orderkey')},
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(year(o_orderdate) AS DOUBLE) END AS reporting_year, CAST(o_orderkey % 2 = 0 AS INT) AS construction_yes,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Food Services' WHEN '2-HIGH' THEN 'RETAIL' WHEN '3-MEDIUM' THEN 'other' ELSE 'UNKNOWN' END AS category
  FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'{cap})
  WHERE borough IS NOT NULL AND longitude <> 0 AND latitude <> 0)"""


def incidents_csv(t) -> str:
    k = F.col("event_id")
    raw = t("events").select(
        F.col("user_id").alias("incident_key"),
        F.when(k % 13 == 0, "unknown").otherwise(F.concat(F.lit("03/15/"), k % 7 + 1993)).alias("OCCUR_DATE"),
        pick(["BROOKLYN", "q", None], k).alias("BORO"),
        _y(k).alias("Latitude"),
        _x(k).alias("Longitude"),
    )
    return write_csv(t, raw, "incidents")


def incidents_sql(max_year: int | None = None) -> str:
    cap = f" AND event_id % 13 <> 0 AND event_id % 7 + 1993 <= {max_year}" if max_year else ""
    return f"""
inc AS (SELECT * FROM (SELECT event_id AS id, user_id AS incident_key, {_POINT.format(k='event_id')},
    (['BROOKLYN', 'QUEENS', NULL])[1 + event_id % 3] AS borough FROM events WHERE true{cap})
  WHERE borough IS NOT NULL AND longitude <> 0 AND latitude <> 0)"""


def _codes(t):
    """One row per part size with its area code in long form."""
    return t("part").groupBy("p_size").agg(F.sum("p_retailprice").alias("v"), F.count("*").alias("n")).withColumn(
        "prefix", pick(PREFIXES, F.col("p_size"))
    )


def index_csv(t) -> str:
    goals = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(i).alias("i")) for i, g in enumerate([*presets.INDEX_GOALS, "Else"])]))
    n = F.col("n")
    raw = _codes(t).filter("p_size <= 42").select("*", goals.alias("goal")).select(
        F.concat("prefix", F.lit(" Community Districts "), "p_size", F.lit(" & 77")).alias("CD"),
        F.concat(F.lit("$"), F.format_number(n * 1000, 0)).alias("Median_Income"),
        F.concat(n, F.lit("%")).alias("NYC_Poverty_Rate"),
        n.alias("Perc_White"),
        F.lit("n/a").alias("Perc_Black"),
        (n + 1).alias("Perc_Asian"),
        (n + 2).alias("Perc_Hispanic"),
        F.col("goal.g").alias("Goal"),
        F.when((F.col("goal.i") != 3) | (F.col("p_size") % 2 == 0), n / 8 + F.col("goal.i")).alias("IndexScore"),
        (F.col("goal.i") + F.col("p_size")).alias("GoalRank"),
    )
    path = scratch_path(t.spark, "index")
    raw.write.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    return path


_CODE_SQL = f"({sql_list(PREFIXES)})[1 + p_size % 5] || lpad(CAST(p_size AS VARCHAR), 2, '0')"
INDEX_SQL = f"""
per AS (SELECT p_size, {_CODE_SQL} AS cd, CAST(count(*) AS DOUBLE) AS n, sum(p_retailprice) AS v FROM part GROUP BY p_size),
idx AS (SELECT cd, n * 1000 AS nfh_median_income, n AS nfh_poverty_rate, n AS nfh_pct_white, CAST(NULL AS DOUBLE) AS nfh_pct_black, n + 1 AS nfh_pct_asian,
    n + 2 AS nfh_pct_hispanic, """ + ", ".join(
    (f"CASE WHEN p_size % 2 = 0 THEN n / 8 + {i} END" if i == 3 else f"n / 8 + {i}") + f" AS {name}_score, CAST({i} + p_size AS DOUBLE) AS {name}_rank"
    for i, name in enumerate(presets.INDEX_GOALS.values())
) + " FROM per WHERE p_size <= 42)"


def profiles_csv(t) -> str:
    n, v = F.col("n"), F.col("v")
    names = list(presets.PROFILE_RENAMES)
    made = {
        names[0]: F.concat(F.lit("Place "), "p_size"),
        names[1]: F.when(F.col("p_size") % 9 == 0, "Zone").otherwise(F.concat("prefix", F.lpad(F.col("p_size").cast("string"), 2, "0"))),
        "2016 Employed": F.when(F.col("p_size") % 8 == 0, F.lit(0)).otherwise(n * 10),
        "2016 Commute via Public Transit": n * 4 + F.col("p_size"),
        "2016 Construction": F.when(F.col("p_size") % 5 == 0, "-").otherwise(F.format_number(F.floor(v), 0)),
    }
    raw = _codes(t).select(
        *[made.get(c, F.concat(F.lit("$"), F.format_number(n * (i + 1) * 100, 0))).alias(c) for i, c in enumerate(names)], F.lit(1).alias("extra")
    )
    return write_csv(t, raw, "profiles")


_PROFILE_NAMES = list(presets.PROFILE_RENAMES.items())
PROFILES_SQL = f"""
prf AS (SELECT 'Place ' || p_size AS neighborhood, cd, {", ".join(
    f"n * {i + 1} * 100 AS {new}" for i, (old, new) in enumerate(_PROFILE_NAMES)
    if new not in ("neighborhood", "cd", "employed_2016", "commute_public_transit", "construction_jobs"))},
    CASE WHEN p_size % 5 <> 0 THEN floor(v) END AS construction_jobs,
    CASE WHEN p_size % 8 <> 0 THEN 100.0 * (n * 4 + p_size) / (n * 10) END AS commute_public_transit,
    (['BRONX', 'BROOKLYN', 'MANHATTAN', 'QUEENS', 'STATEN ISLAND'])[1 + p_size % 5] AS borough
  FROM per WHERE p_size % 9 <> 0),
prof AS (SELECT *, coalesce(construction_jobs, 0) + manufacturing_jobs + wholesale_jobs AS total_jobs,
    pop_black + pop_hispanic + pop_asian AS total_population_proxy FROM prf)"""


def polygons_json(t) -> str:
    """The supplier shapes with codes that start with a two-digit area code, one feature per line."""
    s = F.regexp_extract("cd", r"(\d+)", 1).cast("int")
    code = F.concat(pick(PREFIXES, s), F.lpad((s % 50).cast("string"), 2, "0"), F.lit("-"), s)
    line = F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json(F.struct(F.col("neighborhood").alias("CDTAName"), code.alias("CDTA2020"), pick(list(presets.GROUP_BY_PREFIX.values()), s).alias("BoroName"))),
        F.lit(',"geometry":'),
        geometry_json("rings"),
        F.lit("}"),
    )
    path = scratch_path(t.spark, "polygons")
    polygons(t).select(line.alias("value")).write.text(path)
    return path


AREAS_SQL = f"""
areas AS (SELECT p.cd AS shape, p.neighborhood, ({sql_list(PREFIXES)})[1 + s_suppkey % 5] || lpad(CAST(s_suppkey % 50 AS VARCHAR), 2, '0') || '-' || s_suppkey AS cd,
    ({sql_list(PREFIXES)})[1 + s_suppkey % 5] || lpad(CAST(s_suppkey % 50 AS VARCHAR), 2, '0') AS code,
    ({sql_list(list(presets.GROUP_BY_PREFIX.values()))})[1 + s_suppkey % 5] AS borough,
    CASE WHEN s_suppkey % 2 = 0 THEN 57.0::DOUBLE ELSE 61.0::DOUBLE END AS area_km2 FROM poly p)"""


def located_sql(feed: str, key: str, out: str) -> str:
    """Area of every point of ``feed``: the containing shape, else the nearest, ties to the smaller code."""
    return f"""
{out}_e AS MATERIALIZED (SELECT {key} AS pk, a.cd, x1, y1, x2, y2, longitude AS px, latitude AS py FROM {feed}, edge e JOIN areas a ON a.shape = e.cd),
{out}_in AS (SELECT pk, min(cd) AS cd FROM (SELECT pk, cd FROM {out}_e GROUP BY pk, cd
    HAVING sum(CASE WHEN (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END + x1 THEN 1 ELSE 0 END) % 2 = 1
     AND NOT bool_or((x2 - x1) * (py - y1) = (px - x1) * (y2 - y1) AND px BETWEEN least(x1, x2) AND greatest(x1, x2)
                     AND py BETWEEN least(y1, y2) AND greatest(y1, y2))) GROUP BY pk),
{out}_d AS (SELECT pk, cd, (px - x1 - u * (x2 - x1)) * (px - x1 - u * (x2 - x1)) + (py - y1 - u * (y2 - y1)) * (py - y1 - u * (y2 - y1)) AS d2
  FROM (SELECT *, greatest(0.0, least(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS u FROM {out}_e)),
{out}_near AS (SELECT pk, min({{'d2': d2, 'cd': cd}}).cd AS cd FROM {out}_d GROUP BY pk),
{out} AS MATERIALIZED (SELECT f.* EXCLUDE (borough), coalesce(i.cd, n.cd) AS cd FROM {feed} f JOIN {out}_near n ON n.pk = f.{key} LEFT JOIN {out}_in i ON i.pk = f.{key})"""
