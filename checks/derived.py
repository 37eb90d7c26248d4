"""Tables derived from the given ones, once as operators and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arealens.operators import aggregates as A
from arealens.plans.features import KEYS, merge_features
from arealens.sources.geojson import RINGS_TYPE

PREFIXES = ["BX", "BK", "MN", "QN", "SI"]
CATEGORIES = ["A_AND_F", "A_AND_O", "N_AND_F", "N_AND_O", "R_AND_F", "R_AND_O"]
COUNT_COLUMNS = [f"act_{c}_storefront" for c in CATEGORIES]
SHARE_COLUMNS = [f"act_{c}_density" for c in CATEGORIES]

# --- areas: one per part, points are its line items ---------------------------


def area_keys(t) -> DataFrame:
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), F.col("p_size") % 5 + 1)
    return t("part").select(
        "p_partkey",
        F.concat(F.lit("Area "), "p_partkey").alias("neighborhood"),
        F.concat(prefix, F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("cd"),
        F.col("p_type").alias("borough"),
        F.col("p_size").cast("double").alias("area_km2"),
        "p_size",
        "p_retailprice",
    )


def area_points(t) -> DataFrame:
    """Line items as points with the keys of their area."""
    keys = area_keys(t).select("p_partkey", *KEYS)
    return t("lineitem").join(keys, F.col("l_partkey") == F.col("p_partkey"))


def area_profiles(t) -> DataFrame:
    """Attributes per code with gaps: no row for the largest sizes, no value for every fifth."""
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), F.col("p_size") % 5 + 1)
    gap = F.col("p_size") % 5 == 0
    return (
        t("part")
        .filter(F.col("p_size") <= 43)
        .groupBy(F.concat(prefix, F.lit(" Community District "), "p_size").alias("cd"), "p_size")
        .agg(F.sum("p_retailprice").alias("v"), F.count("*").cast("double").alias("n"))
        .select(
            "cd",
            F.when(~gap, F.floor("v").cast("double")).alias("construction_jobs"),
            F.when(~gap, F.col("v") * 2).alias("median_household_income"),
            (F.col("v") * 3).alias("nfh_median_income"),
            F.when(~gap, F.col("n") * 10).alias("pop_black"),
            (F.col("n") * 20).alias("pop_hispanic"),
            F.col("n").alias("pop_asian"),
            (F.col("n") * 31).alias("total_population_proxy"),
            (F.col("n") / 7).alias("nfh_overall_score"),
            F.col("n").alias("nfh_overall_rank"),
            F.when(~gap, F.col("n")).alias("pct_bachelors_plus"),
        )
    )


def area_table(t) -> DataFrame:
    """The wide feature table of all areas."""
    points = area_points(t)
    areas = area_keys(t).select(*KEYS, "area_km2")
    flow = A.flow_features(
        points.select(*KEYS, (F.col("l_quantity") * 100).alias("avg_pedestrian"), (F.col("l_quantity") * 100).alias("peak_pedestrian")),
        KEYS,
    )
    stops = A.distinct_count_features(points, KEYS, "l_suppkey", "subway_station_count")
    events = t("events").join(area_keys(t).select("p_partkey", *KEYS), F.col("user_id") == F.col("p_partkey"))
    cases = A.incident_features(events, KEYS, "event_id")
    label = F.concat("l_returnflag", F.lit(" & "), "l_linestatus")
    shops = A.category_pivot(A.category_counts(points, KEYS, label), KEYS, COUNT_COLUMNS)
    return merge_features(areas, flow, stops, cases, area_profiles(t), shops)


def _act(template: str, joiner: str = ", ") -> str:
    return joiner.join(template.format(c=c, flag=c[0], status=c[-1]) for c in CATEGORIES)


_IMPUTED = [
    "construction_jobs", "nfh_median_income", "pop_black", "pop_hispanic", "pop_asian",
    "total_population_proxy", "nfh_overall_score", "pct_bachelors_plus", "avg_pedestrian", "peak_pedestrian",
]

AREA_SQL = f"""
WITH area AS (
  SELECT p_partkey, 'Area ' || p_partkey AS neighborhood,
         (['BX','BK','MN','QN','SI'])[1 + p_size % 5] || lpad(CAST(p_size AS VARCHAR), 2, '0') AS cd,
         p_type AS borough, CAST(p_size AS DOUBLE) AS area_km2, p_size
  FROM part),
pts AS (
  SELECT l_partkey AS p_partkey, avg(l_quantity * 100) AS avg_pedestrian, max(l_quantity * 100) AS peak_pedestrian,
         count(l_quantity) AS pedestrian_count_points, count(DISTINCT l_suppkey) AS subway_station_count,
         count(*) AS storefront_filing_count,
         {_act("count(*) FILTER (WHERE l_returnflag = '{flag}' AND l_linestatus = '{status}') AS act_{c}_storefront")}
  FROM lineitem GROUP BY 1),
cases AS (SELECT user_id AS p_partkey, count(DISTINCT event_id) AS shooting_incident_count FROM events GROUP BY 1),
prof AS (
  SELECT p_size, CASE WHEN p_size % 5 <> 0 THEN floor(sum(p_retailprice)) END AS construction_jobs,
         sum(p_retailprice) * 3 AS nfh_median_income,
         CASE WHEN p_size % 5 <> 0 THEN count(*) * 10.0::DOUBLE END AS pop_black, count(*) * 20.0::DOUBLE AS pop_hispanic,
         CAST(count(*) AS DOUBLE) AS pop_asian, count(*) * 31.0::DOUBLE AS total_population_proxy,
         count(*) / 7.0 AS nfh_overall_score,
         CASE WHEN p_size % 5 <> 0 THEN CAST(count(*) AS DOUBLE) END AS pct_bachelors_plus
  FROM part WHERE p_size <= 43 GROUP BY p_size),
raw AS (
  SELECT a.*, t.* EXCLUDE (p_partkey), c.shooting_incident_count, r.* EXCLUDE (p_size)
  FROM area a LEFT JOIN pts t USING (p_partkey) LEFT JOIN cases c USING (p_partkey)
  LEFT JOIN prof r ON r.p_size = a.p_size),
gmed AS (SELECT borough, {", ".join(f"median({c}) AS {c}" for c in _IMPUTED)} FROM raw GROUP BY borough),
filled AS (
  SELECT raw.* EXCLUDE ({", ".join(_IMPUTED)}), {", ".join(f"coalesce(raw.{c}, gmed.{c}) AS {c}" for c in _IMPUTED)}
  FROM raw LEFT JOIN gmed USING (borough)),
omed AS (SELECT {", ".join(f"median({c}) AS {c}" for c in _IMPUTED)} FROM filled),
imp AS (
  SELECT filled.* REPLACE (
    {", ".join(f"coalesce(filled.{c}, omed.{c}" + (", 0.0" if "pedestrian" in c else "") + f") AS {c}" for c in _IMPUTED)},
    coalesce(storefront_filing_count, 0) AS storefront_filing_count,
    coalesce(subway_station_count, 0) AS subway_station_count,
    coalesce(pedestrian_count_points, 0) AS pedestrian_count_points,
    coalesce(shooting_incident_count, 0) AS shooting_incident_count,
    {_act("coalesce(act_{c}_storefront, 0) AS act_{c}_storefront")})
  FROM filled, omed),
feat AS (
  SELECT *, {_act("CAST(act_{c}_storefront > 0 AS INT)", " + ")} AS category_diversity,
    CASE WHEN storefront_filing_count > 0 THEN
      {_act("-(CASE WHEN act_{c}_storefront > 0 THEN act_{c}_storefront / storefront_filing_count * ln(act_{c}_storefront / storefront_filing_count) ELSE 0 END)", " + ")}
    ELSE 0.0 END AS category_entropy,
    {_act("CASE WHEN storefront_filing_count > 0 THEN act_{c}_storefront / storefront_filing_count ELSE 0.0 END AS act_{c}_density")},
    subway_station_count / area_km2 AS subway_density_per_km2,
    storefront_filing_count / area_km2 AS storefront_density_per_km2,
    ln(1 + avg_pedestrian * storefront_filing_count) AS commercial_activity_score,
    ln(1 + storefront_filing_count / (avg_pedestrian + 1)) AS competitive_score,
    ln(1 + subway_station_count * avg_pedestrian) AS transit_activity_score
  FROM imp)
"""

# --- vectors: those of the embeddings table, named after the area -------------


def area_vectors(t) -> DataFrame:
    return t("embeddings").select(F.concat(F.lit("Area "), "vec_id").alias("neighborhood"), "embedding")


def vector_of(t, vec_id: int) -> list[float]:
    return list(t("embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


COSINE_SQL = """
list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))
 / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) + 1e-12)
 / (sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))) + 1e-12)"""

# --- polygons: one L shape per supplier, every other one with a hole ----------


def polygons(t) -> DataFrame:
    i = F.col("s_suppkey")
    x0, y0 = F.col("ox"), F.col("oy")

    def ring(hole: bool, points):
        return F.struct(
            F.lit(hole).alias("hole"),
            F.array(*[F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in points]).alias("points"),
        )

    shell = ring(False, [(0.5, 0.5), (9.5, 0.5), (9.5, 4.5), (5.5, 4.5), (5.5, 9.5), (0.5, 9.5), (0.5, 0.5)])
    hole = ring(True, [(1.5, 1.5), (1.5, 3.5), (3.5, 3.5), (3.5, 1.5), (1.5, 1.5)])
    placed = t("supplier").withColumns(
        {"ox": ((i % 10) * 10).cast("double"), "oy": (F.floor(i / 10) * 10).cast("double")}
    )
    rings = F.when(i % 2 == 0, F.array(shell, hole)).otherwise(F.array(shell))
    return placed.select(
        F.col("s_name").alias("neighborhood"),
        F.concat(F.lit("S"), "s_suppkey").alias("cd"),
        F.concat(F.lit("NATION "), "s_nationkey").alias("borough"),
        rings.cast(RINGS_TYPE).alias("rings"),
    )


def points(t) -> DataFrame:
    """Orders as points; coordinates follow from the key, some are zero and so invalid."""
    k = F.col("o_orderkey")
    return t("orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("borough"),
        ((k * 37) % 1009 / 10.0).alias("longitude"),
        ((k * 91) % 10007 / 10.0).alias("latitude"),
    )


POLYGON_SQL = """
WITH poly AS (
  SELECT s_name AS neighborhood, 'S' || s_suppkey AS cd, 'NATION ' || s_nationkey AS borough,
         s_suppkey, (s_suppkey % 10) * 10.0 AS ox, (s_suppkey // 10) * 10.0 AS oy
  FROM supplier),
shape AS (
  SELECT * FROM (VALUES
    (false, 0.5, 0.5, 9.5, 0.5), (false, 9.5, 0.5, 9.5, 4.5), (false, 9.5, 4.5, 5.5, 4.5), (false, 5.5, 4.5, 5.5, 9.5),
    (false, 5.5, 9.5, 0.5, 9.5), (false, 0.5, 9.5, 0.5, 0.5),
    (true, 1.5, 1.5, 1.5, 3.5), (true, 1.5, 3.5, 3.5, 3.5), (true, 3.5, 3.5, 3.5, 1.5), (true, 3.5, 1.5, 1.5, 1.5)
  ) v(hole, a, b, c, d)),
edge AS (
  SELECT p.cd, s.hole, CAST(ox + a AS DOUBLE) AS x1, CAST(oy + b AS DOUBLE) AS y1,
         CAST(ox + c AS DOUBLE) AS x2, CAST(oy + d AS DOUBLE) AS y2
  FROM poly p, shape s WHERE NOT s.hole OR p.s_suppkey % 2 = 0)
"""

POINT_SQL = POLYGON_SQL + """,
pt AS (
  SELECT o_orderkey, (o_orderkey * 37) % 1009 / 10.0 AS px, (o_orderkey * 91) % 10007 / 10.0 AS py FROM orders),
valid AS (SELECT * FROM pt WHERE px <> 0 AND py <> 0),
hit AS (
  SELECT o_orderkey, cd FROM valid, edge
  GROUP BY o_orderkey, cd
  HAVING sum(CASE WHEN (y1 > py) <> (y2 > py)
                   AND px < (x2 - x1) * (py - y1) / CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END + x1
                  THEN 1 ELSE 0 END) % 2 = 1
     AND NOT bool_or((x2 - x1) * (py - y1) = (px - x1) * (y2 - y1)
                     AND px BETWEEN least(x1, x2) AND greatest(x1, x2)
                     AND py BETWEEN least(y1, y2) AND greatest(y1, y2))),
inside AS (SELECT o_orderkey, min(cd) AS cd FROM hit GROUP BY 1),
dist AS (
  SELECT o_orderkey, cd,
         (px - x1 - u * (x2 - x1)) * (px - x1 - u * (x2 - x1)) + (py - y1 - u * (y2 - y1)) * (py - y1 - u * (y2 - y1)) AS d2
  FROM (SELECT *, greatest(0.0, least(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1))
                                      / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS u
        FROM valid, edge)),
near AS (SELECT o_orderkey, min(row(d2, cd)).cd AS cd FROM (SELECT o_orderkey, d2, cd FROM dist) GROUP BY 1)
"""
POINT_SQL = POINT_SQL.replace("min(row(d2, cd)).cd AS cd", "min({'d2': d2, 'cd': cd}).cd AS cd")
