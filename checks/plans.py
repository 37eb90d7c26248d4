"""Q: composed plans and the SQL surface."""

from pyspark.sql import functions as F

from arealens import presets
from arealens.functions.predicates import HardFilter, hard_filter
from arealens.operators.spatial import identity
from arealens.plans import cleaning as C
from arealens.plans.adhoc import adhoc_select
from arealens.plans.features import build_feature_table, build_vintage
from arealens.session import scratch_path
from arealens.sources.tables import scan_csv
from checks import feeds as X
from checks.base import check, r6, s6
from checks.derived import AREA_SQL, COUNT_COLUMNS, POLYGON_SQL, SHARE_COLUMNS, area_table

FLOW = ["latitude", "longitude", "avg_pedestrian", "peak_pedestrian"]


@check(
    "q1_clean_pedestrian",
    "WITH " + X.pedestrian_sql() + f"SELECT borough, street, from_street, to_street, {', '.join(f'{s6(c)} AS {c}' for c in FLOW)} FROM ped",
)
def q1(t):
    out = C.clean_pedestrian(scan_csv(t.spark, X.pedestrian_csv(t)))
    return out.select("borough", "street", "from_street", "to_street", *[r6(c) for c in FLOW])


@check(
    "q1_clean_pedestrian_vintage",
    "WITH " + X.pedestrian_sql(22) + f"SELECT borough, street, {', '.join(f'{s6(c)} AS {c}' for c in FLOW)} FROM ped",
)
def q1_vintage(t):
    out = C.clean_pedestrian(scan_csv(t.spark, X.pedestrian_csv(t)), 2022)
    return out.select("borough", "street", *[r6(c) for c in FLOW])


@check("q2_clean_stations", "WITH " + X.STATIONS_SQL + f"SELECT station_name, borough, {s6('latitude')} AS latitude, {s6('longitude')} AS longitude, routes FROM sta")
def q2(t):
    return C.clean_stations(scan_csv(t.spark, X.stations_csv(t))).select("station_name", "borough", r6("latitude"), r6("longitude"), "routes")


@check(
    "q3_clean_storefronts",
    "WITH " + X.storefronts_sql()
    + f"SELECT CAST(id AS VARCHAR) AS bbl, borough, {s6('latitude')} AS latitude, {s6('longitude')} AS longitude, reporting_year, construction_yes, category AS business_activity_category FROM sf",
)
def q3(t):
    out = C.clean_storefronts(scan_csv(t.spark, X.storefronts_csv(t)))
    return out.select(
        "bbl", "borough", r6("latitude"), r6("longitude"), "reporting_year", F.col("construction_yes").cast("int"), "business_activity_category"
    )


_INDEX = [*presets.INDEX_BASE_RENAMES.values(), *[f"{g}_{k}" for g in presets.INDEX_GOALS.values() for k in ("score", "rank")]]


@check("q4_clean_health_index", "WITH " + X.INDEX_SQL + f"SELECT cd, {', '.join(f'{s6(c)} AS {c}' for c in _INDEX)} FROM idx")
def q4(t):
    out = C.clean_health_index(scan_csv(t.spark, X.index_csv(t), encoding="ISO-8859-1"))
    return out.select("cd", *[r6(c) for c in _INDEX])


_PROFILE = [c for c in presets.PROFILE_RENAMES.values() if c not in ("neighborhood", "cd", "employed_2016")] + ["total_jobs", "total_population_proxy"]


@check(
    "q5_clean_profiles",
    "WITH " + X.INDEX_SQL + "," + X.PROFILES_SQL
    + f"SELECT neighborhood, prof.cd, borough, {', '.join(f'{s6(c)} AS {c}' for c in [*_PROFILE, *_INDEX])} FROM prof LEFT JOIN idx USING (cd)",
)
def q5(t):
    index = C.clean_health_index(scan_csv(t.spark, X.index_csv(t), encoding="ISO-8859-1"))
    out = C.clean_profiles(scan_csv(t.spark, X.profiles_csv(t)), index)
    return out.select("neighborhood", "cd", "borough", *[r6(c) for c in [*_PROFILE, *_INDEX]])


_MERGED = [
    "area_km2", "avg_pedestrian", "peak_pedestrian", "construction_jobs", "nfh_median_income", "pop_black", "pop_hispanic", "pop_asian",
    "total_population_proxy", "nfh_overall_score", "pct_bachelors_plus", *SHARE_COLUMNS, "category_entropy", "subway_density_per_km2",
    "storefront_density_per_km2", "commercial_activity_score", "competitive_score", "transit_activity_score",
]
_COUNTS = ["pedestrian_count_points", "subway_station_count", "shooting_incident_count", "storefront_filing_count", *COUNT_COLUMNS]


@check(
    "q6_merge_features",
    AREA_SQL
    + f"SELECT neighborhood, cd, borough, category_diversity, {', '.join(_COUNTS)}, {', '.join(f'{s6(c)} AS {c}' for c in _MERGED)} FROM feat",
)
def q6(t):
    return area_table(t).select("neighborhood", "cd", "borough", "category_diversity", *_COUNTS, *[r6(c) for c in _MERGED])


# --- raw files to feature table -------------------------------------------------

_SLUGS = {"Food Services": "FOOD_SERVICES", "RETAIL": "RETAIL", "UNKNOWN": "UNKNOWN", "other": "other"}
_IMPUTED = [c for c in [*_PROFILE, *_INDEX] if c != "median_household_income" and not c.endswith("_rank")] + ["avg_pedestrian", "peak_pedestrian"]
_ALL_COUNTS = [
    "pedestrian_count_points", "subway_station_count", "shooting_incident_count", "storefront_filing_count",
    *[f"act_{s}_storefront" for s in _SLUGS.values()],
]


def _built_sql(year: int | None) -> str:
    counts = " , ".join(f"coalesce({c}, 0) AS {c}" for c in _ALL_COUNTS)
    incident = "count(*)" if year else "count(DISTINCT incident_key)"
    return (
        POLYGON_SQL.rstrip() + "," + X.AREAS_SQL + "," + X.pedestrian_sql(22 if year else 24) + "," + X.STATIONS_SQL + "," + X.storefronts_sql(year)
        + "," + X.incidents_sql(year) + "," + X.INDEX_SQL + "," + X.PROFILES_SQL
        + ",\nstx AS (SELECT row_number() OVER () AS id, * FROM sta),"
        + ",".join(X.located_sql(feed, "id", out) for feed, out in (("ped", "l1"), ("stx", "l2"), ("sf", "l3"), ("inc", "l4")))
        + f""",
f1 AS (SELECT cd, avg(avg_pedestrian) AS avg_pedestrian, max(peak_pedestrian) AS peak_pedestrian, count(street) AS pedestrian_count_points FROM l1 GROUP BY 1),
f2 AS (SELECT cd, count(DISTINCT station_name) AS subway_station_count FROM l2 GROUP BY 1),
f3 AS (SELECT cd, count(*) AS storefront_filing_count, {", ".join(f"count(*) FILTER (WHERE category = '{c}') AS act_{s}_storefront" for c, s in _SLUGS.items())} FROM l3 GROUP BY 1),
f4 AS (SELECT cd, {incident} AS shooting_incident_count FROM l4 GROUP BY 1),
attr AS (SELECT prof.* EXCLUDE (neighborhood, borough, cd), prof.cd AS code, idx.* EXCLUDE (cd) FROM prof LEFT JOIN idx USING (cd)),
raw AS (SELECT a.* EXCLUDE (shape), f1.* EXCLUDE (cd), f2.* EXCLUDE (cd), f3.* EXCLUDE (cd), f4.* EXCLUDE (cd), attr.* EXCLUDE (code)
  FROM areas a LEFT JOIN f1 USING (cd) LEFT JOIN f2 USING (cd) LEFT JOIN f3 USING (cd) LEFT JOIN f4 USING (cd) LEFT JOIN attr USING (code)),
g AS (SELECT borough, {", ".join(f"median({c}) AS {c}" for c in _IMPUTED)} FROM raw GROUP BY 1),
fl AS (SELECT raw.* EXCLUDE ({", ".join(_IMPUTED)}), {", ".join(f"coalesce(raw.{c}, g.{c}) AS {c}" for c in _IMPUTED)} FROM raw LEFT JOIN g USING (borough)),
o AS (SELECT {", ".join(f"median({c}) AS {c}" for c in _IMPUTED)} FROM fl),
done AS (SELECT fl.* EXCLUDE ({", ".join(_IMPUTED + _ALL_COUNTS)}), {counts}, {", ".join(f"coalesce(fl.{c}, o.{c}{', 0' if 'pedestrian' in c else ''}) AS {c}" for c in _IMPUTED)} FROM fl, o)
SELECT neighborhood, cd, borough, {s6('area_km2')} AS area_km2, {", ".join(_ALL_COUNTS)}, {", ".join(f"{s6(c)} AS {c}" for c in _IMPUTED)},
  {", ".join(f"{s6(f'coalesce(act_{s}_storefront / nullif(storefront_filing_count, 0), 0)')} AS act_{s}_density" for s in _SLUGS.values())},
  {s6('subway_station_count / area_km2')} AS subway_density_per_km2, {s6('storefront_filing_count / area_km2')} AS storefront_density_per_km2,
  {s6('ln(1 + avg_pedestrian * storefront_filing_count)')} AS commercial_activity_score,
  {s6('ln(1 + storefront_filing_count / (avg_pedestrian + 1))')} AS competitive_score,
  {s6('ln(1 + subway_station_count * avg_pedestrian)')} AS transit_activity_score
FROM done"""
    )


def _built(t, vintage=None):
    paths = dict(
        pedestrian_path=X.pedestrian_csv(t),
        stations_path=X.stations_csv(t),
        profiles_path=X.profiles_csv(t),
        polygons_path=X.polygons_json(t),
        index_path=X.index_csv(t),
        storefronts_path=X.storefronts_csv(t),
        incidents_path=X.incidents_csv(t),
        output=scratch_path(t.spark, "features"),
        project=identity,
        to_km2=1.0,
        polygon_lines=True,
    )
    tables = build_vintage(t.spark, vintage, pedestrian_year=2022, **paths) if vintage else build_feature_table(t.spark, **paths)
    scores = ["subway_density_per_km2", "storefront_density_per_km2", "commercial_activity_score", "competitive_score", "transit_activity_score"]
    shares = [f"act_{s}_density" for s in _SLUGS.values()]
    return tables["features"].select(
        "neighborhood", "cd", "borough", r6("area_km2"), *_ALL_COUNTS, *[r6(c) for c in [*_IMPUTED, *shares, *scores]]
    )


@check("q7_build_feature_table", _built_sql(None))
def q7(t):
    return _built(t)


@check("q8_build_vintage", _built_sql(1997))
def q8(t):
    return _built(t, 1997)


@check(
    "q9_adhoc_select",
    AREA_SQL
    + f"""SELECT borough, count(*) AS n, {s6('max(commercial_activity_score)')} AS best FROM feat
    WHERE avg_pedestrian >= 2000 AND storefront_filing_count > 20 GROUP BY borough""",
)
def q9(t):
    kept = hard_filter(area_table(t), HardFilter.from_request(min_avg_pedestrian=2000))
    sql = """SELECT borough, count(*) AS n, max(commercial_activity_score) AS best FROM neighborhoods
             WHERE storefront_filing_count > :filings GROUP BY borough;"""
    return adhoc_select(kept, sql, {"filings": 20}).select("borough", "n", r6("best"))
