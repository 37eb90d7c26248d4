"""The wide per-area feature table, current or for a data vintage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from arealens import presets
from arealens.functions import geometry as G
from arealens.functions import scalars as S
from arealens.operators import aggregates as A
from arealens.operators import joins as J
from arealens.operators import spatial as SP
from arealens.plans import cleaning as C
from arealens.session import stage_table
from arealens.sources.geojson import scan_polygons
from arealens.sources.tables import optional_source, scan_csv, write_table

KEYS = list(presets.AREA_KEYS)
FLOW = ("avg_pedestrian", "peak_pedestrian")


def area_features(polygons: DataFrame, project: SP.Projection = G.lambert_conformal, to_km2: float = presets.SQUARE_FEET_TO_KM2) -> DataFrame:
    sizes = SP.polygon_area(polygons, "cd", project=project, to_km2=to_km2)
    return polygons.select(*KEYS).join(sizes, "cd").select(*KEYS, "area_km2")


def storefront_features(
    joined: DataFrame, values: Sequence[str] | None = None, ensure: Sequence[str] = ()
) -> DataFrame:
    """Filings per area and category; ``ensure`` adds category columns that may have no filing. Without a category column
    every filing counts as unknown."""
    category = "business_activity_category"
    label = F.col(category) if category in joined.columns else F.lit(presets.UNKNOWN_LABEL)
    counts = stage_table(A.category_counts(joined, KEYS, label), "category-counts")
    columns = sorted({*(values if values is not None else A.category_values(counts)), *ensure})
    return A.category_pivot(counts, KEYS, columns)


def merge_features(
    areas: DataFrame,
    flow: DataFrame,
    stations: DataFrame,
    incidents: DataFrame,
    profiles: DataFrame,
    storefronts: DataFrame,
    profile_order: Sequence[str] = ("cd",),
) -> DataFrame:
    """Area master with all feeds and attributes, gaps imputed, categories, densities and scores."""
    wide = J.star_left_join(areas, [flow, stations, incidents, storefronts], KEYS)
    attributes = [c for c in profiles.columns if c not in presets.PROFILE_SKIP and c not in profile_order]
    attributes = [c for c in attributes if not c.startswith("_")]
    side = profiles.withColumnsRenamed({"cd": "_profile_cd"}).drop("borough", "neighborhood")
    order = ["_profile_cd" if c == "cd" else c for c in profile_order]
    wide = J.join_on_normalized_key(wide, side, "cd", "_profile_cd", order, attributes)
    wide = stage_table(wide, "merged")
    if attributes:
        J.warn_if_unmatched(wide, "cd", attributes[0])

    imputed = [*attributes, *[c for c in FLOW if c in wide.columns]]
    wide = A.impute_hierarchical(wide, imputed, "borough", FLOW)

    counts = [c for c in wide.columns if c.startswith(presets.CATEGORY_PREFIX) and c.endswith(presets.COUNT_SUFFIX)]
    zero = ["storefront_filing_count", *counts, "subway_station_count", "shooting_incident_count", "pedestrian_count_points"]
    wide = A.fill_zero(wide, zero)
    wide = wide.withColumns(
        {"category_diversity": A.wide_diversity(counts), "category_entropy": A.wide_entropy(counts)}
    )
    wide = A.category_shares(wide, counts)
    filings, stops, pace = "storefront_filing_count", "subway_station_count", "avg_pedestrian"
    wide = wide.withColumns(
        {
            "subway_density_per_km2": F.coalesce(S.safe_divide(stops, "area_km2"), F.lit(0.0)),
            "storefront_density_per_km2": F.coalesce(S.safe_divide(filings, "area_km2"), F.lit(0.0)),
            "commercial_activity_score": S.log_interaction(pace, filings),
            "competitive_score": S.competition_score(filings, pace),
            "transit_activity_score": S.log_interaction(stops, pace),
        }
    )
    return wide.select(*output_columns(wide.columns))


def output_columns(columns: Sequence[str]) -> list[str]:
    """Column order of the feature table: no index ranks, no fallback income beside the index income,
    population counts next to each other."""
    kept = [c for c in columns if not (c.startswith("nfh_") and c.endswith("_rank"))]
    if "nfh_median_income" in kept:
        kept = [c for c in kept if c != "median_household_income"]
    people = [c for c in (*presets.POPULATION_COLUMNS, "total_population_proxy") if c in kept]
    if not people:
        return kept
    at = min(kept.index(c) for c in people)
    rest = [c for c in kept if c not in people]
    before = len([c for c in kept[:at] if c not in people])
    return [*rest[:before], *people, *rest[before:]]


def assemble(
    polygons: DataFrame,
    pedestrian: DataFrame,
    stations: DataFrame,
    profiles: DataFrame,
    storefronts: DataFrame | None,
    incidents: DataFrame | None,
    project: SP.Projection = G.lambert_conformal,
    to_km2: float = presets.SQUARE_FEET_TO_KM2,
    ensure_categories: Sequence[str] = (),
    count_incident_keys: bool = True,
) -> dict[str, DataFrame]:
    """Clean feeds to area features: spatial joins, aggregates and the merged table."""
    polygons = stage_table(polygons, "polygons")
    areas = stage_table(area_features(polygons, project, to_km2), "areas")
    index = SP.area_index(polygons, project=project)

    def located(points: DataFrame) -> DataFrame:
        return SP.assign_area(points, polygons, project=project, index=index)

    flow = A.flow_features(located(pedestrian), KEYS)
    stops = A.distinct_count_features(located(stations), KEYS, "station_name", "subway_station_count")
    incident_rows = None
    if incidents is not None:
        key = "incident_key" if count_incident_keys else None
        incident_rows = A.incident_features(located(incidents), KEYS, key)
    cases = stage_table(optional_source(incident_rows, areas, KEYS, ["shooting_incident_count"]), "incidents")
    shop_rows = storefront_features(located(storefronts), ensure=ensure_categories) if storefronts is not None else None
    shops = stage_table(optional_source(shop_rows, areas, KEYS, ["storefront_filing_count"]), "storefronts")
    features = merge_features(areas, flow, stops, cases, profiles, shops)
    return {
        "features": features,
        "storefronts": shops,
        "incidents": J.density_from_area(areas, cases, KEYS),
        "areas": areas,
    }


def build_feature_table(
    spark: SparkSession,
    pedestrian_path: str,
    stations_path: str,
    profiles_path: str,
    polygons_path: str,
    index_path: str | None = None,
    storefronts_path: str | None = None,
    incidents_path: str | None = None,
    output: str | None = None,
    vintage: int | None = None,
    project: SP.Projection = G.lambert_conformal,
    to_km2: float = presets.SQUARE_FEET_TO_KM2,
    polygon_lines: bool = False,
    pedestrian_year: int | None = None,
) -> dict[str, DataFrame]:
    """Raw files to the feature table. With ``vintage`` the feeds are cut to that year: pedestrian
    periods of exactly that year (or of ``pedestrian_year``), filings and incidents up to it,
    incidents counted by row."""
    year = pedestrian_year or vintage or presets.CURRENT_PERIOD_YEAR
    index = C.clean_health_index(scan_csv(spark, index_path, encoding="ISO-8859-1")) if index_path else None
    parts = {
        "pedestrian": C.clean_pedestrian(scan_csv(spark, pedestrian_path), year),
        "stations": C.clean_stations(scan_csv(spark, stations_path)),
        "profiles": C.clean_profiles(scan_csv(spark, profiles_path), index),
        "storefronts": C.clean_storefronts(scan_csv(spark, storefronts_path), vintage) if storefronts_path else None,
        "incidents": C.clean_incidents(scan_csv(spark, incidents_path), vintage) if incidents_path else None,
    }
    staged = {name: df if df is None else stage_table(df, name) for name, df in parts.items()}
    tables = assemble(
        scan_polygons(spark, polygons_path, lines=polygon_lines).drop("geometry"),
        **staged,
        project=project,
        to_km2=to_km2,
        ensure_categories=["act_UNKNOWN_storefront"] if vintage else (),
        count_incident_keys=vintage is None,
    )
    if output:
        for name, df in {**{k: v for k, v in staged.items() if v is not None}, **tables}.items():
            write_table(df, f"{output}/{name}")
        tables = {name: spark.read.parquet(f"{output}/{name}") for name in tables}
    return tables


def build_vintage(spark: SparkSession, year: int, **options) -> dict[str, DataFrame]:
    """The feature table as it would have looked with data up to ``year``."""
    return build_feature_table(spark, vintage=year, **options)
