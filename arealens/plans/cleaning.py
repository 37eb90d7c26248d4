"""Cleaning of the raw feeds, one function per feed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from arealens import presets
from arealens.functions import predicates as P
from arealens.functions import scalars as S
from arealens.operators.aggregates import pivot_first
from arealens.operators.joins import wide_assemble
from arealens.operators.ordering import dedupe_first
from arealens.sources.tables import missing_columns, rename_keep, require_columns

ROW = "_row"


def with_file_order(df: DataFrame) -> DataFrame:
    """Numbers the rows of a scan by file name and position, the order "first row" refers to.

    Apply it directly to a scan: its partitions are fixed, so a recomputed task numbers alike. A
    table that is not read from files is numbered by partition and position.
    """
    if ROW in df.columns:
        return df
    position = F.monotonically_increasing_id().alias("at")
    try:
        return df.withColumn(ROW, F.struct(F.col("_metadata.file_path").alias("file"), position))
    except AnalysisException:
        return df.withColumn(ROW, F.struct(F.lit("").alias("file"), position))


def _coordinates(df: DataFrame) -> tuple[Column, Column]:
    if "the_geom" in df.columns:
        return S.parse_wkt_point("the_geom", strict=True)
    return S.to_number("longitude"), S.to_number("latitude")


def clean_pedestrian(df: DataFrame, year: int = presets.CURRENT_PERIOD_YEAR, mode: str = "exact") -> DataFrame:
    """Counting points with mean and peak over the periods of a year, without bridges and silent points."""
    lon, lat = _coordinates(df)
    mean, peak = S.row_mean_max([S.to_number(F.col(f"`{c}`")) for c in S.select_period_columns(df.columns, year, mode)])
    # One projection reads only the chosen period columns from the wide file.
    derived = df.select(
        *[c for c in presets.PEDESTRIAN_RENAMES if c in df.columns],
        lat.alias("latitude"),
        lon.alias("longitude"),
        mean.alias("avg_pedestrian"),
        peak.alias("peak_pedestrian"),
    )
    keep = [*presets.PEDESTRIAN_RENAMES.values(), "latitude", "longitude", "avg_pedestrian", "peak_pedestrian"]
    out = rename_keep(derived, presets.PEDESTRIAN_RENAMES, keep)
    out = out.withColumn("borough", S.standardize_group("borough"))
    return out.filter(
        P.not_listed("borough", presets.PEDESTRIAN_DROPPED_GROUPS)
        & F.col("borough").isNotNull()
        & P.valid_coordinates()
        & P.positive("avg_pedestrian")
    )


def clean_stations(df: DataFrame) -> DataFrame:
    """Stations with valid coordinates, one row per name and place."""
    df = with_file_order(df)
    keep = [*presets.STATION_RENAMES.values(), ROW]
    out = rename_keep(df, presets.STATION_RENAMES, keep)
    require_columns(out, presets.STATION_REQUIRED, "station table")
    out = out.withColumns(
        {
            "borough": S.standardize_group("borough"),
            "latitude": S.to_number("latitude"),
            "longitude": S.to_number("longitude"),
        }
    ).filter(F.col("station_name").isNotNull() & F.col("borough").isNotNull() & P.valid_coordinates())
    return dedupe_first(out, ["station_name", "latitude", "longitude"], [ROW]).drop(ROW)


def clean_storefronts(df: DataFrame, max_year: int | None = None) -> DataFrame:
    """Occupied storefront filings with category and coordinates; ``max_year`` caps the latest
    reporting year named in the text and drops filings without one."""
    require_columns(df, list(presets.STOREFRONT_RENAMES), "storefront table")
    out = df.withColumnsRenamed(presets.STOREFRONT_RENAMES)
    if max_year is not None:
        out = out.filter(S.max_year_in_text("reporting_year") <= max_year)
    # The text point only fills coordinates the number columns lack.
    lon, lat = S.parse_wkt_point("lat_long_wkt", strict=False)
    out = out.withColumns(
        {
            "latitude": F.coalesce(S.to_number("latitude"), lat),
            "longitude": F.coalesce(S.to_number("longitude"), lon),
            "borough": S.standardize_group("borough"),
            "reporting_year": S.to_number("reporting_year"),
            "business_activity_category": S.relabel_category("primary_business_activity"),
            **{flag: S.yes_flag(raw) for flag, raw in presets.FLAG_COLUMNS.items()},
        }
    )
    out = out.filter(
        P.no_flag_set(["vacant_on_dec31_yes", "vacant_midyear_yes"])
        & F.col("borough").isNotNull()
        & P.valid_coordinates()
    )
    return out.select(*presets.STOREFRONT_KEEP)


def clean_health_index(df: DataFrame) -> DataFrame | None:
    """One row per area code with demographic columns, index scores and ranks; None if the table
    lacks a needed column."""
    if missing_columns(df, ["CD", *presets.INDEX_BASE_RENAMES, "Goal", "IndexScore", "GoalRank"]):
        return None
    keyed = with_file_order(df)
    if "cd" not in df.columns:
        keyed = keyed.withColumn("cd", S.normalize_join_key("CD"))
    keyed = keyed.filter(F.col("cd").isNotNull())
    base = dedupe_first(keyed.select("cd", *presets.INDEX_BASE_RENAMES, ROW), ["cd"], [ROW]).select(
        "cd", *[S.clean_numeric_string(c).alias(name) for c, name in presets.INDEX_BASE_RENAMES.items()]
    )
    goals = keyed.select(
        "cd", "Goal", S.clean_numeric_string("IndexScore").alias("score"), S.clean_numeric_string("GoalRank").alias("rank"), ROW
    )
    scores = pivot_first(goals, "cd", "Goal", "score", presets.INDEX_GOALS, ROW, "_score")
    ranks = pivot_first(goals, "cd", "Goal", "rank", presets.INDEX_GOALS, ROW, "_rank")
    return wide_assemble(base, [scores, ranks], "cd")


def clean_profiles(df: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Area profiles with numbers, transit share, group, totals and, if given, the index columns."""
    df = with_file_order(require_columns(df, list(presets.PROFILE_RENAMES), "profile table"))
    out = rename_keep(df, presets.PROFILE_RENAMES, [*presets.PROFILE_RENAMES.values(), ROW])
    texts = ("neighborhood", "cd", ROW)
    out = out.select(*[c if c in texts else S.clean_numeric_string(c).alias(c) for c in out.columns])
    out = out.withColumns(
        {
            "commute_public_transit": S.share_of("commute_public_transit", "employed_2016"),
            "borough": S.group_from_code("cd"),
        }
    ).drop("employed_2016")
    out = dedupe_first(out.filter(P.known_code("cd")), ["cd"], [ROW])
    out = out.withColumns(
        {
            "total_jobs": S.null_as_zero_sum(presets.JOB_COLUMNS),
            "total_population_proxy": S.null_as_zero_sum(presets.POPULATION_COLUMNS),
        }
    )
    if index is not None:
        side = index.withColumnRenamed("cd", "_key")
        out = out.withColumn("_key", S.normalize_join_key("cd")).join(side, "_key", "left").drop("_key")
    return out.drop(ROW)


def clean_incidents(
    df: DataFrame, year: int | None = None, mode: str = "upto", date: str = "OCCUR_DATE", group: str = "BORO"
) -> DataFrame:
    """Incident points, optionally capped by year; keeps only valid coordinates and named groups."""
    out = P.cap_by_year(df, date, year, mode) if year is not None else df
    lat, lon = ("Latitude", "Longitude") if "Latitude" in df.columns else ("latitude", "longitude")
    taken = {lat.lower(), lon.lower()}
    rest = [c for c in out.columns if c.lower() not in taken]
    out = out.select(*rest, S.to_number(lat).alias("latitude"), S.to_number(lon).alias("longitude"))
    if group in out.columns:
        out = out.withColumn("borough", S.standardize_group(group)).filter(F.col("borough").isNotNull())
    return out.filter(P.valid_coordinates())


