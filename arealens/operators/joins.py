"""Joins between areas, feeds, attributes, vectors and lookups.

No join here is hinted by hand: Spark broadcasts a side below its size threshold (checked again at
run time by AQE) and otherwise shuffles, splitting skewed partitions.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from arealens.functions import scalars as S
from arealens.operators.ordering import dedupe_first, dedupe_last


def reject_collisions(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Non-key columns with the same name (ignoring case) would be ambiguous after the join."""
    mine = {c.lower() for c in left.columns} - {k.lower() for k in keys}
    both = sorted(c for c in right.columns if c.lower() in mine)
    if both:
        raise ValueError(f"columns on both sides of the join: {both}")


def star_left_join(master: DataFrame, feeds: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    out = master
    for feed in feeds:
        reject_collisions(out, feed, keys)
        out = out.join(feed, list(keys), "left")
    return out


def join_on_normalized_key(
    left: DataFrame,
    right: DataFrame,
    left_code: str,
    right_code: str,
    order: Sequence[str],
    columns: Sequence[str] | None = None,
    explode_all: bool = False,
) -> DataFrame:
    """Left join on the canonical area key of both sides; the first right row per key counts.

    By default a combined right label stands for its first code only; ``explode_all`` attaches it
    to every code it names.
    """
    keyed = right.withColumn("_key", S.normalize_join_key(right_code))
    if explode_all:
        keyed = right.withColumn("_key", F.explode(S.all_join_keys(right_code)))
    wanted = [c for c in (columns or right.columns) if c != right_code]
    side = dedupe_first(keyed.filter("_key is not null").select("_key", *dict.fromkeys([*wanted, *order])), ["_key"], order)
    side = side.select("_key", *wanted)
    reject_collisions(left, side, ["_key"])
    return left.withColumn("_key", S.normalize_join_key(left_code)).join(side, "_key", "left").drop("_key")


def match_report(df: DataFrame, code: str, probe: str) -> DataFrame:
    """Rows with a readable code, rows whose probe column was filled, and the under-half flag."""
    has_key = S.normalize_join_key(code).isNotNull()
    counts = df.agg(F.count_if(has_key).alias("n_with_key"), F.count(probe).alias("n_matched"))
    few = (F.col("n_with_key") > 0) & (F.col("n_matched") < F.col("n_with_key") * 0.5)
    return counts.withColumn("under_half", few)


def warn_if_unmatched(df: DataFrame, code: str, probe: str) -> None:
    row = match_report(df, code, probe).first()
    if row["under_half"]:
        warnings.warn(f"only {row['n_matched']} of {row['n_with_key']} keyed rows matched", stacklevel=2)


def wide_assemble(base: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    return star_left_join(base, parts, [key])


def vintage_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows present in both vintages; no overlap at all is an error."""
    reject_collisions(a, b, keys)
    joined = a.join(b, list(keys))
    if joined.isEmpty():
        raise ValueError(f"the two vintages share no {list(keys)}")
    return joined


def attach_lookup(df: DataFrame, entity: str, assignments: DataFrame, briefs: DataFrame | None = None) -> DataFrame:
    """Cluster id by entity and brief by cluster id; entities without a cluster keep NULL and ''."""
    out = df.join(assignments.select(entity, "cluster"), entity, "left")
    if briefs is None:
        return out.withColumn("cluster_description", F.lit(""))
    texts = briefs.select("cluster", F.col("description").alias("cluster_description"))
    return out.join(texts, "cluster", "left").fillna({"cluster_description": ""})


def align_vectors(df: DataFrame, vectors: DataFrame, key: str, vector: str, order: Sequence[str] | None = None) -> DataFrame:
    """Rows that have a vector. With ``order`` the last of several vectors per key wins; without it
    the keys must be unique already."""
    side = vectors.filter(F.col(vector).isNotNull())
    side = dedupe_last(side.select(key, vector, *(order or [])), [key], order) if order else side
    return df.join(side.select(key, vector), key)


def attach_geometry(df: DataFrame, polygons: DataFrame, key: str = "map_key") -> DataFrame:
    """Rows whose key has a polygon; :func:`geometry_report` counts the ones left out."""
    return df.join(polygons.select(key, "geometry"), key, "left").filter(F.col("geometry").isNotNull())


def geometry_report(df: DataFrame, polygons: DataFrame, key: str = "map_key") -> DataFrame:
    marked = df.select(key).join(polygons.select(key, F.lit(1).alias("_hit")), key, "left")
    return marked.agg(F.count("*").alias("n_rows"), F.count_if(F.col("_hit").isNull()).alias("n_unmatched"))


def density_from_area(
    areas: DataFrame,
    incidents: DataFrame,
    keys: Sequence[str],
    count: str = "shooting_incident_count",
    density: str = "shooting_density_per_km2",
    area: str = "area_km2",
    keep_all: bool = True,
) -> DataFrame:
    """Incidents per area and per km²: with ``keep_all`` every area, zero-filled; otherwise only
    areas that have incidents, a missing area leaving the density NULL."""
    reject_collisions(areas.select(*keys, area), incidents, keys)
    how = "left" if keep_all else "right"
    out = areas.select(*keys, area).join(incidents.select(*keys, count), list(keys), how)
    per_km2 = S.safe_divide(count, area)
    if keep_all:
        out = out.fillna(0, [count])
        per_km2 = F.coalesce(per_km2, F.lit(0.0))
    return out.withColumn(density, per_km2)
