"""Polygons in and out as GeoJSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arealens import presets
from arealens.functions import scalars as S
from arealens.session import scratch_path
from arealens.sources.features import feature_texts

# stands in no JSON text unescaped
SEPARATOR = "\x1e"
RINGS_TYPE = "array<struct<hole:boolean,points:array<struct<x:double,y:double>>>>"
_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def _rings(kind: Column, coordinates: Column) -> Column:
    """All rings of a (multi)polygon; the first ring of each part is the shell, the others are holes."""
    parts = F.when(kind == "MultiPolygon", F.from_json(coordinates, _MULTI)).otherwise(
        F.array(F.from_json(coordinates, _POLYGON))
    )
    return F.flatten(
        F.transform(
            parts,
            lambda part: F.transform(
                part,
                lambda ring, i: F.struct(
                    (i > 0).alias("hole"),
                    F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias(
                        "points"
                    ),
                ),
            ),
        )
    )


def scan_polygons(
    spark: SparkSession,
    path: str,
    fields: Mapping[str, str] = presets.POLYGON_FIELDS,
    group: str = "borough",
    lines: bool = False,
    parts: bool = False,
) -> DataFrame:
    """Areas with trimmed names, an upper-case group, their rings and the raw geometry text.

    ``lines=True`` reads one feature per line; otherwise each file is one feature collection, or with ``parts=True`` all files
    together are one, in the order of their names. Collections are cut into features once, written to the shared folder.
    """
    properties = ", ".join(f"`{name}`: string" for name in fields)
    reader = spark.read.schema(f"properties struct<{properties}>, geometry string")
    if lines:
        features = reader.json(path)
    else:
        texts = scratch_path(spark, "features")
        feature_texts(spark, path, parts).write.option("lineSep", SEPARATOR).text(texts)
        features = reader.json(texts, lineSep=SEPARATOR)
    parsed = features.withColumn("_g", F.from_json("geometry", "type string, coordinates string"))
    return parsed.select(
        *[
            (F.upper(S.strip(c)) if name == group else S.strip(c)).alias(name)
            for source, name in fields.items()
            for c in [F.col(f"properties.`{source}`")]
        ],
        _rings(F.col("_g.type"), F.col("_g.coordinates")).alias("rings"),
        "geometry",
    )


def geometry_json(rings: Column | str) -> Column:
    """Rings as MultiPolygon text; a shell starts a new part and the holes after it belong to it."""
    rings = F.col(rings) if isinstance(rings, str) else rings
    ring_text = F.transform(
        rings,
        lambda r: F.concat(
            F.when(r.getField("hole"), F.lit(",")).otherwise(F.lit("],[")),
            F.to_json(F.transform(r.getField("points"), lambda p: F.array(p.getField("x"), p.getField("y")))),
        ),
    )
    body = F.substring(F.array_join(ring_text, ""), F.lit(3), F.lit(2**31 - 1))
    return F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), body, F.lit("]]}"))


def export_scored_polygons(df: DataFrame, properties: Sequence[str], path: str | None = None) -> DataFrame:
    """One GeoJSON feature per line with the listed columns as properties; written if a path is given."""
    lines = df.select(
        F.concat(
            F.lit('{"type":"Feature","properties":'),
            F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}),
            F.lit(',"geometry":'),
            F.col("geometry"),
            F.lit("}"),
        ).alias("value")
    )
    if path:
        lines.write.mode("overwrite").text(path)
    return lines
