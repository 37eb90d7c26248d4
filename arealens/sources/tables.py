"""Table scans, column contracts and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from arealens import presets


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    """Headed CSV. Without a schema every column is text, so nothing is scanned to infer types.

    ``multi_line`` accepts line breaks inside quoted values, at the price of one task per file.
    """
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("encoding", encoding)
    )
    return reader.schema(schema).csv(path) if schema is not None else reader.csv(path, inferSchema=False)


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"{what} is missing required columns {missing}; available: {df.columns}")
    return df


def require_or_empty(df: DataFrame, columns: Sequence[str], empty_schema: str) -> tuple[DataFrame, bool]:
    """The table, or an empty one of ``empty_schema`` if a column is missing."""
    if missing_columns(df, columns):
        return df.sparkSession.createDataFrame([], empty_schema), False
    return df, True


def rename_keep(df: DataFrame, renames: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Rename, then keep the listed columns that exist, in the listed order."""
    renamed = df.withColumnsRenamed(dict(renames))
    return renamed.select(*[F.col(f"`{c}`") for c in keep if c in renamed.columns])


def optional_source(
    df: DataFrame | None, areas: DataFrame, keys: Sequence[str], zero_columns: Sequence[str]
) -> DataFrame:
    """The feed itself, or every area with zeros when the feed is absent."""
    if df is not None:
        return df
    return areas.select(*keys, *[F.lit(0).alias(c) for c in zero_columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def upsert_snapshot(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key: new rows win, untouched old rows stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating column; other columns pass through."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
            c = F.when(finite, c).alias(field.name)
        out.append(c)
    return df.select(*out)


def to_store_columns(
    df: DataFrame,
    renames: Mapping[str, str] = presets.STORE_RENAMES,
    allowed: Sequence[str] = presets.STORE_COLUMNS,
    integers: Sequence[str] = presets.STORE_INTEGER_COLUMNS,
) -> DataFrame:
    """Rename colliding names, lower-case the rest, keep the allow-list, store whole numbers as integers."""
    target = {c: renames.get(c, c).lower() for c in df.columns}
    lowered = list(target.values())
    clashes = sorted({c for c in lowered if lowered.count(c) > 1})
    if clashes:
        raise ValueError(f"columns collide after lower-casing: {clashes}")
    kept = json_safe(df.select(*[F.col(f"`{c}`").alias(t) for c, t in target.items() if t in allowed]))
    return kept.select(
        *[F.col(c).try_cast("bigint").alias(c) if c in integers else F.col(c) for c in kept.columns]
    )
