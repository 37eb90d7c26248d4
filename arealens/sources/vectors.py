"""Persisted text vectors: one parquet table per backend and vintage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "entity string, text string, embedding array<float>, backend string, vintage string"


def save_vectors(df: DataFrame, path: str, backend: str, vintage: str) -> None:
    """Replace the stored vectors of one backend and vintage; the others stay untouched."""
    (
        df.select("entity", "text", "embedding")
        .withColumns({"backend": F.lit(backend), "vintage": F.lit(vintage)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("backend", "vintage")
        .parquet(path)
    )


def load_vectors(spark: SparkSession, path: str, backend: str, vintage: str) -> DataFrame:
    stored = spark.read.schema(SCHEMA).parquet(path)
    return stored.filter((F.col("backend") == backend) & (F.col("vintage") == vintage))


def stale_rows(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """Texts without a stored vector, or whose text changed since it was stored."""

    def digest(df: DataFrame) -> DataFrame:
        return df.withColumn("_digest", F.md5("text"))

    known = digest(stored).select("entity", "_digest")
    return digest(texts).join(known, ["entity", "_digest"], "left_anti").select(*texts.columns)


def refresh_vectors(texts: DataFrame, stored: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors for ``texts``: stored ones where the text is unchanged, fresh ones elsewhere."""
    current = (
        stored.withColumn("_digest", F.md5("text"))
        .join(texts.select("entity", F.md5("text").alias("_digest")), ["entity", "_digest"], "left_semi")
        .select("entity", "text", "embedding")
    )
    fresh = embed(stale_rows(texts, stored)).select("entity", "text", "embedding")
    return current.unionByName(fresh)
