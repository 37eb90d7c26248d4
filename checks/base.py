"""Registry of queries and their SQL twins, and the derived tables several of them share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def check(name: str, sql: str | None = None):
    """Registers a function from the tables to a DataFrame under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def r6(c, name: str | None = None):
    """Round to six digits without a negative zero."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def s6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"
