"""Tables that operators write once to the cluster's shared folder, and the folder itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arealens.session import stage_table

__all__ = ["deal", "partitions", "shielded", "stage_table"]


def partitions(df: DataFrame, factor: int = 1) -> int:
    """Number of shuffle partitions the session asks for, times ``factor``."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * factor


def deal(df: DataFrame, n: int, column: str) -> DataFrame:
    """Rows of bucket i (0 .. n - 1) go to partition i: one bucket a task, where hashing bucket numbers would pile some up."""
    return df.repartitionById(n, F.col(column).cast("int"))


def shielded(stage):
    """Runs a stage on columns renamed by position, so that no name in ``docs`` can clash with names a stage adds.

    The stage gets the table and a function from a column's own name to its name inside; it returns the inside columns,
    which get their own names back.
    """

    def run(docs: DataFrame) -> DataFrame:
        own = docs.columns
        inside = {c: f"_in{i}" for i, c in enumerate(own)}
        out = stage(docs.toDF(*inside.values()), inside.__getitem__)
        return out.select(*[F.col(i).alias(c) for c, i in inside.items()])

    return run
