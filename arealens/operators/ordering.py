"""Row numbering, ranks, top rows and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from arealens.session import stage_table

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the lower 33 bits


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys where a NULL group matches a NULL group; keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """1..n over the whole table in the given total order, without a one-task window.

    The range-partitioned sort is written once together with each row's partition and index; a row's number is its index
    plus the sizes of the partitions before it (one row per partition).
    """
    placed = stage_table(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_mid", _ROW_BITS).cast("int"))
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, seen = [], 0
    for part, n in sizes:
        offsets.append((part, seen))
        seen += n
    table = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    index = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_offset") + index + 1)
        .drop("_part", "_mid", "_offset")
    )


def number_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """1..n inside each group of ``by``; one group may hold most of the table."""
    numbered = number_rows(df, [*by, *order], "_all")
    if not by:
        return numbered.withColumnRenamed("_all", name)
    firsts = numbered.groupBy(*by).agg(F.min("_all").alias("_first"))
    joined = join_groups(numbered, firsts, by)
    return joined.select(*df.columns, (F.col("_all") - F.col("_first") + 1).alias(name))


def rank_desc(
    df: DataFrame,
    score: str,
    key: Sequence[str],
    by: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """1..n by descending score; equal scores are ordered by the entity key, missing scores last."""
    order = [F.col(score).desc_nulls_last(), *[F.col(k).asc() for k in key]]
    return number_within(df, by, order, name)


def rank_average(
    df: DataFrame,
    score: str,
    by: Sequence[str] = (),
    name: str = "rank",
    descending: bool = True,
) -> DataFrame:
    """Ranks by score where ties share the mean of their positions."""
    direction = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    # Ties collapse before anything is sorted: one row per distinct score carries their number.
    counts = df.groupBy(*by, score).agg(F.count("*").alias("_n"))
    ranked = running_total(counts, by, [direction], "_n", "_through")
    ranks = ranked.select(*by, score, (F.col("_through") - (F.col("_n") - 1) / 2.0).alias(name))
    return join_groups(df, ranks, [*by, score]).select(*df.columns, name)


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], weight: str, name: str
) -> DataFrame:
    """Inclusive running sum of ``weight`` per group in the given order, spread over sorted blocks."""
    block_rows = 100_000
    numbered = number_rows(df, [*[F.col(c).asc() for c in by], *order], "_all")
    numbered = numbered.withColumn("_block", F.floor((F.col("_all") - 1) / block_rows))
    within = W.partitionBy(*by, "_block").orderBy("_all").rowsBetween(W.unboundedPreceding, 0)
    blocks = numbered.groupBy(*by, "_block").agg(F.sum(weight).alias("_sum"))
    # One row per 100,000 rows of input is left for this window.
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    left = numbered.withColumn("_within", F.sum(weight).over(within))
    joined = join_groups(left, blocks.drop("_sum"), [*by, "_block"])
    return joined.select(*df.columns, (F.col("_before") + F.col("_within")).alias(name))


def rank_delta(df: DataFrame, before: str, after: str) -> DataFrame:
    """Rank change and its size, largest first."""
    delta = F.col(after) - F.col(before)
    return df.withColumns({"rank_delta": delta, "rank_delta_abs": F.abs(delta)}).orderBy(
        F.col("rank_delta_abs").desc_nulls_last()
    )


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int, name: str = "rank"
) -> DataFrame:
    """The n first rows of each group. Spark limits every input partition to n rows per group
    before the shuffle (WindowGroupLimit), so a hot group never reaches one task whole."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def order_by_score(df: DataFrame, score: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), *ties)


def top_k(df: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """k best rows; planned as TakeOrderedAndProject, so only k rows per partition move."""
    return order_by_score(df, score, *ties).limit(k)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in the given order, as a combinable aggregate rather than a window:
    a key with many copies shrinks to one row per input partition before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*[_c(o) for o in order])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*[c if c in keys else F.col("_first")[c].alias(c) for c in df.columns])


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*[_c(o) for o in order])).alias("_last")
    return df.groupBy(*keys).agg(last).select(*[c if c in keys else F.col("_last")[c].alias(c) for c in df.columns])
