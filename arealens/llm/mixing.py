"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets a mean repetition rate, target rows over rows present. A document's number of copies is the
Poisson quantile of a uniform number that depends only on the seed and the document, so a run repeats exactly,
needs no random state, and a document keeps its copies when others come or go (at an equal rate).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from arealens.llm.staging import partitions

BROADCAST_SOURCES = 10_000
ADDED = ("mix_rate", "mix_copies", "mix_copy", "mix_order")
HASH_DIGITS = 12


def uniform(seed: str, *parts: Column) -> Column:
    """Number in (0, 1) from the first 48 bits of an MD5; NULL parts count as empty text."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(16**HASH_DIGITS))


def poisson_steps(rate: Column) -> Column:
    """Distribution function of a Poisson variable at 0, 1, 2 ... until it is 1 to double precision.

    Twelve standard deviations above the mean leave less than 1e-17. Large rates are summed from logarithms, so
    ``exp(-rate)`` never runs out of range.
    """
    last = F.ceil(rate + F.lit(12) * F.sqrt(rate) + F.lit(20)).cast("int")
    log_terms = F.aggregate(
        F.sequence(F.lit(1), last),
        F.array(-rate),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + F.log(rate) - F.log(k.cast("double")))),
    )
    return F.aggregate(
        F.slice(log_terms, 2, last),
        F.array(F.exp(-rate)),
        lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.exp(t))),
    )


def source_rates(
    docs: DataFrame, weights: Mapping[str, float] | None = None, total: int | None = None, source: str = "source"
) -> DataFrame:
    """Rows, weight and mean repetition rate per source, one row each.

    Without ``weights`` every source present has the same weight; a source that ``weights`` leaves out, or gives
    0, has rate 0. ``total`` is the wanted number of rows (default: as many as there are). NULL is a source of its own.
    """
    name = F.col(f"`{source}`")
    counted = docs.groupBy(name.alias("_source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        given = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*given)[F.col("_source")], F.lit(0.0)) if given else F.lit(0.0)
    counted = counted.withColumn("weight", F.when(F.col("_source").isNull() & F.lit(weights is not None), F.lit(0.0)).otherwise(weight))
    sums = counted.agg(F.sum("weight").alias("_w"), F.sum("n_docs").alias("_n"))
    wanted = F.lit(float(total)) if total is not None else F.col("_n").cast("double")
    share = F.when(F.col("_w") > 0, F.col("weight") / F.col("_w")).otherwise(F.lit(0.0))
    # one row with two sums joins the short table of sources
    return counted.join(F.broadcast(sums)).select(
        "_source", "n_docs", "weight", (share * wanted / F.col("n_docs")).alias("rate")
    )


def poisson_mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    total: int | None = None,
    seed: str = "mix-1",
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    shuffle: bool = True,
) -> DataFrame:
    """Every column of ``docs`` plus ``mix_rate``, ``mix_copies``, ``mix_copy`` (1 ..) and ``mix_order``.

    Documents with no copies leave. ``mix_order`` is a hash of seed, document and copy: the result is dealt over
    partitions by its leading bits and sorted inside each, so its files read in order are a global shuffle. The hot
    source is no hot key: rates join as a broadcast if there are few sources, else as a join that adaptive
    execution may split, and the final deal is by hashes.

    Copies of a row with the same key and text draw the same number and order; NULL keys and texts draw by what is
    left. Columns of ``docs`` named like one of the four are replaced, all others stay, whatever their names. Empty input
    gives an empty result.
    """
    own = {c: f"_in{i}" for i, c in enumerate(docs.columns) if c not in ADDED}
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in own.items()])
    rates = source_rates(docs, weights, total, source).withColumn("_steps", poisson_steps_or_none(F.col("rate")))
    rates = rates.select("_source", F.col("rate").alias("mix_rate"), "_steps")
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates
    drawn = uniform(seed, F.col(own[key]), F.md5(F.coalesce(F.col(own[text]), F.lit(""))))
    joined = rows.join(rates, rows[own[source]].eqNullSafe(rates["_source"])).withColumn("_u", drawn)
    copies = F.size(F.filter("_steps", lambda p: p <= F.col("_u")))
    out = joined.withColumn("mix_copies", copies.cast("int")).filter(F.col("mix_copies") > 0)
    out = out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(own[key]).cast("string"), F.lit("")), F.col("mix_copy").cast("string")))
    out = out.select(*[F.col(i).alias(c) for c, i in own.items()], "mix_rate", "mix_copies", "mix_copy", order.alias("mix_order"))
    if not shuffle:
        return out
    n = partitions(docs)
    leading = F.conv(F.substring("mix_order", 1, 8), 16, 10).cast("bigint")
    return out.repartitionById(n, F.shiftright(leading * n, 32).cast("int")).sortWithinPartitions("mix_order")


def poisson_steps_or_none(rate: Column) -> Column:
    """Steps of a positive rate; a rate of 0 has no copies at all."""
    return F.when(rate > 0, poisson_steps(F.when(rate > 0, rate).otherwise(F.lit(1.0)))).otherwise(F.array(F.lit(1.0)))
