"""Per-area aggregates, categories, medians and column statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from arealens import presets
from arealens.functions import scalars as S
from arealens.operators.ordering import join_groups, running_total, top_n_per_group
from arealens.session import stage_table

HELD_VALUES = 10_000
MARGIN = 0.002


def flow_features(
    df: DataFrame,
    keys: Sequence[str],
    average: str = "avg_pedestrian",
    peak: str = "peak_pedestrian",
    street: str = "street",
    count_name: str = "pedestrian_count_points",
) -> DataFrame:
    counted = street if street in df.columns else average
    return df.groupBy(*keys).agg(
        F.avg(average).alias(average), F.max(peak).alias(peak), F.count(counted).alias(count_name)
    )


def distinct_count_features(df: DataFrame, keys: Sequence[str], column: str, name: str, approximate: bool = False) -> DataFrame:
    """Distinct values per area. The exact plan first groups by area and value, so a busy area is
    spread over many tasks."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*keys).agg(count(F.col(column)).alias(name))


def incident_features(
    df: DataFrame,
    keys: Sequence[str],
    incident: str | None = "incident_key",
    counted: str = "latitude",
    name: str = "shooting_incident_count",
) -> DataFrame:
    """Distinct incidents if the feed has an incident key, else its rows."""
    if incident and incident in df.columns:
        return distinct_count_features(df, keys, incident, name)
    return df.groupBy(*keys).agg(F.count(counted).alias(name))


def category_counts(df: DataFrame, keys: Sequence[str], category: Column | str) -> DataFrame:
    """Long form: rows per area and category column; labels sharing a slug add up.

    Rows are counted by their raw label first, so the slug is derived once per area and label.
    """
    label = F.col(category) if isinstance(category, str) else category
    counts = df.groupBy(*keys, label.alias("_label")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys, S.category_slug("_label").alias("category")).agg(F.sum("_n").alias("n"))


def category_values(counts: DataFrame, category: str = "category") -> list[str]:
    """Category columns of a long table, for use as fixed pivot values."""
    # they become columns, so every one of them is wanted on the driver
    found = [r[0] for r in counts.select(category).distinct().collect()]
    return reject_case_twins(sorted(v for v in found if v is not None))


def reject_case_twins(names: Sequence[str]) -> list[str]:
    folded: dict[str, str] = {}
    for name in names:
        twin = folded.setdefault(name.lower(), name)
        if twin != name:
            raise ValueError(f"category columns differ only by case: {twin}, {name}")
    return list(names)


def category_pivot(
    counts: DataFrame, keys: Sequence[str], values: Sequence[str], total: str = "storefront_filing_count"
) -> DataFrame:
    """Wide form with the total: one further shuffle of the already counted rows, zeros filled in."""
    reject_case_twins(values)
    cells = [F.coalesce(F.sum(F.when(F.col("category") == v, F.col("n"))), F.lit(0)).alias(v) for v in values]
    return counts.groupBy(*keys).agg(F.sum("n").alias(total), *cells)


def pivot_first(
    df: DataFrame, key: str, metric: str, value: str, metrics: Mapping[str, str], order: str, suffix: str
) -> DataFrame:
    """First present value per key for each listed metric; other metrics are ignored."""
    cells = []
    for label, name in metrics.items():
        hit = (F.col(metric) == label) & F.col(value).isNotNull()
        first = F.min_by(F.when(hit, F.col(value)), F.when(hit, F.col(order)))
        cells.append(first.alias(f"{name}{suffix}"))
    return df.filter(F.col(metric).isin(*metrics)).groupBy(key).agg(*cells)


def category_profile(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Diversity and entropy from the long form in one aggregate: -Σ p ln p = ln N - Σ n ln n / N."""
    n = F.when(F.col("n") > 0, F.col("n").cast("double"))
    out = counts.groupBy(*keys).agg(
        F.count_if(F.col("n") > 0).alias("category_diversity"),
        F.sum(n).alias("_total"),
        F.sum(n * F.ln(n)).alias("_nlogn"),
    )
    entropy = F.ln("_total") - F.col("_nlogn") / F.col("_total")
    return out.withColumn("category_entropy", F.greatest(F.coalesce(entropy, F.lit(0.0)), F.lit(0.0))).drop(
        "_total", "_nlogn"
    )


def _over(columns: Sequence[str], template: str) -> str:
    """SQL text of ``template`` summed over the columns; one parsed text is far cheaper to build
    than a column object per operation when there are many categories."""
    return " + ".join(template.format(c=f"coalesce(cast(`{c}` as double), 0D)") for c in columns)


def wide_diversity(columns: Sequence[str]) -> Column:
    return F.expr(_over(columns, "int({c} > 0)")) if columns else F.lit(0)


def wide_entropy(columns: Sequence[str], normalised: bool = False) -> Column:
    """Natural-log entropy over category columns of one row, 0 without counts; ``normalised``
    divides by the logarithm of the number of categories."""
    if not columns:
        return F.lit(0.0)
    total = F.expr(_over(columns, "{c}"))
    nlogn = F.expr(_over(columns, "if({c} > 0, {c} * ln({c}), 0D)"))
    out = F.when(total > 0, F.greatest(F.ln(total) - nlogn / total, F.lit(0.0))).otherwise(F.lit(0.0))
    return S.safe_divide(out, F.ln(F.lit(float(len(columns))))) if normalised else out


def share_name(count_column: str) -> str:
    return count_column.removesuffix(presets.COUNT_SUFFIX) + presets.SHARE_SUFFIX


def category_shares(df: DataFrame, columns: Sequence[str], total: str = "storefront_filing_count") -> DataFrame:
    """Share of each category in the table's own total, all in one projection."""
    share = "coalesce(try_divide(cast(`{c}` as double), `{total}`), 0D)"
    shares = {share_name(c): F.expr(share.format(c=c, total=total)) for c in columns}
    return df.withColumns(shares) if shares else df


def exact_quantile(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], p: float | Sequence[float] = 0.5, held: int = HELD_VALUES
) -> DataFrame:
    """Exact interpolated quantiles of each column per group (all rows if ``by`` is empty).

    One probability gives a column under its own name, several give arrays. A sketch, whose rank error is bounded, brackets every
    wanted rank; brackets that may hold more than ``held`` values are narrowed by sketches inside them. Then what lies below
    a bracket collapses to one count and the few values inside are counted by value, so a group is never held whole. A group of
    up to ``held`` rows is a bracket of its own.
    """
    one = not isinstance(p, Sequence)
    ps = [float(x) for x in ([p] if one else p)]
    numbers = [f"nanvl(cast(`{c}` as double), NULL) AS `{c}`" for c in columns]
    values = df.selectExpr(*[f"`{c}`" for c in by], *numbers)
    long = stage_table(values.unpivot(list(by), list(columns), "_column", "_v").filter("_v is not null"), "quantiles")
    cell = [*by, "_column"]
    around = [F.lit(x) for q in ps for x in (max(q - MARGIN, 0.0), min(q + MARGIN, 1.0))]
    found = long.groupBy(*cell).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*around), 10_000).alias("_b"),
    )
    few = F.col("_n") <= held
    wanted = [
        F.struct(
            F.lit(i).alias("_i"), F.lit(q).alias("_p"), F.when(few, F.col("_min")).otherwise(F.col("_b")[2 * i]).alias("_lo"),
            F.when(few, F.col("_max")).otherwise(F.col("_b")[2 * i + 1]).alias("_hi"),
        )
        for i, q in enumerate(ps)
    ]
    brackets = stage_table(found.select(*cell, "_n", F.inline(F.array(*wanted))), "brackets")
    place = (F.col("_n") - 1) * F.col("_p")
    first, last = F.floor(place), F.ceil(place)
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    guess = brackets.filter("_lo < _hi").agg(F.max(F.when(~few, F.col("_n") * (2 * MARGIN)))).first()[0]
    while (guess or 0) > held:
        cuts = F.percentile_approx(F.when(inside, F.col("_v")), F.array(*[F.lit(i / 64) for i in range(65)]), 2_000)
        found = join_groups(long, brackets, cell).groupBy(*cell, "_i", "_n", "_p", "_lo", "_hi").agg(
            F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count_if(inside).alias("_inside"), cuts.alias("_cuts")
        )
        # one whole cut of room on either side of the wanted ranks, far more than the sketch can be off
        share = lambda rank: (rank - F.col("_below")) / F.col("_inside") * 64
        low = F.element_at("_cuts", F.greatest(F.lit(1), F.floor(share(first))).cast("int"))
        high = F.element_at("_cuts", F.least(F.lit(65), F.ceil(share(last)) + 2).cast("int"))
        many = F.col("_inside") > held
        # a bracket that does not move is held by equal values at both ends, which count as one each
        moved = many & ((low > F.col("_lo")) | (high < F.col("_hi")))
        brackets = stage_table(
            found.select(
                *cell, "_n", "_i", "_p", F.when(many, low).otherwise(F.col("_lo")).alias("_lo"),
                F.when(many, high).otherwise(F.col("_hi")).alias("_hi"), F.when(moved, F.col("_inside") / 16).alias("_left"),
            ),
            "brackets",
        )
        guess = brackets.filter("_lo < _hi").agg(F.max("_left")).first()[0]
        brackets = brackets.drop("_left")
    near = join_groups(long, brackets, cell).filter("_v <= _hi")
    counted = near.groupBy(*cell, "_i", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(
        F.first("_n").alias("_n"), F.first("_p").alias("_p"), F.count("*").alias("_k")
    )
    through = W.partitionBy(*cell, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    counted = counted.withColumn("_end", F.sum("_k").over(through))
    holds = lambda rank: (F.col("_end") - F.col("_k") <= rank) & (rank < F.col("_end"))
    picked = counted.groupBy(*cell, "_i").agg(
        F.max(F.when(holds(first), F.col("_v"))).alias("_low"), F.max(F.when(holds(last), F.col("_v"))).alias("_high"),
        F.max(place - first).alias("_part"),
    )
    quantile = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    pick = lambda c, i: F.max(F.when((F.col("_column") == c) & (F.col("_i") == i), quantile))
    return picked.groupBy(*by).agg(*[(pick(c, 0) if one else F.array(*[pick(c, i) for i in range(len(ps))])).alias(c) for c in columns])


def impute_hierarchical(
    df: DataFrame,
    columns: Sequence[str],
    group: str,
    zero_columns: Sequence[str] = (),
) -> DataFrame:
    """NULL → median of the group → median of the column so filled → 0 for ``zero_columns``."""
    medians = exact_quantile(df.filter(F.col(group).isNotNull()), [group], columns)
    medians = medians.select(group, *[F.col(c).alias(f"_m_{c}") for c in columns])
    joined = df.join(medians, group, "left")
    filled = joined.selectExpr(
        *[
            f"coalesce(nanvl(cast(`{c}` as double), NULL), `_m_{c}`) AS `{c}`" if c in columns else f"`{c}`"
            for c in df.columns
        ]
    )
    filled = stage_table(filled, "group-filled")
    overall = exact_quantile(filled, [], columns).select(F.struct(*columns))
    # The one-row subquery is a column first, so that it is planned once and not once per use.
    filled = filled.withColumn("_all", overall.scalar())

    def fill(c: str) -> str:
        zero = ", 0D" if c in zero_columns else ""
        return f"coalesce(`{c}`, _all.`{c}`{zero}) AS `{c}`"

    return filled.selectExpr(*[fill(c) if c in columns else f"`{c}`" for c in df.columns])


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, [c for c in columns if c in df.columns])


def _per_column(df: DataFrame, cells: Sequence[Column]) -> DataFrame:
    """One aggregate pass turned into one row per column."""
    return df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def feature_ranges(df: DataFrame, columns: Sequence[str] = presets.RANGE_COLUMNS + presets.INDEX_RANGE_COLUMNS) -> DataFrame:
    """Minimum and maximum of each existing column that has values."""
    cells = []
    for name in columns:
        if name in df.columns:
            c = S.missing_to_null(F.col(name).cast("double"))
            cells.append(F.struct(F.lit(name).alias("feature"), F.min(c).alias("min"), F.max(c).alias("max")))
    return _per_column(df, cells).filter(F.col("min").isNotNull())


def presence_flags(df: DataFrame, columns: Sequence[str] = presets.INDEX_RANGE_COLUMNS) -> DataFrame:
    """Does the table have any value in each of these optional columns?"""
    return df.agg(
        *[(F.count(c) > 0).alias(f"has_{c}") if c in df.columns else F.lit(False).alias(f"has_{c}") for c in columns]
    )


def distinct_groups(df: DataFrame, group: str) -> DataFrame:
    return df.select(group).filter(F.col(group).isNotNull()).distinct().orderBy(group)


def null_audit(df: DataFrame, top: int | None = None) -> DataFrame:
    """Columns with missing values, most first."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"`{c}`").isNull()).alias("n_null")) for c in df.columns
    ]
    out = _per_column(df, cells).filter("n_null > 0").orderBy(F.desc("n_null"), "column")
    return out if top is None else out.limit(top)


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles of one column."""
    out = df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    found = exact_quantile(df, [], [column], (0.25, 0.5, 0.75)).select(column).scalar()
    out = out.withColumn("_q", found)
    quartiles = [F.col("_q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    return out.select("count", "mean", "std", "min", *quartiles, "max")


def group_concentration(df: DataFrame, cluster: str, group: str, n: int = 3) -> DataFrame:
    """Most frequent groups of each cluster."""
    counts = df.groupBy(cluster, group).agg(F.count("*").alias("members"))
    return top_n_per_group(counts, [cluster], [F.desc("members"), group], n)


def empirical_percentiles(df: DataFrame, columns: Sequence[str], values: DataFrame) -> DataFrame:
    """``round(100 · share of rows at or below value)`` for each (feature, value) asked for.

    ``values`` has the columns feature and value; non-finite values get NULL. Equal values count together first; counts and
    questions are then sorted together once, and the running count up to a question is its answer.
    """
    finite = ~F.isnan("value") & (F.abs("value") != F.lit(float("inf")))
    wanted = values.select("feature", F.when(finite, F.col("value").cast("double")).alias("value")).distinct()
    wanted = stage_table(wanted, "asked")
    asked = wanted.filter("value is not null")
    data = df.select(*[S.missing_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    data = data.unpivot([], list(columns), "feature", "_x").filter("_x is not null")
    counts = data.groupBy("feature", "_x").agg(F.count("*").alias("_n"))
    both = counts.withColumn("_ask", F.lit(0)).unionByName(
        asked.select("feature", F.col("value").alias("_x"), F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_ask"))
    )
    placed = running_total(both, ["feature"], [F.col("_x"), F.col("_ask")], "_n", "_through")
    placed = stage_table(placed, "placed")
    total = placed.groupBy("feature").agg(F.max("_through").alias("_total"))
    # the mean of the comparisons times 100, in this order of operations
    share = F.lit(100) * (F.col("_through") / F.col("_total"))
    found = placed.filter("_ask = 1").join(total, "feature").select(
        "feature", F.col("_x").alias("value"), S.half_even(share).cast("int").alias("percentile")
    )
    return join_groups(wanted, found, ["feature", "value"], "left").select("feature", "value", "percentile")


def empirical_percentile(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Percentiles of one column for the distinct values of ``values[value]``."""
    asked = values.select(F.lit(column).alias("feature"), F.col(value).alias("value"))
    return empirical_percentiles(df, [column], asked).select(F.col("value").alias(value), "percentile")
