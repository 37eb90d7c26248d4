"""Blended rankings for one query or many, and their comparison between vintages."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from arealens import presets
from arealens.functions import scalars as S
from arealens.functions.predicates import HardFilter, filter_counts, hard_filter
from arealens.operators.joins import attach_lookup, reject_collisions
from arealens.operators.ordering import join_groups, number_within, order_by_score, rank_average, rank_delta, rank_desc
from arealens.operators.vectors import cosine_similarity, similarity_matrix
from arealens.session import stage_table

# Query vectors shipped to the tasks at a time; more queries are scored slice by slice.
QUERY_VALUES = 4_000_000
# Digits in which row numbers are compared, and rows of counts that a task looks at together.
KENDALL_BLOCK = 256
POOL_ROWS = 200_000


def minmax(x: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; a constant column becomes 0."""
    return (x - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def _bounds(similarity: str, competition: str) -> list[Column]:
    return [
        F.min(similarity).alias("s_low"),
        F.max(similarity).alias("s_high"),
        F.min(-F.col(competition)).alias("c_low"),
        F.max(-F.col(competition)).alias("c_high"),
        F.count("*").alias("n"),
    ]


def minmax_blend(
    df: DataFrame,
    similarity: str,
    competition: str,
    alpha: float = presets.DEFAULT_ALPHA,
    by: Sequence[str] = (),
    name: str = "blended_score",
) -> DataFrame:
    """``alpha`` · scaled similarity + (1 - ``alpha``) · scaled negative competition, scaled over the
    rows of each group; a single row scores 0.5 on both axes."""

    def blend(get) -> Column:
        s = minmax(F.col(similarity), get("s_low"), get("s_high"))
        c = minmax(-F.col(competition), get("c_low"), get("c_high"))
        return F.when(get("n") == 1, F.lit(0.5)).otherwise(F.lit(alpha) * s + F.lit(1.0 - alpha) * c)

    aggs = _bounds(similarity, competition)
    if not by:
        # The one-row subquery is a column first, so that it is planned once and not once per use.
        bounded = df.withColumn("_b", df.agg(F.struct(*aggs)).scalar())
        return bounded.withColumn(name, blend(F.col("_b").getField)).drop("_b")
    bounds = df.groupBy(*by).agg(F.struct(*aggs).alias("_b"))
    return join_groups(df, bounds, by).withColumn(name, blend(F.col("_b").getField)).drop("_b")


def competition_signal(
    df: DataFrame,
    source: str | None = presets.OVERALL_COMPETITION,
    overall: str = "competitive_score",
    flow: str = "avg_pedestrian",
) -> Column:
    """The stored score, or the competition within one category count column."""
    if source in (None, presets.OVERALL_COMPETITION):
        if overall not in df.columns:
            raise ValueError(f"column {overall} is missing")
        return F.col(overall).cast("double")
    if not (source.startswith(presets.CATEGORY_PREFIX) and source.endswith(presets.COUNT_SUFFIX)):
        raise ValueError(f"invalid competition source {source!r}")
    if source not in df.columns:
        raise ValueError(f"column {source} is missing")
    return S.competition_score(source, flow)


def _entity_signals(df: DataFrame, key: str, code: str | None, group: str | None, source: str | None) -> DataFrame:
    meta = [c for c in (code, group) if c and c != key]
    return df.select(key, *meta, competition_signal(df, source).alias("specific_competitive_score"))


def rank_entities(
    df: DataFrame,
    vectors: DataFrame,
    query: Sequence[float],
    key: str = "neighborhood",
    alpha: float = presets.DEFAULT_ALPHA,
    spec: HardFilter | None = None,
    source: str | None = presets.OVERALL_COMPETITION,
    code: str | None = "cd",
    group: str | None = "borough",
    vector: str = "embedding",
    assignments: DataFrame | None = None,
    briefs: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Hard filter, similarity, competition, blend, rank, map key and cluster lookup.

    Vectors become one number before the join. The narrow scored table is written once, because the
    scaling bounds, the order and the result all read it. ``limit`` keeps only the most similar rows
    before scaling, as a nearest-vector search does.
    """
    kept = hard_filter(df, spec) if spec else df
    similar = vectors.filter(F.col(vector).isNotNull()).select(
        key, cosine_similarity(vector, query).alias("semantic_similarity")
    )
    scored = _entity_signals(kept, key, code, group, source).join(similar, key)
    if limit is not None:
        scored = order_by_score(scored, "semantic_similarity", key).limit(limit)
    scored = stage_table(scored, "scored")
    blended = minmax_blend(scored, "semantic_similarity", "specific_competitive_score", alpha)
    ranked = rank_desc(blended, "blended_score", [key])
    if code and group:
        ranked = ranked.withColumn("map_key", S.map_key(F.col(code).cast("string"), F.col(group).cast("string")))
    if assignments is not None:
        ranked = attach_lookup(ranked, key, assignments, briefs)
    return ranked


def ranking_counts(df: DataFrame, vectors: DataFrame, key: str = "neighborhood", spec: HardFilter | None = None, vector: str = "embedding") -> DataFrame:
    """One row beside a ranking: entities with a vector, and those of them that pass the filter."""
    held = vectors.filter(F.col(vector).isNotNull()).select(key).distinct()
    return filter_counts(df.join(held, key, "left_semi"), spec or HardFilter())


def _scores_per_query(vectors: DataFrame, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, query, similarity) for every entity and query, without joining the two tables.

    A bounded slice of query vectors travels with the scoring function; the number of slices grows
    with the number of queries.
    """
    size = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    slices = max(1, math.ceil(size[0] * (size[1] or 1) / QUERY_VALUES))
    parts = []
    for i in range(slices):
        part = queries.filter(F.pmod(F.xxhash64("query"), F.lit(slices)) == i) if slices > 1 else queries
        rows = sorted((r["query"], list(r["embedding"])) for r in part.select("query", "embedding").collect())
        if not rows:
            continue
        names = F.array(*[F.lit(r[0]) for r in rows])
        sims = similarity_matrix(vector, np.asarray([r[1] for r in rows], dtype=np.float64))
        pairs = F.arrays_zip(names.alias("query"), F.col("_sims").alias("sim"))
        scored = vectors.filter(F.col(vector).isNotNull()).select(key, sims.alias("_sims"))
        scored = scored.select(key, F.explode(pairs).alias("_p"))
        parts.append(scored.select(key, "_p.query", F.col("_p.sim").alias("semantic_similarity")))
    if not parts:
        raise ValueError("no queries to rank for")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rank_many(
    df: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    key: Sequence[str],
    alpha: float = presets.DEFAULT_ALPHA,
    source: str | None = presets.OVERALL_COMPETITION,
    vector: str = "embedding",
    entity: str | None = None,
) -> DataFrame:
    """Ranks all entities for each row (query, embedding) of ``queries``; ties share their mean rank."""
    entity = entity or key[0]
    signals = df.select(*key, competition_signal(df, source).alias("specific_competitive_score"))
    scored = _scores_per_query(vectors, queries, entity, vector).join(signals, entity)
    scored = stage_table(scored, "scored-many")
    blended = minmax_blend(scored, "semantic_similarity", "specific_competitive_score", alpha, ["query"])
    ranked = rank_average(blended, "blended_score", ["query"])
    return ranked.select("query", *key, "semantic_similarity", "blended_score", "rank")


def discordant_within(groups: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """Per row, summed over its group later: pairs with rows of a larger x and a smaller y, weighted by the counts ``n`` of both.

    Rows stand by group and x. Two y differ first in one bit: level by level, rows with a 1 there meet the zeros behind them
    that share the bits above.
    """
    out = np.zeros(len(groups), np.int64)
    start = np.flatnonzero(np.concatenate([[True], (groups[1:] != groups[:-1]) | (x[1:] != x[:-1])])) if len(groups) else np.zeros(0, np.int64)
    place = np.cumsum(np.bincount(start, minlength=len(groups))) - 1  # number of the row's (group, x)
    for bit in range(bits):
        above = groups << (bits - bit - 1) | y >> (bit + 1)
        order = np.lexsort((place, above))
        zero = np.where(y[order] >> bit & 1, 0, n[order])
        behind = np.cumsum(zero[::-1])[::-1] - zero
        key, at = above[order], place[order]
        last = np.append((key[1:] != key[:-1]) | (at[1:] != at[:-1]), True)
        # zeros behind the last row of the same place, less those of the keys behind
        ends = np.flatnonzero(last)
        end = ends[np.searchsorted(ends, np.arange(len(order)))]
        final = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        of_key = final[np.searchsorted(final, np.arange(len(order)))]
        out[order] += np.where(y[order] >> bit & 1, n[order] * (behind[end] - behind[of_key]), 0)
    return out


def discordant_pairs(df: DataFrame, by: Sequence[str], x: str, y: str, largest: int, block: int = KENDALL_BLOCK) -> DataFrame:
    """Pairs ordered differently by two row numbers (1 .. ``largest`` at most), per group, without forming pairs.

    Both numbers are written in digits below ``block`` (rounded up to a power of two). Two rows differ first in some digit a of x and some digit b of y; for each (a, b)
    the rows that share the digits above are one group, and only their counts by the two digits matter. Counting combines before its shuffle, and
    no group has more than ``block`` ** 2 counts, however many rows it stands for.
    """
    keys, bits = list(by), max(1, (block - 1).bit_length())
    digits = max(1, math.ceil(int(largest).bit_length() / bits))
    mask = (1 << bits) - 1
    place = lambda c, d: F.shiftright(F.col(c) - 1, d * bits)
    pairs = [
        F.struct(
            F.lit(a * digits + b).alias("_turn"), place(x, a + 1).alias("_ax"), place(y, b + 1).alias("_ay"),
            place(x, a).bitwiseAND(F.lit(mask)).cast("int").alias("_dx"), place(y, b).bitwiseAND(F.lit(mask)).cast("int").alias("_dy"),
        )
        for a in range(digits) for b in range(digits)
    ]
    group = [*keys, "_turn", "_ax", "_ay"]
    counts = df.select(*keys, F.inline(F.array(*pairs))).groupBy(*group, "_dx", "_dy").agg(F.count(F.lit(1)).alias("_n"))
    dealt = counts.repartition(*group).sortWithinPartitions(*group, "_dx")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema], "d long"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, held = [], 0

        def numbered(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for c in group:
                code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            return np.cumsum(new) - 1

        def counted(table: pa.Table, groups: np.ndarray) -> pa.RecordBatch:
            dx, dy, n = (table.column(c).to_numpy().astype(np.int64) for c in ("_dx", "_dy", "_n"))
            found = discordant_within(groups, dx, dy, n, bits)
            first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            sums = pa.array(np.add.reduceat(found, first))
            own = [table.column(c).combine_chunks().take(pa.array(first)) for c in keys]
            return pa.RecordBatch.from_arrays([*own, sums], [*keys, "d"])

        def settled(final: bool) -> Iterator[pa.RecordBatch]:
            """Whole groups of the pool; the last one may go on in the next batch."""
            nonlocal pool, held
            if not pool:
                return
            table = pa.Table.from_batches(pool)
            groups = numbered(table)
            whole = table.num_rows if final else int(np.searchsorted(groups, groups[-1]))
            if whole:
                yield counted(table.slice(0, whole), groups[:whole])
            pool = table.slice(whole).combine_chunks().to_batches()
            held = table.num_rows - whole

        for batch in batches:
            if batch.num_rows:
                pool.append(batch)
                held += batch.num_rows
            if held >= POOL_ROWS:
                yield from settled(False)
        yield from settled(True)

    return dealt.mapInArrow(scan, schema).groupBy(*keys).agg(F.sum("d").alias("discordant"))


def _tied_pairs(df: DataFrame, by: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    n = F.col("_n").cast("double")
    groups = df.groupBy(*by, *columns).agg(F.count("*").alias("_n"))
    return groups.groupBy(*by).agg(F.sum(n * (n - 1) / 2).alias(name))


def kendall_tau(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    key: Sequence[str],
    block: int = KENDALL_BLOCK,
) -> DataFrame:
    """Tau-b per group: (concordant - discordant) / sqrt of the untied pairs of both sides."""
    keys = list(by)
    numbered = number_within(df.select(*keys, *key, x, y), keys, [x, y, *key], "_px")
    numbered = stage_table(number_within(numbered, keys, [y, x, *key], "_py"), "both-orders")
    largest = numbered.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    out = discordant_pairs(numbered, keys, "_px", "_py", largest, block)
    n = F.col("n").cast("double")
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("_all", n * (n - 1) / 2)
    for columns, name in (((x,), "_tx"), ((y,), "_ty"), ((x, y), "_txy")):
        sizes = sizes.join(_tied_pairs(numbered, keys, columns, name), keys)
    balance = F.col("_all") - F.col("_tx") - F.col("_ty") + F.col("_txy") - 2.0 * F.col("discordant")
    spread = F.sqrt(F.col("_all") - F.col("_tx")) * F.sqrt(F.col("_all") - F.col("_ty"))
    return out.join(sizes, keys).select(*keys, F.try_divide(balance, spread).alias("kendall_tau"))


def rank_stability(
    a: DataFrame,
    b: DataFrame,
    key: Sequence[str],
    rank: str = "rank",
    by: Sequence[str] = ("query",),
    block: int = KENDALL_BLOCK,
) -> DataFrame:
    """Per query: entities in both rankings, Spearman and Kendall correlation of their ranks."""
    by, key = list(by), list(key)
    left = a.select(*by, *key, F.col(rank).alias("_x"))
    right = b.select(*by, *key, F.col(rank).alias("_y"))
    both = stage_table(left.join(right, [*by, *key]), "both-rankings")
    ranked = rank_average(both, "_x", by, "_rx", descending=False)
    ranked = rank_average(ranked, "_y", by, "_ry", descending=False)
    # A constant side has no correlation; corr() would fail on its zero deviation.
    spread = F.stddev_pop("_rx") * F.stddev_pop("_ry")
    spearman = ranked.groupBy(*by).agg(
        F.count("*").alias("n_overlap"), F.try_divide(F.covar_pop("_rx", "_ry"), spread).alias("spearman_r")
    )
    return spearman.join(kendall_tau(both, by, "_x", "_y", key, block), by)


def rank_compare(
    a: DataFrame, b: DataFrame, key: Sequence[str], by: Sequence[str] = ("query",), labels: tuple[str, str] = ("before", "after")
) -> DataFrame:
    """Both rankings side by side with the rank change, largest change first."""
    sides = []
    for df, label in ((a, labels[0]), (b, labels[1])):
        values = [c for c in df.columns if c not in (*by, *key)]
        sides.append(df.select(*by, *key, *[F.col(c).alias(f"{c}_{label}") for c in values]))
    reject_collisions(sides[0], sides[1], [*by, *key])
    joined = sides[0].join(sides[1], [*by, *key])
    return rank_delta(joined, f"rank_{labels[0]}", f"rank_{labels[1]}")


def rank_compare_report(
    before: tuple[DataFrame, DataFrame],
    after: tuple[DataFrame, DataFrame],
    queries: DataFrame,
    key: Sequence[str],
    alpha: float = presets.DEFAULT_ALPHA,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(correlations per query, best first; rank changes) of two (features, vectors) vintages."""
    rankings = [stage_table(rank_many(f, v, queries, key, alpha, **options), "ranking") for f, v in (before, after)]
    first = rankings[0].select("query", *key).join(rankings[1].select("query", *key), ["query", *key], "left_semi")
    if first.isEmpty():
        raise ValueError("the two vintages share no entities")
    correlations = rank_stability(*rankings, key)
    return order_by_score(correlations, "spearman_r", "query"), rank_compare(*rankings, key)


def common_categories(a: DataFrame, b: DataFrame, category: str = "category") -> DataFrame:
    """Query texts from the category columns two vintages share, in order."""
    both = a.select(category).intersect(b.select(category))
    return both.select(F.lower(S.strip(S.category_words(category))).alias("query")).orderBy("query")


def dedupe_queries(df: DataFrame, text: str, position: str) -> DataFrame:
    """Trimmed lower-case queries, the first of equal ones kept, blanks dropped, in first-seen order."""
    clean = F.lower(S.strip(text)).alias("query")
    firsts = df.select(clean, F.col(position).alias("_pos")).filter("query <> ''").groupBy("query")
    return firsts.agg(F.min("_pos").alias(position)).orderBy(position)
