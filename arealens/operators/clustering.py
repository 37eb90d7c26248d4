"""K-means segmentation: scaling, assignment, quality, choice of k, members and stored runs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from arealens import presets
from arealens.functions import scalars as S
from arealens.functions.predicates import columns_like, complete_cases
from arealens.operators.ordering import top_n_per_group
from arealens.operators.vectors import cosine_similarity
from arealens.session import stage_table

STD_FLOOR = 1e-8
SILHOUETTE_BLOCK = 1024
BROADCAST_VALUES = 4_000_000


def feature_set(df: DataFrame, requested: Sequence[str]) -> list[str]:
    """Share columns first, then the requested features; raw count columns are ignored."""
    required = columns_like(df, presets.SHARE_SUFFIX)
    chosen = list(required)
    for name in requested:
        is_count = name.startswith(presets.CATEGORY_PREFIX) and name.endswith(presets.COUNT_SUFFIX)
        if not is_count and name not in chosen:
            chosen.append(name)
    unknown = [c for c in chosen if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown feature columns: {unknown}")
    return chosen


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with the arrays of means and population standard deviations."""
    return df.agg(
        F.array(*[F.avg(f) for f in features]).alias("means"),
        F.array(*[F.stddev_pop(f) for f in features]).alias("stds"),
    )


def zscore(df: DataFrame, features: Sequence[str], out: str = "z") -> DataFrame:
    """Adds the array of standardised features; the statistics are a scalar subquery."""
    stats = feature_stats(df, features).select(F.struct("means", "stds")).scalar()
    means, stds = F.col("_stats")["means"], F.col("_stats")["stds"]
    scaled = [
        (F.col(f) - F.get(means, F.lit(i))) / (F.get(stds, F.lit(i)) + F.lit(STD_FLOOR)) for i, f in enumerate(features)
    ]
    return df.withColumn("_stats", stats).withColumn(out, F.array(*scaled)).drop("_stats")


def _points(batch: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a matrix, and which rows count: NULL lists and lists with NULL are left out as zeros."""
    some = np.asarray(batch.is_valid())
    held = batch.filter(pa.array(some))
    lengths = np.asarray(pc.list_value_length(held))
    if (lengths != width).any():
        raise ValueError(f"vectors have {sorted(set(lengths.tolist()))} numbers, the centroids {width}")
    values = held.flatten()
    own = np.asarray(values.is_null()).reshape(-1, width).any(axis=1)
    matrix = np.zeros((len(batch), width))
    matrix[some] = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    some[some] = ~own
    return matrix, some


def _whole(batch: pa.Array) -> np.ndarray:
    """Rows of a list column without gaps as a matrix."""
    lengths = np.asarray(pc.list_value_length(batch))
    if (lengths != lengths[0]).any():
        raise ValueError(f"vectors have {sorted(set(lengths.tolist()))} numbers")
    return np.asarray(batch.flatten()).reshape(len(batch), lengths[0])


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre and its squared distance, from direct differences, one centre at a time."""
    best, d2 = np.zeros(len(points), dtype=np.int32), np.full(len(points), np.inf)
    for i, centre in enumerate(centres):
        distance = ((points - centre) ** 2).sum(axis=1)
        closer = distance < d2
        best[closer], d2[closer] = i, distance[closer]
    return best, d2


def nearest_centroid(vector: Column | str, centroids: Sequence[Sequence[float]]) -> Column:
    """Struct (cluster, d2): the nearest of k centroids, the lowest index on ties; both NULL without a whole vector.

    k × d numbers travel with the function. Vectors of another width than the centroids are an error.
    """
    centres = np.asarray(centroids, dtype=np.float64)
    points_of, nearest = _points, _nearest

    @F.arrow_udf("struct<cluster:int,d2:double>")
    def assign(batch: pa.Array) -> pa.Array:
        points, some = points_of(batch, centres.shape[1])
        best, d2 = nearest(points, centres)
        return pa.StructArray.from_arrays([pa.array(best, mask=~some), pa.array(d2, mask=~some)], names=["cluster", "d2"])

    return assign(F.col(vector) if isinstance(vector, str) else vector)


def assign_nearest(df: DataFrame, vector: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """Adds the cluster of each row and its squared distance to the centroid."""
    nearest = df.withColumn("_nearest", nearest_centroid(vector, centroids))
    return nearest.withColumns({"cluster": F.col("_nearest.cluster"), "d2": F.col("_nearest.d2")}).drop("_nearest")


def update_centroids(df: DataFrame, vector: str, cluster: str = "cluster") -> DataFrame:
    """Mean vector and size per cluster, combined before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return df.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(vector_to_array(mean).alias("centroid"), F.count("*").alias("size"))


def _reseed(df: DataFrame, vector: str, empty: int, seed: int) -> list[list[float]]:
    """Data rows that replace empty clusters, picked by hash order."""
    order = F.xxhash64(F.col(vector), F.lit(seed))
    return [list(r[0]) for r in df.select(vector).orderBy(order).limit(empty).collect()]


def lloyd(
    df: DataFrame,
    vector: str,
    start: Sequence[Sequence[float]],
    max_iter: int = 100,
    tol: float = 1e-4,
    seed: int = 42,
) -> tuple[DataFrame, list[list[float]], int]:
    """Lloyd iterations from given centroids until they move less than ``tol`` together.

    Only the k centroids cross the driver. Returns rows labelled by the last assignment, the final
    centroids and the number of iterations.
    """
    df = stage_table(df, "points")
    centres, assigned, steps = [list(map(float, c)) for c in start], df, 0
    for steps in range(1, max_iter + 1):
        assigned = assign_nearest(df, vector, centres)
        means = {r["cluster"]: list(r["centroid"]) for r in update_centroids(assigned, vector).collect()}
        gaps = [i for i in range(len(centres)) if i not in means]
        if gaps:
            means.update(zip(gaps, _reseed(df, vector, len(gaps), seed + steps)))
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        shift = math.sqrt(sum((a - b) ** 2 for old, new in zip(centres, moved) for a, b in zip(old, new)))
        centres = moved
        if shift < tol:
            break
    return assigned, centres, steps


def kmeans(
    df: DataFrame, vector: str, k: int, seed: int = 42, max_iter: int = 100, tol: float = 1e-4
) -> tuple[list[list[float]], int]:
    """Centroids and iterations of a distributed k-means with parallel k-means++ seeding."""
    features = df.filter(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector)).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, initMode="k-means||").fit(features)
    return [list(map(float, c)) for c in model.clusterCenters()], model.summary.numIter


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("d2").alias("inertia"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between two blocks of rows: from products, and from direct differences where products cancel."""
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    norms = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)
    squared = norms - 2 * (a @ b.T)
    close = squared <= 1e-4 * norms
    for i in np.flatnonzero(close.any(axis=1)):
        squared[i, close[i]] = ((b[close[i]] - a[i]) ** 2).sum(axis=1)
    return np.sqrt(squared)


def silhouette_exact(
    df: DataFrame,
    key: str,
    vector: str,
    labels: Sequence[str],
    singleton: str = "one",
    block_rows: int = SILHOUETTE_BLOCK,
    broadcast_values: int = BROADCAST_VALUES,
) -> DataFrame:
    """Mean silhouette (Euclidean) of each label column, all from one pass over the distances.

    The measure needs every distance, so the work is quadratic by definition; see
    :func:`silhouette_squared` for the linear-time figure. Rows are packed into blocks of about
    ``block_rows``; a task holds two blocks at a time, reads them from their one copy and passes on per-cluster
    sums, one row per row and partition of the other side, so what is written grows with the rows. ``key`` must be unique. ``singleton`` says what a cluster of one row scores: "one" (if any other cluster is
    apart from it) or "zero".
    """
    if singleton not in ("one", "zero"):
        raise ValueError(f"singleton must be 'one' or 'zero', got {singleton!r}")
    rows = stage_table(df.select(F.col(key).alias("k"), F.col(vector).alias("v"), *labels), "silhouette")
    n, width, *tops = rows.agg(F.count("*"), F.max(F.size("v")), *[F.max(c) for c in labels]).first()
    if not n:
        return df.sparkSession.createDataFrame([], "labels string, silhouette double")
    ks = [int(t) + 1 for t in tops]
    blocks = math.ceil(n / block_rows)
    long = rows.select(*labels).unpivot([], list(labels), "name", "cluster")
    found = {(r["name"], r["cluster"]): r["count"] for r in long.groupBy("name", "cluster").count().collect()}
    sizes = {name: [found.get((name, i), 0) for i in range(k)] for name, k in zip(labels, ks)}
    block = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    item = F.struct("k", "v", F.array(*[F.col(c).cast("int") for c in labels]).alias("c"))
    packed = rows.groupBy(block.alias("b")).agg(F.collect_list(item).alias("items"))

    def fields(prefix: str) -> list[Column]:
        return [
            F.flatten(F.transform("items", lambda i: i.getField("v"))).alias(f"{prefix}v"),
            F.flatten(F.transform("items", lambda i: i.getField("c"))).alias(f"{prefix}c"),
        ]

    packed = stage_table(packed, "silhouette-blocks")
    left = packed.select(F.col("b").alias("own"), F.transform("items", lambda i: i.getField("k")).alias("k"), *fields("l"))
    right = packed.select(*fields("r"))
    # Block pairs are few rows of heavy work, so their number of tasks is set by count, not by bytes. Every pair of partitions
    # is a task of its own that reads both sides where they lie; nothing is copied per pair.
    values, tasks = n * (width or 1), 4 * df.sparkSession.sparkContext.defaultParallelism
    if values <= broadcast_values:
        left, right = left.repartition(min(blocks, tasks)), F.broadcast(right)
    else:
        parts = math.ceil(values / BROADCAST_VALUES)
        right = right.repartition(min(blocks, parts)).hint("shuffle_replicate_nl")
        left = left.repartition(min(blocks, max(parts, math.ceil(tasks / parts))))
    n_labels, starts = len(ks), np.concatenate([[0], np.cumsum(ks)]).astype(int)
    tags, slots = [f"c{j}" for j in range(n_labels)], [f"s{i}" for i in range(int(starts[-1]))]
    distances = _distances

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None

        def part() -> pd.DataFrame:
            return pd.concat([pd.DataFrame({"k": keys}), pd.DataFrame(mine, columns=tags), pd.DataFrame(totals, columns=slots)], axis=1)

        for batch in batches:
            for r in batch.itertuples(index=False):
                # The pairs of one block follow each other; a block met again only gives one more partial sum.
                if r.own != own:
                    if own is not None:
                        yield part()
                    own, keys, mine = r.own, r.k, np.asarray(r.lc).reshape(-1, n_labels)
                    here = np.asarray(r.lv, dtype=np.float64).reshape(-1, width)
                    totals = np.zeros((len(here), starts[-1]))
                there = np.asarray(r.rv, dtype=np.float64).reshape(-1, width)
                clusters = np.asarray(r.rc).reshape(-1, n_labels)
                member = np.zeros((len(there), starts[-1]))
                for j in range(n_labels):
                    member[np.arange(len(there)), starts[j] + clusters[:, j]] = 1.0
                totals += distances(here, there) @ member
        if own is not None:
            yield part()

    key_type = rows.schema["k"].dataType.simpleString()
    schema = ", ".join([f"k {key_type}", *[f"{c} int" for c in tags], *[f"{x} double" for x in slots]])
    partial = left.crossJoin(right).select("own", "k", "lv", "lc", "rv", "rc").mapInPandas(sums, schema)
    summed = partial.groupBy("k", *tags).agg(*[F.sum(x).alias(x) for x in slots])
    cells = []
    for j, name in enumerate(labels):
        own_cluster = F.col(tags[j])
        own = [F.when(own_cluster == i, F.col(f"s{starts[j] + i}")) for i in range(ks[j])]
        own_size = F.coalesce(*[F.when(own_cluster == i, F.lit(sizes[name][i])) for i in range(ks[j])])
        others = [
            F.when(own_cluster != i, F.col(f"s{starts[j] + i}") / sizes[name][i]) for i in range(ks[j]) if sizes[name][i]
        ]
        a = F.when(own_size > 1, F.coalesce(*own) / (own_size - 1)).otherwise(F.lit(0.0))
        b = F.least(*others) if len(others) > 1 else F.lit(None).cast("double")
        score = F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(F.lit(0.0))
        if singleton == "zero":
            score = F.when(own_size == 1, F.lit(0.0)).otherwise(score)
        # Fewer than two clusters leave b empty and every row scores 0.
        value = F.avg(F.when(b.isNull(), F.lit(0.0)).otherwise(score))
        cells.append(F.struct(F.lit(name).alias("labels"), value.alias("silhouette")))
    return summed.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def silhouette_squared(df: DataFrame, vector: str, cluster: str = "cluster") -> float:
    """Silhouette with squared Euclidean distances: linear time, a different number than the exact one."""
    features = df.select(array_to_vector(F.col(vector)).alias("features"), F.col(cluster).cast("int").alias("prediction"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(features)


def sweep_starts(df: DataFrame, vector: str, max_k: int, seed: int = 42) -> list[list[float]]:
    """``max_k`` spread-out rows by k-means++ over all different vectors, one scan for each; k clusters start from the first k.

    The next start is drawn by squared distance from the last ones: hashes are exponential draws, and the least in proportion to
    its distance wins. The draw depends on the rows and the seed alone, not on partitions or copies. Fewer different rows give
    fewer starts.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    chosen: list[list[float]] = []
    whole_of = _whole
    while len(chosen) < max_k:
        centres = np.asarray(chosen)

        def scan(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = whole_of(batch.column("v"))
                draw = ((batch.column("h").to_numpy() >> 11) % (1 << 53) + 0.5) / (1 << 53)
                # direct differences, so that copies of a start are exactly at 0
                d2 = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0) if len(centres) else np.ones(len(points))
                some = np.flatnonzero(d2 > 0)
                if len(some):
                    race = -np.log(draw[some]) / d2[some]
                    best = int(np.argmin(race))
                    yield pa.RecordBatch.from_arrays([pa.array([float(race[best])]), batch.column("v").take([int(some[best])])], ["race", "v"])

        drawn = rows.select("v", F.xxhash64("v", F.lit(seed), F.lit(len(chosen))).alias("h")).mapInArrow(scan, "race double, v array<double>")
        first = drawn.agg(F.min(F.struct("race", "v")).alias("w")).first()["w"]
        if first is None:
            break
        chosen.append(list(first["v"]))
    return chosen


def _sweep_sums(points: DataFrame, vector: str, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Per k: rows, vector sums and sums of squared norms of every cluster, and the inertia, from one scan for all k."""
    width = next(iter(centres.values())).shape[1]
    points_of, nearest = _points, _nearest

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, some = points_of(batch.column(0), width)
            rows = rows[some]
            norms, out = (rows**2).sum(axis=1), []
            for k, own in centres.items():
                best, d2 = nearest(rows, own)
                for c in np.unique(best).tolist():
                    hit = best == c
                    out.append((k, c, int(hit.sum()), float(norms[hit].sum()), float(d2[hit].sum()), rows[hit].sum(axis=0).tolist()))
            if out:
                types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["k", "c", "n", "q", "d2", "s"])

    partial = points.select(vector).mapInArrow(scan, "k int, c int, n long, q double, d2 double, s array<double>")
    sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]
    found = partial.groupBy("k", "c").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("d2").alias("d2"), *sums).collect()
    out = {k: (np.zeros(len(c)), np.zeros((len(c), width)), np.zeros(len(c)), 0.0) for k, c in centres.items()}
    for r in found:
        n, s, q, inertia_ = out[r["k"]]
        n[r["c"]], q[r["c"]], s[r["c"]] = r["n"], r["q"], [r[f"s{i}"] for i in range(width)]
        out[r["k"]] = (n, s, q, inertia_ + r["d2"])
    return out


def sweep_lloyd(
    points: DataFrame, vector: str, starts: dict[int, Sequence[Sequence[float]]], max_iter: int = 100, tol: float = 1e-4
) -> tuple[dict[int, list[list[float]]], dict[int, int]]:
    """Lloyd iterations for every k together: each round is one scan of the staged ``points`` for all k that still move.

    Only centroids cross the driver. An empty cluster keeps its place. Returns centroids and iterations by k.
    """
    centres = {k: np.asarray(c, dtype=np.float64) for k, c in starts.items()}
    steps, open_ = dict.fromkeys(centres, 0), list(centres)
    for _ in range(max_iter):
        if not open_:
            break
        sums = _sweep_sums(points, vector, {k: centres[k] for k in open_})
        still = []
        for k in open_:
            n, s, _, _ = sums[k]
            moved = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres[k])
            shift = float(np.sqrt(((moved - centres[k]) ** 2).sum()))
            centres[k], steps[k] = moved, steps[k] + 1
            if shift >= tol:
                still.append(k)
        open_ = still
    return {k: c.tolist() for k, c in centres.items()}, steps


def sweep_labels(points: DataFrame, key: str, vector: str, centres: dict[int, list[list[float]]]) -> DataFrame:
    """key, vector and, for every k, ``cluster_k`` and ``d2_k``, from one function call per row batch."""
    arrays = {k: np.asarray(c, dtype=np.float64) for k, c in centres.items()}
    width = next(iter(arrays.values())).shape[1]
    points_of, nearest = _points, _nearest
    fields = [(f"{name}_{k}", t) for k in arrays for name, t in (("cluster", "int"), ("d2", "double"))]

    @F.arrow_udf("struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">")
    def assign(batch: pa.Array) -> pa.Array:
        rows, some = points_of(batch, width)
        columns = [pa.array(x, mask=~some) for own in arrays.values() for x in nearest(rows, own)]
        return pa.StructArray.from_arrays(columns, names=[n for n, _ in fields])

    return points.withColumn("_at", assign(F.col(vector))).select(key, vector, *[F.col("_at")[n].alias(n) for n, _ in fields])


def _sweep_silhouettes(points: DataFrame, vector: str, centres: dict[int, list[list[float]]], sums: dict) -> dict[int, float]:
    """Squared-distance silhouette of every k from the cluster sums and one more scan: linear in the rows."""
    arrays = {k: np.asarray(c, dtype=np.float64) for k, c in centres.items()}
    stats = {k: sums[k][:3] for k in arrays}
    width = next(iter(arrays.values())).shape[1]
    points_of, nearest = _points, _nearest

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, some = points_of(batch.column(0), width)
            rows = rows[some]
            norms, out = (rows**2).sum(axis=1), []
            for k, own in arrays.items():
                best, _ = nearest(rows, own)
                n, s, q = stats[k]
                at = np.arange(len(rows))
                total = norms[:, None] * n + q - 2 * rows @ s.T
                a = total[at, best] / np.maximum(n[best] - 1, 1)
                mean = np.where(n > 0, total / np.maximum(n, 1), np.inf)
                mean[at, best] = np.inf
                b = mean.min(axis=1) if len(n) > 1 else np.full(len(rows), np.inf)
                value = np.where(np.isfinite(b) & (n[best] > 1), (b - a) / np.maximum(np.maximum(a, np.where(np.isfinite(b), b, 0)), 1e-300), 0.0)
                out.append((k, float(value.sum()), len(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["k", "s", "n"])

    found = points.select(vector).mapInArrow(scan, "k long, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("v"))
    return {r["k"]: r["v"] for r in found.collect()}


def k_sweep(
    df: DataFrame,
    key: str,
    vector: str,
    max_k: int = 8,
    seed: int = 42,
    exact_silhouette: bool = False,
    singleton: str = "one",
    max_iter: int = 100,
    tol: float = 1e-4,
    starts: Sequence[Sequence[float]] | None = None,
) -> tuple[DataFrame, DataFrame, dict[int, list[list[float]]]]:
    """k = 2..min(max_k, n-1): (curve table, labelled rows with one column per k, centroids by k).

    Vectors are written once; every round of Lloyd's iterations is one scan for all k, and two more scans give inertia and the
    linear silhouette of every k. k clusters start from the first k of ``starts`` (default: ``sweep_starts``). The exact
    silhouette needs all distances and is quadratic, so it is computed on request only. Rows without a vector get NULL labels.
    """
    points = stage_table(df.select(key, vector), "sweep")
    n = points.filter(F.col(vector).isNotNull()).count()
    starts = sweep_starts(points, vector, min(max_k, max(n - 1, 0)), seed) if starts is None and n else starts or []
    ks = list(range(2, min(max_k, n - 1, len(starts)) + 1))
    if not ks:
        raise ValueError(f"{n} rows are too few to sweep k")
    centres, _ = sweep_lloyd(points, vector, {k: starts[:k] for k in ks}, max_iter, tol)
    sums = _sweep_sums(points, vector, {k: np.asarray(c) for k, c in centres.items()})
    squared = _sweep_silhouettes(points, vector, centres, sums)
    labelled = stage_table(sweep_labels(points, key, vector, centres), "sweep-labels")
    exact = {}
    if exact_silhouette:
        found = silhouette_exact(labelled.filter(F.col(vector).isNotNull()), key, vector, [f"cluster_{k}" for k in ks], singleton)
        exact = {r["labels"]: r["silhouette"] for r in found.collect()}
    rows = [(k, float(sums[k][3]), exact.get(f"cluster_{k}"), float(squared[k])) for k in ks]
    curve = df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, silhouette_squared double")
    return curve, labelled, centres


def select_k(curve: DataFrame, score: str = "silhouette", chosen: int | None = None) -> DataFrame:
    """One row with the chord elbow, the curvature knee, the best silhouette and the chosen k.

    The curve has one row per swept k, so its windows are as small as the sweep.
    """
    tiny = 1e-12
    whole = W.orderBy("k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    along = W.orderBy("k")
    k = F.col("k").cast("double")
    x = (k - F.min(k).over(whole)) / (F.max(k).over(whole) - F.min(k).over(whole) + tiny)
    low, high = F.min("inertia").over(whole), F.max("inertia").over(whole)
    y = (F.col("inertia") - low) / (high - low + tiny)
    line = curve.select("k", score, x.alias("x"), y.alias("y"))
    x0, x1 = F.first("x").over(whole), F.last("x").over(whole)
    y0, y1 = F.first("y").over(whole), F.last("y").over(whole)
    dx, dy = x1 - x0, y1 - y0
    chord = F.abs(dy * F.col("x") - dx * F.col("y") + x1 * y0 - y1 * x0) / (F.sqrt(dx * dx + dy * dy) + tiny)
    bend = F.abs(F.lead("y").over(along) - 2 * F.col("y") + F.lag("y").over(along))
    line = line.select("k", score, chord.alias("_chord"), bend.alias("_bend"))

    def first_best(value: str) -> Column:
        return F.max_by("k", F.when(F.col(value).isNotNull(), F.struct(F.col(value), -F.col("k"))))

    out = line.agg(
        first_best("_chord").alias("elbow_k"),
        F.coalesce(first_best("_bend"), F.min("k")).alias("curvature_k"),
        first_best(score).alias("best_silhouette_k"),
        F.sort_array(F.collect_list("k")).alias("_ks"),
    )
    if chosen is None:
        pick = F.col("elbow_k")
    else:
        pick = F.when(F.array_contains("_ks", F.lit(chosen)), F.lit(chosen)).otherwise(
            F.raise_error(F.lit(f"chosen k {chosen} is not in the sweep")).cast("int")
        )
    return out.withColumn("chosen_k", pick).drop("_ks")


def centroid_table(spark: SparkSession, centroids: Sequence[Sequence[float]], features: Sequence[str]) -> DataFrame:
    """Long form (cluster, position, feature, z) of the k centroids."""
    rows = [
        (c, i, name, float(z)) for c, centre in enumerate(centroids) for i, (name, z) in enumerate(zip(features, centre))
    ]
    return spark.createDataFrame(rows, "cluster int, position int, feature string, z double")


def unscale_centroids(centroids: DataFrame, stats: DataFrame) -> DataFrame:
    """Centroids back in feature units: z · std + mean."""
    std, mean = F.get(F.col("_stats")["stds"], F.col("position")), F.get(F.col("_stats")["means"], F.col("position"))
    scaled = centroids.withColumn("_stats", stats.select(F.struct("means", "stds")).scalar())
    return scaled.withColumn("value", F.col("z") * std + mean).drop("_stats")


def closest_members(assigned: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n members of each cluster nearest to its centroid."""
    near = assigned.select("cluster", key, F.sqrt("d2").alias("distance"))
    return top_n_per_group(near, ["cluster"], ["distance", key], n)


def text_representatives(
    members: DataFrame, vectors: DataFrame, key: str, vector: str = "embedding", text: str = "text", n: int = 3, length: int = 420
) -> DataFrame:
    """The n members of each cluster most similar to its mean text vector, with a text excerpt."""
    joined = members.select(key, "cluster").join(vectors.select(key, vector, text), key).filter(F.col(vector).isNotNull())
    means = update_centroids(joined, vector).select("cluster", F.col("centroid").alias("_mean"))
    scored = joined.join(means, "cluster").select(
        "cluster",
        key,
        cosine_similarity(vector, F.col("_mean")).alias("cosine_to_mean"),
        S.excerpt(text, length).alias("profile_excerpt"),
    )
    return top_n_per_group(scored, ["cluster"], [F.desc("cosine_to_mean"), key], n)


def data_fingerprint(df: DataFrame, columns: Sequence[str]) -> str:
    """Order-free digest of the rows: count and sum of the row hashes."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))).first()
    return f"{row[0]}:{row[1]}"


def run_key(k: int, features: Sequence[str], seed: int, fingerprint: str) -> str:
    """Key of a run: feature order does not matter, data, seed and k do."""
    text = "|".join([str(k), *sorted(features), str(seed), fingerprint])
    return hashlib.md5(text.encode()).hexdigest()


def save_run(assigned: DataFrame, key: str, centroids: Sequence[Sequence[float]], iterations: int, path: str, run: str) -> None:
    """Store labels and centroids of a run below ``path``, replacing an earlier run of the same key."""
    spark = assigned.sparkSession
    centres = spark.createDataFrame(
        [(i, list(map(float, c)), int(iterations)) for i, c in enumerate(centroids)],
        "cluster int, centroid array<double>, iterations int",
    )
    for table, name in ((assigned.select(F.col(key).alias("entity"), "cluster"), "labels"), (centres, "centroids")):
        (
            table.withColumn("run_key", F.lit(run))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_key")
            .parquet(f"{path}/{name}")
        )


def load_run(spark: SparkSession, path: str, run: str) -> tuple[DataFrame, DataFrame] | None:
    """(labels, centroids) of a stored run, or None."""
    try:
        tables = [spark.read.parquet(f"{path}/{name}").filter(F.col("run_key") == run) for name in ("labels", "centroids")]
    except AnalysisException:
        return None
    return None if tables[1].isEmpty() else (tables[0].drop("run_key"), tables[1].drop("run_key"))


def kmeans_stored(
    df: DataFrame, key: str, vector: str, k: int, features: Sequence[str], path: str, seed: int = 42
) -> tuple[DataFrame, DataFrame, int]:
    """(labels, centroids, iterations): a stored run is returned as it is with 0 iterations."""
    spark = df.sparkSession
    run = run_key(k, features, seed, data_fingerprint(df, [key, vector]))
    hit = load_run(spark, path, run)
    iterations = 0
    if hit is None:
        centres, iterations = kmeans(df, vector, k, seed)
        save_run(assign_nearest(df, vector, centres), key, centres, iterations, path, run)
        hit = load_run(spark, path, run)
    return hit[0], hit[1], iterations


def cluster_points(
    df: DataFrame, features: Sequence[str], key: str = "neighborhood", code: str = "cd", group: str = "borough"
) -> DataFrame:
    """Per entity: cluster, map key and the raw features as a map."""
    raw = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])
    return df.select(key, code, group, S.map_key(code, group).alias("map_key"), "cluster", raw.alias("raw"))


def segment(
    df: DataFrame,
    features: Sequence[str],
    key: str = "neighborhood",
    group: str = "borough",
    groups: Sequence[str] = (),
    max_k: int = 8,
    chosen_k: int | None = None,
    seed: int = 42,
    exact_silhouette: bool = False,
) -> dict:
    """Whole segmentation: features, complete rows, scaling, sweep, choice of k, members and centroids."""
    chosen = feature_set(df, features)
    rows = df.filter(F.col(group).isin(*groups)) if groups else df
    rows = stage_table(complete_cases(rows, chosen), "complete")
    scaled = zscore(rows, chosen)
    curve, labelled, centres = k_sweep(scaled, key, "z", max_k, seed, exact_silhouette)
    score = "silhouette" if exact_silhouette else "silhouette_squared"
    picks = select_k(curve, score, chosen_k)
    k = picks.first()["chosen_k"]
    labels = labelled.select(key, F.col(f"cluster_{k}").alias("cluster"), F.col(f"d2_{k}").alias("d2"), F.col("z"))
    return {
        "features": chosen,
        "curve": curve,
        "choice": picks,
        "stats": feature_stats(rows, chosen),
        "members": rows.join(labels, key),
        "centroids": centroid_table(df.sparkSession, centres[k], chosen),
        "k": k,
    }
