"""Centroid clustering on integers with a pivot table (LAESA).

The distances of every vector to a few fixed pivots are computed once and stored beside it. In each round the distances of the centroids to
the same pivots are known too, and by the triangle inequality |d(v, p) - d(c, p)| bounds d(v, c) from below for every pivot p. The
centroid with the least bound gets its exact distance; only centroids whose bound does not exceed it get theirs. Bounds are
floating-point numbers with a margin for their rounding, distances that decide are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from arealens.llm.staging import stage_table

WIDTH, SCALE, CLUSTERS, ROUNDS, PIVOTS = 64, 256, 40, 5, 16
#: Scaled components stay below 2**27, so that a squared distance of 64 components fits into 63 bits.
LARGEST = 1 << 27
MARGIN = 1e-12
ROWS = 4096


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Components x as integers floor(scale * x); beyond LARGEST an error, since their distances would not fit into a long."""
    limit = F.lit(LARGEST / scale)
    beyond = F.raise_error(F.lit(f"a vector component is {LARGEST // scale} or more")).cast("int")
    return F.transform(vector, lambda x: F.when(F.abs(x) < limit, F.floor(x * F.lit(float(scale))).cast("int")).otherwise(beyond))


def kept_vectors(table: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """(_key, _v) of the rows whose vector has ``width`` components, none NULL or non-finite."""
    values = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall("_x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = table.select(F.col(f"`{key}`").alias("_key"), values.alias("_x")).filter(F.coalesce(F.size("_x") == width, F.lit(False)) & finite)
    return rows.select("_key", scaled(F.col("_x"), scale).alias("_v"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def roots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every vector to every pivot."""
    return np.stack([np.sqrt(squared(vectors, p[None]).astype(float)) for p in pivots], axis=1)


def spread_pivots(starts: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the starting centroids, each the farthest from those before it; equal ones stand once."""
    chosen = [0]
    least = squared(starts, starts[:1])
    while len(chosen) < count and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squared(starts, starts[chosen[-1]][None]))
    return starts[chosen]


def nearest(vectors: np.ndarray, near: np.ndarray, centroids: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every vector (of equally near ones the smaller number), its squared distance, and how many distances were exact.

    ``near`` and ``far`` hold the distances of the vectors and of the centroids to the pivots.
    """
    lower = np.zeros((len(vectors), len(centroids)))
    for p in range(near.shape[1]):
        np.maximum(lower, np.abs(near[:, p, None] - far[None, :, p]), out=lower)
    guess = lower.argmin(1)
    bound = squared(vectors, centroids[guess])
    lower = np.maximum(lower - MARGIN * (near.max() + far.max()), 0.0)
    rows, columns = np.nonzero(lower * lower <= (bound * (1 + MARGIN))[:, None])
    exact = squared(vectors[rows], centroids[columns])
    least = np.minimum.reduceat(exact, np.searchsorted(rows, np.arange(len(vectors))))
    hit = np.flatnonzero(exact == least[rows])
    first = hit[np.unique(rows[hit], return_index=True)[1]]
    return columns[first], least, len(vectors) + len(rows)


def arrays(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, integer vectors, pivot distances) of a stored table (_key, _v, _near), in pieces of ROWS rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            vectors, near = (part.column(c).flatten().to_numpy() for c in (1, 2))
            yield part, vectors.reshape(-1, width).astype(np.int64), near.reshape(part.num_rows, -1)


def with_pivots(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """(_key, _v, _near): every vector with its distances to the pivots."""
    kind = rows.schema["_key"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy().reshape(-1, width).astype(np.int64)
            near = roots(vectors, pivots)
            at = pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, near.ravel())], ["_key", "_v", "_near"])

    return rows.mapInArrow(scan, f"_key {kind}, _v array<int>, _near array<double>")


def member_sums(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Members and exact component sums of every non-empty centroid; a task sends one row per centroid."""
    far, width = roots(centroids, pivots), centroids.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, vectors, near in arrays(batches, width):
            cluster, _, _ = nearest(vectors, near, centroids, far)
            count += np.bincount(cluster, minlength=len(centroids))
            np.add.at(total, cluster, vectors)
        some = np.flatnonzero(count)
        if len(some):
            at = pa.array(np.arange(0, len(some) * width + 1, width), pa.int32())
            sums = pa.ListArray.from_arrays(at, total[some].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), sums], ["cluster", "n", "sums"])

    parts = stored.mapInArrow(scan, "cluster int, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(width)]) for r in rows}


def lloyd(stored: DataFrame, starts: np.ndarray, pivots: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds; components are floor(sum / count), empty centroids stay."""
    centroids = starts.copy()
    for _ in range(rounds):
        for cluster, (n, sums) in member_sums(stored, centroids, pivots).items():
            centroids[cluster] = [s // n for s in sums]
    return centroids


def pivot_clusters(
    table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS, seed: str = "2",
    key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE,
) -> DataFrame:
    """One row per kept vector: key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 and n_exact.

    Kept are vectors of ``width`` components, none NULL or non-finite; x becomes the integer floor(scale * x). The first centroids are
    the vectors with the smallest hex SHA-256 of ``seed:key`` (of equal keys the lesser vector), fewer if fewer are kept. After
    ``rounds`` rounds every vector is assigned once more. ``n_exact`` is the number of exact distances its share of rows took in that
    last pass, on average.

    NULL keys hash as empty text; repeated rows and equal keys are vectors of their own; ties go to the smaller number. Components of
    ``LARGEST / scale`` or more raise an error, as their distances fit into no long. Empty tables give an empty result. The driver holds centroids,
    pivots and their sums alone; the table is read from storage once a round, and no row moves.
    """
    rows = kept_vectors(table, key, vector, width, scale)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))), 256)
    first = rows.withColumn("_hash", hashed).orderBy("_hash", "_v").limit(clusters).collect()
    kind = table.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_exact double"
    if not first:
        return table.sparkSession.createDataFrame([], out)
    starts = np.array([r["_v"] for r in first], np.int64)
    chosen = spread_pivots(starts, pivots)
    stored = stage_table(with_pivots(rows, chosen, width), "pivot-table")
    centroids = lloyd(stored, starts, chosen, rounds)
    far = roots(centroids, chosen)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors, near in arrays(batches, width):
            cluster, distance, exact = nearest(vectors, near, centroids, far)
            share = np.full(len(cluster), exact / len(cluster))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(share)], ["_key", "cluster", "distance", "n_exact"])

    assigned = stage_table(stored.mapInArrow(scan, f"_key {kind}, cluster int, distance long, n_exact double"), "assigned")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = F.create_map(*[F.lit(x) for i, d in enumerate(digests) for x in (i, d)])
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    # one row per centroid, and one in all
    sums = sums.join(F.broadcast(inertia)).withColumn("centroid_sha256", named[F.col("cluster")])
    joined = assigned.join(F.broadcast(sums), "cluster")
    return joined.select(F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")
