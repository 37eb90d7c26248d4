"""Text vectors and similarity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arealens import presets
from arealens.functions.predicates import HardFilter, hard_filter
from arealens.operators.joins import align_vectors
from arealens.operators.ordering import order_by_score, top_k

EPSILON = 1e-12
SLICE_VALUES = 1 << 20  # words and vector cells that a task counts at a time

TextModel = Callable[[Sequence[str]], "np.ndarray"]


def embed_text(
    df: DataFrame,
    text: str,
    out: str = "embedding",
    load_model: Callable[[], TextModel] | None = None,
    dimensions: int = 256,
) -> DataFrame:
    """Adds a float vector per text. ``load_model`` returns a function from texts to a matrix and is
    called once per Python worker; without it a ``TextSpace`` is fitted on these
    texts. Fit a space once and keep it where later texts or queries have to be compared with these."""
    if load_model is None:
        return TextSpace.fit(df, text, dimensions).embed(df, text, out)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for batch in batches:
            matrix = np.asarray(model(batch.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(matrix), index=batch.index)

    return df.withColumn(out, embed(F.col(text)))


def hash_buckets(text: Column | str, dimensions: int) -> Column:
    """The bucket of every word (runs of letters and digits, lower-cased), from the first 32 bits of its MD5."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int"))


def _unit_counts(offsets: np.ndarray, buckets: np.ndarray, weights: np.ndarray, slice_values: int = SLICE_VALUES) -> np.ndarray:
    """Weighted bucket counts of every text, scaled to unit length. Texts are taken in slices of bounded size, so that memory
    beside the result does not follow the length of the texts in a batch."""
    starts, n, width = offsets - offsets[0], len(offsets) - 1, len(weights)
    out = np.empty((n, width), dtype=np.float32)
    if not n:
        return out
    part = (starts[:-1].astype(np.int64) + np.arange(n, dtype=np.int64) * width) // slice_values
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for low, high in zip(cuts, cuts[1:]):
        cells = np.repeat(np.arange(high - low) * width, np.diff(starts[low : high + 1]))
        cells += buckets[starts[low] : starts[high]]
        matrix = np.bincount(cells, minlength=(high - low) * width).reshape(high - low, width) * weights
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        out[low:high] = matrix
    return out


@dataclass(frozen=True)
class TextSpace:
    """A fitted space of hashed TF-IDF vectors: one weight per bucket. Corpus, refreshed rows and queries share it."""

    weights: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, text: str, dimensions: int = 256) -> TextSpace:
        """ln((n + 1) / (texts with the bucket + 1)) per bucket, counted over all texts; NULL texts count as empty."""
        buckets = df.select(F.array_distinct(hash_buckets(text, dimensions)).alias("_b"))
        counted = buckets.select(F.explode("_b").alias("b")).groupBy("b").agg(F.count("*").alias("n"))
        total, seen = df.count(), {r["b"]: r["n"] for r in counted.collect()}
        return cls(tuple(math.log((total + 1) / (seen.get(i, 0) + 1)) for i in range(dimensions)))

    def embed(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        """Adds the unit vector of every text; a text without weighted words has the zero vector."""
        weights = np.asarray(self.weights)

        counted = _unit_counts

        @F.arrow_udf("array<float>")
        def vectors(batch: pa.Array) -> pa.Array:
            matrix = counted(np.asarray(batch.offsets), np.asarray(batch.flatten()), weights)
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * len(weights)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))

        return df.withColumn(out, vectors(hash_buckets(text, len(weights))))

    def embed_query(self, spark: SparkSession, query: str) -> list[float]:
        return [float(v) for v in self.embed(spark.createDataFrame([(query,)], "q string"), "q").first()["embedding"]]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = spark.createDataFrame(list(enumerate(self.weights)), "bucket int, weight double")
        rows.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextSpace:
        rows = spark.read.schema("bucket int, weight double").parquet(path).collect()
        return cls(tuple(r["weight"] for r in sorted(rows, key=lambda r: r["bucket"])))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(vector, lambda v: v.cast("double") * v.cast("double"))))


def cosine_similarity(vector: Column | str, query: Sequence[float] | Column) -> Column:
    """Dot product of both sides divided by their length plus a tiny constant."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    if isinstance(query, Column):
        unit, scale = query, norm(query) + EPSILON
    else:
        q = np.asarray(query, dtype=np.float64)
        q = q / (np.linalg.norm(q) + EPSILON)
        unit, scale = F.array(*[F.lit(float(v)) for v in q]), F.lit(1.0)
    dot = _sum(F.zip_with(vector, unit, lambda a, b: a.cast("double") * b.cast("double")))
    return dot / (norm(vector) + EPSILON) / scale


def similarity_matrix(vector: Column | str, queries: np.ndarray) -> Column:
    """Cosine of each vector with every row of a bounded query matrix, as one array per row."""
    units = queries / (np.linalg.norm(queries, axis=1, keepdims=True) + EPSILON)

    @F.arrow_udf("array<double>")
    def score(batch: pa.Array) -> pa.Array:
        some = np.asarray(batch.is_valid())
        matrix = np.zeros((len(batch), units.shape[1]))
        matrix[some] = batch.filter(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, units.shape[1])
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True) + EPSILON
        sims = (matrix / lengths) @ units.T
        offsets = np.arange(len(batch) + 1, dtype=np.int32) * len(units)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(sims.ravel()))

    return score(F.col(vector) if isinstance(vector, str) else vector)


def match_entities(
    df: DataFrame,
    vectors: DataFrame,
    query: Sequence[float],
    spec: HardFilter,
    key: str,
    vector: str = "embedding",
    limit: int | None = None,
) -> DataFrame:
    """Filter, similarity and the nearest rows (the first ``limit``, or all in order) in one lazy plan.

    Vectors shrink to one number per key before the join, so they are never shuffled.
    """
    similar = vectors.filter(F.col(vector).isNotNull()).select(
        key, cosine_similarity(vector, query).alias("similarity")
    )
    joined = hard_filter(df, spec).join(similar, key)
    return order_by_score(joined, "similarity", key) if limit is None else top_k(joined, "similarity", limit, key)


__all__ = [
    "TextSpace",
    "align_vectors",
    "cosine_similarity",
    "embed_text",
    "match_entities",
    "norm",
    "similarity_matrix",
]
