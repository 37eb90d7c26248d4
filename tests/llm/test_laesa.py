import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens.llm import laesa

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, clusters, rounds, width, seed="2"):
    fine = [(k, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for k, v, _ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda k: hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()
    centres = [list(v) for _, _, v in sorted((sha(k), v, v) for k, v in fine)[:clusters]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((dist(v, c), i) for i, c in enumerate(centres))[::-1] for _, v in fine]
    for _ in range(rounds):
        own = assign()
        for i in range(len(centres)):
            members = [v for (_, v), (j, _) in zip(fine, own) if j == i]
            if members:
                centres[i] = [sum(x) // len(members) for x in zip(*members)]
    own = assign()
    total = sum(d for _, d in own)
    return sorted(
        [(k, i, d, sum(e for j, e in own if j == i), total, hashlib.sha256(",".join(map(str, centres[i])).encode()).hexdigest()) for (k, _), (i, d) in zip(fine, own)],
        key=lambda r: (r[0] is not None, *r) if r[0] is not None else (False, 0, *r[1:]),
    )


def rows_of(seed, n, width):
    rng = random.Random(seed)
    centres = [[rng.uniform(-2, 2) for _ in range(width)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)], 1) for i in range(n)]
    rows += [(n + i, rows[0][1], 2) for i in range(40)]
    rows += [(3, rows[3][1], 1), (3, rows[3][1], 1), (None, rows[5][1], 0), (n + 50, [0.0] * width, 0), (n + 51, [-0.001] * width, 0)]
    odd = [None, [], [1.0] * (width - 1), [1.0] * (width + 1), [None] + [1.0] * (width - 1), [math.nan] + [0.0] * (width - 1), [math.inf] * width]
    return rows + [(n + 60 + i, v, 0) for i, v in enumerate(odd)]


def result(df):
    rows = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, *r) if r[0] is not None else (False, 0, *r[1:]))


@pytest.mark.parametrize("clusters, rounds, pivots, width", [(7, 3, 4, 5), (40, 2, 16, 3), (500, 2, 3, 4)])
def test_same_as_brute_force(spark, clusters, rounds, pivots, width):
    rows = rows_of(clusters, 120, width)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("mine") for c in ("_key", "_v", "_x", "cluster", "n", "distance", "inertia")})
    got = laesa.pivot_clusters(table, clusters, rounds, pivots, width=width)
    assert result(got) == brute(rows, clusters, rounds, width)


def test_nearest_breaks_ties_by_number_and_spares_distances():
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (12, 6))
    centres[7] = centres[2]
    vectors = np.concatenate([centres[rng.integers(0, 12, 500)] + rng.integers(-9, 9, (500, 6)), rng.integers(-3, 3, (100, 6))])
    pivots = laesa.spread_pivots(centres, 5)
    cluster, least, exact = laesa.nearest(vectors, laesa.roots(vectors, pivots), centres, laesa.roots(centres, pivots))
    all_ = ((vectors[:, None] - centres[None]) ** 2).sum(2)
    assert cluster.tolist() == all_.argmin(1).tolist() and least.tolist() == all_.min(1).tolist()
    assert 7 not in cluster and exact < all_.size


def test_bounds_hold_for_large_components():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-laesa.LARGEST, laesa.LARGEST, (300, 64))
    near = vectors[:40] + rng.integers(-1, 2, (40, 64))
    pivots = laesa.spread_pivots(near, 8)
    cluster, least, _ = laesa.nearest(vectors, laesa.roots(vectors, pivots), near, laesa.roots(near, pivots))
    assert cluster[:40].tolist() == list(range(40)) and (least >= 0).all()


def test_equal_vectors_have_one_pivot():
    assert len(laesa.spread_pivots(np.ones((5, 3), np.int64), 4)) == 1


def test_components_beyond_the_bound_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e9, 0.0], 0)], SCHEMA)
    with pytest.raises(Exception, match="component"):
        laesa.pivot_clusters(table, 2, 1, 1, width=2).collect()


def test_empty_table(spark):
    got = laesa.pivot_clusters(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns[:3] == ["vec_id", "cluster", "distance"]
    assert laesa.pivot_clusters(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0
