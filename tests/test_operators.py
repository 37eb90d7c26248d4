import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens.functions.predicates import HardFilter
from arealens.operators import aggregates as A
from arealens.operators import clustering as K
from arealens.operators import joins as J
from arealens.operators import ordering as O
from arealens.operators import ranking as R
from arealens.operators import vectors as V


def test_minmax_of_a_constant_column_is_zero_and_one_row_scores_half(spark):
    df = spark.createDataFrame([("a", 0.3, 1.0), ("b", 0.3, 2.0)], "k string, s double, c double")
    got = {r.k: r.blended_score for r in R.minmax_blend(df, "s", "c", 0.8).collect()}
    assert got == {"a": pytest.approx(0.2), "b": 0.0}
    assert R.minmax_blend(df.limit(1), "s", "c", 0.8).first().blended_score == 0.5


def test_ranks_break_ties_by_key_and_put_missing_last(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", 2.0)], "k string, s double")
    got = {r.k: r["rank"] for r in O.rank_desc(df, "s", ["k"]).collect()}
    assert got == {"d": 1, "a": 2, "b": 3, "c": 4}
    mean = {r.k: r["rank"] for r in O.rank_average(df, "s").collect()}
    assert mean == {"d": 1.0, "a": 2.5, "b": 2.5, "c": 4.0}


def test_one_hot_group_is_numbered_like_a_window(spark):
    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("g"), (F.col("id") * 37 % 1000).alias("s"), "id")
    a = O.number_within(df, ["g"], ["s", "id"])
    b = O.number_within(df, ["g"], ["s", "id"])
    assert a.exceptAll(b).count() == 0 and a.count() == 5000


def test_dedupe_first_and_last(spark):
    df = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (2, "z", 5)], "k int, v string, at int")
    assert sorted(map(tuple, O.dedupe_first(df, ["k"], ["at"]).collect())) == [(1, "y", 1), (2, "z", 5)]
    assert sorted(map(tuple, O.dedupe_last(df, ["k"], ["at"]).collect())) == [(1, "x", 2), (2, "z", 5)]


def test_colliding_columns_are_rejected(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, area_km2 double")
    with pytest.raises(ValueError, match="both sides"):
        J.star_left_join(a, [a], ["k"])
    with pytest.raises(ValueError, match="differ only by case"):
        A.reject_case_twins(["act_OTHER_storefront", "act_other_storefront"])
    with pytest.raises(ValueError, match="share no"):
        J.vintage_join(a, a.select((F.col("k") + 1).alias("k")), ["k"])


def test_combined_codes_first_or_all(spark):
    left = spark.createDataFrame([("BX03",), ("BX06",)], "cd string")
    right = spark.createDataFrame([("BX03 & BX06", 7.0, 0)], "label string, v double, at int")
    first = J.join_on_normalized_key(left, right, "cd", "label", ["at"], ["v"])
    every = J.join_on_normalized_key(left, right, "cd", "label", ["at"], ["v"], explode_all=True)
    assert {r.cd: r.v for r in first.collect()} == {"BX03": 7.0, "BX06": None}
    assert {r.cd: r.v for r in every.collect()} == {"BX03": 7.0, "BX06": 7.0}
    sparse = spark.createDataFrame([("BX01", 1.0), ("BX02", None), ("BX03", None), ("park", None)], "cd string, v double")
    with pytest.warns(UserWarning, match="1 of 3"):
        J.warn_if_unmatched(sparse, "cd", "v")


@pytest.mark.parametrize("p", [0.25, 0.5, 0.75])
def test_bracketed_quantile_is_exact_on_a_hot_skewed_group(spark, p):
    rng = random.Random(5)
    rows = [("hot", rng.choice([1.0, 1.0, rng.lognormvariate(0, 4)])) for _ in range(20_000)]
    rows += [("small", float(i)) for i in range(4)] + [("gap", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.v for r in A.exact_quantile(df, ["g"], ["v"], p).collect()}
    hot = [v for g, v in rows if g == "hot"]
    assert got["hot"] == pytest.approx(float(np.quantile(hot, p)), rel=1e-12)
    assert got["small"] == pytest.approx(float(np.quantile([0, 1, 2, 3], p)))
    assert got.get("gap") is None and got.get("nan") is None


def test_imputation_uses_the_filled_column_for_the_overall_median(spark):
    rows = [("a", 1.0), ("a", None), ("a", 3.0), ("b", 100.0), ("b", None), ("b", None), ("c", None), (None, None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("z", F.lit(None).cast("double"))
    got = A.impute_hierarchical(df, ["v", "z"], "g", ["z"]).collect()
    filled = [1.0, 2.0, 3.0, 100.0, 100.0, 100.0]
    assert sorted(r.v for r in got if r.g in ("a", "b")) == filled
    assert {r.v for r in got if r.g in ("c", None)} == {statistics.median(filled)}
    assert {r.z for r in got} == {0.0}


def test_entropy_and_shares(spark):
    df = spark.createDataFrame([(2, 2, 0, 4), (0, 0, 0, 0), (5, None, 0, 5)], "a int, b int, c int, storefront_filing_count int")
    got = [r[0] for r in df.select(A.wide_entropy(["a", "b", "c"])).collect()]
    assert got == [pytest.approx(math.log(2)), 0.0, 0.0]
    flat = spark.createDataFrame([(3, 3)], "a int, b int").select(A.wide_entropy(["a", "b"], normalised=True)).first()[0]
    assert flat == pytest.approx(1.0)
    shares = A.category_shares(df.withColumnsRenamed({"a": "act_A_storefront"}), ["act_A_storefront"])
    assert [r.act_A_density for r in shares.collect()] == [0.5, 0.0, 1.0]


def test_percentile_divides_before_it_scales(spark):
    """23 of 40 is 57.49999... per cent, as a mean of comparisons times 100."""
    df = spark.createDataFrame([(float(i),) for i in range(40)], "x double")
    asked = spark.createDataFrame([(22.0,)], "v double")
    assert A.empirical_percentile(df, "x", asked, "v").first().percentile == 57


@pytest.mark.parametrize("held", [10_000, 20, 3])
def test_quantiles_with_narrowed_brackets(spark, held):
    rng = random.Random(held)
    rows = [("a", float(rng.randrange(50))) for _ in range(4000)] + [("b", rng.random()) for _ in range(3000)] + [("c", 1.0)] * 900 + [(None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.v for r in A.exact_quantile(df, ["g"], ["v"], (0.0, 0.25, 0.5, 1.0), held=held).collect()}
    for g in ("a", "b", "c", None):
        own = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx(list(np.quantile(own, [0, 0.25, 0.5, 1])), rel=1e-12)


def test_percentiles_of_non_finite_values_are_missing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    asked = spark.createDataFrame([(5.0,), (float("inf"),), (float("nan"),), (0.5,), (None,)], "v double")
    got = {r.v: r.percentile for r in A.empirical_percentile(df, "x", asked, "v").collect()}
    assert got == {5.0: 50, 0.5: 0, None: None}


def kendall(xs, ys):
    s = tx = ty = 0
    for (x1, y1), (x2, y2) in itertools.combinations(zip(xs, ys), 2):
        s += np.sign(x1 - x2) * np.sign(y1 - y2)
        tx += x1 != x2
        ty += y1 != y2
    return s / math.sqrt(tx * ty)


@pytest.mark.parametrize("block", [3, 1000])
def test_kendall_matches_all_pairs(spark, block):
    rng = random.Random(9)
    rows = [(g, i, rng.randint(0, 12), rng.randint(0, 9)) for g in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "g string, k int, x int, y int")
    got = {r.g: r.kendall_tau for r in R.kendall_tau(df, ["g"], "x", "y", ["k"], block=block).collect()}
    for g in got:
        xs, ys = zip(*[(x, y) for h, _, x, y in rows if h == g])
        assert got[g] == pytest.approx(kendall(xs, ys))


def test_discordant_pairs_by_digits():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(0, 50))
        g, x, y, w = np.sort(rng.integers(0, 4, n)), rng.integers(0, 16, n), rng.integers(0, 16, n), rng.integers(1, 4, n)
        order = np.lexsort((x, g))
        g, x = g[order], x[order]
        later = (g[:, None] == g) & (x[:, None] < x) & (y[:, None] > y)
        assert R.discordant_within(g, x, y, w, 4).tolist() == (w * (later * w).sum(1)).tolist()


def test_kendall_of_a_long_ranking(spark):
    n = 30_000
    df = spark.range(n).select(F.lit("q").alias("g"), F.col("id").alias("k"), F.col("id").alias("x"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("y"))
    y = np.arange(n) * 7919 % n
    discordant = sum(int((y[i + 1 :] < y[i]).sum()) for i in range(n))
    row = R.kendall_tau(df, ["g"], "x", "y", ["k"]).first()
    assert row.kendall_tau == pytest.approx(1 - 4 * discordant / (n * (n - 1)))


def test_constant_ranking_has_no_correlation(spark):
    a = spark.createDataFrame([("q", i, 2.0) for i in range(3)], "query string, k int, rank double")
    b = spark.createDataFrame([("q", i, float(i)) for i in range(3)], "query string, k int, rank double")
    row = R.rank_stability(a, b, ["k"]).first()
    assert (row.n_overlap, row.spearman_r, row.kendall_tau) == (3, None, None)


def test_many_queries_in_slices_equal_one_slice(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)], "k int, embedding array<double>")
    entities = spark.createDataFrame([(i, float(i % 5)) for i in range(30)], "k int, competitive_score double")
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in rng.normal(size=4)]) for i in range(6)], "query string, embedding array<double>")

    def ranked():
        rows = R.rank_many(entities, vectors, queries, ["k"]).collect()
        return sorted((r[0], r[1], round(r[2], 9), round(r[3], 9), r[4]) for r in rows)

    whole = ranked()
    monkeypatch.setattr(R, "QUERY_VALUES", 8)
    assert ranked() == whole
    assert len(whole) == 180 and sorted(r[4] for r in whole if r[0] == "q0") == [float(i) for i in range(1, 31)]


def test_nearest_rows_only_are_scaled_with_a_limit(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", None)], "neighborhood string, embedding array<double>")
    df = spark.createDataFrame([(n, "X", 1.0) for n in "abcd"], "neighborhood string, borough string, competitive_score double")
    out = R.rank_entities(df, vectors, [1.0, 0.0], spec=HardFilter(), code=None, limit=2).orderBy("rank").collect()
    assert [r.neighborhood for r in out] == ["a", "b"]
    assert [r.blended_score for r in out] == [pytest.approx(0.8), 0.0]


def test_competition_source_is_validated(spark):
    df = spark.createDataFrame([(1.0,)], "avg_pedestrian double")
    for source in ("__overall__", "price", "act_X_storefront"):
        with pytest.raises(ValueError):
            R.competition_signal(df, source)


def test_hashed_vectors_depend_on_the_text_alone(spark):
    df = spark.createDataFrame([(1, "red apple pie"), (2, "pie red apple"), (3, "grey stone wall"), (4, None)], "id int, t string")
    got = {r.id: np.array(r.embedding) for r in V.embed_text(df, "t").collect()}
    assert np.allclose(got[1], got[2]) and np.linalg.norm(got[1]) == pytest.approx(1.0, abs=1e-6)
    assert abs(got[1] @ got[3]) < 0.9 and not got[4].any()


# --- clustering ------------------------------------------------------------------


def frame(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, v array<double>")


def blobs(seed, n, shift):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.standard_normal((n, 2)), rng.standard_normal((n, 2)) + np.array(shift)])


def test_two_blobs_give_two_labels(spark):
    df = frame(spark, blobs(0, 30, (5.0, 5.0)))
    centres, steps = K.kmeans(df, "v", 2, seed=0)
    labels = [r.cluster for r in K.assign_nearest(df, "v", centres).collect()]
    assert len(centres) == 2 and steps >= 1 and len(labels) == 60 and set(labels) == {0, 1}


def test_stored_run_is_not_recomputed(spark, tmp_path):
    df = frame(spark, blobs(0, 10, (4.0, 0.0)))
    first = K.kmeans_stored(df, "id", "v", 2, ["x", "y"], str(tmp_path), seed=0)
    second = K.kmeans_stored(df, "id", "v", 2, ["y", "x"], str(tmp_path), seed=0)
    assert first[2] >= 1 and second[2] == 0
    assert sorted(map(tuple, first[0].collect())) == sorted(map(tuple, second[0].collect()))
    changed = K.kmeans_stored(df.limit(15), "id", "v", 2, ["x", "y"], str(tmp_path), seed=0)
    assert changed[2] >= 1 and changed[0].count() == 15


def test_assignment_and_inertia_by_hand(spark):
    labels = K.assign_nearest(frame(spark, [(0, 0), (10, 0)]), "v", [(0, 0), (9, 0)]).orderBy("id").collect()
    assert [r.cluster for r in labels] == [0, 1]
    tied = K.assign_nearest(frame(spark, [(1, 0)]), "v", [(0, 0), (2, 0)]).first()
    assert (tied.cluster, tied.d2) == (0, 1.0)
    assigned = K.assign_nearest(frame(spark, [(0, 0), (2, 0), (10, 0)]), "v", [(1, 0), (10, 0)])
    assert K.inertia(assigned).first()[0] == pytest.approx(2.0)


def test_lloyd_lowers_inertia_and_reseeds_empty_clusters(spark):
    df = frame(spark, blobs(2, 20, (6.0, 0.0)))
    start = [(0.0, 0.0), (6.0, 0.0), (99.0, 99.0)]
    before = K.inertia(K.assign_nearest(df, "v", start)).first()[0]
    assigned, centres, steps = K.lloyd(df, "v", start, max_iter=20)
    assert K.inertia(assigned).first()[0] <= before and steps > 1
    assert all(abs(x) < 20 for c in centres for x in c)


def test_texts_are_counted_in_slices_of_bounded_memory():
    import tracemalloc

    from arealens.operators import vectors as V

    rng, width = np.random.default_rng(3), 16
    sizes = np.array([0, 5, 90_000, 1, 0, *[30_000] * 60])
    offsets = np.concatenate([[0], np.cumsum(sizes)]) + 7
    buckets, weights = rng.integers(0, width, sizes.sum()).astype(np.int32), np.arange(1.0, width + 1)
    tracemalloc.start()
    got = V._unit_counts(offsets, buckets, weights, 1 << 15)
    assert tracemalloc.get_traced_memory()[1] < 4 * 8 * 90_000
    tracemalloc.stop()
    counts = [np.bincount(b, minlength=width) * weights for b in np.split(buckets, np.cumsum(sizes)[:-1])]
    assert np.allclose(got, [c / max(np.linalg.norm(c), 1e-300) for c in counts])


def test_own_starts_read_the_areas_once(spark, monkeypatch):
    from checks import clustering as C

    read, staged = [], C.stage_table
    rows = [(f"Area {i}", float(i % 7), float(i % 11), float(i % 5)) for i in range(60)]
    table = spark.createDataFrame(rows, "neighborhood string, avg_pedestrian double, storefront_density_per_km2 double, category_entropy double")
    monkeypatch.setattr(C, "area_table", lambda t: table)
    monkeypatch.setattr(C, "stage_table", lambda df, label: read.append(label) or staged(df, label))
    assert [r.k for r in C.k8_own(None).collect()] == [2, 3, 4, 5, 6]
    assert read == ["areas"]


def silhouette(points, labels, singleton):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    out = []
    for i, c in enumerate(labels):
        own = [j for j in range(len(labels)) if labels[j] == c and j != i]
        a = d[i, own].mean() if own else 0.0
        b = min(d[i, [j for j in range(len(labels)) if labels[j] == o]].mean() for o in set(labels) - {c})
        s = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
        out.append(0.0 if not own and singleton == "zero" else s)
    return float(np.mean(out))


@pytest.mark.parametrize("singleton", ["one", "zero"])
def test_exact_silhouette_of_several_labelings(spark, singleton):
    points = blobs(1, 25, (8.0, 0.0))
    one = [0] * 25 + [1] * 25
    two = [i % 3 for i in range(49)] + [4]
    rows = [(i, [float(x) for x in p], a, b, 0) for i, (p, a, b) in enumerate(zip(points, one, two))]
    df = spark.createDataFrame(rows, "id int, v array<double>, one int, two int, flat int")
    out = K.silhouette_exact(df, "id", "v", ["one", "two", "flat"], singleton, block_rows=7)
    got = {r.labels: r.silhouette for r in out.collect()}
    assert got["one"] > 0.3
    assert got["one"] == pytest.approx(silhouette(points, one, singleton))
    assert got["two"] == pytest.approx(silhouette(points, two, singleton))
    assert got["flat"] == 0.0


def test_exact_silhouette_copies_no_block_per_pair(spark):
    points = np.concatenate([blobs(1, 25, (8.0, 0.0)), blobs(1, 25, (8.0, 0.0))]) + 1e5
    labels = [i // 25 % 2 for i in range(len(points))]
    df = spark.createDataFrame([(i, [float(x) for x in p], c) for i, (p, c) in enumerate(zip(points, labels))], "id int, v array<double>, c int")
    out = K.silhouette_exact(df, "id", "v", ["c"], block_rows=7, broadcast_values=0)
    assert out.first().silhouette == pytest.approx(silhouette(points, labels, "one"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode" not in plan


def test_choice_of_k(spark):
    rows = [(2, 100.0, 0.2), (3, 40.0, 0.5), (4, 30.0, 0.5), (5, 25.0, 0.4)]
    curve = spark.createDataFrame(rows, "k int, inertia double, silhouette double")
    row = K.select_k(curve).first()
    assert (row.elbow_k, row.curvature_k, row.best_silhouette_k, row.chosen_k) == (3, 3, 3, 3)
    assert K.select_k(curve, chosen=5).first().chosen_k == 5
    with pytest.raises(Exception, match="not in the sweep"):
        K.select_k(curve, chosen=9).collect()
    two = curve.filter("k <= 3")
    assert K.select_k(two).first().curvature_k == 2


def test_starts_come_from_all_rows_whatever_their_copies(spark):
    held = [[float(i % 2), 0.0] for i in range(9000)] + [[50.0, 50.0], [0.0, 90.0], None, [None, 1.0]]
    df = spark.createDataFrame(list(enumerate(held)), "id int, v array<double>")
    starts = K.sweep_starts(df.repartition(5), "v", 6)
    assert sorted(starts) == [[0.0, 0.0], [0.0, 90.0], [1.0, 0.0], [50.0, 50.0]]
    assert K.sweep_starts(df.coalesce(1), "v", 6) == starts
    rare = K.sweep_starts(df, "v", 3)
    assert [50.0, 50.0] in rare and [0.0, 90.0] in rare
    assert K.sweep_starts(df.filter("id < 0"), "v", 3) == []


def test_whole_segmentation(spark):
    rng = np.random.default_rng(4)
    rows = [
        (f"n{i}", f"c{i}", "A" if i % 2 else "B", float(i % 3 * 10 + rng.normal()), float(rng.normal()), None if i == 0 else i / 40)
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, "neighborhood string, cd string, borough string, avg_pedestrian double, x double, act_A_density double")
    out = K.segment(df, ["avg_pedestrian", "act_A_storefront"], max_k=5, chosen_k=3)
    assert out["features"] == ["act_A_density", "avg_pedestrian"] and out["k"] == 3
    assert out["members"].count() == 39 and [r.k for r in out["curve"].orderBy("k").collect()] == [2, 3, 4, 5]
    with pytest.raises(ValueError, match="unknown"):
        K.segment(df, ["height"])
