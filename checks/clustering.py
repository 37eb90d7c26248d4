"""K: clustering."""

from pyspark.sql import Window, functions as F

from arealens.operators import clustering as K
from arealens.session import scratch_path, stage_table
from checks.base import check, r6, s6
from checks.derived import AREA_SQL, COSINE_SQL, SHARE_COLUMNS, area_table

START = 8


def _points(t):
    return t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def _start(t, k=START):
    rows = t("embeddings").orderBy("vec_id").limit(k).collect()
    return [list(r["embedding"]) for r in rows]


def _assign_sql(points: str, centres: str, out: str) -> str:
    """Nearest of the centres (cluster, c) for every point (vec_id, v)."""
    return f"""
{out}d AS (SELECT p.vec_id, p.v, x.cluster, pow(list_distance(p.v, x.c), 2) AS d2 FROM {points} p, {centres} x),
{out} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d2': d2, 'cluster': cluster}}).cluster AS cluster, min(d2) AS d2 FROM {out}d GROUP BY vec_id)"""


def _mean_sql(assigned: str, out: str) -> str:
    return f"""
{out}u AS (SELECT cluster, unnest(v) AS value, generate_subscripts(v, 1) AS i FROM {assigned}),
{out}m AS (SELECT cluster, i, avg(value) AS value, count(*) AS size FROM {out}u GROUP BY 1, 2),
{out} AS MATERIALIZED (SELECT cluster, list(value ORDER BY i) AS c FROM {out}m GROUP BY 1)"""


_POINT_SQL = f"""
WITH pt AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
c0 AS (SELECT CAST(vec_id AS INT) AS cluster, v AS c FROM pt WHERE vec_id < {START}),"""
_ONE_SQL = _POINT_SQL + _assign_sql("pt", "c0", "a1")
_TWO_SQL = _ONE_SQL + "," + _mean_sql("a1", "c1") + "," + _assign_sql("pt", "c1", "a2")


@check(
    "k1_feature_set",
    AREA_SQL
    + "SELECT neighborhood, "
    + ", ".join(f"{s6(c)} AS {c}" for c in [*SHARE_COLUMNS, "avg_pedestrian", "transit_activity_score"])
    + " FROM feat",
)
def k1(t):
    df = area_table(t).withColumn("act_UNKNOWN_density", F.lit(0.0))
    chosen = K.feature_set(df, ["avg_pedestrian", "act_A_AND_F_storefront", "act_A_AND_F_density", "transit_activity_score"])
    return df.select("neighborhood", *[r6(c) for c in chosen])


@check("k2_assign_nearest", _ONE_SQL + f" SELECT vec_id, cluster, {s6('d2')} AS d2 FROM a1")
def k2(t):
    return K.assign_nearest(_points(t), "v", _start(t)).select("vec_id", "cluster", r6("d2"))


@check("k3_update_centroids", _ONE_SQL + "," + _mean_sql("a1", "c1") + f" SELECT cluster, CAST(i - 1 AS INT) AS position, {s6('value')} AS value, size FROM c1m")
def k3(t):
    means = K.update_centroids(K.assign_nearest(_points(t), "v", _start(t)), "v")
    return means.select("cluster", F.posexplode("centroid").alias("position", "value"), "size").withColumn("value", r6("value"))


@check("k4_lloyd", _TWO_SQL + f" SELECT vec_id, cluster, {s6('d2')} AS d2 FROM a2")
def k4_lloyd(t):
    assigned, _, _ = K.lloyd(stage_table(_points(t), "points"), "v", _start(t), max_iter=2, tol=0.0)
    return assigned.select("vec_id", "cluster", r6("d2"))


@check("k4_kmeans", f"SELECT {START} AS clusters, count(*) AS rows, 0 AS misplaced, true AS not_above_start FROM embeddings")
def k4(t):
    """Its seeding is its own, so what must hold of any result: every cluster has rows, every row is at its nearest centre."""
    points = stage_table(_points(t), "points")
    centres, _ = K.kmeans(points, "v", START)
    start = K.assign_nearest(points, "v", _start(t)).agg(F.sum("d2")).first()[0]
    placed = K.assign_nearest(points, "v", centres)
    far = [F.aggregate(F.zip_with("v", F.array(*[F.lit(x) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in centres]
    out = placed.withColumn("_least", F.least(*far)).agg(
        F.count_distinct("cluster").cast("int").alias("clusters"), F.count("*").alias("rows"),
        F.count_if(F.col("d2") > F.col("_least") + 1e-9).cast("int").alias("misplaced"), (F.sum("d2") <= F.lit(start)).alias("not_above_start"),
    )
    return out


@check(
    "k2_missing_vectors",
    """WITH p AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings),
    c0 AS (SELECT CAST(vec_id AS INT) AS cluster, CAST(embedding AS DOUBLE[]) AS c FROM embeddings WHERE vec_id < 8),"""
    + _assign_sql("(SELECT * FROM p WHERE v IS NOT NULL)", "c0", "a1")
    + f" SELECT vec_id, cluster, {s6('d2')} AS d2 FROM p LEFT JOIN (SELECT vec_id, cluster, d2 FROM a1) USING (vec_id)",
)
def k2_missing(t):
    gaps = _points(t).withColumn("v", F.when(F.col("vec_id") % 3 != 0, F.col("v")))
    return K.assign_nearest(gaps, "v", _start(t)).select("vec_id", "cluster", r6("d2"))


@check("k5_inertia", _TWO_SQL + f" SELECT {s6('sum(d2)')} AS inertia FROM a2")
def k5(t):
    assigned, _, _ = K.lloyd(stage_table(_points(t), "points"), "v", _start(t), max_iter=2, tol=0.0)
    return K.inertia(assigned).select(r6("inertia"))


_SILHOUETTE_SQL = """
s AS (SELECT a.vec_id, a.{label} AS own, b.{label} AS other, sum({distance}) AS total, count(*) AS n
      FROM {points} a, {points} b GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, max(CASE WHEN own = other THEN CASE WHEN n > 1 THEN total / (n - 1) ELSE 0 END END) AS a,
              min(CASE WHEN own <> other THEN total / n END) AS b FROM s GROUP BY 1)
SELECT round(avg(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab"""


@check("k6_silhouette_exact", _ONE_SQL + "," + _SILHOUETTE_SQL.format(points="a1", label="cluster", distance="list_distance(a.v, b.v)"))
def k6(t):
    assigned = K.assign_nearest(_points(t), "v", _start(t))
    out = K.silhouette_exact(assigned, "vec_id", "v", ["cluster"], block_rows=200)
    return out.select(r6("silhouette"))


@check("k6_silhouette_shuffled", _ONE_SQL + "," + _SILHOUETTE_SQL.format(points="a1", label="cluster", distance="list_distance(a.v, b.v)"))
def k6_shuffled(t):
    assigned = K.assign_nearest(_points(t), "v", _start(t))
    out = K.silhouette_exact(assigned, "vec_id", "v", ["cluster"], block_rows=100, broadcast_values=0)
    return out.select(r6("silhouette"))


@check("k7_silhouette_squared", _ONE_SQL + "," + _SILHOUETTE_SQL.format(points="a1", label="cluster", distance="pow(list_distance(a.v, b.v), 2)"))
def k7(t):
    value = K.silhouette_squared(K.assign_nearest(_points(t), "v", _start(t)), "v")
    return t.spark.createDataFrame([(round(value, 6),)], "silhouette double")


_SWEEP_KS = (2, 3, 4, 5)


def _sweep_sql() -> str:
    """Two Lloyd rounds for each k from the first k vectors, then inertia and the squared silhouette."""
    steps, rows = ["pt AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"], []
    for k in _SWEEP_KS:
        steps.append(f"c{k}_0 AS (SELECT CAST(vec_id AS INT) AS cluster, v AS c FROM pt WHERE vec_id < {k})")
        for i in (1, 2):
            steps.append(_assign_sql("pt", f"c{k}_{i - 1}", f"a{k}_{i}"))
            steps.append(_mean_sql(f"a{k}_{i}", f"c{k}_{i}"))
        steps.append(_assign_sql("pt", f"c{k}_2", f"a{k}_3"))
        steps.append(_SILHOUETTE_SQL.format(points=f"a{k}_3", label="cluster", distance="pow(list_distance(a.v, b.v), 2)")
                     .replace("s AS (", f"s{k} AS (", 1).replace("FROM s GROUP", f"FROM s{k} GROUP").replace("ab AS (", f"ab{k} AS (", 1).replace("FROM ab", f"FROM ab{k}")
                     .rsplit("SELECT round", 1)[0].rstrip())
        rows.append(
            f"SELECT {k} AS k, {s6(f'(SELECT sum(d2) FROM a{k}_3)')} AS inertia, (SELECT round(avg(CASE WHEN b IS NULL OR greatest(a, b) = 0"
            f" THEN 0 ELSE (b - a) / greatest(a, b) END), 6) FROM ab{k}) AS silhouette_squared"
        )
    return "WITH " + ",\n".join(steps) + "\n" + "\nUNION ALL ".join(rows)


@check("k8_k_sweep", _sweep_sql())
def k8(t):
    curve = K.k_sweep(_points(t), "vec_id", "v", max(_SWEEP_KS), starts=_start(t, max(_SWEEP_KS)), max_iter=2, tol=0.0)[0]
    return curve.select("k", r6("inertia"), r6("silhouette_squared"))


@check("k8_own_starts", "SELECT CAST(unnest(range(2, 7)) AS INT) AS k, true AS falls")
def k8_own(t):
    """With seeds of its own: every k is swept and the inertia of k + 1 clusters is not far above that of k."""
    features = ["avg_pedestrian", "storefront_density_per_km2", "category_entropy"]
    # Scaling reads the areas twice: for their means, and row by row.
    areas = stage_table(area_table(t).select("neighborhood", *features), "areas")
    scaled = K.zscore(areas, features)
    curve = K.k_sweep(scaled, "neighborhood", "z", 6)[0]
    before = F.lag("inertia").over(Window.orderBy("k"))
    return curve.select("k", (F.coalesce(before, F.col("inertia")) * 1.1 >= F.col("inertia")).alias("falls"))


_KS = list(range(2, START + 1))
_CURVE_SQL = (
    "WITH pt AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
    "c0 AS (SELECT CAST(vec_id AS INT) AS cluster, v AS c FROM pt WHERE vec_id < 8), "
    "d AS MATERIALIZED (SELECT p.vec_id, x.cluster, pow(list_distance(p.v, x.c), 2) AS d2 FROM pt p, c0 x), "
    "curve AS MATERIALIZED (SELECT k, sum(d2) AS inertia, max(d2) AS score FROM (SELECT r.k, vec_id, min(d2) AS d2 FROM d, "
    "(SELECT CAST(unnest(range(2, 9)) AS INT) AS k) r WHERE cluster < r.k GROUP BY 1, 2) GROUP BY 1), "
    """n AS (SELECT k, score, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER () + 1e-12) AS x,
      (inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER () + 1e-12) AS y FROM curve),
    e AS (SELECT *, first_value(x) OVER w AS x0, last_value(x) OVER w AS x1, first_value(y) OVER w AS y0, last_value(y) OVER w AS y1,
      abs(lead(y) OVER (ORDER BY k) - 2 * y + lag(y) OVER (ORDER BY k)) AS bend FROM n
      WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    g AS (SELECT *, abs((y1 - y0) * x - (x1 - x0) * y + x1 * y0 - y1 * x0) AS chord FROM e)
    SELECT (SELECT k FROM g ORDER BY chord DESC, k LIMIT 1) AS elbow_k, (SELECT k FROM g ORDER BY bend DESC NULLS LAST, k LIMIT 1) AS curvature_k,
      (SELECT k FROM g ORDER BY score DESC, k LIMIT 1) AS best_silhouette_k, 5 AS chosen_k"""
)


@check("k9_select_k", _CURVE_SQL)
def k9(t):
    start = _start(t)
    df = t("embeddings").select(
        *[K.nearest_centroid(F.col("embedding"), start[:k])["d2"].alias(f"d{k}") for k in _KS]
    )
    cells = [F.struct(F.lit(k).alias("k"), F.sum(f"d{k}").alias("inertia"), F.max(f"d{k}").alias("silhouette")) for k in _KS]
    curve = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    return K.select_k(curve, chosen=5)


_Z_SQL = """
WITH st AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(c_nationkey) AS mb, stddev_pop(c_nationkey) AS sb FROM customer),
z AS (SELECT c_custkey, c_mktsegment, (c_acctbal - ma) / (sa + 1e-8) AS za, (c_nationkey - mb) / (sb + 1e-8) AS zb FROM customer, st),
c AS (SELECT CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS cluster, avg(za) AS za, avg(zb) AS zb FROM z GROUP BY c_mktsegment)
"""


def _segments(t):
    scaled = K.zscore(t("customer"), ["c_acctbal", "c_nationkey"])
    rows = scaled.groupBy("c_mktsegment").agg(F.avg(F.col("z")[0]).alias("a"), F.avg(F.col("z")[1]).alias("b")).orderBy("c_mktsegment").collect()
    return scaled, [[r["a"], r["b"]] for r in rows]


@check(
    "k10_unscale_centroids",
    _Z_SQL
    + f"""SELECT cluster, 'c_acctbal' AS feature, {s6('za * sa + ma')} AS value FROM c, st
        UNION ALL SELECT cluster, 'c_nationkey', {s6('zb * sb + mb')} FROM c, st""",
)
def k10(t):
    features = ["c_acctbal", "c_nationkey"]
    _, centres = _segments(t)
    table = K.centroid_table(t.spark, centres, features)
    out = K.unscale_centroids(table, K.feature_stats(t("customer"), features))
    return out.select("cluster", "feature", r6("value"))


@check(
    "k11_closest_members",
    _Z_SQL
    + f""", d AS (SELECT c_custkey, cluster, (z.za - c.za) * (z.za - c.za) + (z.zb - c.zb) * (z.zb - c.zb) AS d2 FROM z, c),
    n AS (SELECT c_custkey, min({{'d2': d2, 'cluster': cluster}}) AS m FROM d GROUP BY 1)
    SELECT * FROM (SELECT m.cluster AS cluster, c_custkey, {s6('sqrt(m.d2)')} AS distance,
       CAST(row_number() OVER (PARTITION BY m.cluster ORDER BY m.d2, c_custkey) AS INT) AS rank FROM n) WHERE rank <= 5""",
)
def k11(t):
    scaled, centres = _segments(t)
    out = K.closest_members(K.assign_nearest(scaled, "z", centres), "c_custkey")
    return out.select("cluster", "c_custkey", r6("distance"), "rank")


@check(
    "k12_text_representatives",
    """
    WITH m AS (SELECT e.label AS cluster, d.doc_id, CAST(e.embedding AS DOUBLE[]) AS v, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
    u AS (SELECT cluster, unnest(v) AS value, generate_subscripts(v, 1) AS i FROM m),
    c AS (SELECT cluster, list(value ORDER BY i) AS mean FROM (SELECT cluster, i, avg(value) AS value FROM u GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT cluster, doc_id, text, """
    + COSINE_SQL.format(a="m.v", b="c.mean")
    + """ AS sim FROM m JOIN c USING (cluster))
    SELECT * FROM (SELECT cluster, doc_id, round(sim, 6) + 0.0 AS cosine_to_mean,
      CASE WHEN length(text) > 420 THEN substr(text, 1, 419) || '…' ELSE text END AS profile_excerpt,
      CAST(row_number() OVER (PARTITION BY cluster ORDER BY sim DESC, doc_id) AS INT) AS rank FROM s) WHERE rank <= 3""",
)
def k12(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(t("documents").select("doc_id", "text"), "doc_id")
    members = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"))
    out = K.text_representatives(members, vectors, "doc_id")
    return out.select("cluster", "doc_id", r6("cosine_to_mean"), "profile_excerpt", "rank")


@check("k13_run_store", _ONE_SQL + " SELECT CAST(vec_id AS VARCHAR) AS entity, cluster FROM a1")
def k13(t):
    points, start = _points(t), _start(t)
    path = scratch_path(t.spark, "runs")
    run = K.run_key(START, ["b", "a"], 42, K.data_fingerprint(points, ["vec_id", "v"]))
    K.save_run(K.assign_nearest(points, "v", start), "vec_id", start, 1, path, run)
    other = K.run_key(START, ["a", "b"], 43, "other data")
    K.save_run(K.assign_nearest(points, "v", start[:2]), "vec_id", start[:2], 1, path, other)
    labels, _ = K.load_run(t.spark, path, K.run_key(START, ["a", "b"], 42, K.data_fingerprint(points, ["vec_id", "v"])))
    return labels.select(F.col("entity").cast("string").alias("entity"), "cluster")


@check(
    "k14_cluster_points",
    AREA_SQL
    + f"""SELECT f.neighborhood, f.cd || ' | ' || f.borough AS map_key, label AS cluster, {s6('avg_pedestrian')} AS flow, {s6('category_entropy')} AS entropy
    FROM feat f JOIN embeddings ON f.neighborhood = 'Area ' || vec_id""",
)
def k14(t):
    labels = t("embeddings").select(F.concat(F.lit("Area "), "vec_id").alias("neighborhood"), F.col("label").alias("cluster"))
    out = K.cluster_points(area_table(t).join(labels, "neighborhood"), ["avg_pedestrian", "category_entropy"])
    return out.select("neighborhood", "map_key", "cluster", r6(F.col("raw")["avg_pedestrian"], "flow"), r6(F.col("raw")["category_entropy"], "entropy"))
