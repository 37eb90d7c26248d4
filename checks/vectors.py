"""H: vector search, ranking and rank comparison."""

from pyspark.sql import functions as F

from arealens.functions.predicates import HardFilter
from arealens.operators import ranking as R
from arealens.operators import vectors as V
from arealens.session import scratch_path, stage_table
from checks.base import check, r6, s6
from checks.derived import AREA_SQL, COSINE_SQL, area_table, area_vectors, vector_of

COS_Q = COSINE_SQL.format(a="e.embedding", b="q.embedding")
QUERY_SQL = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


_SPACE_SQL = r"""
WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
c AS MATERIALIZED (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS b, count(*) AS n FROM w GROUP BY ALL),
i AS (SELECT b, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) AS weight FROM c GROUP BY b),
t AS (SELECT doc_id, b, n * weight AS x FROM c JOIN i USING (b)),
l AS (SELECT doc_id, sqrt(sum(x * x)) AS length FROM t GROUP BY doc_id),
unit AS MATERIALIZED (SELECT doc_id, b, x / length AS v FROM t JOIN l USING (doc_id) WHERE length > 0)
"""


@check("h1_embed_text", _SPACE_SQL + "SELECT doc_id, b::INTEGER AS bucket, round(v, 3) + 0.0 AS v FROM unit WHERE abs(v) > 1e-9")
def h1(t):
    out = V.embed_text(t("documents").select("doc_id", "text"), "text")
    out = out.select("doc_id", F.posexplode("embedding").alias("bucket", "v")).filter("abs(v) > 1e-9")
    return out.withColumn("v", F.round(F.col("v").cast("double"), 3) + 0.0)


@check(
    "h1_text_query",
    _SPACE_SQL
    + """, q AS (SELECT b, v FROM unit WHERE doc_id = 1),
    s AS (SELECT unit.doc_id, sum(unit.v * q.v) AS v FROM unit JOIN q USING (b) GROUP BY 1)
    SELECT doc_id, round(coalesce(s.v, 0), 3) + 0.0 AS similarity FROM documents LEFT JOIN s USING (doc_id)""",
)
def h1_query(t):
    """A query text, embedded in the saved space of the corpus, against every document: the query is document 1's text."""
    docs = t("documents").select("doc_id", "text")
    path = scratch_path(t.spark, "space")
    V.TextSpace.fit(docs, "text").save(t.spark, path)
    space = V.TextSpace.load(t.spark, path)
    query = space.embed_query(t.spark, docs.filter("doc_id = 1").first()["text"])
    found = space.embed(docs, "text")
    return found.select("doc_id", (F.round(V.cosine_similarity("embedding", query), 3) + 0.0).alias("similarity"))


@check("h1_embed_text_with_model", "SELECT doc_id, length(text) AS length, length(text) - length(replace(text, 'e', '')) AS n_e FROM documents")
def h1_model(t):
    def load():
        import numpy as np

        # Stands for any user model: a function from a batch of texts to a matrix.
        return lambda texts: np.asarray([[len(x), x.count("e")] for x in texts])

    out = V.embed_text(t("documents").select("doc_id", "text"), "text", load_model=load)
    return out.select("doc_id", *[F.col("embedding")[i].cast("long").alias(n) for i, n in enumerate(("length", "n_e"))])


@check("h2_cosine_similarity", f"SELECT e.vec_id, {s6(COS_Q)} AS similarity FROM embeddings e, {QUERY_SQL} q")
def h2(t):
    return t("embeddings").select("vec_id", r6(V.cosine_similarity("embedding", vector_of(t, 0)), "similarity"))


@check(
    "h3_match_entities",
    f"""SELECT p_partkey, p_name, {s6(COS_Q)} AS similarity FROM part JOIN embeddings e ON e.vec_id = p_partkey, {QUERY_SQL} q
    WHERE p_type IN ('PROMO', 'SMALL', 'LARGE') AND p_size >= 10 AND p_retailprice <= 940 ORDER BY {COS_Q} DESC, p_partkey LIMIT 50""",
)
def h3(t):
    spec = HardFilter(("PROMO", "SMALL", "LARGE"), {"p_size": 10}, {"p_retailprice": 940}, "p_type")
    vectors = t("embeddings").withColumnRenamed("vec_id", "p_partkey")
    out = V.match_entities(t("part"), vectors, vector_of(t, 0), spec, "p_partkey", limit=50)
    return out.select("p_partkey", "p_name", r6("similarity"))


@check(
    "h4_competition_signal",
    AREA_SQL
    + f"""SELECT neighborhood, {s6('competitive_score')} AS overall,
          {s6('ln(1 + act_R_AND_F_storefront / (avg_pedestrian + 1))')} AS specific FROM feat""",
)
def h4(t):
    df = area_table(t)
    overall, specific = R.competition_signal(df), R.competition_signal(df, "act_R_AND_F_storefront")
    return df.select("neighborhood", r6(overall, "overall"), r6(specific, "specific"))


_RANKED_SQL = """,
scored AS (SELECT f.neighborhood, f.cd, f.borough, {competition} AS competition, e.vec_id, e.label, {cosine} AS sim
  FROM feat f JOIN embeddings e ON f.neighborhood = 'Area ' || e.vec_id, {query} q WHERE {where}),
blended AS (SELECT *, {alpha}::DOUBLE * ((sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()))
  + (1::DOUBLE - {alpha}::DOUBLE) * ((max(competition) OVER () - competition) / (max(competition) OVER () - min(competition) OVER ())) AS blend
  FROM scored)
SELECT row_number() OVER (ORDER BY blend DESC, neighborhood) AS rank, neighborhood, cd, borough, cd || ' | ' || borough AS map_key,
  round(sim, 6) + 0.0 AS semantic_similarity, round(competition, 6) + 0.0 AS specific_competitive_score,
  round(blend, 6) + 0.0 AS blended_score, label AS cluster, CASE WHEN label < 5 THEN 'brief ' || label ELSE '' END AS cluster_description
FROM blended"""
_RANKED = ["rank", "neighborhood", "cd", "borough", "map_key", "cluster", "cluster_description"]
_SCORES = ["semantic_similarity", "specific_competitive_score", "blended_score"]


def _lookups(t):
    labels = t("embeddings").select(F.concat(F.lit("Area "), "vec_id").alias("neighborhood"), F.col("label").alias("cluster"))
    briefs = labels.select("cluster").distinct().filter("cluster < 5")
    return labels, briefs.withColumn("description", F.concat(F.lit("brief "), "cluster"))


@check(
    "h5_rank_entities",
    AREA_SQL
    + _RANKED_SQL.format(
        competition="competitive_score", cosine=COS_Q, query=QUERY_SQL, alpha=0.8,
        where="borough IN ('PROMO', 'SMALL', 'LARGE', 'MEDIUM') AND avg_pedestrian >= 2000 AND storefront_filing_count >= 15",
    ),
)
def h5(t):
    spec = HardFilter.from_request(
        boroughs=["PROMO", "SMALL", "LARGE", "MEDIUM"], min_avg_pedestrian=2000, min_storefront_filings=15
    )
    labels, briefs = _lookups(t)
    out = R.rank_entities(area_table(t), area_vectors(t), vector_of(t, 0), spec=spec, assignments=labels, briefs=briefs)
    return out.select(*_RANKED, *[r6(c) for c in _SCORES])


@check(
    "h5_ranking_counts",
    AREA_SQL
    + """SELECT count(*) AS n_total, count(*) FILTER (WHERE borough IN ('PROMO', 'SMALL', 'LARGE', 'MEDIUM') AND avg_pedestrian >= 2000
           AND storefront_filing_count >= 15) AS n_filtered FROM feat WHERE neighborhood IN (SELECT 'Area ' || vec_id FROM embeddings)""",
)
def h5_counts(t):
    spec = HardFilter.from_request(boroughs=["PROMO", "SMALL", "LARGE", "MEDIUM"], min_avg_pedestrian=2000, min_storefront_filings=15)
    return R.ranking_counts(area_table(t), area_vectors(t), spec=spec)


@check(
    "h5_rank_by_category",
    AREA_SQL
    + _RANKED_SQL.format(
        competition="ln(1 + act_N_AND_O_storefront / (avg_pedestrian + 1))", cosine=COS_Q, query=QUERY_SQL, alpha=0.35, where="true"
    ),
)
def h5_category(t):
    labels, briefs = _lookups(t)
    out = R.rank_entities(
        area_table(t), area_vectors(t), vector_of(t, 0), alpha=0.35, source="act_N_AND_O_storefront", assignments=labels,
        briefs=briefs,
    )
    return out.select(*_RANKED, *[r6(c) for c in _SCORES])


# --- two vintages: line items shipped by the end of 1998, and all of them ------

_MANY_SQL = """
WITH q AS (SELECT 'query ' || label AS query, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
f1 AS (SELECT l_partkey AS k, ln(1 + count(*) / (avg(l_quantity) + 1)) AS c FROM lineitem WHERE year(l_shipdate) <= 1998 GROUP BY 1),
f2 AS (SELECT l_partkey AS k, ln(1 + count(*) / (avg(l_quantity) + 1)) AS c FROM lineitem GROUP BY 1),
sims AS MATERIALIZED (SELECT q.query, e.vec_id AS k, {cosine} AS sim FROM q, embeddings e),
""".format(cosine=COS_Q) + ", ".join(
    f"""
b{i} AS (SELECT query, k, sim, 0.8::DOUBLE * ((sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w))
    + (1::DOUBLE - 0.8::DOUBLE) * ((max(c) OVER w - c) / (max(c) OVER w - min(c) OVER w)) AS blend
  FROM sims JOIN f{i} USING (k) WINDOW w AS (PARTITION BY query)),
r{i} AS MATERIALIZED (SELECT query, k, sim, blend, rank() OVER (PARTITION BY query ORDER BY blend DESC)
    + (count(*) OVER (PARTITION BY query, blend) - 1) / 2.0 AS rank FROM b{i})"""
    for i in (1, 2)
)


def _queries(t):
    return t("embeddings").groupBy(F.concat(F.lit("query "), "label").alias("query")).agg(F.min_by("embedding", "vec_id").alias("embedding"))


def _vintage(t, year=None):
    lines = t("lineitem").filter(F.year("l_shipdate") <= year) if year else t("lineitem")
    per = lines.groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("flow"))
    return per.select("k", F.log1p(F.col("n") / (F.col("flow") + 1)).alias("competitive_score"))


def _keyed_vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("k"), "embedding")


@check("h6_rank_many", _MANY_SQL + f"SELECT query, k, rank, {s6('sim')} AS semantic_similarity, {s6('blend')} AS blended_score FROM r2")
def h6(t):
    out = R.rank_many(_vintage(t), _keyed_vectors(t), _queries(t), ["k"])
    return out.select("query", "k", "rank", r6("semantic_similarity"), r6("blended_score"))


_STABILITY_SQL = """,
both_ AS MATERIALIZED (SELECT query, k, r1.rank AS x, r2.rank AS y FROM r1 JOIN r2 USING (query, k)),
ranked AS (SELECT query, rank() OVER (PARTITION BY query ORDER BY x) + (count(*) OVER (PARTITION BY query, x) - 1) / 2.0 AS rx,
                  rank() OVER (PARTITION BY query ORDER BY y) + (count(*) OVER (PARTITION BY query, y) - 1) / 2.0 AS ry FROM both_),
sp AS (SELECT query, count(*) AS n_overlap, corr(rx, ry) AS s FROM ranked GROUP BY 1),
kd AS (SELECT a.query, sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))) AS t
       FROM both_ a JOIN both_ b ON a.query = b.query AND a.k < b.k GROUP BY 1)
SELECT query, n_overlap, round(s, 6) AS spearman_r, round(t, 6) AS kendall_tau FROM sp JOIN kd USING (query)"""


def _rankings(t):
    return [stage_table(R.rank_many(f, _keyed_vectors(t), _queries(t), ["k"]), "ranks") for f in (_vintage(t, 1998), _vintage(t))]


@check("h7_rank_stability", _MANY_SQL + _STABILITY_SQL)
def h7(t):
    out = R.rank_stability(*_rankings(t), ["k"])
    return out.select("query", "n_overlap", r6("spearman_r"), r6("kendall_tau"))


@check(
    "h7_kendall_with_ties",
    """
    WITH c AS (SELECT c_mktsegment AS g, c_custkey AS k, c_nationkey AS x, CAST(floor(c_acctbal / 500) AS INT) AS y FROM customer)
    SELECT a.g, round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))), 6) AS kendall_tau
    FROM c a JOIN c b ON a.g = b.g AND a.k < b.k GROUP BY 1""",
)
def h7_ties(t):
    df = t("customer").select(
        F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("x"),
        F.floor(F.col("c_acctbal") / 500).alias("y"),
    )
    # Small blocks and no small-table route: the path that large groups take.
    return R.kendall_tau(df, ["g"], "x", "y", ["k"], block=16).select("g", r6("kendall_tau"))


@check(
    "h8_rank_compare_report",
    _MANY_SQL
    + """SELECT query, k, r1.rank AS rank_before, r2.rank AS rank_after, r2.rank - r1.rank AS rank_delta,
         abs(r2.rank - r1.rank) AS rank_delta_abs FROM r1 JOIN r2 USING (query, k)""",
)
def h8(t):
    sides = [(f, _keyed_vectors(t)) for f in (_vintage(t, 1998), _vintage(t))]
    _, changes = R.rank_compare_report(*sides, _queries(t), ["k"])
    return changes.select("query", "k", "rank_before", "rank_after", "rank_delta", "rank_delta_abs")
