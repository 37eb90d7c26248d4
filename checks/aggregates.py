"""E: aggregations."""

from pyspark.sql import functions as F

from arealens import presets
from arealens.functions.predicates import stage_counts
from arealens.operators import aggregates as A
from arealens.session import stage_table
from checks.base import check, r6, s6
from checks.derived import AREA_SQL, COUNT_COLUMNS, SHARE_COLUMNS, area_table

FLAG_SQL = "l_returnflag || ' & ' || l_linestatus"


@check(
    "e1_flow_features",
    f"""SELECT user_id, {s6('avg(value)')} AS avg_pedestrian, max(value) AS peak_pedestrian,
        count(CASE WHEN event_type <> 'error' THEN 1 END) AS pedestrian_count_points FROM events GROUP BY 1""",
)
def e1(t):
    df = t("events").select(
        "user_id",
        F.col("value").alias("avg_pedestrian"),
        F.col("value").alias("peak_pedestrian"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("street"),
    )
    out = A.flow_features(df, ["user_id"])
    return out.withColumn("avg_pedestrian", r6("avg_pedestrian"))


@check(
    "e1_flow_null_group",
    f"""SELECT CASE WHEN event_type <> 'view' THEN event_type END AS area, {s6('avg(value)')} AS avg_pedestrian,
        max(value) AS peak_pedestrian, count(*) AS pedestrian_count_points FROM events GROUP BY 1""",
)
def e1_null(t):
    area = F.when(F.col("event_type") != "view", F.col("event_type")).alias("area")
    df = t("events").select(area, F.col("value").alias("avg_pedestrian"), F.col("value").alias("peak_pedestrian"))
    out = A.flow_features(df, ["area"])
    return out.withColumn("avg_pedestrian", r6("avg_pedestrian"))


@check("e2_distinct_count_features", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def e2(t):
    return A.distinct_count_features(t("lineitem"), ["l_suppkey"], "l_partkey", "n_parts")


@check(
    "e3_incident_features",
    """SELECT event_type, 'keyed' AS kind, count(DISTINCT user_id) AS n FROM events GROUP BY 1
       UNION ALL SELECT event_type, 'rows', count(*) FILTER (WHERE value > 1) FROM events GROUP BY 1""",
)
def e3(t):
    keyed = t("events").withColumnRenamed("user_id", "incident_key")
    rows = t("events").withColumn("latitude", F.when(F.col("value") > 1, F.col("value")))
    one = A.incident_features(keyed, ["event_type"], name="n").withColumn("kind", F.lit("keyed"))
    two = A.incident_features(rows, ["event_type"], name="n").withColumn("kind", F.lit("rows"))
    return one.unionByName(two)


@check(
    "e4_category_counts",
    f"""SELECT l_suppkey, CASE WHEN l_returnflag = 'N' THEN 'act_other_storefront'
          ELSE 'act_' || l_returnflag || '_AND_' || l_linestatus || '_storefront' END AS category, count(*) AS n
        FROM lineitem GROUP BY 1, 2""",
)
def e4(t):
    label = F.concat("l_returnflag", F.lit(" & "), "l_linestatus")
    # Two spellings of one category add up.
    label = F.when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "F", "Other").otherwise("OTHER ")).otherwise(label)
    return A.category_counts(t("lineitem"), ["l_suppkey"], label)


_PIVOT = ", ".join(
    f"count(*) FILTER (WHERE l_returnflag = '{f}' AND l_linestatus = '{s}') AS act_{f}_AND_{s}_storefront" for f in "ANR" for s in "FO"
)


@check("e4_category_pivot", f"SELECT l_partkey, count(*) AS storefront_filing_count, {_PIVOT} FROM lineitem GROUP BY 1")
def e4_pivot(t):
    label = F.concat("l_returnflag", F.lit(" & "), "l_linestatus")
    counts = stage_table(A.category_counts(t("lineitem"), ["l_partkey"], label), "counts")
    return A.category_pivot(counts, ["l_partkey"], A.category_values(counts))


@check(
    "e5_pivot_first",
    """
    SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P') AS urgent_score,
           arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority = '5-LOW' AND o_orderstatus <> 'P') AS low_score
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1""",
)
def e5(t):
    df = t("orders").withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return A.pivot_first(df, "o_custkey", "o_orderpriority", "v", {"1-URGENT": "urgent", "5-LOW": "low"}, "o_orderkey", "_score")


@check(
    "e6_e7_category_profile",
    f"""
    SELECT l_suppkey, count(*) AS category_diversity, {s6('-sum(p * ln(p))')} AS category_entropy
    FROM (SELECT l_suppkey, n / sum(n) OVER (PARTITION BY l_suppkey) AS p FROM
          (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)) GROUP BY 1""",
)
def e6(t):
    counts = A.category_counts(t("lineitem"), ["l_suppkey"], F.concat("l_returnflag", F.lit(" & "), "l_linestatus"))
    out = A.category_profile(counts, ["l_suppkey"])
    return out.withColumn("category_entropy", r6("category_entropy"))


@check("e7_wide_entropy", AREA_SQL + f"SELECT neighborhood, category_diversity, {s6('category_entropy')} AS category_entropy FROM feat")
def e7(t):
    df = area_table(t)
    return df.select("neighborhood", A.wide_diversity(COUNT_COLUMNS).alias("category_diversity"), r6(A.wide_entropy(COUNT_COLUMNS), "category_entropy"))


@check("e8_category_shares", AREA_SQL + "SELECT neighborhood, " + ", ".join(f"{s6(c)} AS {c}" for c in SHARE_COLUMNS) + " FROM feat")
def e8(t):
    df = area_table(t).select("neighborhood", "storefront_filing_count", *COUNT_COLUMNS)
    return A.category_shares(df, COUNT_COLUMNS).select("neighborhood", *[r6(c) for c in SHARE_COLUMNS])


_GAPS_SQL = """
WITH raw AS (SELECT c_custkey, CASE WHEN c_nationkey <> 9 THEN c_nationkey END AS grp,
                    CASE WHEN c_acctbal > 2000 AND c_nationkey <> 3 THEN c_acctbal END AS a,
                    CASE WHEN c_nationkey < 20 AND c_acctbal < 0 THEN c_acctbal END AS b, CAST(NULL AS DOUBLE) AS z FROM customer),
g AS (SELECT grp, median(a) AS a, median(b) AS b FROM raw WHERE grp IS NOT NULL GROUP BY 1),
f AS (SELECT c_custkey, raw.grp, coalesce(raw.a, g.a) AS a, coalesce(raw.b, g.b) AS b FROM raw LEFT JOIN g USING (grp)),
o AS (SELECT median(a) AS a, median(b) AS b FROM f)
"""


def _gaps(t):
    n, bal = F.col("c_nationkey"), F.col("c_acctbal")
    return t("customer").select(
        "c_custkey",
        F.when(n != 9, n).alias("grp"),
        F.when((bal > 2000) & (n != 3), bal).alias("a"),
        F.when((n < 20) & (bal < 0), bal).otherwise(F.lit(float("nan"))).alias("b"),
        F.lit(None).cast("double").alias("z"),
    )


@check(
    "e9_impute_hierarchical",
    _GAPS_SQL + f"SELECT c_custkey, f.grp, {s6('coalesce(f.a, o.a)')} AS a, {s6('coalesce(f.b, o.b)')} AS b, 0.0::DOUBLE AS z FROM f, o",
)
def e9(t):
    out = A.impute_hierarchical(_gaps(t), ["a", "b", "z"], "grp", zero_columns=["z"])
    return out.select("c_custkey", "grp", r6("a"), r6("b"), "z")


@check(
    "e9_impute_bracketed",
    _GAPS_SQL + f"SELECT c_custkey, f.grp, {s6('coalesce(f.a, o.a)')} AS a, {s6('coalesce(f.b, o.b)')} AS b FROM f, o",
)
def e9_bracketed(t):
    # The route for large tables: sketch, bracket, exact count inside the bracket.
    out = A.impute_hierarchical(_gaps(t), ["a", "b"], "grp")
    return out.select("c_custkey", "grp", r6("a"), r6("b"))


@check(
    "e9_exact_quantile",
    f"""SELECT l_returnflag, {s6('quantile_cont(l_extendedprice, 0.9)')} AS l_extendedprice, {s6('quantile_cont(l_quantity, 0.9)')} AS l_quantity
        FROM lineitem GROUP BY 1""",
)
def e9_quantile(t):
    out = A.exact_quantile(t("lineitem"), ["l_returnflag"], ["l_extendedprice", "l_quantity"], 0.9)
    return out.select("l_returnflag", r6("l_extendedprice"), r6("l_quantity"))


@check(
    "e10_fill_zero",
    "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
)
def e10(t):
    counts = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return A.fill_zero(t("customer").select("c_custkey").join(counts, "c_custkey", "left"), ["n_orders", "absent"])


_RANGES = [c for c in presets.RANGE_COLUMNS + presets.INDEX_RANGE_COLUMNS if c not in ("total_jobs", "nfh_goal4_fin_shocks_score")]


@check(
    "e11_feature_ranges",
    AREA_SQL
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {s6(f'min({c})')} AS \"min\", {s6(f'max({c})')} AS \"max\" FROM feat" for c in _RANGES),
)
def e11(t):
    out = A.feature_ranges(area_table(t).withColumn("total_jobs", F.lit(None).cast("double")))
    return out.select("feature", r6("min"), r6("max"))


@check("e11_groups", "SELECT DISTINCT p_type AS borough FROM part WHERE p_type <> 'PROMO'")
def e11_groups(t):
    return A.distinct_groups(t("part").select(F.nullif("p_type", F.lit("PROMO")).alias("borough")), "borough")


@check(
    "e11_presence_flags",
    "SELECT false AS has_nfh_goal4_fin_shocks_score, count(*) > 0 AS has_nfh_overall_score FROM customer WHERE c_acctbal > 0",
)
def e11_presence(t):
    return A.presence_flags(t("customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("nfh_overall_score")))


@check(
    "e12_null_audit",
    """SELECT * FROM (SELECT 'a' AS "column", count(*) - count(CASE WHEN l_discount > 0.05 THEN 1 END) AS n_null FROM lineitem
       UNION ALL SELECT 'b', count(*) - count(CASE WHEN l_tax > 0.07 THEN 1 END) FROM lineitem) WHERE n_null > 0""",
)
def e12(t):
    return A.null_audit(
        t("lineitem").select(
            "l_orderkey",
            F.when(F.col("l_discount") > 0.05, F.lit(1)).alias("a"),
            F.when(F.col("l_tax") > 0.07, F.lit(1)).alias("b"),
        )
    )


@check(
    "e13_describe",
    f"""SELECT count(l_extendedprice) AS "count", {s6('avg(l_extendedprice)')} AS mean, {s6('stddev_samp(l_extendedprice)')} AS std,
        min(l_extendedprice) AS "min", {s6('quantile_cont(l_extendedprice, 0.25)')} AS p25, {s6('quantile_cont(l_extendedprice, 0.5)')} AS p50,
        {s6('quantile_cont(l_extendedprice, 0.75)')} AS p75, max(l_extendedprice) AS "max" FROM lineitem""",
)
def e13(t):
    out = A.describe(t("lineitem"), "l_extendedprice")
    return out.select("count", *[r6(c) for c in ("mean", "std", "p25", "p50", "p75")], "min", "max")


@check(
    "e14_group_concentration",
    """SELECT * FROM (SELECT c_nationkey, c_mktsegment, count(*) AS members,
         CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS INT) AS rank FROM customer GROUP BY 1, 2) WHERE rank <= 3""",
)
def e14(t):
    return A.group_concentration(t("customer"), "c_nationkey", "c_mktsegment")


_PERCENTILE_SQL = """
SELECT v AS mean_price, CASE WHEN v IS NULL THEN NULL ELSE CAST(round_even(100::DOUBLE * ((SELECT count(*) FROM lineitem WHERE l_extendedprice <= v)
   / (SELECT count(*) FROM lineitem)), 0) AS INT) END AS percentile
FROM (SELECT DISTINCT round(CASE WHEN s_acctbal > 0 THEN s_acctbal * 10 END, 6) AS v FROM supplier)"""


def _asked(t):
    return t("supplier").select(F.round(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 10), 6).alias("mean_price"))


@check("e15_empirical_percentile", _PERCENTILE_SQL)
def e15(t):
    return A.empirical_percentile(t("lineitem"), "l_extendedprice", _asked(t), "mean_price")


@check("e15_percentile_many_values", _PERCENTILE_SQL)
def e15_many(t):
    # The route for many values: one distributed sort of data and values together.
    out = A.empirical_percentiles(
        t("lineitem"), ["l_extendedprice"],
        _asked(t).select(F.lit("l_extendedprice").alias("feature"), F.col("mean_price").alias("value")),
    )
    return out.select(F.col("value").alias("mean_price"), "percentile")


@check(
    "e18_stage_counts",
    """SELECT count(*) AS n_before, count(*) FILTER (WHERE year(o_orderdate) <= 1998) AS in_years,
       count(*) FILTER (WHERE year(o_orderdate) <= 1998 AND o_orderstatus <> 'P') AS settled FROM orders""",
)
def e18(t):
    return stage_counts(t("orders"), {"in_years": F.year("o_orderdate") <= 1998, "settled": F.col("o_orderstatus") != "P"})
