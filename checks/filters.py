"""C: filters and predicates."""

from pyspark.sql import functions as F

from arealens.functions import predicates as P
from arealens.operators.ordering import dedupe_first, number_rows, order_by_score
from checks.base import check, r6, s6
from checks.derived import AREA_SQL, SHARE_COLUMNS, area_table

BOUNDS = {"min_avg_pedestrian": 2400, "min_storefront_filings": 20, "min_nfh_overall": 3, "max_competitive_score": 0.02}
BOUND_SQL = "avg_pedestrian >= 2400 AND storefront_filing_count >= 20 AND nfh_overall_score >= 3 AND competitive_score <= 0.02"


@check(
    "c1_hard_filter",
    AREA_SQL
    + f"""SELECT neighborhood, borough, {s6('commercial_activity_score')} AS commercial_activity_score FROM feat
    WHERE borough IN ('PROMO', 'SMALL') AND {BOUND_SQL}""",
)
def c1(t):
    spec = P.HardFilter.from_request(boroughs=["PROMO", "SMALL"], min_subway_stations=None, **BOUNDS)
    kept = order_by_score(P.hard_filter(area_table(t), spec), "commercial_activity_score", "neighborhood")
    return kept.select("neighborhood", "borough", r6("commercial_activity_score"))


@check(
    "c1_filter_order",
    AREA_SQL
    + f"""SELECT neighborhood, row_number() OVER (ORDER BY commercial_activity_score DESC NULLS LAST, neighborhood) AS pos FROM feat
    WHERE borough IN ('PROMO', 'SMALL') AND {BOUND_SQL}""",
)
def c1_order(t):
    """The place of every row that the filter keeps."""
    return number_rows(c1(t).withColumn("_at", F.monotonically_increasing_id()), ["_at"]).select("neighborhood", "pos")


@check("c1_filter_counts", AREA_SQL + f"SELECT count(*) AS n_total, count(*) FILTER (WHERE {BOUND_SQL}) AS n_filtered FROM feat")
def c1_counts(t):
    return P.filter_counts(area_table(t), P.HardFilter.from_request(**BOUNDS))


@check("c1_filter_null_group", "SELECT c_custkey FROM customer WHERE c_nationkey <> 7 AND c_acctbal >= 100 AND c_acctbal > 500")
def c1_null(t):
    # A missing group drops out even without a list, a missing measure fails a set bound.
    df = t("customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") != 7, F.col("c_mktsegment")).alias("borough"),
        F.when(F.col("c_acctbal") > 500, F.col("c_acctbal")).alias("avg_pedestrian"),
    )
    return P.hard_filter(df, P.HardFilter.from_request(min_avg_pedestrian=100)).select("c_custkey")


@check(
    "c2_valid_coordinates",
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderstatus <> 'P'",
)
def c2(t):
    k = F.col("o_orderkey")
    df = t("orders").select(
        "o_orderkey",
        ((k % 7) / 10).alias("longitude"),
        F.when(F.col("o_orderstatus") != "P", (k % 11) / 10).alias("latitude"),
    )
    return df.filter(P.valid_coordinates()).select("o_orderkey")


@check(
    "c3_domain_filters",
    """SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0
       AND c_nationkey % 4 <> 1 AND c_nationkey % 3 <> 0
    UNION ALL SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0
       AND c_nationkey % 4 <> 1 AND c_nationkey % 3 <> 0""",
)
def c3(t):
    n = F.col("c_nationkey")
    df = t("customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
        F.when(n % 2 == 0, F.lit(0)).alias("flag_a"),
        (n % 4 == 1).cast("int").alias("flag_b"),
        F.when(n % 3 != 0, F.concat(F.lit("QN"), n)).otherwise("??").alias("code"),
    )
    return df.filter(
        P.not_listed("segment", ["BUILDING"]) & P.positive("balance") & P.no_flag_set(["flag_a", "flag_b"]) & P.known_code("code")
    ).select("c_custkey")


@check("c4_complete_cases", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey <> 4")
def c4(t):
    df = t("supplier").select(
        "s_suppkey",
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("a"),
        F.when(F.col("s_nationkey") != 4, F.col("s_nationkey")).alias("b"),
    )
    return P.complete_cases(df, ["a", "b"]).select("s_suppkey")


@check(
    "c5_columns_like",
    AREA_SQL + "SELECT neighborhood, " + ", ".join(f"{s6(c)} AS {c}" for c in SHARE_COLUMNS) + " FROM feat",
)
def c5(t):
    df = area_table(t).withColumn("act_UNKNOWN_density", F.lit(0.0))
    return df.select("neighborhood", *[r6(c) for c in P.columns_like(df, "_density")])


@check(
    "c6_dedupe_first",
    "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1",
)
def c6(t):
    return dedupe_first(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])
