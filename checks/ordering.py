"""F and G1: windows, ranking, sorting, limits, category sets."""

from pyspark.sql import functions as F

from arealens.operators import aggregates as A
from arealens.operators import ordering as O
from arealens.operators import ranking as R
from arealens.operators.clustering import zscore
from checks.base import check, r6, s6

_RANK_SQL = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders"


@check("f1_rank_desc", _RANK_SQL)
def f1(t):
    df = t("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return O.rank_desc(df, "o_totalprice", ["o_orderkey"], ["o_custkey"]).drop("o_totalprice")


@check("f1_rank_desc_distributed", _RANK_SQL)
def f1_distributed(t):
    df = t("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return O.rank_desc(df, "o_totalprice", ["o_orderkey"], ["o_custkey"]).drop("o_totalprice")


@check(
    "f1_rank_desc_whole_table",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem""",
)
def f1_whole(t):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return O.rank_desc(t("lineitem").select(*key, "l_extendedprice"), "l_extendedprice", key)


_AVERAGE_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank
FROM lineitem"""


def _average(t, **options):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    return O.rank_average(df, "l_quantity", ["l_returnflag"], **options).drop("l_quantity")


@check("f2_rank_average", _AVERAGE_SQL)
def f2(t):
    return _average(t)


@check("f2_rank_average_distributed", _AVERAGE_SQL)
def f2_distributed(t):
    return _average(t)


_BLEND_SQL = """
SELECT o_orderkey, round(CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE * ((o_totalprice - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END))
   + (1::DOUBLE - 0.7::DOUBLE) * ((kh - k) / (CASE WHEN kh = kl THEN 1 ELSE kh - kl END)) END, 6) + 0.0 AS blended_score
FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 97 AS k, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi,
             max(o_orderkey % 97) OVER w AS kh, min(o_orderkey % 97) OVER w AS kl, count(*) OVER w AS n FROM orders {window})"""


@check("f3_minmax_blend", _BLEND_SQL.format(window="WINDOW w AS ()"))
def f3(t):
    df = t("orders").withColumn("k", F.col("o_orderkey") % 97)
    return R.minmax_blend(df, "o_totalprice", "k", 0.7).select("o_orderkey", r6("blended_score"))


@check("f3_minmax_blend_by_group", _BLEND_SQL.format(window="WINDOW w AS (PARTITION BY o_custkey)"))
def f3_group(t):
    df = t("orders").withColumn("k", F.col("o_orderkey") % 97)
    return R.minmax_blend(df, "o_totalprice", "k", 0.7, ["o_custkey"]).select("o_orderkey", r6("blended_score"))


@check(
    "f3_minmax_blend_null_group",
    _BLEND_SQL.replace("FROM orders", "FROM (SELECT *, nullif(o_custkey % 5, 0) AS g FROM orders)").format(window="WINDOW w AS (PARTITION BY g)"),
)
def f3_null_group(t):
    df = t("orders").withColumn("k", F.col("o_orderkey") % 97).withColumn("g", F.expr("nullif(o_custkey % 5, 0)"))
    return R.minmax_blend(df, "o_totalprice", "k", 0.7, ["g"]).select("o_orderkey", r6("blended_score"))


@check(
    "f4_zscore",
    f"""SELECT c_custkey, {s6('(c_acctbal - a) / (sa + 1e-8)')} AS z_balance, {s6('(c_nationkey - b) / (sb + 1e-8)')} AS z_nation, 0.0::DOUBLE AS z_constant
    FROM customer, (SELECT avg(c_acctbal) AS a, stddev_pop(c_acctbal) AS sa, avg(c_nationkey) AS b, stddev_pop(c_nationkey) AS sb FROM customer)""",
)
def f4(t):
    df = zscore(t("customer").withColumn("constant", F.lit(4.0)), ["c_acctbal", "c_nationkey", "constant"])
    z = F.col("z")
    return df.select("c_custkey", r6(z[0], "z_balance"), r6(z[1], "z_nation"), r6(z[2], "z_constant"))


@check(
    "f5_rank_delta",
    """
    SELECT o_custkey, b - a AS rank_delta, abs(b - a) AS rank_delta_abs FROM (
      SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS a,
             row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS b FROM orders GROUP BY 1)""",
)
def f5(t):
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    ranked = O.rank_desc(O.rank_desc(per, "n", ["o_custkey"], name="a"), "v", ["o_custkey"], name="b")
    return O.rank_delta(ranked, "a", "b").select("o_custkey", "rank_delta", "rank_delta_abs")


@check(
    "f6_top_n_per_group",
    """SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 5""",
)
def f6(t):
    df = t("lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"]
    return O.top_n_per_group(df, ["l_returnflag"], order, 5).withColumn("rank", F.col("rank").cast("long"))


@check("f7_order_by_score", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS score FROM supplier ORDER BY score DESC NULLS LAST")
def f7(t):
    df = t("supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("score"))
    return O.order_by_score(df, "score", "s_suppkey")


@check(
    "f7_order_positions",
    """SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_acctbal > 0 THEN s_acctbal END DESC NULLS LAST, s_suppkey) AS pos FROM supplier""",
)
def f7_positions(t):
    """The place of every row in the order that comes out."""
    placed = f7(t).withColumn("_at", F.monotonically_increasing_id())
    return O.number_rows(placed, ["_at"]).select("s_suppkey", "pos")


@check("f8_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def f8(t):
    return O.top_k(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 50, "o_orderkey")


@check(
    "g1_common_categories",
    """SELECT lower(p_type) || ' and ' || lower(replace(p_brand, '#', ' ')) AS query FROM part WHERE p_size <= 10
       INTERSECT SELECT lower(p_type) || ' and ' || lower(replace(p_brand, '#', ' ')) FROM part WHERE p_size > 45""",
)
def g1(t):
    label = F.concat("p_type", F.lit(" & "), "p_brand")
    counts = A.category_counts(t("part"), ["p_size"], label)
    return R.common_categories(counts.filter("p_size <= 10"), counts.filter("p_size > 45"))
