"""B: projections and scalar functions."""

from pyspark.sql import functions as F

from arealens import presets
from arealens.functions import scalars as S
from arealens.functions.predicates import cap_by_year
from arealens.operators.ranking import dedupe_queries
from checks.base import check, r6, s6
from checks.derived import AREA_SQL, COUNT_COLUMNS, area_table

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_SQL = ", ".join(LINE)

NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

_MESSY_SQL = """CASE l_linenumber WHEN 1 THEN '  ' || l_quantity || ' ' WHEN 2 THEN l_quantity || 'd' WHEN 3 THEN 'nan'
 WHEN 4 THEN '' WHEN 5 THEN '-' || l_quantity WHEN 6 THEN l_suppkey || 'e2' ELSE NULL END"""


def _messy():
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("string")
    return (
        F.when(n == 1, F.concat(F.lit("  "), q, F.lit(" ")))
        .when(n == 2, F.concat(q, F.lit("d")))
        .when(n == 3, "nan")
        .when(n == 4, "")
        .when(n == 5, F.concat(F.lit("-"), q))
        .when(n == 6, F.concat("l_suppkey", F.lit("e2")))
    )


@check(
    "b1_to_number",
    f"""SELECT {LINE_SQL}, CASE WHEN regexp_matches(trim(m), '{NUMBER_RE}') THEN TRY_CAST(trim(m) AS DOUBLE) END AS number
    FROM (SELECT *, {_MESSY_SQL} AS m FROM lineitem)""",
)
def b1(t):
    return t("lineitem").select(*LINE, S.to_number(_messy()).alias("number"))


@check(
    "b2_clean_numeric_string",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderkey * 1000 AS DOUBLE) END AS amount FROM orders",
)
def b2(t):
    text = F.concat(F.lit(" $"), F.format_number(F.col("o_orderkey") * 1000, 0), F.lit("% "))
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(text)
    return t("orders").select("o_orderkey", S.clean_numeric_string(text).alias("amount"))


_GROUP_FORMS = [" mn ", "M", "bx", "x", "Bk", "b", "QN", "q", "si", "s", "Staten Isla", " queens", "Bronx ", "Elsewhere"]
_GROUP_WANT = [
    "MANHATTAN", "MANHATTAN", "BRONX", "BRONX", "BROOKLYN", "BROOKLYN", "QUEENS", "QUEENS", "STATEN ISLAND",
    "STATEN ISLAND", "STATEN ISLAND", "QUEENS", "BRONX", "ELSEWHERE",
]


@check(
    "b3_standardize_group",
    f"SELECT c_custkey, ({_GROUP_WANT!r})[1 + c_custkey % {len(_GROUP_FORMS)}] AS grp FROM customer",
)
def b3(t):
    form = F.element_at(F.array(*[F.lit(x) for x in _GROUP_FORMS]), (F.col("c_custkey") % len(_GROUP_FORMS) + 1).cast("int"))
    return t("customer").select("c_custkey", S.standardize_group(form).alias("grp"))


@check(
    "b4_group_from_code",
    """SELECT c_custkey, (['MANHATTAN','BRONX','MANHATTAN',NULL,'STATEN ISLAND'])[1 + c_custkey % 5] AS grp FROM customer""",
)
def b4(t):
    forms = ["xMN07", "BX01 & BX02", "SI03 MN02", "mn01", "zone SI"]
    code = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return t("customer").select("c_custkey", S.group_from_code(code).alias("grp"))


@check(
    "b5_normalize_join_key",
    """
    SELECT c_custkey, CASE c_custkey % 8
      WHEN 0 THEN CASE WHEN c_nationkey = 0 THEN NULL ELSE 'MN' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END
      WHEN 1 THEN 'BK' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')
      WHEN 2 THEN 'QN' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')
      WHEN 3 THEN 'BX' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')
      WHEN 4 THEN 'BX' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')
      WHEN 5 THEN NULL WHEN 6 THEN NULL
      ELSE 'SI' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS join_key,
    CASE c_custkey % 8 WHEN 4 THEN 2 WHEN 3 THEN 2 WHEN 5 THEN 0 WHEN 6 THEN 0
      WHEN 0 THEN CASE WHEN c_nationkey = 0 THEN 0 ELSE 1 END ELSE 1 END AS n_keys
    FROM customer""",
)
def b5(t):
    k, n = F.col("c_custkey") % 8, F.col("c_nationkey")
    two = F.lpad(n.cast("string"), 2, "0")
    other = F.concat(F.lit(" & "), (n + 30).cast("string"))
    code = (
        F.when(k == 0, F.concat(F.lit("1"), two))
        .when(k == 1, F.concat(F.lit(" bk"), n))
        .when(k == 2, F.concat(F.lit("Part of QN "), two, F.lit(" (north)")))
        .when(k == 3, F.concat(F.lit("BX Community Districts "), n, other))
        .when(k == 4, F.concat(F.lit("BX"), two, F.lit(" & BX40")))
        .when(k == 5, F.concat(F.lit("9"), two))
        .when(k == 6, "nowhere")
        .otherwise(F.concat(F.lit("SI  Community District "), n))
    )
    return t("customer").select(
        "c_custkey", S.normalize_join_key(code).alias("join_key"), F.size(S.all_join_keys(code)).alias("n_keys")
    )


@check(
    "b6_parse_wkt_point",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE -(o_orderkey % 1000) / 10.0 END AS strict_lon,
           CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (o_orderkey % 777) / 10.0 END AS strict_lat,
           -(o_orderkey % 1000) / 10.0 AS lon, (o_orderkey % 777) / 10.0 AS lat
    FROM orders""",
)
def b6(t):
    k = F.col("o_orderkey")
    x, y = (k % 1000) / 10.0, ((k % 777) / 10.0).cast("string")
    # Every tenth longitude is written without decimals, which only the lenient form reads.
    lon = F.when(k % 10 == 0, x.cast("int").cast("string")).otherwise(x.cast("string"))
    text = F.concat(F.lit("POINT (-"), lon, F.lit(" "), y, F.lit(")"))
    strict, lenient = S.parse_wkt_point(text), S.parse_wkt_point(text, strict=False)
    return t("orders").select(
        "o_orderkey",
        strict[0].alias("strict_lon"),
        strict[1].alias("strict_lat"),
        (lenient[0] + 0.0).alias("lon"),
        lenient[1].alias("lat"),
    )


@check(
    "b7_yes_flag",
    "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS flag FROM orders",
)
def b7(t):
    status = F.col("o_orderstatus")
    text = F.when(status == "F", " yes ").when(status == "O", "YES!")
    return t("orders").select("o_orderkey", S.yes_flag(text).cast("int").alias("flag"))


@check(
    "b8_relabel_category",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'other' WHEN 'click' THEN 'other' WHEN 'error' THEN 'UNKNOWN'
              ELSE event_type END AS category FROM events""",
)
def b8(t):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", " Other ")
        .when(kind == "click", "Miscellaneous Other Service")
        .when(kind == "error", "  ")
        .otherwise(F.concat(F.lit(" "), kind))
    )
    return t("events").select("event_id", S.relabel_category(text).alias("category"))


@check(
    "b9_category_slug",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'act_UNKNOWN_storefront'
        WHEN p_partkey % 9 = 1 THEN 'act_other_storefront'
        ELSE 'act_' || upper(replace(p_name, ' ', '_')) || '_AND_' || replace(upper(p_brand), '#', '_') || '_storefront' END AS slug
    FROM part""",
)
def b9(t):
    k = F.col("p_partkey") % 9
    label = (
        F.when(k == 0, " -- ").when(k == 1, "Other").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" & / "), "p_brand", F.lit(".")))
    )
    return t("part").select("p_partkey", S.category_slug(label).alias("slug"))


@check(
    "b10_row_mean_max",
    f"""
    SELECT c_custkey, {s6('list_avg(list_filter(v, lambda x: x IS NOT NULL))')} AS mean, {s6('list_max(v)')} AS peak
    FROM (SELECT c_custkey, [CASE WHEN c_acctbal > 0 THEN c_acctbal END, CASE WHEN c_nationkey > 5 THEN c_nationkey * 1.0 END,
                             CASE WHEN c_acctbal > 5000 THEN c_acctbal / 2 END] AS v FROM customer)""",
)
def b10(t):
    df = t("customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"),
        F.when(F.col("c_nationkey") > 5, F.col("c_nationkey") * 1.0).alias("b"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal") / 2).alias("c"),
    )
    mean, peak = S.row_mean_max(["a", "b", "c"])
    return df.select("c_custkey", r6(mean, "mean"), r6(peak, "peak"))


_PERIODS = {"May95_AM": 1995, "May95_PM": 1995, "Oct96_MD": 1996, "Sept97_PM": 1997, "May98_AM": 1998}
_PERIOD_TOTALS = ", ".join(
    f"sum(o_totalprice) FILTER (WHERE year(o_orderdate) = {y}) + {i} AS {c}" for i, (c, y) in enumerate(_PERIODS.items())
)


@check(
    "b11_select_period_columns",
    f"""
    SELECT o_custkey, {s6('list_avg(list_filter([May95_AM, May95_PM], lambda x: x IS NOT NULL))')} AS exact_mean,
           {s6('list_max([May95_AM, May95_PM, Oct96_MD, Sept97_PM])')} AS upto_peak
    FROM (SELECT o_custkey, {_PERIOD_TOTALS} FROM orders GROUP BY 1)""",
)
def b11(t):
    price, year = F.col("o_totalprice"), F.year("o_orderdate")
    wide = t("orders").groupBy("o_custkey").agg(
        *[(F.sum(F.when(year == y, price)) + i).alias(c) for i, (c, y) in enumerate(_PERIODS.items())]
    )
    # Two-digit years read as 2000+yy, so 95 stands for 2095 here.
    mean, _ = S.row_mean_max(S.select_period_columns(wide.columns, 2095, "exact"))
    _, peak = S.row_mean_max(S.select_period_columns(wide.columns, 2097, "upto"))
    return wide.select("o_custkey", r6(mean, "exact_mean"), r6(peak, "upto_peak"))


@check(
    "b12_max_year_in_text",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL
        ELSE greatest(year(o_orderdate), 1900 + CAST(o_orderkey % 100 AS INT)) END AS latest
    FROM orders""",
)
def b12(t):
    text = F.concat(
        F.year("o_orderdate"), F.lit(" and "), (F.col("o_orderkey") % 100 + 1900).cast("int"), F.lit(" / 123456")
    )
    text = F.when(F.col("o_orderstatus") == "P", "since 95").otherwise(text)
    return t("orders").select("o_orderkey", S.max_year_in_text(text).cast("long").alias("latest"))


@check(
    "b13_cap_by_year",
    """
    SELECT mode, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM (
      SELECT 'upto' AS mode, * FROM orders WHERE year(o_orderdate) <= 1997 AND o_orderstatus <> 'P'
      UNION ALL SELECT 'exact', * FROM orders WHERE year(o_orderdate) = 1997 AND o_orderstatus <> 'P') GROUP BY 1""",
)
def b13(t):
    text = F.date_format("o_orderdate", presets.INCIDENT_DATE_FORMAT)
    text = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(text)
    df = t("orders").select("o_orderkey", text.alias("when"))
    parts = [cap_by_year(df, "when", 1997, m).withColumn("mode", F.lit(m)) for m in ("upto", "exact")]
    return parts[0].unionByName(parts[1]).groupBy("mode").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")
    )


@check(
    "b14_safe_divide",
    f"""
    SELECT {LINE_SQL}, {s6('l_extendedprice / nullif(l_discount, 0)')} AS ratio,
           {s6('coalesce(l_quantity / nullif(l_tax, 0), 0)')} AS filled FROM lineitem""",
)
def b14(t):
    return t("lineitem").select(
        *LINE,
        r6(S.safe_divide("l_extendedprice", "l_discount"), "ratio"),
        r6(F.coalesce(S.safe_divide("l_quantity", "l_tax"), F.lit(0.0)), "filled"),
    )


@check(
    "b15_share_of",
    f"SELECT c_custkey, {s6('CASE WHEN c_acctbal > 0 THEN 100.0 * c_nationkey / c_acctbal END')} AS share FROM customer",
)
def b15(t):
    return t("customer").select("c_custkey", r6(S.share_of("c_nationkey", "c_acctbal"), "share"))


@check(
    "b16_null_as_zero_sum",
    f"""
    SELECT c_custkey, {s6('coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) + coalesce(nullif(c_nationkey, 3), 0)')} AS total
    FROM customer""",
)
def b16(t):
    parts = [F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.nullif(F.col("c_nationkey"), F.lit(3))]
    return t("customer").select("c_custkey", r6(S.null_as_zero_sum(parts), "total"))


@check(
    "b17_log_interaction",
    f"SELECT c_custkey, {s6('ln(1 + greatest(c_acctbal * c_nationkey, 0))')} AS score FROM customer",
)
def b17(t):
    return t("customer").select("c_custkey", r6(S.log_interaction("c_acctbal", "c_nationkey"), "score"))


@check(
    "b18_competition_score",
    f"""
    SELECT l_suppkey, {s6('ln(1 + greatest(n / (flow + 1), 0))')} AS score
    FROM (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS flow FROM lineitem GROUP BY 1)""",
)
def b18(t):
    per = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("flow"))
    return per.select("l_suppkey", r6(S.competition_score("n", "flow"), "score"))


@check(
    "b19_map_key",
    "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name || ' | ' || n_name END AS map_key FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def b19(t):
    code = F.when(F.col("s_acctbal") > 0, F.col("s_name"))
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", S.map_key(code, "n_name").alias("map_key"))


@check("b20_name_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red%'")
def b20(t):
    return t("part").filter(S.name_search("p_name", "RED")).select("p_partkey", "p_name")


@check(
    "b22_activity_label",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'food service' WHEN p_partkey % 3 = 1 THEN lower(p_type)
        ELSE 'avg pedestrian' END AS label FROM part""",
)
def b22(t):
    k = F.col("p_partkey") % 3
    name = (
        F.when(k == 0, "act_FOOD_SERVICES_density")
        .when(k == 1, F.concat(F.lit("act_"), "p_type", F.lit("_storefront")))
        .otherwise("avg_pedestrian")
    )
    return t("part").select("p_partkey", S.feature_label(name).alias("label"))


@check(
    "b23_band",
    f"""
    SELECT event_id, CASE WHEN f > 5000 THEN 'very high' WHEN f > 3000 THEN 'high' WHEN f > 1500 THEN 'moderate' ELSE 'low' END AS flow_band,
      CASE WHEN v > 30 THEN 'extremely dense' WHEN v > 10 THEN 'dense' WHEN v > 3 THEN 'moderate' ELSE 'sparse' END AS density_band,
      CASE WHEN e > 0.8 THEN 'highly diverse' WHEN e > 0.6 THEN 'diverse' WHEN e > 0.4 THEN 'moderate' ELSE 'limited' END AS entropy_band,
      CASE WHEN p IS NULL THEN 'typical' WHEN p >= 95 THEN 'extreme' WHEN p >= 80 THEN 'very high' WHEN p >= 65 THEN 'high'
           WHEN p <= 20 THEN 'low' ELSE 'moderate' END AS percentile_band
    FROM (SELECT event_id, value AS v, value * 100 AS f, value / 100 AS e, nullif(CAST(event_id % 101 AS INT), 50) AS p FROM events)""",
)
def b23(t):
    v = F.col("value")
    pct = F.nullif((F.col("event_id") % 101).cast("int"), F.lit(50))
    return t("events").select(
        "event_id",
        S.band(v * 100, presets.FOOT_TRAFFIC_BANDS, presets.FOOT_TRAFFIC_ELSE).alias("flow_band"),
        S.band(v, presets.DENSITY_BANDS, presets.DENSITY_ELSE).alias("density_band"),
        S.band(v / 100, presets.ENTROPY_BANDS, presets.ENTROPY_ELSE).alias("entropy_band"),
        S.percentile_band(pct).alias("percentile_band"),
    )


@check(
    "b24_format_list",
    """
    SELECT doc_id, CASE len(w) WHEN 0 THEN '' WHEN 1 THEN w[1] ELSE array_to_string(w[1:len(w) - 1], ', ') || ', and ' || w[len(w)] END AS words,
           CASE WHEN length(text) > 420 THEN substr(text, 1, 419) || '…' ELSE text END AS excerpt
    FROM (SELECT doc_id, text, list_filter([lang, '  ', source, CASE WHEN n_chars > 500 THEN 'long' ELSE '' END], lambda x: trim(x) <> '')[1:3] AS w
          FROM documents)""",
)
def b24(t):
    words = F.array("lang", F.lit("  "), "source", F.when(F.col("n_chars") > 500, "long").otherwise(""))
    return t("documents").select("doc_id", S.format_list(words, 3).alias("words"), S.excerpt("text", 420).alias("excerpt"))


@check(
    "b25_query_slug",
    r"""
    SELECT item_id, CASE WHEN s = '' THEN 'query' ELSE s END AS slug
    FROM (SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS s FROM benchmark)""",
)
def b25(t):
    return t("benchmark").select("item_id", S.query_slug("text").alias("slug"))


@check(
    "b25_dedupe_queries",
    "SELECT lower(trim(text)) AS query, min(row_id) AS row_id FROM (SELECT text, conv_id * 1000 + turn AS row_id FROM conversations) GROUP BY 1 HAVING query <> ''",
)
def b25_dedupe(t):
    df = t("conversations").select(F.concat(F.lit("  "), "text", F.lit(" ")).alias("q"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"))
    both = df.unionByName(t("conversations").select(F.col("text").alias("q"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id")))
    return dedupe_queries(both, "q", "row_id")


@check(
    "b18_category_competition",
    AREA_SQL
    + f"SELECT neighborhood, {s6('ln(1 + act_A_AND_F_storefront / (avg_pedestrian + 1))')} AS score FROM feat",
)
def b18_category(t):
    df = area_table(t)
    return df.select("neighborhood", r6(S.competition_score(COUNT_COLUMNS[0], "avg_pedestrian"), "score"))


@check(
    "t11_rounded_texts",
    """SELECT o_orderkey, CAST(printf('%.2f', x) AS DOUBLE) AS two, CAST(printf('%.1f', x) AS DOUBLE) AS one, round_even(100::DOUBLE * (n / 40), 0) AS whole
    FROM (SELECT o_orderkey, CAST(o_orderkey % 4000 * 10 + 5 AS DOUBLE) / 1000 AS x, o_orderkey % 41 AS n FROM orders)""",
)
def t11(t):
    """Values whose decimal text is a tie, as 2.675 and 1.015: the binary value decides."""
    x = (F.col("o_orderkey") % 4000 * 10 + 5).cast("double") / 1000
    share = F.lit(100.0) * ((F.col("o_orderkey") % 41).cast("double") / 40)
    return t("orders").select("o_orderkey", S.half_even(x, 2).alias("two"), S.half_even(x, 1).alias("one"), S.half_even(share).alias("whole"))
