"""P: tables and texts that describe areas and clusters."""

from pyspark.sql import functions as F

from arealens import presets
from arealens.operators import clustering as K
from arealens.operators import profiles as P
from arealens.session import scratch_path, stage_table
from checks.base import check, r6, s6
from checks.derived import AREA_SQL, CATEGORIES, COUNT_COLUMNS, SHARE_COLUMNS, area_table

_ROUNDED = [
    "avg_pedestrian", "category_entropy", "storefront_density_per_km2", "subway_density_per_km2", "commercial_activity_score",
    "competitive_score", "transit_activity_score", "nfh_median_income", "nfh_overall_score", "construction_jobs",
    "total_population_proxy", "pop_black", "pop_hispanic", "pop_asian", "pct_bachelors_plus",
]


def _rounded_areas(t):
    """Areas with measures rounded, so that texts do not show differences in the last bit; some gaps."""
    df = area_table(t)
    df = df.select(*[F.round(c, 6).alias(c) if c in _ROUNDED else c for c in df.columns])
    gap = F.substring("cd", 3, 2).cast("int") % 4 == 0
    return df.withColumns({
        "pct_bachelors_plus": F.when(~gap, F.col("pct_bachelors_plus")),
        "commute_public_transit": F.when(gap, F.round(F.col("area_km2") * 1.37, 6)),
        "nfh_overall_score": F.when(~gap, F.col("nfh_overall_score")),
        "total_jobs": F.col("construction_jobs"),
    })


def _decimal(expr: str, digits: int) -> str:
    text = f"printf('%.{max(digits, 1)}f', {expr if digits else f'round_even({expr}, 0)'})"
    return f"regexp_replace({text}, '(\\.\\d+?)0+$', '\\1')" if digits > 1 else text


_LISTED = "[" + ", ".join(f"{{'less': -act_{c}_storefront, 'at': {i}, 'label': '{c.replace('_', ' ')}', 'n': act_{c}_storefront}}" for i, c in enumerate(CATEGORIES)) + "]"

_TEXT_SQL = (
    AREA_SQL.rstrip()
    + """,
rnd AS (SELECT * REPLACE ("""
    + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED)
    + """) FROM feat),
gaps AS (SELECT * REPLACE (CASE WHEN p_size % 4 <> 0 THEN pct_bachelors_plus END AS pct_bachelors_plus,
                          CASE WHEN p_size % 4 <> 0 THEN nfh_overall_score END AS nfh_overall_score),
           CASE WHEN p_size % 4 = 0 THEN round(area_km2 * 1.37::DOUBLE, 6) END AS commute_public_transit, construction_jobs AS total_jobs
         FROM rnd),
cats AS (SELECT *, list_filter(list_sort("""
    + _LISTED
    + """), lambda x: x.less < 0) AS cat FROM gaps),
text AS (SELECT *, concat(
  neighborhood, ' in ', borough, '. CDTA area about ', """
    + _decimal("area_km2", 1)
    + """, ' km2. ', storefront_filing_count, ' non-vacant storefront filings; ',
  CASE WHEN CAST(printf('%.1f', storefront_density_per_km2) AS DOUBLE) > 30 THEN 'extremely dense' WHEN CAST(printf('%.1f', storefront_density_per_km2) AS DOUBLE) > 10 THEN 'dense'
       WHEN CAST(printf('%.1f', storefront_density_per_km2) AS DOUBLE) > 3 THEN 'moderate' ELSE 'sparse' END, ' filing density (', """
    + _decimal("storefront_density_per_km2", 1)
    + """, '/km2). ', category_diversity, ' distinct primary-business-activity buckets from storefront filings. Activity mix diversity is ',
  CASE WHEN CAST(printf('%.2f', category_entropy) AS DOUBLE) > 0.8 THEN 'highly diverse' WHEN CAST(printf('%.2f', category_entropy) AS DOUBLE) > 0.6 THEN 'diverse'
       WHEN CAST(printf('%.2f', category_entropy) AS DOUBLE) > 0.4 THEN 'moderate' ELSE 'limited' END, ' (entropy ', """
    + _decimal("category_entropy", 2)
    + """, '). ', CASE WHEN trunc(avg_pedestrian) > 5000 THEN 'very high' WHEN trunc(avg_pedestrian) > 3000 THEN 'high'
       WHEN trunc(avg_pedestrian) > 1500 THEN 'moderate' ELSE 'low' END, ' foot traffic (avg ', CAST(trunc(avg_pedestrian) AS BIGINT),
  ' pedestrians). ', subway_station_count, ' subway stations nearby. Commercial activity score ', """
    + _decimal("commercial_activity_score", 0)
    + ", ', competitive score ', "
    + _decimal("competitive_score", 2)
    + ", ', transit activity score ', "
    + _decimal("transit_activity_score", 0)
    + """, '. 2024 shooting incident count ', shooting_incident_count, '. Employment composition (counts): construction ',
  CAST(trunc(construction_jobs) AS BIGINT), ', manufacturing 0, wholesale 0, total jobs ', CAST(trunc(total_jobs) AS BIGINT),
  '. Business stock proxies: food services 0, total businesses 0.',
  ' Community socioeconomic proxies: NFH median income about $', format('{:,}', CAST(trunc(nfh_median_income) AS BIGINT)),
  CASE WHEN pct_bachelors_plus IS NOT NULL THEN '; about ' || printf('%.0f', round_even(pct_bachelors_plus, 0)) || '% adults with bachelor''s or higher (community profile)' ELSE '' END, '.',
  CASE WHEN commute_public_transit IS NOT NULL THEN ' About ' || printf('%.0f', round_even(commute_public_transit, 0)) || '% of workers commute by public transit (community profile).' ELSE '' END,
  ' Community demographics (MOCEJ-style resident counts by group, not percentages): Black population about ', format('{:,}', CAST(trunc(pop_black) AS BIGINT)),
  '; Hispanic population about ', format('{:,}', CAST(trunc(pop_hispanic) AS BIGINT)), '; Asian population about ', format('{:,}', CAST(trunc(pop_asian) AS BIGINT)),
  '; total population proxy (sum of those three groups) about ', format('{:,}', CAST(trunc(total_population_proxy) AS BIGINT)), '.',
  CASE WHEN storefront_filing_count > 0 THEN ' Non-vacant storefront filings by primary business activity: ' || storefront_filing_count || ' total. Counts by activity: '
     || array_to_string(list_transform(cat, lambda x: x.label || ' (' || x.n || ')'), ', ') || '.' ELSE '' END,
  CASE WHEN nfh_overall_score IS NOT NULL THEN ' Neighborhood financial health overall index score is ' || printf('%.2f', CAST(printf('%.2f', nfh_overall_score) AS DOUBLE)) || '.' ELSE '' END
  ) AS text FROM cats)
"""
)


@check("p1_text_profile", _TEXT_SQL + "SELECT neighborhood, text FROM text")
def p1(t):
    return P.text_profile(_rounded_areas(t)).select("neighborhood", "text")


_PRESENT = [(label, c) for label, c in presets.LABELLED_VALUES if c in set(_ROUNDED) | {
    "area_km2", "storefront_filing_count", "category_diversity", "subway_station_count", "shooting_incident_count",
    "commute_public_transit", "total_jobs"}]

_LABELLED_SQL = (
    _TEXT_SQL.rstrip()
    + """,
labelled AS (SELECT neighborhood, array_to_string(list_filter(list_concat(
    [neighborhood || ' (' || borough || ')', repeat('-', length(neighborhood || ' (' || borough || ')')),
     """
    + ", ".join(f"'{label.replace(chr(39), chr(39) * 2)}: ' || CAST({c} AS VARCHAR)" for label, c in _PRESENT)
    + """],
    CASE WHEN len(cat) > 0 THEN list_concat(['Storefront activity counts:'],
      list_transform(list_sort(list_transform(cat, lambda x: {'less': x.less, 'label': x.label, 'n': x.n})), lambda x: '  - ' || x.label || ': ' || x.n)) ELSE [] END,
    ['Embedding text:', text]), lambda x: x IS NOT NULL), chr(10)) AS profile FROM text)
"""
)


@check("p2_labelled_profile", _LABELLED_SQL + "SELECT neighborhood, profile FROM labelled")
def p2(t):
    return P.labelled_profile(_rounded_areas(t)).select("neighborhood", "profile")


@check("p3_write_profiles", _LABELLED_SQL + "SELECT unnest(string_split(profile || chr(10), chr(10))) AS line, count(*) AS n FROM labelled GROUP BY 1")
def p3(t):
    path = scratch_path(t.spark, "profiles")
    P.write_profiles(P.labelled_profile(_rounded_areas(t)), path)
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


# --- clusters: areas with a vector, grouped by its label -----------------------


def _master(t):
    """Areas whose every tenth code has no filings at all."""
    df = area_table(t)
    idle = F.substring("cd", 3, 2).cast("int") % 10 == 0
    gone = ["storefront_filing_count", "commercial_activity_score", "competitive_score"]
    df = df.select(*[F.when(~idle, F.col(c)).alias(c) if c in gone else c for c in df.columns])
    return stage_table(df, "master")


def _members(t, master):
    labels = t("embeddings").select(F.concat(F.lit("Area "), "vec_id").alias("neighborhood"), F.col("label").alias("cluster"))
    return stage_table(master.join(labels, "neighborhood"), "members")


_FEATURES = [
    *SHARE_COLUMNS, "storefront_density_per_km2", "avg_pedestrian", "category_entropy", "transit_activity_score", "subway_station_count",
]


def _centroids(members, scale=6.0):
    """Centroids of the labelled clusters, stretched so that the cut points of the texts matter."""
    scaled = K.zscore(members, _FEATURES)
    z = F.posexplode("z").alias("position", "z")
    names = F.element_at(F.array(*[F.lit(f) for f in _FEATURES]), F.col("position") + 1)
    long = scaled.select("cluster", z).withColumn("feature", names)
    means = long.groupBy("cluster", "position", "feature").agg((F.avg("z") * scale).alias("z"))
    return stage_table(means.withColumn("z", F.round("z", 6)), "centroids")


_CLUSTER_SQL = (
    AREA_SQL.rstrip()
    + """,
master AS MATERIALIZED (SELECT * REPLACE (
    CASE WHEN p_size % 10 <> 0 THEN storefront_filing_count END AS storefront_filing_count,
    CASE WHEN p_size % 10 <> 0 THEN commercial_activity_score END AS commercial_activity_score,
    CASE WHEN p_size % 10 <> 0 THEN competitive_score END AS competitive_score) FROM feat),
members AS MATERIALIZED (SELECT m.*, e.label AS cluster FROM master m JOIN embeddings e ON m.neighborhood = 'Area ' || e.vec_id),
wide AS ("""
    + " UNION ALL ".join(
        f"SELECT cluster, {i} AS position, '{f}' AS feature, ({f} - avg({f}) OVER ()) / (stddev_pop({f}) OVER () + 1e-8) AS z FROM members"
        for i, f in enumerate(_FEATURES)
    )
    + """),
cent AS MATERIALIZED (SELECT cluster, position, feature, round(avg(z) * 6, 6) AS z FROM wide GROUP BY 1, 2, 3)
"""
)
_METRICS = [m for m, _ in presets.CLUSTER_METRICS]
_METRIC_SQL = """,
mm AS (""" + " UNION ALL ".join(
    f"SELECT cluster, count(*) AS size, '{m}' AS feature, avg({m}) AS mean FROM members GROUP BY 1" for m in _METRICS
) + """),
long_master AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT '{m}' AS feature, {m} AS x FROM master" for m in _METRICS) + """),
metrics AS MATERIALIZED (SELECT mm.cluster, any_value(size) AS size, mm.feature, any_value(mean) AS mean,
   CAST(round_even(100::DOUBLE * (count(*) FILTER (WHERE x <= mean) / count(x)), 0) AS INT) AS percentile
   FROM mm JOIN long_master l ON l.feature = mm.feature GROUP BY mm.cluster, mm.feature),
banded AS (SELECT *, CASE WHEN percentile >= 95 THEN 'extreme' WHEN percentile >= 80 THEN 'very high' WHEN percentile >= 65 THEN 'high'
   WHEN percentile <= 20 THEN 'low' ELSE 'moderate' END AS band FROM metrics)
"""


@check("p4_cluster_metrics", _CLUSTER_SQL.rstrip() + _METRIC_SQL + f"SELECT cluster, size, feature, {s6('mean')} AS mean, percentile, band FROM banded")
def p4(t):
    master = _master(t)
    out = P.cluster_metrics(_members(t, master), master)
    return out.select("cluster", "size", "feature", r6("mean"), "percentile", "band")


_FLAG_SQL = """,
reps AS MATERIALIZED (SELECT * FROM (SELECT cluster, neighborhood, row_number() OVER (PARTITION BY cluster ORDER BY area_km2 DESC, neighborhood) AS rank
   FROM members) WHERE rank <= 3),
flags AS (SELECT m.cluster, count(*) AS size, count(*) FILTER (WHERE storefront_filing_count IS NULL) AS n_no_activity,
     coalesce(sum(storefront_filing_count), 0) <= 0 AS none, any_value(r.n_reps) AS n_reps, any_value(r.n_idle) AS n_idle
   FROM members m JOIN (SELECT r.cluster, count(*) AS n_reps, count(*) FILTER (WHERE x.storefront_filing_count IS NULL) AS n_idle
        FROM reps r JOIN members x USING (neighborhood) GROUP BY 1) r ON r.cluster = m.cluster GROUP BY 1),
flagged AS (SELECT cluster, size, n_no_activity, none, none OR n_no_activity / size >= 0.5 OR n_idle >= least(2, n_reps) AS prominent FROM flags)
"""


def _representatives(members):
    from arealens.operators.ordering import top_n_per_group

    return top_n_per_group(members.select("cluster", "neighborhood", "area_km2"), ["cluster"], [F.desc("area_km2"), "neighborhood"], 3)


@check("p5_no_activity_flags", _CLUSTER_SQL.rstrip() + _FLAG_SQL + "SELECT * FROM flagged")
def p5(t):
    members = _members(t, _master(t))
    return P.no_activity_flags(members, _representatives(members))


@check("p5_no_activity_rows", _CLUSTER_SQL + "SELECT neighborhood, storefront_filing_count IS NULL AS idle FROM members")
def p5_rows(t):
    members = _members(t, _master(t))
    return members.select("neighborhood", P.no_activity(members).alias("idle"))


_TITLE_SQL = """,
zw AS (SELECT cluster, max(z) FILTER (WHERE feature = 'storefront_density_per_km2') AS dense,
     greatest(max(z) FILTER (WHERE feature = 'transit_activity_score'), max(z) FILTER (WHERE feature = 'subway_station_count')) AS transit,
     max(z) FILTER (WHERE feature = 'avg_pedestrian') AS foot, max(z) FILTER (WHERE feature = 'category_entropy') AS mix FROM cent GROUP BY 1),
titles AS (SELECT cluster, CASE WHEN dense >= 0.8 AND foot >= 0.4 AND mix >= 0 THEN 'Dense Mixed-Use Commercial Core'
     WHEN dense >= 0.8 AND foot >= 0.4 THEN 'High-Traffic Commercial Core' WHEN transit >= 0.8 AND dense >= 0 THEN 'Transit-Oriented Commercial District'
     WHEN dense <= -0.5 AND transit <= 0 THEN 'Lower-Density Local Commercial Area' ELSE 'Balanced Neighborhood Market' END AS title FROM zw)
"""


@check("p6_cluster_title", _CLUSTER_SQL.rstrip() + _TITLE_SQL + "SELECT * FROM titles")
def p6(t):
    return P.cluster_title(_centroids(_members(t, _master(t))))


def _label(column: str) -> str:
    return f"lower(replace(regexp_replace(regexp_replace({column}, '^act_', ''), '(_storefront|_density)$', ''), '_', ' '))"


def _join(items: str) -> str:
    """SQL twin of the readable list of already limited items."""
    return (
        f"CASE len({items}) WHEN 1 THEN {items}[1] ELSE array_to_string({items}[1:len({items}) - 1], ', ') || ', and ' || {items}[len({items})] END"
    )


_NAME = f"CASE WHEN feature LIKE 'act\\_%' ESCAPE '\\' THEN {_label('feature')} ELSE replace(feature, '_', ' ') END"


def _top_sql(name: str, source: str, where: str, order: str, item: str, n: int) -> str:
    return f"""{name} AS (SELECT cluster, list(item ORDER BY place) AS items FROM (SELECT cluster, {item} AS item,
        row_number() OVER (PARTITION BY cluster ORDER BY {order}) AS place FROM {source} WHERE {where}) WHERE place <= {n} GROUP BY 1)"""


_MIX_SQL = (
    """,
sums AS ("""
    + " UNION ALL ".join(
        f"SELECT cluster, {i} AS position, 'act_{c}_storefront' AS col, 'act_{c}_density' AS feature, sum(act_{c}_storefront) AS n, avg(act_{c}_density) AS mean_share, "
        f"coalesce(sum(storefront_filing_count), 0) AS filings, {' + '.join(f'sum({x})' for x in COUNT_COLUMNS)} AS total FROM members GROUP BY 1"
        for i, c in enumerate(CATEGORIES)
    )
    + """),
shares AS MATERIALIZED ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x FROM master" for c in SHARE_COLUMNS)
    + """),
placed AS MATERIALIZED (SELECT cluster, position, any_value(col) AS col, s.feature, any_value(mean_share) AS mean_share,
     CAST(round_even(100.0 * any_value(n) / greatest(any_value(CASE WHEN filings > 0 THEN filings ELSE total END), 1), 0) AS INT) AS share,
     CAST(round_even(100::DOUBLE * (count(*) FILTER (WHERE x <= mean_share) / count(x)), 0) AS INT) AS percentile
   FROM sums s JOIN shares h ON h.feature = s.feature WHERE n > 0 GROUP BY cluster, position, s.feature),
"""
    + _top_sql("tops", "placed", "true", "mean_share DESC, position", f"{_label('col')} || '—' || share || '% of filings, ' || percentile || 'th pct density'", 3)
    + ", "
    + _top_sql("ups", "cent", "z >= 0.45 AND feature LIKE 'act%'", "z DESC, position", f"{_label('feature')} || ' (' || printf('%.2f', CAST(printf('%.2f', z) AS DOUBLE)) || ')'", 4)
    + ", "
    + _top_sql("downs", "cent", "z <= -0.45 AND feature LIKE 'act%'", "z, position", f"{_label('feature')} || ' (' || printf('%.2f', CAST(printf('%.2f', z) AS DOUBLE)) || ')'", 3)
    + f""",
mixes AS (SELECT tops.cluster, 'Granular storefront mix: top categories by density are ' || {_join('tops.items')} || '.'
    || CASE WHEN ups.items IS NOT NULL THEN ' Unusually elevated category densities include ' || {_join('ups.items')} || '.' ELSE '' END
    || CASE WHEN downs.items IS NOT NULL THEN ' Comparatively sparse categories include ' || {_join('downs.items')} || '.' ELSE '' END AS mix
  FROM tops LEFT JOIN ups USING (cluster) LEFT JOIN downs USING (cluster))
"""
)


@check("p7_category_mix", _CLUSTER_SQL.rstrip() + _MIX_SQL + "SELECT cluster, mix FROM mixes")
def p7(t):
    master = _master(t)
    members = _members(t, master)
    return P.category_mix(members, master, _centroids(members)).select("cluster", "mix")


_HIGH_LOW_SQL = (
    ",\n"
    + _top_sql("hi4", "cent", "z >= 0.45", "z DESC, position", _NAME, 4)
    + ", "
    + _top_sql("lo3", "cent", "z <= -0.45", "z, position", _NAME, 3)
    + ", "
    + _top_sql("hi3", "cent", "z >= 0.5", "z DESC, position", "replace(feature, '_', ' ')", 3)
    + ", "
    + _top_sql("lo2", "cent", "z <= -0.5", "z, position", "replace(feature, '_', ' ')", 2)
    + "\n"
)


@check(
    "p8_high_low_features",
    _CLUSTER_SQL.rstrip()
    + _HIGH_LOW_SQL
    + """SELECT c.cluster, coalesce(array_to_string(hi4.items, '; '), '') AS high, coalesce(array_to_string(lo3.items, '; '), '') AS low
    FROM (SELECT DISTINCT cluster FROM cent) c LEFT JOIN hi4 USING (cluster) LEFT JOIN lo3 USING (cluster)""",
)
def p8(t):
    out = P.high_low_features(_centroids(_members(t, _master(t))))
    return out.select("cluster", F.array_join("high", "; ").alias("high"), F.array_join("low", "; ").alias("low"))


@check(
    "p8_brief_description",
    _CLUSTER_SQL.rstrip()
    + _HIGH_LOW_SQL
    + """SELECT c.cluster, CASE
      WHEN hi3.items IS NOT NULL AND lo2.items IS NOT NULL
        THEN 'Above average on ' || array_to_string(hi3.items, ', ') || '; relatively lower on ' || array_to_string(lo2.items, ', ') || '.'
      WHEN hi3.items IS NOT NULL THEN 'Above average on ' || array_to_string(hi3.items, ', ') || '.'
      WHEN lo2.items IS NOT NULL THEN 'No feature is strongly above the filtered-set average (z < 0.5); relatively lower on ' || array_to_string(lo2.items, ', ') || '.'
      ELSE 'Mid-range on all selected features for this filter (no z ≥ 0.5 or z ≤ -0.5 at the cluster centroid).' END AS description
    FROM (SELECT DISTINCT cluster FROM cent) c LEFT JOIN hi3 USING (cluster) LEFT JOIN lo2 USING (cluster)""",
)
def p8_brief(t):
    return P.brief_description(_centroids(_members(t, _master(t))))


_LABEL_SQL = "CASE feature " + " ".join(f"WHEN '{m}' THEN '{label}'" for m, label in presets.CLUSTER_METRICS) + " END"
_ORDER_SQL = "CASE feature " + " ".join(f"WHEN '{m}' THEN {i}" for i, (m, _) in enumerate(presets.CLUSTER_METRICS)) + " END"


@check(
    "p9_cluster_description",
    _CLUSTER_SQL.rstrip()
    + _METRIC_SQL.rstrip()
    + _FLAG_SQL.rstrip()
    + _TITLE_SQL.rstrip()
    + _MIX_SQL.rstrip()
    + _HIGH_LOW_SQL.rstrip()
    + ",\n"
    + _top_sql("signals", "banded", "percentile IS NOT NULL", _ORDER_SQL,
               f"band || ' ' || {_LABEL_SQL} || ' (around the ' || percentile || 'th percentile citywide)'", 3)
    + """,
groups AS (SELECT cluster, list(g ORDER BY n DESC, b) [1:3] AS items FROM (SELECT cluster, borough AS b,
     upper(borough[1]) || lower(borough[2:]) AS g, count(*) AS n FROM members GROUP BY 1, 2, 3) GROUP BY 1),
named AS (SELECT cluster, list(neighborhood ORDER BY rank) AS items FROM reps GROUP BY 1)
SELECT f.cluster, f.size, CASE WHEN none THEN 'No Recorded Commercial Activity Zone' WHEN prominent THEN 'Mostly No-Activity / Special-Use Geography' ELSE title END AS title,
  concat('Cluster ', f.cluster, ' - ', CASE WHEN none THEN 'No Recorded Commercial Activity Zone' WHEN prominent THEN 'Mostly No-Activity / Special-Use Geography' ELSE title END, '.',
  CASE WHEN none THEN ' """
    + presets.CLUSTER_NO_ACTIVITY
    + """' WHEN prominent THEN ' ' || n_no_activity || ' of ' || f.size || '"""
    + presets.CLUSTER_MOSTLY_NO_ACTIVITY.replace("{idle} of {size}", "")
    + f"""' ELSE '' END,
  CASE WHEN hi4.items IS NOT NULL THEN ' Characterized by elevated ' || {_join('hi4.items')} || '.' ELSE '' END,
  CASE WHEN lo3.items IS NOT NULL THEN ' Relatively lower on ' || {_join('lo3.items')} || '.' ELSE '' END,
  ' Profile signals include ', array_to_string(signals.items, '; '), '.',
  CASE WHEN NOT prominent AND mix IS NOT NULL THEN ' ' || mix ELSE '' END,
  ' Concentrated in ', {_join('groups.items')}, '; nearest text-profile matches include ', {_join('named.items')}, '.') AS description
FROM flagged f JOIN titles USING (cluster) LEFT JOIN hi4 USING (cluster) LEFT JOIN lo3 USING (cluster) JOIN signals USING (cluster)
  LEFT JOIN mixes USING (cluster) JOIN groups USING (cluster) JOIN named USING (cluster)""",
)
def p9(t):
    master = _master(t)
    members = _members(t, master)
    return P.cluster_description(members, master, _centroids(members), _representatives(members))
