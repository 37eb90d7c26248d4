"""Texts and tables that describe areas and clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from arealens import presets
from arealens.functions import scalars as S
from arealens.functions.templates import fill
from arealens.operators.aggregates import empirical_percentiles, group_concentration, share_name
from arealens.operators.ordering import join_groups, top_n_per_group
from arealens.session import stage_table


def _number(df: DataFrame, name: str) -> Column:
    """The column as a double, 0 for missing values or a missing column."""
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(S.missing_to_null(F.col(name).cast("double")), F.lit(0.0))


def _optional(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    return S.missing_to_null(F.col(name).cast("double"))


def _whole(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def _grouped(x: Column) -> Column:
    return F.format_number(x.cast("bigint").cast("double"), 0)


def _rounded(x: Column, digits: int) -> Column:
    """A rounded number without padding zeros but with at least one decimal."""
    text = F.format_string(f"%.{max(digits, 1)}f", S.half_even(x, digits))
    return F.regexp_replace(text, "(\\.\\d+?)0+$", "$1")


def _fixed(x: Column, digits: int) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", S.half_even(x, digits)))


def category_count_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(presets.CATEGORY_PREFIX) and c.endswith(presets.COUNT_SUFFIX)]


def _category_list(df: DataFrame) -> Column:
    """(count, label) of the categories present, largest first, equal counts in column order."""
    columns = category_count_columns(df)
    if not columns:
        return F.array().cast("array<struct<less:double,at:int,label:string,n:bigint>>")
    items = [
        F.struct(
            (-_number(df, c)).alias("less"),
            F.lit(i).alias("at"),
            S.category_words(F.lit(c)).alias("label"),
            _number(df, c).cast("bigint").alias("n"),
        )
        for i, c in enumerate(columns)
    ]
    return F.array_sort(F.filter(F.array(*items), lambda x: x.getField("less") < 0))


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def text_profile_column(df: DataFrame) -> Column:
    """One descriptive paragraph per area; sentences on optional measures appear only with a value."""

    def n(name: str) -> Column:
        return _number(df, name)

    def o(name: str) -> Column:
        return _optional(df, name)

    density = S.half_even(n("storefront_density_per_km2"), 1)
    entropy = S.half_even(n("category_entropy"), 2)
    flow = n("avg_pedestrian").cast("bigint")
    filings = n("storefront_filing_count").cast("bigint")
    opening = fill(
        presets.PROFILE_OPENING,
        name=F.coalesce(F.col("neighborhood"), F.lit(presets.UNNAMED_AREA)),
        group=F.coalesce(F.col("borough"), F.lit("")),
        area=_rounded(n("area_km2"), 1),
        filings=filings,
        density_band=S.band(density, presets.DENSITY_BANDS, presets.DENSITY_ELSE),
        density=_rounded(density, 1),
        diversity=_whole(n("category_diversity")),
        entropy_band=S.band(entropy, presets.ENTROPY_BANDS, presets.ENTROPY_ELSE),
        entropy=_rounded(entropy, 2),
        flow_band=S.band(flow, presets.FOOT_TRAFFIC_BANDS, presets.FOOT_TRAFFIC_ELSE),
        flow=flow,
        stations=_whole(n("subway_station_count")),
        commercial=_rounded(n("commercial_activity_score"), 0),
        competition=_rounded(n("competitive_score"), 2),
        transit=_rounded(n("transit_activity_score"), 0),
        incidents=_whole(n("shooting_incident_count")),
        construction=_whole(n("construction_jobs")),
        manufacturing=_whole(n("manufacturing_jobs")),
        wholesale=_whole(n("wholesale_jobs")),
        jobs=_whole(n("total_jobs")),
        food=_whole(n("food_services")),
        businesses=_whole(n("total_businesses")),
    )
    # A template is NULL when its value is missing, which drops the sentence.
    proxies = F.array_compact(
        F.array(
            fill(presets.PROFILE_INCOME, income=_grouped(o("nfh_median_income"))),
            fill(presets.PROFILE_DEGREES, degrees=_fixed(o("pct_bachelors_plus"), 0)),
        )
    )
    social = F.when(F.size(proxies) > 0, fill(presets.PROFILE_SOCIAL, items=F.array_join(proxies, "; ")))
    commute = fill(presets.PROFILE_COMMUTE, commute=_fixed(o("commute_public_transit"), 0))
    residents = F.when(
        o("total_population_proxy") > 0,
        fill(
            presets.PROFILE_RESIDENTS,
            black=_grouped(n("pop_black")),
            hispanic=_grouped(n("pop_hispanic")),
            asian=_grouped(n("pop_asian")),
            total=_grouped(n("total_population_proxy")),
        ),
    )
    listed = F.transform(_category_list(df), lambda x: fill(presets.PROFILE_CATEGORY, label=x.label, n=x.n))
    categories = F.when(F.size(listed) > 0, fill(presets.PROFILE_CATEGORIES, items=F.array_join(listed, ", ")))
    by_activity = F.when(
        filings > 0, F.concat(fill(presets.PROFILE_FILINGS, filings=filings), _or_empty(categories))
    )
    health = fill(presets.PROFILE_HEALTH, score=_fixed(o("nfh_overall_score"), 2))
    shocks = fill(presets.PROFILE_SHOCKS, score=_fixed(o("nfh_goal4_fin_shocks_score"), 2))
    return F.concat(opening, *[_or_empty(x) for x in (social, commute, residents, by_activity, health, shocks)])


def text_profile(df: DataFrame, name: str = "text") -> DataFrame:
    return df.withColumn(name, text_profile_column(df))


def labelled_profile_column(df: DataFrame) -> Column:
    """A heading, one line per present value, category counts and the paragraph, line by line."""
    heading = F.when(
        F.coalesce(F.col("borough"), F.lit("")) != "", F.concat("neighborhood", F.lit(" ("), "borough", F.lit(")"))
    ).otherwise(F.col("neighborhood"))
    lines = [heading, F.repeat(F.lit("-"), F.length(heading))]
    for label, column in presets.LABELLED_VALUES:
        if column in df.columns:
            value = F.col(column).cast("string")
            present = _optional(df, column).isNotNull()
            lines.append(F.when(present, F.concat(F.lit(f"{label}: "), value)))
    by_count = F.array_sort(
        F.transform(_category_list(df), lambda x: F.struct(x.less.alias("less"), x.label.alias("label"), x.n.alias("n")))
    )
    counts = F.transform(by_count, lambda x: fill(presets.LABELLED_COUNT, label=x.label, n=x.n))
    block = F.when(F.size(counts) > 0, F.concat(F.array(F.lit(presets.LABELLED_COUNTS_HEADING)), counts))
    tail = F.array(F.lit(presets.LABELLED_TEXT_HEADING), text_profile_column(df))
    everything = F.concat(F.array(*lines), F.coalesce(block, F.array().cast("array<string>")), tail)
    return F.array_join(F.array_compact(everything), "\n")


def labelled_profile(df: DataFrame, name: str = "profile") -> DataFrame:
    return df.withColumn(name, labelled_profile_column(df))


def write_profiles(df: DataFrame, path: str, name: str = "profile") -> None:
    """One text block per area, blocks separated by an empty line."""
    df.select(F.concat(F.col(name), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def cluster_metrics(
    members: DataFrame, master: DataFrame, metrics: Sequence[tuple[str, str]] = presets.CLUSTER_METRICS
) -> DataFrame:
    """Per cluster and metric: size, mean, share of all areas at or below the mean, and its band."""
    present = [m for m, _ in metrics if m in members.columns and m in master.columns]
    means = members.groupBy("cluster").agg(
        F.count("*").alias("size"), *[F.avg(S.missing_to_null(F.col(m).cast("double"))).alias(m) for m in present]
    )
    # written once: a mean that is computed again may differ in its last bit and would not be found
    long = stage_table(means.unpivot(["cluster", "size"], present, "feature", "mean"), "cluster-means")
    found = empirical_percentiles(master, present, long.select("feature", F.col("mean").alias("value")))
    out = join_groups(long.withColumnRenamed("mean", "value"), found, ["feature", "value"], "left")
    return out.select(
        "cluster", "size", "feature", F.col("value").alias("mean"), "percentile", S.percentile_band("percentile").alias("band")
    )


def no_activity(df: DataFrame) -> Column:
    """Filings, commercial and competition score all zero or missing."""
    return (
        (_number(df, "storefront_filing_count") <= 0)
        & (_number(df, "commercial_activity_score") <= 0)
        & (_number(df, "competitive_score") <= 0)
    )


def no_activity_flags(members: DataFrame, representatives: DataFrame | None = None, key: str = "neighborhood") -> DataFrame:
    """Per cluster: members without activity, whether all are, and whether it dominates the cluster."""
    flagged = members.withColumn("_idle", no_activity(members))
    filings, commercial, competition = (
        _number(members, c) for c in ("storefront_filing_count", "commercial_activity_score", "competitive_score")
    )
    out = flagged.groupBy("cluster").agg(
        F.count("*").alias("size"),
        F.count_if("_idle").alias("n_no_activity"),
        ((F.sum(filings) <= 0) & (F.max(commercial) <= 0) & (F.max(competition) <= 0)).alias("none"),
    )
    if representatives is not None:
        named = representatives.select("cluster", F.lower(F.col(key)).alias("_name"))
        # Matched by lower-case name, as several areas may differ only by case.
        idle = flagged.filter("_idle").select("cluster", F.lower(F.col(key)).alias("_name")).distinct()
        reps = named.join(idle.withColumn("_hit", F.lit(1)), ["cluster", "_name"], "left")
        reps = reps.groupBy("cluster").agg(F.count("*").alias("_reps"), F.count("_hit").alias("_idle_reps"))
        out = out.join(reps, "cluster", "left")
    else:
        out = out.withColumns({"_reps": F.lit(0), "_idle_reps": F.lit(0)})
    reps = F.coalesce("_reps", F.lit(0))
    by_reps = (reps > 0) & (F.coalesce("_idle_reps", F.lit(0)) >= F.least(F.lit(2), reps))
    prominent = F.col("none") | (F.col("n_no_activity") / F.col("size") >= 0.5) | by_reps
    return out.withColumn("prominent", prominent).drop("_reps", "_idle_reps")


def cluster_title(centroids: DataFrame) -> DataFrame:
    """Title per cluster: the first rule its centroid meets. A signal is the highest of its features;
    a feature that was not clustered counts as very low."""
    features = sorted({f for signal in presets.TITLE_SIGNALS.values() for f in signal})
    wide = centroids.groupBy("cluster").agg(
        *[F.coalesce(F.max(F.when(F.col("feature") == f, F.col("z"))), F.lit(presets.MISSING_Z)).alias(f) for f in features]
    )
    signals = wide.select(
        "cluster",
        *[(F.greatest(*fs) if len(fs) > 1 else F.col(fs[0])).alias(name) for name, fs in presets.TITLE_SIGNALS.items()],
    )
    met = [F.when(F.expr(test), F.lit(title)) for test, title in presets.TITLE_RULES]
    return signals.select("cluster", F.coalesce(*met, F.lit(presets.TITLE_ELSE)).alias("title"))


def override_title(none: Column, prominent: Column, title: Column) -> Column:
    return (
        F.when(none, presets.TITLE_NO_ACTIVITY).when(prominent, presets.TITLE_MOSTLY_NO_ACTIVITY).otherwise(title)
    )


def _ranked_names(
    centroids: DataFrame, keep: Column, order: Sequence[Column | str], label: Column, n: int, name: str
) -> DataFrame:
    top = top_n_per_group(centroids.filter(keep), ["cluster"], order, n, "_at")
    items = F.sort_array(F.collect_list(F.struct("_at", label.alias("_label"))))
    return top.groupBy("cluster").agg(F.transform(items, lambda x: x.getField("_label")).alias(name))


def high_low_features(
    centroids: DataFrame, high: float = 0.45, low: float = -0.45, n_high: int = 4, n_low: int = 3, labels=S.feature_label
) -> DataFrame:
    """Per cluster the labels of the features clearly above and below average, strongest first."""
    label = labels("feature")
    ups = _ranked_names(centroids, F.col("z") >= high, [F.desc("z"), "position"], label, n_high, "high")
    downs = _ranked_names(centroids, F.col("z") <= low, ["z", "position"], label, n_low, "low")
    empty = F.array().cast("array<string>")
    out = centroids.select("cluster").distinct().join(ups, "cluster", "left").join(downs, "cluster", "left")
    return out.select("cluster", F.coalesce("high", empty).alias("high"), F.coalesce("low", empty).alias("low"))


def brief_description(centroids: DataFrame, high: float = 0.5, low: float = -0.5) -> DataFrame:
    """One sentence per cluster on its strongest features, in four variants."""
    names = high_low_features(centroids, high, low, 3, 2, S.pretty_feature)
    ups, downs = F.array_join("high", ", "), F.array_join("low", ", ")
    has_up, has_down = F.size("high") > 0, F.size("low") > 0
    cuts = {"high_cut": F.lit(f"{high:g}"), "low_cut": F.lit(f"{low:g}")}
    text = (
        F.when(has_up & has_down, fill(presets.BRIEF_BOTH, high=ups, low=downs))
        .when(has_up, fill(presets.BRIEF_HIGH, high=ups))
        .when(has_down, fill(presets.BRIEF_LOW, low=downs, **cuts))
        .otherwise(fill(presets.BRIEF_NONE, **cuts))
    )
    return names.select("cluster", text.alias("description"))


def category_mix(members: DataFrame, master: DataFrame, centroids: DataFrame) -> DataFrame:
    """Per cluster: top categories by mean share with part of filings and percentile, then the
    elevated and the sparse categories of its centroid."""
    counts = [c for c in category_count_columns(members) if share_name(c) in members.columns and share_name(c) in master.columns]
    every_count = category_count_columns(members)
    shares = [share_name(c) for c in counts]
    sums = members.groupBy("cluster").agg(
        F.sum(_number(members, "storefront_filing_count")).alias("_filings"),
        *[F.sum(_number(members, c)).alias(c) for c in every_count],
        *[F.avg(S.missing_to_null(F.col(s).cast("double"))).alias(s) for s in shares],
    )
    total = F.lit(0.0)
    for c in every_count:
        total = total + F.col(c)
    base = F.greatest(F.when(F.col("_filings") > 0, F.col("_filings")).otherwise(total), F.lit(1.0))
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(s).alias("feature"),
            F.col(c).alias("n"), F.col(s).alias("mean_share"),
        )
        for i, (c, s) in enumerate(zip(counts, shares))
    ])
    long = stage_table(sums.select("cluster", base.alias("_base"), F.inline(cells)).filter("n > 0"), "cluster-shares")
    asked = long.select("feature", F.col("mean_share").alias("value"))
    found = empirical_percentiles(master, shares, asked)
    placed = join_groups(long.withColumnRenamed("mean_share", "value"), found, ["feature", "value"])
    ranked = placed.filter("percentile is not null").select(
        "cluster", "position", "column", F.col("value").alias("mean_share"), "percentile",
        S.half_even(100 * F.col("n") / F.col("_base")).cast("int").alias("share"),
    )
    bit = fill(
        presets.MIX_CATEGORY, label=S.activity_label("column"), share=F.col("share"), percentile=F.col("percentile")
    )
    top = _ranked_names(ranked, F.lit(True), [F.desc("mean_share"), "position"], bit, 3, "top")
    is_share = F.col("feature").isin(*shares) if shares else F.lit(False)
    label = fill(presets.MIX_SCORED, label=S.activity_label("feature"), z=_fixed(F.col("z"), 2))
    ups = _ranked_names(centroids, is_share & (F.col("z") >= 0.45), [F.desc("z"), "position"], label, 4, "elevated")
    downs = _ranked_names(centroids, is_share & (F.col("z") <= -0.45), ["z", "position"], label, 3, "sparse")
    out = top.join(ups, "cluster", "left").join(downs, "cluster", "left")
    sentences = F.array_compact(
        F.array(
            fill(presets.MIX_TOP, items=S.format_list(F.col("top"), 3)),
            fill(presets.MIX_ELEVATED, items=S.format_list(F.col("elevated"), 4)),
            fill(presets.MIX_SPARSE, items=S.format_list(F.col("sparse"), 3)),
        )
    )
    return out.select("cluster", "top", "elevated", "sparse", F.array_join(sentences, " ").alias("mix"))


def cluster_description(
    members: DataFrame,
    master: DataFrame,
    centroids: DataFrame,
    representatives: DataFrame | None = None,
    key: str = "neighborhood",
    group: str = "borough",
) -> DataFrame:
    """One text per cluster: title, activity notes, strong and weak features, profile signals,
    category mix, main groups and nearest text profiles."""
    flags = no_activity_flags(members, representatives, key)
    # clusters that have a centroid but no members keep a row
    flags = centroids.select("cluster").distinct().join(flags, "cluster", "left").withColumns(
        {"size": F.coalesce("size", F.lit(0).cast("long")), "none": F.coalesce("none", F.lit(False)), "prominent": F.coalesce("prominent", F.lit(False))}
    )
    metric_order = F.create_map(*[x for i, (m, _) in enumerate(presets.CLUSTER_METRICS) for x in (F.lit(m), F.lit(i))])
    metric_label = F.create_map(*[x for m, label in presets.CLUSTER_METRICS for x in (F.lit(m), F.lit(label))])
    metrics = cluster_metrics(members, master).filter("percentile is not null").withColumn(
        "_bit",
        fill(
            presets.CLUSTER_SIGNAL,
            band=F.col("band"),
            label=metric_label[F.col("feature")],
            percentile=F.col("percentile"),
        ),
    )
    signals = _ranked_names(metrics, F.lit(True), [metric_order[F.col("feature")]], F.col("_bit"), 3, "signals")
    groups = group_concentration(members.filter(F.col(group).isNotNull()), "cluster", group).withColumn("_at", F.col("rank"))
    groups = groups.groupBy("cluster").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_at", F.initcap(S.strip(group)).alias("g")))), lambda x: x.getField("g")
        ).alias("groups")
    )
    parts = [cluster_title(centroids), high_low_features(centroids), signals, category_mix(members, master, centroids), groups]
    if representatives is not None:
        reps = representatives.groupBy("cluster").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(key).alias("n")))), lambda x: x.getField("n")).alias("reps")
        )
        parts.append(reps)
    out = flags
    for part in parts:
        out = out.join(part, "cluster", "left")
    reps_list = F.col("reps") if representatives is not None else F.lit(None).cast("array<string>")
    none, prominent = F.col("none"), F.col("prominent")
    title = override_title(none, prominent, F.col("title"))

    def listing(template: str, items: Column, joined: Column) -> Column:
        return F.when(F.size(items) > 0, fill(template, items=joined))

    def named(template: str, items: Column, limit: int) -> Column:
        return listing(template, items, S.format_list(items, limit))

    places = F.array_compact(
        F.array(
            named(presets.CLUSTER_GROUPS, F.col("groups"), 3),
            named(presets.CLUSTER_REPRESENTATIVES, reps_list, 3),
        )
    )
    idle_note = F.when(none, F.lit(presets.CLUSTER_NO_ACTIVITY)).when(
        prominent, fill(presets.CLUSTER_MOSTLY_NO_ACTIVITY, idle=F.col("n_no_activity"), size=F.col("size"))
    )
    sentences = F.array_compact(
        F.array(
            fill(presets.CLUSTER_HEADING, cluster=F.col("cluster"), title=title),
            idle_note,
            named(presets.CLUSTER_HIGH, F.col("high"), 4),
            named(presets.CLUSTER_LOW, F.col("low"), 3),
            listing(presets.CLUSTER_SIGNALS, F.col("signals"), F.array_join("signals", "; ")),
            F.when(~prominent & (F.col("mix") != ""), F.col("mix")),
            listing(presets.CLUSTER_PLACES, places, F.array_join(places, "; ")),
        )
    )
    return out.select(
        "cluster",
        "size",
        title.alias("title"),
        F.array_join(sentences, " ").alias("description"),
    )


