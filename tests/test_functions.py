import math

import pytest
from pyspark.sql import functions as F

from arealens import presets
from arealens.functions import predicates as P
from arealens.functions import scalars as S
from arealens.functions.geometry import equirectangular_km, lambert_conformal


def values(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    ("label", "slug"),
    [
        ("OTHER", "act_other_storefront"),
        ("  food services  ", "act_FOOD_SERVICES_storefront"),
        ("HEALTH CARE / SOCIAL-ASSISTANCE", "act_HEALTH_CARE_SOCIAL_ASSISTANCE_storefront"),
        ("", "act_UNKNOWN_storefront"),
        (None, "act_UNKNOWN_storefront"),
        ("--", "act_UNKNOWN_storefront"),
        ("A & B", "act_A_AND_B_storefront"),
    ],
)
def test_category_slug(spark, label, slug):
    assert values(spark, "c string", [(label,)], S.category_slug("c")) == [slug]


@pytest.mark.parametrize(
    ("code", "key"),
    [
        ("101", "MN01"),
        ("318", "BK18"),
        ("100", None),
        ("901", None),
        ("MN1", "MN01"),
        ("BK08", "BK08"),
        ("bk 8", "BK08"),
        ("BX03 & BX06", "BX03"),
        ("BX Community District 8", "BX08"),
        ("BX Community Districts 3 & 6", "BX03"),
        ("BK55 Prospect Park", "BK55"),
        ("BX123", None),
        ("", None),
        ("nan", None),
        (None, None),
    ],
)
def test_join_key(spark, code, key):
    assert values(spark, "c string", [(code,)], S.normalize_join_key("c")) == [key]


def test_every_key_of_a_combined_label(spark):
    rows = [("BX01 & BX02",), ("BX Community Districts 3 & 6",), ("104",), ("park",)]
    assert values(spark, "c string", rows, S.all_join_keys("c")) == [["BX01", "BX02"], ["BX03", "BX06"], ["MN04"], []]


def test_numbers_are_read_strictly(spark):
    rows = [("5",), (" -1.5e2 ",), ("5d",), ("nan",), ("inf",), ("",), (None,), (".5",), ("1,000",)]
    assert values(spark, "c string", rows, S.to_number("c")) == [5.0, -150.0, None, None, None, None, None, 0.5, None]
    assert values(spark, "c string", [(" $1,234.5% ",), ("$",)], S.clean_numeric_string("c")) == [1234.5, None]


def test_missing_group_stays_missing(spark):
    rows = [("m",), (" Staten Isla ",), (None,), ("east river bridges",)]
    assert values(spark, "c string", rows, S.standardize_group("c")) == ["MANHATTAN", "STATEN ISLAND", None, "EAST RIVER BRIDGES"]


def test_group_from_code_takes_the_first_prefix_in_table_order(spark):
    assert values(spark, "c string", [("BX01 MN02",), ("zz",)], S.group_from_code("c")) == ["MANHATTAN", None]


def test_scores_keep_missing_inputs_missing(spark):
    rows = [(10.0, 2.0), (None, 2.0), (-5.0, 2.0), (10.0, -1.0)]
    got = values(spark, "a double, b double", rows, S.competition_score("a", "b"))
    assert got[0] == pytest.approx(math.log1p(10 / 3))
    assert got[1:] == [None, 0.0, None]
    assert values(spark, "a double, b double", rows, S.log_interaction("a", "b"))[1:3] == [None, 0.0]


def test_rounding_follows_the_binary_value(spark):
    got = values(spark, "x double", [(2.675,), (1.015,), (1.005,), (0.125,), (-2.675,), (-0.125,), (2.5e17,), (None,)], S.half_even("x", 2))
    assert got == [2.67, 1.01, 1.0, 0.12, -2.67, -0.12, 2.5e17, None]
    assert values(spark, "x double", [(0.5,), (1.5,), (57.49999999999999,), (-0.5,)], S.half_even("x")) == [0.0, 2.0, 57.0, 0.0]


def test_rounding_is_half_even(spark):
    assert values(spark, "x double", [(0.125,), (0.375,), (2.5,)], S.half_even("x", 2)) == [0.12, 0.38, 2.5]


def test_band_cuts_are_strict(spark):
    cut = S.band("x", presets.FOOT_TRAFFIC_BANDS, presets.FOOT_TRAFFIC_ELSE)
    assert values(spark, "x double", [(5000.0,), (5000.1,), (1500.0,)], cut) == ["high", "very high", "low"]
    assert values(spark, "x int", [(95,), (80,), (65,), (20,), (21,), (None,)], S.percentile_band("x")) == [
        "extreme", "very high", "high", "low", "moderate", "typical",
    ]


def test_lists_and_excerpts(spark):
    rows = [([],), (["a"],), (["a", " ", "b"],), (["a", "b", "c", "d"],)]
    assert values(spark, "x array<string>", rows, S.format_list(F.col("x"), 3)) == ["", "a", "a, and b", "a, b, and c"]
    assert values(spark, "x string", [("abcdef",), ("abc",)], S.excerpt("x", 4)) == ["abc…", "abc"]


def test_period_columns():
    names = ["May23_AM", "May24_AM", "Oct24_MD", "Oct24_MD_x", "loc_AM", "May13_PM"]
    assert S.select_period_columns(names, 2024) == ["May24_AM", "Oct24_MD"]
    assert S.select_period_columns(names, 2023, "upto") == ["May23_AM", "May13_PM"]
    with pytest.raises(ValueError):
        S.select_period_columns(names, 2023, "before")


def test_year_text_and_flags(spark):
    assert values(spark, "c string", [("2020 and 2021",), ("12345",), (None,)], S.max_year_in_text("c")) == [2021, None, None]
    assert values(spark, "c string", [(" yes",), ("y",), (None,)], S.yes_flag("c")) == [1, 0, 0]


def test_labels(spark):
    rows = [("act_FOOD_SERVICES_storefront",), ("act_MOVIES_VIDEO_SOUND_density",), ("avg_pedestrian",), ("act_NEW_KIND_density",)]
    assert values(spark, "c string", rows, S.feature_label("c")) == ["food service", "media and entertainment", "avg pedestrian", "new kind"]


def test_name_search(spark):
    df = spark.createDataFrame([("Harlem",), (None,)], "n string")
    assert df.filter(S.name_search("n", "HAR")).count() == 1
    assert df.filter(S.name_search("n", "")).count() == 2


def test_filters_reject_unknown_bounds():
    with pytest.raises(ValueError):
        P.HardFilter.from_request(min_height=3)


def test_too_few_complete_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    with pytest.raises(ValueError, match="only 1"):
        P.complete_cases(df, ["a", "b"])


def test_lambert_conformal_origin_and_scale(spark):
    # At the projection origin x is the false easting; one degree north is about 364,600 ft.
    rows = [(-74.0, 40.16666666666666), (-74.0, 41.16666666666666)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    x, y = lambert_conformal(F.col("lon"), F.col("lat"))
    (x0, y0), (x1, y1) = [tuple(r) for r in df.select(x, y).collect()]
    assert x0 == pytest.approx(984250.0, abs=0.01) and y0 == pytest.approx(0.0, abs=0.01)
    assert x1 == pytest.approx(984250.0, abs=0.01)
    assert y1 * 0.3048006096012192 == pytest.approx(111_050, rel=2e-3)


def test_equirectangular_error_is_small_near_the_reference_latitude(spark):
    df = spark.createDataFrame([(-74.0, 40.7)], "lon double, lat double")
    x, y = equirectangular_km(F.col("lon"), F.col("lat"), 40.7)
    assert df.select(y).first()[0] == pytest.approx(40.7 * 111.195, rel=1e-4)
    assert df.select(x).first()[0] == pytest.approx(-74 * 111.195 * math.cos(math.radians(40.7)), rel=1e-4)
