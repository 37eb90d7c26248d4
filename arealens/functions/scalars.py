"""Column expressions: cleaning, keys, scores, labels. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from arealens import presets

_BLANKS = " \t\n\r\f\u000b"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(_col(c), F.lit(_BLANKS))


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """Value of ``c`` in a small constant table, NULL if absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), c)


def missing_to_null(c: Column | str) -> Column:
    """NaN marks a missing number at the sources; the library knows only NULL."""
    return F.nanvl(_col(c), F.lit(None))


def to_number(c: Column | str) -> Column:
    """Number from text; anything that is not a plain decimal becomes NULL.

    The shape check keeps casts from reading "5d" as 5.0 or "nan" as a number.
    """
    text = strip(_col(c).cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def clean_numeric_string(c: Column | str) -> Column:
    """Number from text with thousands separators, currency or percent signs."""
    return to_number(F.regexp_replace(_col(c).cast("string"), "[,$%]", ""))


def standardize_group(c: Column | str, aliases: Mapping[str, str] = presets.GROUP_ALIASES) -> Column:
    text = F.upper(strip(c))
    return F.coalesce(lookup(text, aliases), text)


def group_from_code(c: Column | str, groups: Mapping[str, str] = presets.GROUP_BY_PREFIX) -> Column:
    """Group of the first prefix, in table order, that occurs anywhere in the code."""
    c = _col(c)
    return F.coalesce(*[F.when(F.contains(c, F.lit(p)), F.lit(g)) for p, g in groups.items()])


def _pad2(digits: Column) -> Column:
    return F.lpad(digits.try_cast("int").cast("string"), 2, "0")


def normalize_join_key(
    c: Column | str,
    prefixes: Sequence[str] = presets.CODE_PREFIXES,
    digit_prefix: Mapping[str, str] = presets.DIGIT_TO_PREFIX,
    long_words: str = presets.LONG_CODE_WORDS,
) -> Column:
    """Canonical ``PREFIX + two digits`` key from numeric, short, embedded or long area codes."""
    text = F.upper(strip(_col(c).cast("string")))
    any_prefix = "|".join(prefixes)

    number = F.regexp_extract(text, r"^(\d{3})$", 1)
    from_number = F.when(
        F.substring(number, 2, 2) != "00",
        F.concat(lookup(F.substring(number, 1, 1), digit_prefix), F.substring(number, 2, 2)),
    )

    def matched(pattern: str) -> Column:
        return F.when(
            text.rlike(pattern),
            F.concat(F.regexp_extract(text, pattern, 1), _pad2(F.regexp_extract(text, pattern, 2))),
        )

    short_or_embedded = matched(rf"({any_prefix})\s*0*(\d{{1,2}})\b")
    long_label = matched(rf"({any_prefix}){long_words}(\d{{1,2}})")
    return F.when(number != "", from_number).otherwise(F.coalesce(short_or_embedded, long_label))


def all_join_keys(
    c: Column | str,
    prefixes: Sequence[str] = presets.CODE_PREFIXES,
    long_words: str = presets.LONG_CODE_WORDS,
) -> Column:
    """Every key of a combined label ("BX01 & BX02", "BX Community Districts 3 & 6") as an array."""
    text = F.upper(strip(_col(c).cast("string")))
    any_prefix = "|".join(prefixes)
    short = rf"(?:{any_prefix})\s*\d{{1,2}}\b"
    shorts = F.transform(F.regexp_extract_all(text, F.lit(short), F.lit(0)), lambda x: normalize_join_key(x))
    long_pattern = rf"({any_prefix}){long_words}(\d{{1,2}}(?:\s*&\s*\d{{1,2}})*)"
    prefix = F.regexp_extract(text, long_pattern, 1)
    numbers = F.regexp_extract_all(F.regexp_extract(text, long_pattern, 2), F.lit(r"\d{1,2}"), F.lit(0))
    longs = F.transform(numbers, lambda n: F.concat(prefix, _pad2(n)))
    one = normalize_join_key(c)
    return (
        F.when(F.size(shorts) > 0, F.array_distinct(shorts))
        .when(F.size(longs) > 0, F.array_distinct(longs))
        .when(one.isNotNull(), F.array(one))
        .otherwise(F.array().cast("array<string>"))
    )


def parse_wkt_point(c: Column | str, strict: bool = True) -> tuple[Column, Column]:
    """(longitude, latitude) of ``POINT (x y)``; NULL where the text has another form."""
    c = _col(c)
    lon, lat = (
        (presets.WKT_STRICT_LON, presets.WKT_STRICT_LAT)
        if strict
        else (presets.WKT_LENIENT_LON, presets.WKT_LENIENT_LAT)
    )
    return to_number(F.regexp_extract(c, lon, 1)), to_number(F.regexp_extract(c, lat, 1))


def yes_flag(c: Column | str) -> Column:
    return F.coalesce(F.upper(strip(_col(c).cast("string"))) == "YES", F.lit(False)).cast("byte")


def relabel_category(c: Column | str) -> Column:
    label = F.coalesce(strip(c), F.lit(""))
    return (
        F.when(F.upper(label).isin(*presets.OTHER_ACTIVITIES), presets.OTHER_LABEL)
        .when(label == "", presets.UNKNOWN_LABEL)
        .otherwise(label)
    )


def category_slug(
    c: Column | str, prefix: str = presets.CATEGORY_PREFIX, suffix: str = presets.COUNT_SUFFIX
) -> Column:
    """Stable column name of a category; labels that differ only in case or punctuation share it."""
    label = F.coalesce(strip(c), F.lit(""))
    text = F.replace(F.replace(F.upper(label), F.lit("&"), F.lit("AND")), F.lit("/"), F.lit("_"))
    slug = F.btrim(F.regexp_replace(text, "[^A-Z0-9]+", "_"), F.lit("_"))
    slug = (
        F.when(F.lower(label) == presets.OTHER_LABEL, presets.OTHER_LABEL)
        .when(slug == "", presets.UNKNOWN_LABEL)
        .otherwise(slug)
    )
    return F.concat(F.lit(prefix), slug, F.lit(suffix))


def row_mean_max(columns: Sequence[str]) -> tuple[Column, Column]:
    """Mean and maximum across columns of one row, ignoring NULLs; NULL if all are missing."""
    if not columns:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    cols = [_col(c).cast("double") for c in columns]
    total, present = F.lit(0.0), F.lit(0)
    for c in cols:
        total = total + F.coalesce(c, F.lit(0.0))
        present = present + c.isNotNull().cast("int")
    peak = F.greatest(*cols) if len(cols) > 1 else cols[0]
    return F.try_divide(total, present), peak


def select_period_columns(columns: Sequence[str], year: int, mode: str = "exact") -> list[str]:
    """Count columns whose name carries the year (``exact``) or an earlier one (``upto``)."""
    if mode not in ("exact", "upto"):
        raise ValueError(f"mode must be 'exact' or 'upto', got {mode!r}")
    chosen = []
    for name in columns:
        found = re.search(presets.PERIOD_YEAR, name)
        if not found or not any(mark in name for mark in presets.PERIOD_MARKS):
            continue
        column_year = 2000 + int(found.group(1))
        if column_year == year or (mode == "upto" and column_year < year):
            chosen.append(name)
    return chosen


def max_year_in_text(c: Column | str) -> Column:
    years = F.regexp_extract_all(_col(c).cast("string"), F.lit(r"\b(\d{4})\b"), F.lit(1))
    return F.array_max(F.transform(years, lambda y: y.cast("int")))


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """Quotient, NULL for a zero divisor."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def share_of(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.when(b > 0, F.lit(100.0) * a / b)


def null_as_zero_sum(columns: Sequence[Column | str]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(_col(c).cast("double"), F.lit(0.0))
    return total


def _log1p_floor(x: Column) -> Column:
    # greatest() skips NULLs, so a missing input has to be kept missing explicitly.
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def log_interaction(a: Column | str, b: Column | str) -> Column:
    return _log1p_floor(_col(a).cast("double") * _col(b))


def competition_score(n: Column | str, flow: Column | str) -> Column:
    return _log1p_floor(F.try_divide(_col(n).cast("double"), _col(flow) + 1.0))


def map_key(code: Column | str, group: Column | str) -> Column:
    return F.concat(_col(code), F.lit(" | "), _col(group))


def name_search(c: Column | str, text: str | None) -> Column:
    """Case-insensitive substring test; an empty text matches every row, a missing name none."""
    if not text:
        return F.lit(True)
    return F.coalesce(F.contains(F.lower(_col(c)), F.lit(text.lower())), F.lit(False))


def _category_words(c: Column | str) -> Column:
    bare = F.regexp_replace(
        F.regexp_replace(_col(c), f"^{presets.CATEGORY_PREFIX}", ""),
        f"({presets.COUNT_SUFFIX}|{presets.SHARE_SUFFIX})$",
        "",
    )
    return F.replace(bare, F.lit("_"), F.lit(" "))


def category_words(c: Column | str) -> Column:
    """Category part of a column name with blanks for underscores, case kept."""
    return _category_words(c)


def activity_label(c: Column | str) -> Column:
    words = F.lower(_category_words(c))
    return F.coalesce(lookup(words, presets.ACTIVITY_LABELS), words)


def pretty_feature(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("_"), F.lit(" "))


def feature_label(c: Column | str) -> Column:
    """Activity label for category columns, the plain words for any other feature."""
    c = _col(c)
    return F.when(F.startswith(c, F.lit(presets.CATEGORY_PREFIX)), activity_label(c)).otherwise(pretty_feature(c))


def band(
    c: Column | str,
    cuts: Sequence[tuple[float, str]],
    otherwise: str,
    *,
    inclusive: bool = False,
    low: tuple[float, str] | None = None,
    missing: str | None = None,
) -> Column:
    """Label of the first cut that the value exceeds (reaches, if ``inclusive``)."""
    c = _col(c)
    first, *rest = cuts
    test = (lambda cut: c >= cut) if inclusive else (lambda cut: c > cut)
    out = F.when(test(first[0]), first[1])
    for cut, label in rest:
        out = out.when(test(cut), label)
    if low:
        out = out.when(c <= low[0], low[1])
    out = out.otherwise(otherwise)
    return F.when(c.isNull(), F.lit(missing)).otherwise(out)


def percentile_band(pct: Column | str) -> Column:
    return band(
        pct,
        presets.PERCENTILE_BANDS,
        presets.PERCENTILE_ELSE,
        inclusive=True,
        low=presets.PERCENTILE_LOW,
        missing=presets.PERCENTILE_MISSING,
    )


def format_list(items: Column, limit: int) -> Column:
    """``a``, ``a, and b``, ``a, b, and c`` from the first non-blank items."""
    kept = F.slice(F.filter(items, lambda x: strip(x) != ""), 1, limit)
    head = F.array_join(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), ", ")
    return (
        F.when(F.size(kept) == 0, "")
        .when(F.size(kept) == 1, F.get(kept, F.lit(0)))
        .otherwise(F.concat(head, F.lit(", and "), F.get(kept, F.size(kept) - 1)))
    )


def excerpt(c: Column | str, n: int) -> Column:
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def query_slug(c: Column | str) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    return F.when(slug == "", "query").otherwise(slug)


_SPLIT = 134217729.0  # 2**27 + 1 cuts a double into two halves whose products are exact


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Rounds the binary value itself, halves to even: 2.675 is a little less than its text and becomes 2.67.

    The value is scaled by a power of ten together with the rounding error of that product (split multiplication), so a tie is
    recognised exactly; what is not a tie in the product follows the product, what looks like one follows the error.
    """
    scale = float(10**digits)
    scale_high = scale * _SPLIT - (scale * _SPLIT - scale)
    scale_low = scale - scale_high

    def rounded(x: Column) -> Column:
        product = x * F.lit(scale)
        high = x * F.lit(_SPLIT) - (x * F.lit(_SPLIT) - x)
        low = x - high
        error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
        whole = F.floor(product).cast("double")
        over = product - whole - F.lit(0.5)
        over = F.when(over == 0, error).otherwise(over)
        up = (over > 0) | ((over == 0) & (F.abs(whole % 2) == 1))
        inside = F.abs(product) < F.lit(float(1 << 52))
        return F.when(inside, (whole + up.cast("double")) / F.lit(scale)).otherwise(x)

    # bound once, however often the formula names it
    return F.get(F.transform(F.array(_col(c).cast("double")), rounded), F.lit(0))
