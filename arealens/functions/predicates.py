"""Row predicates and column choices."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from arealens import presets
from arealens.functions import scalars as S


@dataclass(frozen=True)
class HardFilter:
    """Optional bounds; an unset one adds no predicate, a missing value fails a set one."""

    groups: Sequence[str] = ()
    at_least: Mapping[str, float] = field(default_factory=dict)
    at_most: Mapping[str, float] = field(default_factory=dict)
    group_column: str = "borough"

    @classmethod
    def from_request(cls, group_column: str = "borough", boroughs: Sequence[str] | None = None, **bounds):
        """Filter from the named optional bounds of a ranking request."""
        known = {**presets.MINIMUM_FILTERS, **presets.MAXIMUM_FILTERS}
        unknown = sorted(set(bounds) - set(known))
        if unknown:
            raise ValueError(f"unknown filters: {unknown}")
        set_bounds = {k: float(v) for k, v in bounds.items() if v is not None}
        return cls(
            groups=tuple(boroughs or ()),
            at_least={presets.MINIMUM_FILTERS[k]: v for k, v in set_bounds.items() if k in presets.MINIMUM_FILTERS},
            at_most={presets.MAXIMUM_FILTERS[k]: v for k, v in set_bounds.items() if k in presets.MAXIMUM_FILTERS},
            group_column=group_column,
        )

    def predicate(self) -> Column:
        # Without a list every group present in the data passes, so only NULL groups drop out.
        group = F.col(self.group_column)
        tests = [group.isin(*self.groups) if self.groups else group.isNotNull()]
        tests += [F.col(c) >= v for c, v in self.at_least.items()]
        tests += [F.col(c) <= v for c, v in self.at_most.items()]
        return reduce(Column.__and__, tests)


def hard_filter(df: DataFrame, spec: HardFilter) -> DataFrame:
    return df.filter(spec.predicate())


def filter_counts(df: DataFrame, spec: HardFilter) -> DataFrame:
    """Rows before and after the filter, from one pass over the table."""
    return df.agg(F.count("*").alias("n_total"), F.count_if(spec.predicate()).alias("n_filtered"))


def valid_coordinates(lat: str = "latitude", lon: str = "longitude") -> Column:
    """Both present, finite and not 0. A NULL, NaN or infinite coordinate is never valid."""

    def valid(c: Column) -> Column:
        number = c.cast("double")
        return c.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))) & (number != 0)

    return valid(F.col(lat)) & valid(F.col(lon))


def not_listed(c: Column | str, values: Iterable[str]) -> Column:
    """Keeps rows whose value is not listed; a NULL is not a listed value."""
    c = F.col(c) if isinstance(c, str) else c
    return ~F.coalesce(c.isin(*values), F.lit(False))


def positive(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(0.0)) > 0


def no_flag_set(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.coalesce(F.col(c), F.lit(0)) == 0 for c in columns])


def known_code(c: str, prefixes: Sequence[str] = presets.CODE_PREFIXES) -> Column:
    return F.coalesce(F.col(c).rlike("|".join(prefixes)), F.lit(False)) & S.group_from_code(c).isNotNull()


def complete_cases(df: DataFrame, columns: Sequence[str], minimum: int = 4) -> DataFrame:
    """Rows with every feature present; an error if fewer than ``minimum`` remain."""
    kept = df.dropna(subset=list(columns))
    found = kept.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"only {found} complete rows, need at least {minimum}")
    return kept


def columns_like(
    df: DataFrame,
    suffix: str,
    prefix: str = presets.CATEGORY_PREFIX,
    exclude: Sequence[str] = presets.PLACEHOLDER_CATEGORIES,
) -> list[str]:
    """Sorted category columns without the placeholder categories."""
    skipped = {f"{prefix}{name}{suffix}" for name in exclude}
    return sorted(c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and c not in skipped)


def cap_by_year(df: DataFrame, date_text: str, year: int, mode: str = "upto") -> DataFrame:
    """Keeps rows whose parsed year is the given one or, for ``upto``, not later; unparsable dates drop."""
    if mode not in ("exact", "upto"):
        raise ValueError(f"mode must be 'exact' or 'upto', got {mode!r}")
    parsed = F.year(F.try_to_timestamp(F.col(date_text), F.lit(presets.INCIDENT_DATE_FORMAT)))
    return df.filter(parsed == year if mode == "exact" else parsed <= year)


def stage_counts(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows that survive each cumulative filter stage, counted in one pass."""
    passed, aggs = F.lit(True), [F.count("*").alias("n_before")]
    for name, predicate in stages.items():
        passed = passed & F.coalesce(predicate, F.lit(False))
        aggs.append(F.count_if(passed).alias(name))
    return df.agg(*aggs)
