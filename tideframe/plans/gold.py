"""The feature table: two daily calendars, one monthly release, spreads, differences, complete cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.operators.align import asof_release, outer_calendar
from tideframe.operators.contracts import require_columns
from tideframe.operators.features import bounded_fill, difference, year_over_year
from tideframe.panel import PanelSpec, framed

FAMILIES = ("all", "levels", "stationary")


def select_family(df: DataFrame, spec: PanelSpec, family: str) -> DataFrame:
    """Key and date columns plus the levels, the ``d_`` columns, or both."""
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {FAMILIES}, not {family!r}")
    index = [*spec.keys, spec.time]
    values = [c for c in df.columns if c not in index]
    kept = {
        "all": values,
        "levels": [c for c in values if not c.startswith("d_")],
        "stationary": [c for c in values if c.startswith("d_")],
    }[family]
    return df.select(*index, *kept)


def available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns the frame has."""
    return df.select(*[c for c in wanted if c in df.columns])


def build_gold(
    left: DataFrame, right: DataFrame, monthly: DataFrame, spec: PanelSpec,
    index: str, spreads: Mapping[str, tuple[str, str]], diffs: Sequence[str],
    family: str = "all", limit: int = 2, carry_in: bool = False,
) -> DataFrame:
    """Join both daily calendars, fill short gaps, attach the last published index and its
    year-over-year change, add spreads and first differences, keep complete rows.

    ``monthly`` holds the keys, ``month``, ``release_date`` and the ``index`` column.
    """
    require_columns(left, [*spec.keys, spec.time])
    require_columns(right, [*spec.keys, spec.time])
    require_columns(monthly, [*spec.keys, "month", "release_date", index])
    yoy = f"{index}_yoy"
    month_spec = PanelSpec(spec.keys, "month")
    daily = outer_calendar(left, right, spec)
    levels = [c for c in daily.columns if c not in (*spec.keys, spec.time)]
    daily = framed(daily, spec, bounded_fill(levels, limit))
    published = year_over_year(monthly, month_spec, index, yoy)
    facts = asof_release(daily, published, spec, "release_date", [index, yoy], tie=["month"], carry_in=carry_in)
    facts = facts.withColumns({name: F.col(a) - F.col(b) for name, (a, b) in spreads.items()})
    facts = framed(facts, spec, difference(*[c for c in (*diffs, yoy, *spreads) if c in facts.columns]))
    return select_family(facts.na.drop("any"), spec, family)
