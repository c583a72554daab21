"""The cointegration job end to end: gate, lag order, rank, forecasts; systems told apart by a label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.operators.cointegration import johansen, primary_rank, vecm_forecasts
from tideframe.operators.diagnostics import integration_report
from tideframe.panel import PanelSpec
from tideframe.session import stored


def system_ranks(df: DataFrame, spec: PanelSpec, columns: Sequence[str], k_ar_diff: int, enforce_i1: bool) -> DataFrame:
    """Rank per series and why a series gives no forecasts; rank 0 is a reported result, not an error."""
    keys = list(spec.keys)
    ranks = primary_rank(johansen(df, spec, columns, k_ar_diff), keys)
    gate = integration_report(df, spec, columns).groupBy(*keys).agg(F.bool_and("is_i1").alias("all_i1"))
    both = ranks.join(gate, keys, "full_outer")
    passed = F.col("all_i1") if enforce_i1 else F.lit(True)
    outcome = (F.when(F.col("rank").isNull(), "no fit").when(~passed, "failed the integration gate")
               .when(F.col("rank") == 0, "no cointegration").otherwise("forecast"))
    return both.withColumn("outcome", outcome)


def run_systems(
    df: DataFrame, spec: PanelSpec, systems: Mapping[str, Sequence[str]], target: str, k_ar_diff: int,
    horizons: Sequence[int], min_train: int, step: int, enforce_i1: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Forecasts and rank report of all systems, each with a ``system`` column."""
    forecasts = report = None
    for name, columns in systems.items():
        ranks = stored(system_ranks(df, spec, columns, k_ar_diff, enforce_i1), "ranks")
        usable = ranks.filter("outcome = 'forecast'")
        # The report tells why a series has no forecasts.
        made = vecm_forecasts(df, spec, columns, target, k_ar_diff, usable, horizons, min_train, step).filter(F.col("origin_date").isNotNull())
        made, ranks = made.withColumn("system", F.lit(name)), ranks.withColumn("system", F.lit(name))
        forecasts = made if forecasts is None else forecasts.unionByName(made)
        report = ranks if report is None else report.unionByName(ranks)
    return forecasts, report
