"""Error metrics and paired coverage on long forecast frames.

A forecast frame holds one row per key, model, origin and horizon with ``actual``,
``naive``, ``pred`` and optional band columns. The model is a column, so every
measure is one aggregate for all arms at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.functions.scalars import improvement_pct, is_close, is_finite



def _rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def error_metrics(forecasts: DataFrame, groups: Sequence[str], improvement: bool = True) -> DataFrame:
    """RMSE, MAE and count per group, scored with the naive error on the same complete rows."""
    e, e0 = F.col("actual") - F.col("pred"), F.col("actual") - F.col("naive")
    scored = forecasts.na.drop("any", subset=["actual", "naive", "pred"])
    out = scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_forecasts"),
        _rmse(e).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        _rmse(e0).alias("naive_rmse"), F.avg(F.abs(e0)).alias("naive_mae"),
    )
    out = out.withColumns({
        "beats_naive_rmse": F.col("rmse") < F.col("naive_rmse"),
        "beats_naive_mae": F.col("mae") < F.col("naive_mae"),
    })
    if not improvement:
        return out
    return out.withColumns({
        "rmse_improvement_pct": improvement_pct(F.col("rmse"), F.col("naive_rmse")),
        "mae_improvement_pct": improvement_pct(F.col("mae"), F.col("naive_mae")),
    })


def interval_coverage(
    forecasts: DataFrame, groups: Sequence[str], lower: Mapping[int, str], upper: Mapping[int, str]
) -> DataFrame:
    """Empirical coverage in percent and mean width per nominal level.

    A row with a missing, NaN or infinite bound or value is left out of that level, not counted as a miss.
    """
    if set(lower) != set(upper):
        raise ValueError(f"levels differ: {sorted(lower)} and {sorted(upper)}")
    measures = [F.count(F.lit(1)).alias("n_forecasts")]
    for level in sorted(lower):
        lo, hi = F.col(lower[level]), F.col(upper[level])
        usable = is_finite(lo) & is_finite(hi) & is_finite(F.col("actual"))
        inside = F.when(F.col("actual").between(lo, hi), 100.0).otherwise(0.0)
        measures += [
            F.avg(F.when(usable, inside)).alias(f"coverage_{level}"),
            F.avg(F.when(usable, hi - lo)).alias(f"width_{level}"),
        ]
    return forecasts.groupBy(*groups).agg(*measures)


def coverage_by_level(coverage: DataFrame, groups: Sequence[str], levels: Sequence[int]) -> DataFrame:
    """One row per group and nominal level: realised coverage, its distance from the level and mean width."""
    rows = F.explode(F.array(*[F.struct(F.lit(float(n)).alias("nominal"), F.col(f"coverage_{n}").alias("coverage"), F.col(f"width_{n}").alias("width")) for n in levels])).alias("_c")
    return coverage.select(*groups, "n_forecasts", rows).select(*groups, "n_forecasts", "_c.*").withColumn("shortfall", F.col("nominal") - F.col("coverage"))


def convergence_rate(fits: DataFrame, groups: Sequence[str]) -> DataFrame:
    ok = F.sum(F.col("fit_ok").cast("long"))
    return fits.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_fits"), ok.alias("n_ok"),
        (ok / F.count(F.lit(1)) * 100).alias("ok_pct"),
    )


def converged_and_all(forecasts: DataFrame) -> DataFrame:
    """Two samples side by side: all rows, and the rows whose own fit converged."""
    return forecasts.withColumn(
        "sample", F.explode(F.when(F.col("fit_ok"), F.array(F.lit("all"), F.lit("converged"))).otherwise(F.array(F.lit("all"))))
    )


def paired_counts(forecasts: DataFrame, groups: Sequence[str]) -> DataFrame:
    paired = F.col("actual").isNotNull() & F.col("pred").isNotNull()
    return forecasts.groupBy(*groups).agg(F.count_if(paired).alias("n_paired"))


def min_covered(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Smallest non-zero paired count; 0 when nothing is covered."""
    n = F.when(F.col("n_paired") > 0, F.col("n_paired"))
    return counts.groupBy(*groups).agg(F.coalesce(F.min(n), F.lit(0)).alias("min_covered"))


def distribution_gate(counts: DataFrame, groups: Sequence[str] = (), least: int = 30) -> DataFrame:
    gate = F.when(F.col("min_covered") >= least, "show").otherwise("too few paired origins")
    return min_covered(counts, groups).withColumn("gate", gate)


def origin_fingerprints(forecasts: DataFrame, groups: Sequence[str], model: str = "model") -> DataFrame:
    """Whether all models cover the same set of origins, not merely equally many.

    Sets are compared by count and two hash sums of distinct origins, so no group of
    dates is collected anywhere.
    """
    rows = forecasts.filter(F.col("pred").isNotNull()).select(*groups, model, "origin_date").distinct()
    stamp = rows.groupBy(*groups, model).agg(
        F.count(F.lit(1)).alias("n_origins"),
        F.sum(F.xxhash64("origin_date").cast("decimal(20,0)")).alias("_s1"),
        F.sum(F.xxhash64(F.lit(7), "origin_date").cast("decimal(20,0)")).alias("_s2"),
    )
    equal = (F.min("n_origins") == F.max("n_origins")) & (F.min("_s1") == F.max("_s1")) & (F.min("_s2") == F.max("_s2"))
    return stamp.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_models"), F.min("n_origins").alias("min_origins"),
        F.max("n_origins").alias("max_origins"), equal.alias("is_paired"),
    )


def window_label(forecasts: DataFrame, groups: Sequence[str]) -> DataFrame:
    return forecasts.groupBy(*groups).agg(
        F.min("origin_date").alias("first_origin"), F.max("origin_date").alias("last_origin"),
        F.count_distinct("origin_date").alias("n_origins"),
    )


def dataset_metadata(forecasts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Smallest and total size over horizons, with the dates spanned."""
    per_h = forecasts.groupBy(*groups, "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.min("origin_date").alias("lo"), F.max("origin_date").alias("hi"))
    return per_h.groupBy(*groups).agg(
        F.min("n").alias("origins_per_horizon"), F.sum("n").alias("n_rows"),
        F.min("lo").alias("first_origin"), F.max("hi").alias("last_origin"))


def common_origins(forecasts: DataFrame, keys: Sequence[str], model: str = "model") -> DataFrame:
    """Keep the origins that every model covers."""
    have = forecasts.select(*keys, model, "origin_date").distinct()
    models = have.groupBy(*keys).agg(F.count_distinct(model).alias("_all"))
    covered = have.groupBy(*keys, "origin_date").agg(F.count(F.lit(1)).alias("_have"))
    full = covered.join(models, list(keys))
    return forecasts.join(full.filter("_have = _all"), [*keys, "origin_date"], "left_semi")


def common_sample(forecasts: DataFrame, keys: Sequence[str], models: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Wide frame: one row per origin and horizon that every required model scored.

    ``parity_ok`` says the arms agree on actual and naive within 1e-10 relative.
    """
    values = [*models, *optional]
    best = {m: F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in values}
    wide = forecasts.groupBy(*keys, "origin_date", "horizon").agg(
        F.max("actual").alias("actual"), F.max("naive").alias("naive"),
        (is_close(F.min("actual"), F.max("actual")) & is_close(F.min("naive"), F.max("naive"))).alias("parity_ok"),
        *best.values(),
    )
    return wide.na.drop("any", subset=list(models))


def assert_rows_kept(joined: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``expected`` that a join chain lost; empty when nothing was lost."""
    return expected.select(*keys).join(joined.select(*keys), list(keys), "left_anti")


def tag_regime(df: DataFrame, regimes: Sequence[tuple[str, str, str]], time: str) -> DataFrame:
    """Label rows by the closed interval that holds their date; rows in none are dropped.

    The intervals are literals of the plan: one projection, no join.
    """
    label = F.lit(None).cast("string")
    for name, start, stop in reversed(regimes):
        label = F.when(F.col(time).between(F.lit(start).cast("date"), F.lit(stop).cast("date")), F.lit(name)).otherwise(label)
    return df.withColumn("regime", label).filter(F.col("regime").isNotNull())


def join_regimes(df: DataFrame, regimes: Sequence[tuple[str, str, str]], time: str) -> DataFrame:
    """The same with intervals that may overlap: a row counts for each that holds its date.

    The intervals are an array of literals and the rows are filtered and exploded in place: no join, nothing to broadcast.
    """
    held = F.array(*[F.when(F.col(time).between(F.lit(start).cast("date"), F.lit(stop).cast("date")), F.lit(name)) for name, start, stop in regimes])
    return df.withColumn("regime", F.explode(F.array_compact(held)))


def decision_summary(metrics: DataFrame, tests: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group: best RMSE, best MAE, strongest p and whether any test survives correction."""
    best = metrics.groupBy(*groups).agg(
        F.min_by("model", F.struct(F.round("rmse", 9), "model")).alias("best_rmse_model"), F.min("rmse").alias("best_rmse"),
        F.min_by("model", F.struct(F.round("mae", 9), "model")).alias("best_mae_model"), F.min("mae").alias("best_mae"))
    strongest = tests.filter(F.col("cw_p_value").isNotNull()).groupBy(*groups).agg(
        F.min_by("model", F.struct(F.round("cw_p_value", 9), "model")).alias("strongest_model"),
        F.min("cw_p_value").alias("strongest_p"),
        F.bool_or("significant_fdr_horizon").alias("any_significant"))
    return best.join(strongest, list(groups), "left")


def forecast_audit(forecasts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Missing, NaN and infinite forecasts and their range."""
    p = F.col("pred")
    return forecasts.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(p.isNull()).alias("n_null"),
        F.count_if(F.isnan(p)).alias("n_nan"),
        F.count_if(F.abs(p) == float("inf")).alias("n_infinite"),
        F.min(p).alias("min_pred"), F.max(p).alias("max_pred"))


def coverage_disclosure(coverage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sentence per key that quotes the realised coverage."""
    parts = F.array_sort(F.collect_list(F.struct("horizon", "coverage_90")))
    joined = lambda f: F.array_join(F.transform(parts, f), "/")
    text = F.format_string(
        "bands of 90%% held %s%% of the outcomes at horizons %s",
        joined(lambda s: F.format_string("%.1f", s["coverage_90"])), joined(lambda s: s["horizon"].cast("string")))
    return coverage.groupBy(*keys).agg(text.alias("disclosure"))
