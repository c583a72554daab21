"""Frame profiles: missing values, summaries, histograms, rankings, attribution tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.operators.order_statistics import exact_quantiles
from tideframe.panel import null_safe_join


def _unpivot(wide: DataFrame, groups: Sequence[str], columns: Sequence[str], measures: Sequence[str]) -> DataFrame:
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{m}|{c}").alias(m) for m in measures]) for c in columns])).alias("_c")
    return wide.select(*groups, cells).select(*groups, "_c.*")


def summary(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Count, missing count and percent, mean, deviation, min and max per column, in one pass."""
    n = F.count(F.lit(1))
    measures = {
        "n_rows": lambda c: n, "n_null": lambda c: F.count_if(F.col(c).isNull()),
        "null_pct": lambda c: F.count_if(F.col(c).isNull()) / n * 100, "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c), "min": lambda c: F.min(F.col(c).cast("double")), "max": lambda c: F.max(F.col(c).cast("double"))}
    wide = df.groupBy(*groups).agg(*[f(c).alias(f"{m}|{c}") for m, f in measures.items() for c in columns])
    return _unpivot(wide, groups, columns, list(measures))


def missing_map(df: DataFrame, bucket: Column, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Missing count per column and date bucket."""
    wide = df.groupBy(*groups, bucket.alias("bucket")).agg(*[F.count_if(F.col(c).isNull()).alias(f"n_null|{c}") for c in columns])
    return _unpivot(wide, [*groups, "bucket"], columns, ["n_null"])


def constant_columns(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    wide = df.groupBy(*groups).agg(*[(F.min(c) == F.max(c)).alias(f"is_constant|{c}") for c in columns])
    return _unpivot(wide, groups, columns, ["is_constant"])


def zero_share(df: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    """Share of rows that are exactly zero, as release series are after differencing."""
    return df.groupBy(*groups).agg(
        F.count(column).alias("n_obs"), F.avg((F.col(column) == 0).cast("double")).alias("zero_share"))


def histogram(df: DataFrame, groups: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin; values outside go to the bins below the first and above the last."""
    slot = F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.filter(F.col(value).isNotNull()).groupBy(*groups, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


def box_statistics(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Exact quartiles, mean and the whiskers: extreme values within 1.5 interquartile ranges."""
    on = list(groups)
    quartiles = exact_quantiles(df, on, value, (0.25, 0.5, 0.75))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    x = F.col(value)
    inside = x.between(F.col("q25") - reach, F.col("q75") + reach)
    spread = null_safe_join(df, quartiles, on).groupBy(*on).agg(
        F.avg(x).alias("mean"), F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outside"))
    return null_safe_join(quartiles, spread, on)


def top_n(df: DataFrame, groups: Sequence[str], score: str, tie: str, n: int) -> DataFrame:
    """The n largest rows per group, ranked."""
    w = Window.partitionBy(*groups).orderBy(F.col(score).desc(), tie)
    return df.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n)


def recent_and_background(df: DataFrame, keys: Sequence[str], time: str, recent: int, background: int) -> DataFrame:
    """The newest ``recent`` rows per key and the ``background`` rows before them."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    role = F.when(F.col("_back") <= recent, "recent").when(F.col("_back") <= recent + background, "background")
    return df.withColumn("_back", F.row_number().over(w)).withColumn("role", role).filter(F.col("role").isNotNull()).drop("_back")


def mean_absolute(attributions: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean absolute attribution per group and feature from one column per feature."""
    wide = attributions.groupBy(*groups).agg(*[F.avg(F.abs(c)).alias(f"mean_abs|{c}") for c in columns])
    out = _unpivot(wide, groups, columns, ["mean_abs"])
    return out.withColumnRenamed("column", "feature")


def sum_steps(attributions: DataFrame, column: str, alias: str) -> DataFrame:
    """Sum an array of per-step attributions."""
    return attributions.withColumn(alias, F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x))


def seed_summary(runs: DataFrame, config: Sequence[str], score: str) -> DataFrame:
    """Mean and sample deviation over seeds; a single run has deviation 0."""
    return runs.groupBy(*config).agg(
        F.avg(score).alias("mean_score"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std_score"),
        F.count(F.lit(1)).alias("n_seeds"))


def fold_summary(runs: DataFrame, config: Sequence[str], loss: str, epochs: str) -> DataFrame:
    return runs.groupBy(*config).agg(
        F.avg(loss).alias("mean_loss"), F.stddev_pop(loss).alias("std_loss"), F.avg(epochs).alias("mean_epochs"))


def rank_in_band(configs: DataFrame, parsimony: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Rank by mean score; inside one median deviation of the leader simpler configurations come first.

    Ranked per search, whose rows are the configurations of one grid.
    """
    on = list(groups)
    key = [F.col(g) for g in on] or [F.lit(0)]
    whole = Window.partitionBy(*key)
    band = F.coalesce(F.median(F.when(F.col("std_score") != 0, F.col("std_score"))).over(whole), F.lit(0.0))
    out = configs.withColumns({"band": band, "_lead": F.min("mean_score").over(whole)})
    out = out.withColumn("in_band", F.col("mean_score") <= F.col("_lead") + F.col("band"))
    simple = [F.when(F.col("in_band"), F.col(c)) for c in parsimony]
    order = Window.partitionBy(*key).orderBy(F.col("in_band").desc(), *simple, "mean_score", *parsimony)
    return out.withColumn("rank", F.row_number().over(order).cast("long")).drop("_lead")


def best_against_canonical(ranked: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rank 1 against the flagged canonical row: gain in percent and whether it is a new best."""
    best, flag = F.col("rank") == 1, F.col("is_canonical")
    out = ranked.groupBy(*groups).agg(
        F.max(F.when(best, F.col("mean_score"))).alias("best_score"), F.max(F.when(flag, F.col("mean_score"))).alias("canonical_score"),
        F.max(F.when(flag, F.col("rank"))).alias("canonical_rank"), F.bool_or(best & flag).alias("_same"))
    gain = (F.col("canonical_score") - F.col("best_score")) / F.col("canonical_score") * 100
    return out.withColumns({"relative_gain_pct": gain, "is_new_best": ~F.col("_same")}).drop("_same")
