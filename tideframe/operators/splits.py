"""Walk-forward origins, folds and embargoed roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.panel import PanelSpec, series_length, with_position


def origin_grid(df: DataFrame, spec: PanelSpec, min_train: int, step: int, max_h: int) -> DataFrame:
    """Keep the rows that are forecast origins.

    ``rn`` is the number of levels known at the origin; origins run from
    ``min_train`` in steps of ``step`` and leave ``max_h`` rows plus one after them.
    """
    counted = series_length(with_position(df, spec, "rn"), spec, "n_rows")
    return counted.filter(is_origin(min_train, step, max_h))


def is_origin(min_train: int, step: int, max_h: int) -> Column:
    rn = F.col("rn")
    return (rn >= min_train) & ((rn - min_train) % step == 0) & (rn < F.col("n_rows") - max_h)


def fold_size(n: Column, min_train: int, n_folds: int) -> Column:
    size = F.floor((n - min_train) / n_folds)
    return F.when(size >= 1, size).otherwise(
        F.raise_error(F.format_string("%d rows are too few for min_train=%d and %d folds", n, F.lit(min_train), F.lit(n_folds))).cast("long")
    )


def rolling_folds(df: DataFrame, spec: PanelSpec, min_train: int, n_folds: int) -> DataFrame:
    """Expanding folds: add ``rn``, ``n_rows`` and the fold whose test block holds the row.

    Rows of the first ``min_train`` get a null fold; the last fold takes the remainder.
    """
    counted = series_length(with_position(df, spec, "rn"), spec, "n_rows")
    raw = F.floor((F.col("rn") - 1 - min_train) / fold_size(F.col("n_rows"), min_train, n_folds))
    fold = F.when(F.col("rn") > min_train, F.least(raw, F.lit(n_folds - 1)))
    return counted.withColumn("fold", fold)


def fold_bounds(df: DataFrame, spec: PanelSpec, min_train: int, n_folds: int, strict: bool = True) -> DataFrame:
    """One row per key and fold with 0-based half-open test bounds.

    A series too short for the folds fails the job; with ``strict=False`` it has one row of null fold, and the column ``reason``
    tells why.
    """
    sizes = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n_rows"))
    raw = F.floor((F.col("n_rows") - min_train) / n_folds)
    size = fold_size(F.col("n_rows"), min_train, n_folds) if strict else F.when(raw >= 1, raw)
    folds = F.array(*[F.lit(k) for k in range(n_folds)])
    spread = sizes.withColumn("_size", size).withColumn("fold", F.explode_outer(F.when(F.col("_size").isNotNull(), folds)))
    start = F.lit(min_train) + F.col("fold") * F.col("_size")
    last = F.col("fold") == n_folds - 1
    short = F.format_string("%d rows are too few for min_train=%d and %d folds", "n_rows", F.lit(min_train), F.lit(n_folds))
    reason = [] if strict else [F.when(F.col("fold").isNull(), short).alias("reason")]
    return spread.select(
        *spec.keys, "fold", "n_rows", start.alias("train_end"),
        F.when(last, F.col("n_rows")).otherwise(start + F.col("_size")).alias("test_end"), *reason,
    )


def _tail(n: Column, share: float, floor: int) -> Column:
    return F.greatest(F.floor(n * F.lit(share)), F.lit(floor))


def role_at(i: Column, train_end: Column, test_end: Column, horizon: Column, cal_share: float = 0.15, cal_floor: int = 20) -> Column:
    """The role of the row at 0-based position ``i`` in a fold: fit, gap, calibration, embargo or test; null after the test block."""
    train = train_end - horizon
    fit = train - _tail(train, cal_share, cal_floor) - horizon
    return (
        F.when(i >= test_end, F.lit(None))
        .when(i >= train_end, "test")
        .when(i >= train, "embargo")
        .when(i >= fit + horizon, "calibration")
        .when(i >= fit, "gap")
        .otherwise("fit")
    )


def embargo_roles(
    df: DataFrame, spec: PanelSpec, bounds: DataFrame, horizons: Sequence[int],
    cal_share: float = 0.15, cal_floor: int = 20,
) -> DataFrame:
    """Label each row per fold and horizon: fit, gap, calibration, embargo or test.

    Training ends h rows before the test block; its tail calibrates the band and is
    parted from the fit rows by another gap of h. Rows after the test block are dropped.
    """
    placed = with_position(df, spec, "rn").withColumn("_i", F.col("rn") - 1)
    hs = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    rows = placed.join(bounds.select("*", hs).drop("n_rows"), list(spec.keys)).filter(F.col("_i") < F.col("test_end"))
    role = role_at(F.col("_i"), F.col("train_end"), F.col("test_end"), F.col("horizon"), cal_share, cal_floor)
    return rows.withColumn("role", role).drop("_i", "train_end", "test_end")


def search_role_at(i: Column, pool: Column, horizon: Column, cal_share: float = 0.15, val_share: float = 0.15) -> Column:
    """The role of the row at 0-based position ``i`` of a pool of ``pool`` rows; a pool too small for an embargoed split fails."""
    train = pool - horizon
    fit = train - _tail(train, cal_share, 20) - horizon
    inner = fit - _tail(fit, val_share, 20) - horizon
    safe = (pool >= 60) & (fit >= 20) & (inner >= 10)
    return (
        F.when(~safe, F.raise_error(F.lit("selection pool is too small for an embargoed split")))
        .when(i < inner, "inner_train")
        .when(i < inner + horizon, "gap")
        .when(i < fit, "inner_val")
        .when(i < fit + horizon, "gap")
        .when(i < train, "calibration")
        .otherwise("embargo")
    )


def search_roles(
    df: DataFrame, spec: PanelSpec, selection_end: int, horizons: Sequence[int],
    cal_share: float = 0.15, val_share: float = 0.15,
) -> DataFrame:
    """Roles for hyper-parameter search inside the rows that are never scored.

    inner_train | gap | inner_val | gap | calibration | embargo, all before
    ``selection_end``. A pool too small for an embargoed split fails the job.
    """
    pool = with_position(df, spec, "rn").filter(F.col("rn") <= selection_end)
    pool = series_length(pool, spec, "_pool").withColumn("_i", F.col("rn") - 1)
    hs = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    role = search_role_at(F.col("_i"), F.col("_pool"), F.col("horizon"), cal_share, val_share)
    return pool.select("*", hs).withColumn("role", role).drop("_i", "_pool")


def partition_log(roles: DataFrame, groups: Sequence[str], time: str = "date") -> DataFrame:
    """Row range, row count and dates of each role."""
    return roles.groupBy(*groups, "role").agg(
        F.min("rn").alias("first_row"), F.max("rn").alias("last_row"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min(time).alias("first_date"), F.max(time).alias("last_date"),
    )


def leakage_report(roles: DataFrame, groups: Sequence[str], target_position: str = "rn") -> DataFrame:
    """Last row any training target reaches against the first test row, per group."""
    trained = F.col("role").isin("fit", "calibration")
    return roles.groupBy(*groups).agg(
        F.max(F.when(trained, F.col(target_position) + F.col("horizon"))).alias("last_train_target"),
        F.min(F.when(F.col("role") == "test", F.col(target_position))).alias("first_test_row"),
    ).withColumn("leak_free", F.col("last_train_target") < F.col("first_test_row"))


def with_parameters(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Repeat each row for every combination of parameter values, which are literals of the plan."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def parameter_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of parameter values, one row each."""
    return with_parameters(spark.range(1), **axes).drop("id")
