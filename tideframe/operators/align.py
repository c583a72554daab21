"""Calendar alignment, point-in-time joins, splices and target dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.panel import PanelSpec, Running, framed, keep_one, null_safe_join, running, with_position
from tideframe.operators.features import bounded_fill
from tideframe.session import stored


def outer_calendar(left: DataFrame, right: DataFrame, spec: PanelSpec) -> DataFrame:
    """Keep the days of both calendars."""
    return left.join(right, [*spec.keys, spec.time], "full_outer")


def fill_forward(df: DataFrame, spec: PanelSpec, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Forward-fill, bounded to ``limit`` rows or without bound."""
    if limit is not None:
        return framed(df, spec, bounded_fill(columns, limit))
    items = [Running("last", c, f"_f_{c}") for c in columns]
    filled = running(df, spec, *items)
    return filled.select(
        *[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def asof_release(
    facts: DataFrame,
    releases: DataFrame,
    spec: PanelSpec,
    release_time: str,
    values: Sequence[str],
    tie: Sequence[str] = (),
    carry_in: bool = False,
) -> DataFrame:
    """Attach to each fact the newest value published on or before its date.

    Both sides are stacked and the last published non-null value runs forward, so the
    join is one shuffle and linear in rows. Of several releases on one day the one
    with the largest ``tie`` counts. ``carry_in=False`` ignores releases dated before
    the first fact of the series; ``True`` carries them in.
    """
    on = list(spec.keys)
    dated = releases.filter(F.col(release_time).isNotNull())
    newest = keep_one(
        dated.select(*on, F.col(release_time).alias(spec.time), *values, *tie),
        [*on, spec.time],
        [F.col(c) for c in (tie or values)],
        keep="last",
    )
    if not carry_in and spec.grain is not None:
        first = facts.groupBy(*on).agg(F.min(spec.time).alias("_first"))
        newest = newest.join(first, on).filter(F.col(spec.time) >= F.col("_first")).drop("_first")
    published = newest.select(*on, spec.time, *values, F.lit(0).alias("_fact"))
    held = facts.drop(*values)
    stacked = held.withColumn("_fact", F.lit(1)).unionByName(published, allowMissingColumns=True)
    if not carry_in and spec.grain is None:
        first = F.min(F.when(F.col("_fact") == 1, F.col(spec.time))).over(Window.partitionBy(*spec.key_columns))
        stacked = stacked.withColumn("_first", first).withColumns(
            {v: F.when(F.col(spec.time) >= F.col("_first"), F.col(v)) for v in values})
    items = [Running("last", v, f"_asof_{v}") for v in values]
    order = PanelSpec(spec.keys, spec.time, ("_fact", *spec.tie), spec.grain, spec.block_rows)
    carried = running(stacked, order, *items).filter("_fact = 1")
    return carried.select(*held.columns, *[F.col(f"_asof_{v}").alias(v) for v in values])


def splice(df: DataFrame, time: str, break_date: str, legacy: str, current: str, alias: str) -> DataFrame:
    """Legacy before the break, current on and after it; both inputs stay."""
    before = F.col(time) < F.lit(break_date).cast("date")
    return df.withColumn(alias, F.when(before, F.col(legacy)).otherwise(F.col(current)))


def stitch(legacy: DataFrame, current: DataFrame, time: str, break_date: str) -> DataFrame:
    """Union of two clipped range scans; each side's filter reaches its scan."""
    cut = F.lit(break_date).cast("date")
    return legacy.filter(F.col(time) < cut).unionByName(current.filter(F.col(time) >= cut))


def join_one_to_one(base: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that refuses a key twice on either side, checked inside the same job; a null key meets a null key.

    Each side is read once: the aggregate that counts a key's rows also carries its row.
    """

    def single(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in on]
        held = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[F.col(c) for c in rest] or [F.lit(0).alias("_none")])).alias("_row"))
        once = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate key on the {side} side"))).otherwise(F.col("_n"))
        return held.filter(once == 1).select(*[F.col(c) if c in on else F.col(f"_row.{c}").alias(c) for c in df.columns])

    return null_safe_join(single(base, "left"), single(other, "right"), on, "left")


def attach_target_date(
    forecasts: DataFrame, calendar: DataFrame, spec: PanelSpec,
    origin: str = "origin_date", horizon: str = "horizon", alias: str = "target_date",
) -> DataFrame:
    """The calendar date ``horizon`` positions after the origin; null past the end.

    ``calendar`` holds one row per key and trading day.
    """
    days = with_position(calendar.select(*spec.keys, spec.time).distinct(), spec, "_pos")
    starts = days.withColumnRenamed(spec.time, origin)
    ends = days.select(*spec.keys, F.col("_pos").alias("_end"), F.col(spec.time).alias(alias))
    placed = forecasts.join(starts, [*spec.keys, origin], "left").withColumn(
        "_end", F.col("_pos") + F.col(horizon)
    )
    return placed.join(ends, [*spec.keys, "_end"], "left").drop("_pos", "_end")


def merge_by_target(
    left: DataFrame, left_model: str, left_calendar: DataFrame,
    right: DataFrame, right_model: str, right_calendar: DataFrame,
    spec: PanelSpec, tolerance: float = 1e-9,
) -> DataFrame:
    """Join two forecast frames whose calendars differ, keeping rows with equal target dates.

    The ``actual`` of both sides must agree where the target date does; a
    disagreement fails the job when the rows are read.
    """
    reserved = {"origin_date", "horizon", "target_date", "actual", "naive"}
    if left_model == right_model or {left_model, right_model} & reserved:
        raise ValueError("model columns need two different names that are not frame columns")
    on = [*spec.keys, "origin_date", "horizon"]
    a = attach_target_date(left, left_calendar, spec).select(
        *on, "target_date", "actual", "naive", left_model)
    b = attach_target_date(right, right_calendar, spec).select(
        *on, F.col("target_date").alias("_target"), F.col("actual").alias("_actual"), right_model)
    agrees = F.abs(F.col("actual") - F.col("_actual")) <= tolerance
    checked = F.when(
        F.coalesce(agrees, F.lit(True)), F.col("actual")
    ).otherwise(F.raise_error(F.lit("same target date but different actual")).cast("double"))
    return (
        a.join(b, on)
        .filter(F.col("target_date") == F.col("_target"))
        .withColumn("actual", checked)
        .drop("_target", "_actual")
    )


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, stop: str, days: int = 32, hot: int = 1_000_000
) -> DataFrame:
    """Every point with every interval of its key that holds its date; both ends belong to the interval.

    Intervals are dealt to the buckets of ``days`` days they touch and meet the points of a bucket in an equi-join; the dates
    decide inside. A null end is open and reaches to the last bucket that has points. An interval that stops before it starts
    holds nothing, and a null date lies in none. Null keys meet null keys. A bucket with more than ``hot`` points is split by
    a hash of its points, and its intervals are copied to each part. Hot buckets are few (rows / ``hot`` at most), so neither side
    moves to learn of them: points and intervals move once, to meet. Columns of the intervals that points have too, keys aside, must be renamed before.
    """
    bucket = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / days)
    dated = points.filter(F.col(at).isNotNull()).withColumn("_bucket", bucket(at))
    on = [*keys, "_bucket"]
    span = dated.agg(F.min("_bucket").alias("low"), F.max("_bucket").alias("high")).first()
    low, high = (F.lit(span[k] if span[k] is not None else 0).cast("long") for k in ("low", "high"))
    parts = stored(dated.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("_parts")).filter("_parts > 1"), "hot-buckets")
    own = intervals.withColumns({"_first": F.greatest(F.coalesce(bucket(start), low), low), "_last": F.least(F.coalesce(bucket(stop), high), high)})
    own = own.filter((F.col("_first") <= F.col("_last")) & F.coalesce(F.col(start) <= F.col(stop), F.lit(True)))
    dealt = own.withColumn("_bucket", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    if parts.isEmpty():
        placed = dated
    else:
        of = F.coalesce("_parts", F.lit(1))
        dealt = null_safe_join(dealt, parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), of - 1))).drop("_parts")
        placed = null_safe_join(dated, parts, on, "left").withColumn("_part", F.pmod(F.xxhash64(*points.columns), of).cast("int")).drop("_parts")
        on = [*on, "_part"]
    met = null_safe_join(placed, dealt, on)
    inside = F.coalesce(F.col(at) >= F.col(start), F.lit(True)) & F.coalesce(F.col(at) <= F.col(stop), F.lit(True))
    return met.filter(inside).drop("_bucket", "_part")
