"""The panel: many series told apart by key columns, each ordered by time.

Every window in this library goes through :class:`PanelSpec`. There are two
physical forms of the same logical window:

* ``grain=None``: the series is bounded by its calendar (daily or monthly rows,
  unique per key and date, so a century is 36,525 rows). One window per key.
* ``grain="minute"`` and the like: rows per key have no bound and one key may hold a
  large share of the table. Choose the grain so that one bucket of the largest series
  sorts well in one task; the number of buckets may be large. Row positions are found by counting per time bucket,
  the series is cut into blocks of ``block_rows`` rows, each block carries the few
  neighbour rows its frames need, and running values carry a total per bucket.
  No task ever sees a whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED = Window.unboundedPreceding


@dataclass(frozen=True)
class PanelSpec:
    keys: tuple[str, ...] = ("series",)
    time: str = "date"
    tie: tuple[str, ...] = ()
    grain: str | int | None = None
    block_rows: int = 100_000

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tie]

    @property
    def key_columns(self) -> list[Column]:
        """Partitioning columns; one calendar-bounded series without keys is one partition."""
        return [F.col(k) for k in self.keys] or [F.lit(0)]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.key_columns).orderBy(*self.order)

    def with_keys(self, *extra: str) -> PanelSpec:
        return replace(self, keys=(*self.keys, *extra))

    def bucket(self) -> Column:
        """Time bucket of a long series: a unit name for times, a width for numbers."""
        if isinstance(self.grain, int):
            return F.floor(F.col(self.time) / self.grain)
        return F.date_trunc(self.grain, F.col(self.time))


@dataclass(frozen=True)
class Framed:
    """Columns over a bounded row frame: ``back`` rows before, ``ahead`` rows after."""

    back: int
    ahead: int
    build: Callable[[WindowSpec], dict[str, Column]]


@dataclass(frozen=True)
class Running:
    """A running value from the start of the series: sum, count, mean or last non-null."""

    kind: str
    column: str
    alias: str


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name where null meets null; the result has the columns of ``left``, then the rest."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(renamed, match, how).drop(*[f"_right_{c}" for c in on])


def with_position(df: DataFrame, spec: PanelSpec, name: str = "pos") -> DataFrame:
    """1-based position of each row within its series."""
    if spec.grain is None:
        return df.withColumn(name, F.row_number().over(spec.window()).cast("long"))
    keyed = df.withColumn("_bucket", spec.bucket())
    on = [*spec.keys, "_bucket"]
    counts = keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*spec.key_columns).orderBy("_bucket").rowsBetween(UNBOUNDED, -1)
    starts = counts.select(*on, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*on).orderBy(*spec.order)
    return (
        null_safe_join(keyed, starts, on)
        .withColumn(name, F.col("_start") + F.row_number().over(inside))
        .drop("_bucket", "_start")
    )


def series_length(df: DataFrame, spec: PanelSpec, name: str = "n_rows") -> DataFrame:
    """Add the number of rows of the series.

    A calendar-bounded series is counted in the partition its windows already use; a
    longer one is counted apart with a map-side combine.
    """
    if spec.grain is None:
        return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*spec.key_columns)))
    return null_safe_join(df, df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias(name)), list(spec.keys))


def framed(df: DataFrame, spec: PanelSpec, *items: Framed) -> DataFrame:
    """Add bounded-frame columns; all items share one shuffle and one sort."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for item in items:
            out.update(item.build(w))
        return out

    if spec.grain is None:
        return df.withColumns(columns(spec.window()))
    back = max(i.back for i in items)
    ahead = max(i.ahead for i in items)
    size = spec.block_rows
    if max(back, ahead) > size:
        raise ValueError(f"a frame of {max(back, ahead)} rows does not fit blocks of {size} rows")
    zero_based = F.col("_pos") - 1
    homes = F.array_compact(
        F.array(
            F.col("_home"),
            F.when(zero_based % size >= size - back, F.col("_home") + 1),
            F.when(zero_based % size < ahead, F.col("_home") - 1),
        )
    )
    w = Window.partitionBy(*spec.keys, "_block").orderBy("_pos")
    return (
        with_position(df, spec, "_pos")
        .withColumn("_home", F.floor(zero_based / size))
        .withColumn("_block", F.explode(homes))
        .withColumns(columns(w))
        .filter(F.col("_home") == F.col("_block"))
        .drop("_pos", "_home", "_block")
    )


def running(df: DataFrame, spec: PanelSpec, *items: Running) -> DataFrame:
    """Add running values; long series carry one total per time bucket."""
    if spec.grain is None:
        w = spec.window().rowsBetween(UNBOUNDED, 0)
        plain = {
            "sum": lambda c: F.sum(c).over(w),
            "count": lambda c: F.count(c).over(w),
            "mean": lambda c: F.avg(c).over(w),
            "last": lambda c: F.last(c, True).over(w),
        }
        return df.withColumns({i.alias: plain[i.kind](i.column) for i in items})

    on = [*spec.keys, "_bucket"]
    inside = Window.partitionBy(*on).orderBy(*spec.order).rowsBetween(UNBOUNDED, 0)
    before = Window.partitionBy(*spec.key_columns).orderBy("_bucket").rowsBetween(UNBOUNDED, -1)
    totals, carries, local, final = [], {}, {}, {}
    for item in items:
        c, a = item.column, item.alias
        if item.kind == "last":
            stamp = F.when(F.col(c).isNotNull(), F.struct(*spec.order))
            totals.append(F.max_by(c, stamp).alias(f"_t_{a}"))
            carries[f"_c_{a}"] = F.last(f"_t_{a}", True).over(before)
            local[f"_l_{a}"] = F.last(c, True).over(inside)
            final[a] = F.coalesce(F.col(f"_l_{a}"), F.col(f"_c_{a}"))
            continue
        totals += [F.sum(c).alias(f"_t_{a}"), F.count(c).alias(f"_n_{a}")]
        carries[f"_c_{a}"] = F.sum(f"_t_{a}").over(before)
        carries[f"_cn_{a}"] = F.coalesce(F.sum(f"_n_{a}").over(before), F.lit(0))
        local[f"_l_{a}"] = F.sum(c).over(inside)
        local[f"_ln_{a}"] = F.count(c).over(inside)
        total = F.coalesce(F.col(f"_l_{a}") + F.col(f"_c_{a}"), F.col(f"_l_{a}"), F.col(f"_c_{a}"))
        count = F.col(f"_ln_{a}") + F.col(f"_cn_{a}")
        final[a] = {"sum": total, "count": count, "mean": total / F.nullif(count, F.lit(0))}[item.kind]
    keyed = df.withColumn("_bucket", spec.bucket())
    carry = keyed.groupBy(*on).agg(*totals).withColumns(carries).select(*on, *carries)
    kept = df.columns
    return (
        null_safe_join(keyed, carry, on)
        .withColumns(local)
        .withColumns(final)
        .select(*[c for c in kept if c not in final], *final)
    )


def keep_one(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: str = "first"
) -> DataFrame:
    """One row per key by a total order.

    Done as an aggregate, not a ranking window: rows are reduced on the map side, so
    a key that holds a large share of the table is never sorted in one task.
    ``order`` is ascending; ``first`` keeps the smallest, ``last`` the largest.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    stamp = F.struct(*order)
    pick = F.min_by if keep == "first" else F.max_by
    picked = df.groupBy(*keys).agg(pick(row, stamp).alias("_row"))
    return picked.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])
