"""Causal features, grids, targets and sequence windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tideframe.panel import Framed, PanelSpec, framed, series_length, with_position


def difference(*columns: str, prefix: str = "d_") -> Framed:
    return Framed(1, 0, lambda w: {f"{prefix}{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def lagged(columns: Sequence[str], steps: Sequence[int]) -> Framed:
    if any(k < 1 for k in steps):
        raise ValueError(f"lags must be 1 or more, else the feature looks ahead: {list(steps)}")
    return Framed(
        max(steps), 0, lambda w: {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in steps}
    )


def rolling(column: str, rows: int, statistic: str, alias: str, shift: int = 1) -> Framed:
    """Rolling statistic of the series delayed by ``shift`` rows; null until the frame is full."""
    measures = {"std": F.stddev_samp, "sum": F.sum, "mean": F.avg}

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-(rows - 1 + shift), -shift)
        return {alias: F.when(F.count(column).over(frame) == rows, measures[statistic](column).over(frame))}

    return Framed(rows - 1 + shift, 0, build)


def bounded_fill(columns: Sequence[str], limit: int) -> Framed:
    """Forward-fill at most ``limit`` consecutive rows."""
    return Framed(
        limit, 0, lambda w: {c: F.last(c, True).over(w.rowsBetween(-limit, 0)) for c in columns}
    )


def forward_sum(column: str, horizons: Sequence[int], stem: str = "target_h") -> Framed:
    """Sum over the next h rows, null when fewer than h remain."""

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for h in horizons:
            ahead = w.rowsBetween(1, h)
            out[f"{stem}{h}"] = F.when(F.count(column).over(ahead) == h, F.sum(column).over(ahead))
        return out

    return Framed(0, max(horizons), build)


def forward_value(column: str, horizons: Sequence[int], stem: str) -> Framed:
    return Framed(
        0, max(horizons), lambda w: {f"{stem}{h}": F.lead(column, h).over(w) for h in horizons}
    )


def sequence_window(columns: Sequence[str], lookback: int, alias: str = "window") -> Framed:
    """The ``lookback`` rows before each row as an array of feature arrays; null until full."""

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-lookback, -1)
        row = F.array(*[F.col(c).cast("double") for c in columns])
        seq = F.collect_list(row).over(frame)
        return {alias: F.when(F.size(seq) == lookback, seq)}

    return Framed(lookback, 0, build)


def lag_block(columns: Sequence[str], rows: int, alias: str = "block", shift: int = 0) -> Framed:
    """The last ``rows`` rows flattened to one vector, oldest first; null until full."""

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-(rows - 1 + shift), -shift)
        complete = F.greatest(*[F.col(c).isNull() for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNull()
        row = F.when(~complete, F.array(*[F.col(c).cast("double") for c in columns]))
        seq = F.collect_list(row).over(frame)
        return {alias: F.when(F.size(seq) == rows, F.flatten(seq))}

    return Framed(rows - 1 + shift, 0, build)


def trim_edges(df: DataFrame, spec: PanelSpec, head: int, tail: int) -> DataFrame:
    """Drop the first ``head`` and the last ``tail`` rows of each series."""
    counted = series_length(with_position(df, spec, "_pos"), spec, "_n")
    return counted.filter((F.col("_pos") > head) & (F.col("_pos") <= F.col("_n") - tail)).drop("_pos", "_n")


def observed_volatility(df: DataFrame, spec: PanelSpec, column: str, windows: Sequence[int]) -> DataFrame:
    """Rolling sample deviation on the index of observed values: null rows leave before indexing."""
    items = [rolling(column, n, "std", f"vol_{n}", shift=0) for n in windows]
    return framed(df.filter(F.col(column).isNotNull()), spec, *items)


def clamp(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Closed date range; a frame without the column is refused."""
    if time not in df.columns:
        raise ValueError(f"no column {time!r} to clamp")
    return df.filter(F.col(time).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def day_window(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Half-open window in whole days: stamps within the last day stay."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return df.filter((F.col(time) >= first) & (F.col(time) < F.date_add(last, 1)))


def calendar_grid(df: DataFrame, spec: PanelSpec, unit: str = "day") -> DataFrame:
    """All days or months between the first and the last row of each series."""
    step = F.expr(f"interval 1 {unit}")
    bounds = df.groupBy(*spec.keys).agg(F.min(spec.time).alias("_lo"), F.max(spec.time).alias("_hi"))
    grid = F.explode(F.sequence("_lo", "_hi", step)).alias(spec.time)
    return bounds.select(*spec.keys, grid)


def densify(df: DataFrame, spec: PanelSpec, unit: str = "day") -> DataFrame:
    """Left-join each series onto its full calendar; days without a row hold nulls."""
    return calendar_grid(df, spec, unit).join(df, [*spec.keys, spec.time], "left")


def missing_periods(df: DataFrame, spec: PanelSpec, unit: str = "month") -> DataFrame:
    """Expected periods that have no row."""
    return calendar_grid(df, spec, unit).join(df, [*spec.keys, spec.time], "left_anti")


def year_over_year(df: DataFrame, spec: PanelSpec, column: str, alias: str, periods: int = 12) -> DataFrame:
    """Percent change against exactly ``periods`` calendar months earlier; gaps give null."""
    dense = densify(df, spec, "month")
    change = (F.col(column) / F.lag(column, periods).over(spec.window()) - 1) * 100
    return dense.withColumn(alias, change).filter(F.col(column).isNotNull())
