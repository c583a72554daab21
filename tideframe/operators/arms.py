"""Forecast arms that need only running moments: naive, drift, iterated AR(1), direct regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.functions.distributions import normal_quantile
from tideframe.operators.features import forward_value
from tideframe.operators.splits import is_origin
from tideframe.panel import Framed, PanelSpec, Running, framed, running, series_length, with_position

Z90, Z95 = normal_quantile(0.95), normal_quantile(0.975)


def _moments(x: Column, y: Column, stem: str) -> tuple[dict[str, Column], list[Running]]:
    """Per-row terms whose running sums give a one-regressor least squares fit."""
    both = x.isNotNull() & y.isNotNull()
    terms = {"x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    cells = {f"_{stem}_{k}": F.when(both, v) for k, v in terms.items()}
    items = [Running("sum", c, f"{c}_s") for c in cells] + [Running("count", f"_{stem}_x", f"_{stem}_n")]
    return cells, items


def _fit(stem: str) -> tuple[Column, Column, Column]:
    """Intercept, slope and residual variance from running sums."""
    n = F.nullif(F.col(f"_{stem}_n"), F.lit(0))
    s = {k: F.col(f"_{stem}_{k}_s") for k in ("x", "y", "xx", "xy", "yy")}
    sxx, sxy, syy = s["xx"] - s["x"] * s["x"] / n, s["xy"] - s["x"] * s["y"] / n, s["yy"] - s["y"] * s["y"] / n
    slope = F.when(sxx > 1e-12, sxy / sxx)
    return s["y"] / n - slope * s["x"] / n, slope, F.when(n > 2, F.greatest(syy - slope * sxy, F.lit(0.0)) / (n - 2))


def cumulative_level_sd(phi: Column, variance: Column, h: Column) -> Column:
    """Deviation of the sum of h AR(1) steps: sigma * sqrt(sum of squared running responses)."""
    def step(state: Column, _: Column) -> Column:
        psi = state["psi"] + state["power"]
        return F.struct((state["power"] * phi).alias("power"), psi.alias("psi"), (state["total"] + psi * psi).alias("total"))

    start = F.struct(F.lit(1.0).alias("power"), F.lit(0.0).alias("psi"), F.lit(0.0).alias("total"))
    return F.aggregate(F.sequence(F.lit(1), h), start, step, lambda s: F.sqrt(variance * s["total"]))


def linear_forecasts(
    df: DataFrame, spec: PanelSpec, level: str, horizons: Sequence[int], min_train: int, step: int
) -> DataFrame:
    """Walk-forward forecasts of four arms in long form, each fitted on data up to its origin."""
    def lags(w):
        d = F.col(level) - F.lag(level).over(w)
        return {"_d": d, **{f"_c{h}": F.col(level) - F.lag(level, h).over(w) for h in horizons}}

    def delayed(w):
        return {"_d1": F.lag("_d").over(w), **{f"_x{h}": F.lag("_d", h).over(w) for h in horizons}}

    top = max(horizons)
    base = framed(df.select(*spec.keys, spec.time, level), spec, Framed(top, 0, lags))
    base = framed(
        base, spec, Framed(top, 0, delayed),
        forward_value(level, horizons, "_actual"), forward_value(spec.time, horizons, "_target"))
    pairs = {"ar": ("_d1", "_d"), **{f"dir{h}": (f"_x{h}", f"_c{h}") for h in horizons}}
    cells, items = {"_dd": F.col("_d") * F.col("_d")}, [
        Running("sum", "_d", "_d_s"), Running("count", "_d", "_d_n"), Running("sum", "_dd", "_dd_s")]
    for stem, (x, y) in pairs.items():
        more, running_items = _moments(F.col(x), F.col(y), stem)
        cells.update(more)
        items += running_items
    fitted = running(base.withColumns(cells), spec, *items)
    fitted = series_length(with_position(fitted, spec, "rn"), spec, "n_rows").filter(is_origin(min_train, step, top))

    n = F.col("_d_n")
    mean = F.col("_d_s") / n
    a, phi, ar_var = _fit("ar")
    drift_var = F.greatest((F.col("_dd_s") - F.col("_d_s") * mean) / (n - 1), F.lit(0.0))
    cells = {"_mean": mean, "_drift_var": drift_var, "_a": a, "_phi": phi, "_ar_var": ar_var}
    per_horizon = []
    for h in horizons:
        da, db, _ = _fit(f"dir{h}")
        cells.update({f"_da{h}": da, f"_db{h}": db})
        per_horizon.append(F.struct(
            F.lit(h).alias("horizon"), F.col(f"_target{h}").alias("target_date"), F.col(f"_actual{h}").alias("actual"),
            F.col(f"_da{h}").alias("a"), F.col(f"_db{h}").alias("b")))
    shared = ["_d", "_mean", "_drift_var", "_a", "_phi", "_ar_var"]
    rows = fitted.withColumns(cells).select(
        *spec.keys, F.col(spec.time).alias("origin_date"), F.col(level).alias("naive"), *shared, F.explode(F.array(*per_horizon)).alias("_h"))
    y, h, mu = F.col("naive"), F.col("_h.horizon"), F.col("_mu")
    rows = rows.withColumn("_mu", F.col("_a") / (1 - F.col("_phi")))
    phi = F.col("_phi")
    none = F.lit(None).cast("double")
    arms = {
        "naive": (y, none),
        "drift": (y + h * F.col("_mean"), F.sqrt(F.col("_drift_var") * h)),
        "ar1": (y + h * mu + (F.col("_d") - mu) * phi * (1 - F.pow(phi, h)) / (1 - phi), cumulative_level_sd(phi, F.col("_ar_var"), h)),
        "direct": (y + F.col("_h.a") + F.col("_h.b") * F.col("_d"), none)}
    made = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("pred"), sd.alias("sd")) for m, (p, sd) in arms.items()])
    long = rows.select(
        *spec.keys, "origin_date", "naive", "_h.horizon", "_h.target_date", "_h.actual", F.explode(made).alias("_m"))
    pred, sd = F.col("_m.pred"), F.col("_m.sd")
    return long.select(
        *spec.keys, F.col("_m.model").alias("model"), "origin_date", "horizon", "target_date", "actual", "naive", pred.alias("pred"),
        (pred - Z90 * sd).alias("lo90"), (pred + Z90 * sd).alias("hi90"),
        (pred - Z95 * sd).alias("lo95"), (pred + Z95 * sd).alias("hi95"), pred.isNotNull().alias("fit_ok"))


def reconstruct_levels(df: DataFrame, level: str, change: str, bands: Sequence[str] = ()) -> DataFrame:
    """Level plus forecast change; band columns that hold changes shift likewise."""
    return df.withColumns({c: F.col(level) + F.col(c) for c in (change, *bands)})
