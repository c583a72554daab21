"""Forecast comparison tests on long frames: Diebold-Mariano, Clark-West, false-discovery control.

The long-run variance needs autocovariances up to lag h-1. They are ``lag`` columns
of one window and sums of one aggregate; no series leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.distributions import normal_tail, student_two_sided
from tideframe.functions.scalars import guarded_ratio, is_finite
from tideframe.panel import UNBOUNDED, null_safe_join
from tideframe.session import stored


def model_pairs(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All pairs of models that scored the same origin and horizon."""
    on = [*keys, "origin_date", "horizon"]
    a = forecasts.select(*on, "actual", F.col("model").alias("model_a"), F.col("pred").alias("pred_a"))
    b = forecasts.select(*on, F.col("model").alias("model_b"), F.col("pred").alias("pred_b"))
    return a.join(b, on).filter("model_a < model_b")


def against_naive(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of each model with the naive forecast of its own rows."""
    return forecasts.select(
        *keys, "origin_date", "horizon", "actual", F.col("model").alias("model_a"), F.lit("naive").alias("model_b"),
        F.col("pred").alias("pred_a"), F.col("naive").alias("pred_b"))


LOSSES = {"squared": lambda e: e * e, "absolute": F.abs}


def diebold_mariano(
    pairs: DataFrame, groups: Sequence[str], horizons: Sequence[int], alpha: float = 0.05,
    losses=LOSSES, p_values: bool = True,
) -> DataFrame:
    """Equal-accuracy test per group, horizon and loss; a negative statistic favours model A.

    Bartlett long-run variance truncated at h-1, Harvey small-sample factor, two-sided
    Student tail. The Bartlett weights are a box folded with itself, so the weighted sum
    of autocovariances is the mean square of all moving sums of h terms, those that
    overhang either end included. Groups with n <= h or no positive variance report
    ``insufficient_sample``.
    """
    groups = [*groups, "model_a", "model_b", "horizon"]
    part = Window.partitionBy(*groups)
    w = part.orderBy("origin_date")
    usable = pairs.filter(is_finite(F.col("actual")) & is_finite(F.col("pred_a")) & is_finite(F.col("pred_b")))
    usable = usable.filter(F.col("horizon").isin(*horizons))
    ea, eb = F.col("actual") - F.col("pred_a"), F.col("actual") - F.col("pred_b")
    d = usable.withColumns({f"_d_{k}": f(ea) - f(eb) for k, f in losses.items()})
    d = d.withColumns({f"_z_{k}": F.col(f"_d_{k}") - F.avg(f"_d_{k}").over(part) for k in losses})

    def by_horizon(make):
        out = F.lit(None).cast("double")
        for h in horizons:
            out = F.when(F.col("horizon") == h, make(h)).otherwise(out)
        return out

    ahead = {h: w.rowsBetween(0, h - 1) for h in horizons}
    d = d.withColumn("_full", by_horizon(lambda h: (F.count(F.lit(1)).over(ahead[h]) == h).cast("double")))
    for k in losses:
        z = f"_z_{k}"
        d = d.withColumns({
            f"_back_{k}": by_horizon(lambda h: F.sum(z).over(w.rowsBetween(-(h - 1), 0))),
            f"_rest_{k}": by_horizon(lambda h: F.sum(z).over(ahead[h]))})
    sums = [F.count(F.lit(1)).alias("n_forecasts")]
    for k in losses:
        back, rest = F.col(f"_back_{k}"), F.when(F.col("_full") == 0, F.col(f"_rest_{k}")).otherwise(0.0)
        sums += [F.avg(f"_d_{k}").alias(f"_mean_{k}"), F.sum(back * back + rest * rest).alias(f"_box_{k}")]
    out = d.groupBy(*groups).agg(*sums)
    n, h = F.col("n_forecasts"), F.col("horizon")
    harvey = F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(0.0)))
    for k in losses:
        variance = F.col(f"_box_{k}") / h / n / n
        stat = F.when((n > h) & (variance > 1e-20), F.col(f"_mean_{k}") / F.sqrt(variance) * harvey)
        out = out.withColumn(f"dm_{k}", stat)
    lacking = F.lit(False)
    for k in losses:
        lacking = lacking | F.col(f"dm_{k}").isNull()
    out = out.withColumn("insufficient_sample", lacking)
    out = out.withColumns({f"dm_{k}": F.when(~F.col("insufficient_sample"), F.col(f"dm_{k}")) for k in losses})
    out = out.select(*groups, "n_forecasts", "insufficient_sample", *[f"dm_{k}" for k in losses])
    if not p_values:
        return out
    out = out.withColumns({f"p_{k}": student_two_sided(F.col(f"dm_{k}"), (n - 1).cast("double")) for k in losses})
    names = {"squared": "rmse", "absolute": "mae"}
    flags = {}
    for k in losses:
        hit = F.coalesce(F.col(f"p_{k}") < alpha, F.lit(False))
        flags[f"a_better_{names.get(k, k)}"] = hit & (F.col(f"dm_{k}") < 0)
        flags[f"b_better_{names.get(k, k)}"] = hit & (F.col(f"dm_{k}") > 0)
    return out.withColumns({f: F.coalesce(c, F.lit(False)) for f, c in flags.items()})


def overall_winner(tests: DataFrame) -> DataFrame:
    """Model A wins overall only when both losses say so; likewise for B."""
    a = F.col("a_better_rmse") & F.col("a_better_mae")
    b = F.col("b_better_rmse") & F.col("b_better_mae")
    return tests.withColumn("overall", F.when(a, F.col("model_a")).when(b, F.col("model_b")).otherwise("none"))


def against_rivals(forecasts: DataFrame, keys: Sequence[str], model: str, rivals: Sequence[str]) -> DataFrame:
    """Pairs of one model with each rival that scored the same origin and horizon."""
    on = [*keys, "origin_date", "horizon"]
    own = forecasts.filter(F.col("model") == model).select(*on, "actual", F.lit(model).alias("model_a"), F.col("pred").alias("pred_a"))
    others = forecasts.filter(F.col("model").isin(*rivals)).select(*on, F.col("model").alias("model_b"), F.col("pred").alias("pred_b"))
    return own.join(others, on)


def rivals_report(tests: DataFrame, keys: Sequence[str], rivals: Sequence[str]) -> DataFrame:
    """One row per key and horizon: what the tests of one model say against each rival, under both losses, and how many
    rivals it beats, or loses to, under both."""
    on = [*keys, "model_a", "horizon"]
    shown = [c for c in tests.columns if c.startswith(("dm_", "p_", "a_better_", "b_better_"))]
    cells = [F.max(F.when(F.col("model_b") == m, F.col(c))).alias(f"{m}_{c}") for m in rivals for c in shown]
    flags = [c for c in shown if c.startswith(("a_", "b_"))]
    won = [F.count_if(F.forall(F.array(*[F.col(c) for c in flags if c.startswith(side)]), lambda x: x)).alias(name) for side, name in (("a_", "n_beaten"), ("b_", "n_lost_to"))] if flags else []
    return tests.groupBy(*on).agg(*cells, *won)


def clark_west(
    forecasts: DataFrame, groups: Sequence[str], alpha: float = 0.05, small_sample: bool = True, longest: int | None = None
) -> DataFrame:
    """Nested-model test of ``pred`` against ``naive`` per group and horizon, one-sided.

    Rows look back as far as the longest horizon needs; ``longest`` tells it, else the forecasts are asked (one more job).

    Rows keep their position: a row with a missing value takes no part, but the lag
    distance across it stays, and each autocovariance is divided by its own number of
    valid pairs. Null results where n <= h or n < 3.
    """
    groups = [*groups, "horizon"]
    part = Window.partitionBy(*groups)
    w = part.orderBy("origin_date")
    top = max(1, int(longest if longest is not None else forecasts.agg(F.max("horizon")).first()[0] or 1))
    too_far = F.raise_error(F.lit(f"a horizon is longer than {top}")).cast("long")
    forecasts = forecasts.withColumn("horizon", F.when(F.col("horizon") <= top, F.col("horizon").cast("long")).otherwise(too_far))
    valid = is_finite(F.col("actual")) & is_finite(F.col("naive")) & is_finite(F.col("pred"))
    e1, e2 = F.col("actual") - F.col("naive"), F.col("actual") - F.col("pred")
    adj = F.pow(F.col("naive") - F.col("pred"), 2)
    d = forecasts.select(*groups, "origin_date", *[
        F.when(valid, c).alias(a) for a, c in (("_sq1", e1 * e1), ("_sq2", e2 * e2), ("_adj", adj))])
    d = d.withColumn("_f", F.col("_sq1") - (F.col("_sq2") - F.col("_adj")))
    d = d.withColumns({"_z": F.col("_f") - F.avg("_f").over(part), "_at": F.row_number().over(w)})

    # Lag products only up to h-1: each row meets its h-1 predecessors, gaps keep their place.
    past = F.collect_list(F.struct("_z")).over(w.rowsBetween(-(top - 1), 0))
    near = F.reverse(F.col("_past"))
    products = F.transform(F.slice(near, F.lit(1), F.least(F.size("_past"), F.col("horizon"))), lambda s: s["_z"] * F.col("_z"))
    d = d.withColumn("_past", past).withColumn("_products", products)
    lagged = d.select(*groups, "_sq1", "_sq2", "_adj", "_f", F.posexplode_outer("_products").alias("_k", "_zz"))
    here = F.col("_k") == 0
    own = lambda c: F.when(here, F.col(c))
    per_lag = lagged.groupBy(*groups, "_k").agg(
        F.sum("_zz").alias("_s"), F.count("_zz").alias("_pairs"),
        *[F.sum(own(c)).alias(c) for c in ("_sq1", "_sq2", "_adj", "_f")])
    n_lag0 = F.max(F.when(here, F.col("_pairs")))
    gamma = F.coalesce(F.col("_s") / F.nullif(F.col("_pairs"), F.lit(0)), F.lit(0.0))
    weight = F.when(here, 1.0).otherwise(2 * (1 - F.col("_k") / F.col("horizon")))
    mean = lambda c: F.max(own(c)) / F.nullif(n_lag0, F.lit(0))
    out = per_lag.groupBy(*groups).agg(
        n_lag0.alias("n_forecasts"), mean("_sq1").alias("mspe_naive"), mean("_sq2").alias("mspe_model"),
        mean("_adj").alias("cw_adjustment"), mean("_f").alias("mean_f"), F.sum(weight * gamma).alias("_omega"))
    n, h = F.col("n_forecasts"), F.col("horizon")
    omega = F.greatest(F.col("_omega"), F.lit(1e-14))
    variance = omega / n / ((n - h) * (n - h + 1) / (n * n)) if small_sample else omega / n
    enough = (n > h) & (n >= 3)
    out = out.withColumns({"insufficient_sample": ~enough, "se_f": F.when(enough, F.sqrt(variance))})
    blank = ["mspe_naive", "mspe_model", "cw_adjustment", "mean_f"]
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in blank})
    stat = F.col("mean_f") / F.col("se_f")
    out = out.withColumns({
        "mspe_model_adj": F.col("mspe_model") - F.col("cw_adjustment"),
        "r2_oos": 1 - guarded_ratio(F.col("mspe_model"), F.col("mspe_naive")),
        "r2_oos_adj": guarded_ratio(F.col("mean_f"), F.col("mspe_naive")),
        "cw_stat": stat, "cw_p_value": normal_tail(stat)})
    better = F.coalesce((F.col("cw_p_value") < alpha) & (F.col("cw_stat") > 0), F.lit(False))
    return out.select(
        *groups, "n_forecasts", "mspe_naive", "mspe_model", "cw_adjustment", "mspe_model_adj", "r2_oos", "r2_oos_adj",
        "mean_f", "se_f", "cw_stat", "cw_p_value", better.alias("significant"), "insufficient_sample")


def fdr_adjust(df: DataFrame, p: str, alias: str, groups: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg adjusted p within each group; untestable (null) rows stay null.

    Equal p-values are counted first, then ranked inside value buckets with a running
    total over buckets, so one family of millions of tests is not sorted in one task.
    """
    on = [*groups, "_bin"]
    binned = F.least(F.floor(-F.ln(F.greatest(F.col(p), F.lit(1e-40))) * 256), F.lit(25_000))
    distinct = df.filter(F.col(p).isNotNull()).groupBy(*groups, p).agg(F.count(F.lit(1)).alias("_ties"))
    distinct = distinct.withColumn("_bin", binned)
    key = [F.col(g) for g in groups] or [F.lit(0)]
    bins = distinct.groupBy(*on).agg(F.sum("_ties").alias("_rows"))
    smaller = Window.partitionBy(*key).orderBy(F.col("_bin").desc()).rowsBetween(UNBOUNDED, -1)
    whole = Window.partitionBy(*key)
    bins = bins.select(
        *on, F.coalesce(F.sum("_rows").over(smaller), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("_m"))
    up = Window.partitionBy(*on).orderBy(p)
    ranked = null_safe_join(distinct, bins, on).withColumn("_rank", F.col("_before") + F.sum("_ties").over(up))
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    larger = Window.partitionBy(*key).orderBy("_bin").rowsBetween(UNBOUNDED, -1)
    floors = ranked.groupBy(*on).agg(F.min("_raw").alias("_low"))
    floors = floors.select(*on, F.min("_low").over(larger).alias("_later"))
    down = Window.partitionBy(*on).orderBy(F.col(p).desc())
    adjusted = null_safe_join(ranked, floors, on).select(
        *groups, F.col(p).alias("_p"),
        F.least(F.min("_raw").over(down), F.coalesce(F.col("_later"), F.lit(1.0)), F.lit(1.0)).alias(alias))
    match = F.col("_l." + p) == F.col("_r._p")
    for g in groups:
        match = match & F.col("_l." + g).eqNullSafe(F.col("_r." + g))
    return df.alias("_l").join(adjusted.alias("_r"), match, "left").select("_l.*", f"_r.{alias}")


def fdr_two_tiers(tests: DataFrame, family: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Adjust over the whole family and within each horizon; significance needs a positive statistic.

    Both tiers are ranked in one pass: a p-value stands in the family of all horizons and in that of its own. The result table is
    stored first, since it is read twice.
    """
    out = stored(tests.withColumn("_p", F.when(~F.col("insufficient_sample"), F.col("cw_p_value"))), "tests")
    tier = F.explode(F.array(F.struct(F.lit("global").alias("_tier"), F.lit(None).cast("long").alias("_of")), F.struct(F.lit("horizon").alias("_tier"), F.col("horizon").cast("long").alias("_of")))).alias("_t")
    rows = out.filter(F.col("_p").isNotNull()).select(*family, "horizon", "_p", tier).select(*family, "horizon", "_p", "_t.*")
    ranked = fdr_adjust(rows, "_p", "_adjusted", [*family, "_tier", "_of"])
    both = ranked.groupBy(*family, "horizon", "_p").agg(*[F.max(F.when(F.col("_tier") == t, F.col("_adjusted"))).alias(f"p_adj_{t}") for t in ("global", "horizon")])
    return null_safe_join(out, both, [*family, "horizon", "_p"], "left").drop("_p").withColumns({
        f"significant_fdr_{tier}": F.coalesce((F.col(f"p_adj_{tier}") <= alpha) & (F.col("cw_stat") > 0), F.lit(False))
        for tier in ("global", "horizon")})


def regime_report(
    tagged: DataFrame, groups: Sequence[str], metrics: DataFrame, alpha: float = 0.05, longest: int | None = None
) -> DataFrame:
    """Metrics and test per regime; the test is shown only where n >= 5h, groups with n < 3 are dropped."""
    tests = clark_west(tagged, groups, alpha, longest=longest)
    on = [*groups, "horizon"]
    shown = metrics.filter("n_forecasts >= 3").join(
        tests.drop("n_forecasts", "insufficient_sample"), on)
    powered = F.col("n_forecasts") >= 5 * F.col("horizon")
    gated = {c: F.when(powered, F.col(c)) for c in ("r2_oos_adj", "cw_stat", "cw_p_value")}
    return shown.withColumns({
        **gated, "insufficient_sample": ~powered, "significant": F.col("significant") & powered})


def mspe_decomposition(tests: DataFrame) -> DataFrame:
    """Raw difference, adjusted difference and the share the adjustment explains."""
    raw = F.col("mspe_naive") - F.col("mspe_model")
    return tests.withColumns({
        "raw_diff": raw, "adjusted_diff": F.col("mspe_naive") - F.col("mspe_model_adj"),
        "adjustment_share_pct": guarded_ratio(F.col("cw_adjustment"), F.col("mspe_model")) * 100})
