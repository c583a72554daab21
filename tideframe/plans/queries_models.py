"""Queries: collinearity, unit roots, lag order, vector models, cointegration, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import cointegration as co
from tideframe.operators import diagnostics as dg
from tideframe.operators import vector_models as vm
from tideframe.operators.scoring import error_metrics, interval_coverage
from tideframe.panel import Running, running
from tideframe.plans import views as v
from tideframe.plans import walkforward as wf
from tideframe.plans.catalogue import query, r, rounded
from tideframe.plans.views import HORIZONS, MIN_TRAIN, SPEC, STEP, sql_with
from tideframe.session import stored

WALKS = ["walk_orders", "walk_linked", "walk_supply", "walk_counts", "walk_quantity", "walk_shipped"]
LAGS = 10


def walks(spark, folder):
    """Six integrated series per region: summed surprises of orders, supply, counts and quantity, and noisy doubles of two.

    The second moves with the first and the sixth with the third, so the system has two cointegrating relations by
    construction. What parts them is the surprise of the day's mean discount or tax, which none of the sums holds.
    """
    both = v.daily_region(spark, folder).join(v.daily_supply(spark, folder, terms=True), ["series", "date"])
    means = both.groupBy("series").agg(*[F.avg(c).alias(f"m_{c}") for c in ("y", "s", "n", "q", "discount", "tax")])
    surprise = both.join(means, "series").select(
        "series", "date", *[(F.col(c) - F.col(f"m_{c}")).alias(f"e_{c}") for c in ("y", "s")], *[(F.col(c) / F.col(f"m_{c}") - 1).alias(f"e_{c}") for c in ("n", "q", "discount", "tax")])
    sums = [Running("sum", f"e_{c}", f"walk_{w}") for c, w in (("y", "orders"), ("s", "supply"), ("n", "counts"), ("q", "quantity"))]
    return running(surprise, SPEC, *sums).select(
        "series", "date", "walk_orders", (2 * F.col("walk_orders") - F.col("e_discount")).alias("walk_linked"), "walk_supply", "walk_counts", "walk_quantity",
        (2 * F.col("walk_supply") - F.col("e_tax")).alias("walk_shipped"))


@query("corr_levels_vs_diffs", sql_with("""
SELECT series, form, 'n' AS column_a, 's' AS column_b, """ + r("corr(n,s)", "corr") + " FROM src WHERE y IS NOT NULL AND n IS NOT NULL AND s IS NOT NULL GROUP BY 1,2 UNION ALL "
    "SELECT series, form, 'y', 'n', " + r("corr(y,n)", "corr") + " FROM src WHERE y IS NOT NULL AND n IS NOT NULL AND s IS NOT NULL GROUP BY 1,2 UNION ALL "
    "SELECT series, form, 'y', 's', " + r("corr(y,s)", "corr") + " FROM src WHERE y IS NOT NULL AND n IS NOT NULL AND s IS NOT NULL GROUP BY 1,2",
    "daily_region", "daily_supply",
    levels="SELECT series, date, y, CAST(n AS DOUBLE) AS n, s FROM daily_region JOIN daily_supply USING (series, date)",
    src="SELECT 'level' AS form, series, y, n, s FROM levels UNION ALL SELECT 'diff', series, y-lag(y) OVER w, n-lag(n) OVER w, s-lag(s) OVER w FROM levels WINDOW w AS (PARTITION BY series ORDER BY date)"))
def corr_levels_vs_diffs(spark, folder):
    from tideframe.operators.features import difference
    from tideframe.panel import framed

    levels = v.daily_region(spark, folder).join(v.daily_supply(spark, folder).select("series", "date", "s"), ["series", "date"])
    d = framed(levels, SPEC, difference("y", "n", "s"))
    forms = F.explode(F.array(*[
        F.struct(F.lit(form).alias("form"), *[F.col(f"{pre}{c}").cast("double").alias(c) for c in ("y", "n", "s")])
        for form, pre in (("level", ""), ("diff", "d_"))])).alias("_f")
    return rounded(dg.correlations(d.select("series", forms).select("series", "_f.*"), ["series", "form"], ["y", "n", "s"]))


@query("vif_two_columns", f"""
SELECT l_returnflag AS series, 'l_quantity' AS feature, {r('1/(1-pow(corr(l_quantity,l_extendedprice),2))','vif')} FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_extendedprice', {r('1/(1-pow(corr(l_quantity,l_extendedprice),2))','vif')} FROM lineitem GROUP BY 1""")
def vif_two_columns(spark, folder):
    li = v.table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "series")
    return rounded(dg.variance_inflation(li, ["series"], ["l_quantity", "l_extendedprice"]))


@query("vif_many_columns")
def vif_many_columns(spark, folder):
    li = v.table(spark, folder, "lineitem").withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = dg.variance_inflation(li, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_net"])
    return rounded(out, 4)


@query("adf")
def adf(spark, folder):
    """Order levels are stationary around a mean, their running sums are not."""
    return rounded(dg.integration_report(walks(spark, folder), SPEC, WALKS), 4)


@query("lag_order")
def lag_order(spark, folder):
    return rounded(dg.lag_order(stored(walks(spark, folder), "walks"), SPEC, WALKS), 6)


@query("johansen")
def johansen(spark, folder):
    return rounded(co.johansen(stored(walks(spark, folder), "walks"), SPEC, WALKS, LAGS), 4)


def ranked(spark, folder):
    data = stored(walks(spark, folder), "walks")
    return data, stored(co.primary_rank(co.johansen(data, SPEC, WALKS, LAGS), ["series"]), "ranks")


@query("error_correction")
def error_correction(spark, folder):
    return rounded(co.error_correction(*_with_ranks(spark, folder)), 5)


def _with_ranks(spark, folder):
    data, ranks = ranked(spark, folder)
    return data, SPEC, WALKS, LAGS, ranks


@query("vecm")
def vecm(spark, folder):
    data, ranks = ranked(spark, folder)
    return rounded(co.vecm_forecasts(data, SPEC, WALKS, "walk_orders", LAGS, ranks, HORIZONS, MIN_TRAIN, STEP), 5)


@query("cointegration_job")
def cointegration_job(spark, folder):
    """Two systems through gate, rank and forecasts; the report names series without forecasts."""
    data = stored(walks(spark, folder), "walks")
    forecasts, report = wf.run_systems(
        data, SPEC, {"three": WALKS[:3], "two": WALKS[:2]}, "walk_orders", LAGS, HORIZONS, MIN_TRAIN, STEP)
    scored = error_metrics(forecasts, ["system", "series", "horizon"]).select("system", "series", "horizon", "n_forecasts", "rmse", "naive_rmse")
    return rounded(report.join(scored, ["system", "series"], "left"), 5)


@query("granger")
def granger(spark, folder):
    return rounded(co.granger(stored(walks(spark, folder), "walks"), SPEC, WALKS, LAGS), 4)


def irf_frame(spark, folder):
    data, ranks = ranked(spark, folder)
    return co.impulse_responses(data, SPEC, WALKS, LAGS, ranks)


@query("irf")
def irf(spark, folder):
    return rounded(irf_frame(spark, folder))


@query("fevd")
def fevd(spark, folder):
    return rounded(co.variance_shares(irf_frame(spark, folder), ["series"]))


@query("irf_summary")
def irf_summary(spark, folder):
    return rounded(co.response_summary(irf_frame(spark, folder), ["series"]))


@query("fevd_summary")
def fevd_summary(spark, folder):
    return rounded(co.top_contributors(co.variance_shares(irf_frame(spark, folder), ["series"]), ["series"], 20))


# ---- the same operators where SQL can follow: one variable, or one lag of two -------------

_LAGGED = "SELECT series, date, y, lag(y) OVER (PARTITION BY series ORDER BY date) AS y1, y - lag(y) OVER (PARTITION BY series ORDER BY date) AS dy FROM daily_region"


@query("johansen_single", sql_with(f"""
SELECT series, CAST(det_order AS BIGINT) AS det_order, round(lam, 6) + 0.0 AS eigenvalue, round(-n * ln(1 - lam), 4) + 0.0 AS trace_stat, cv AS trace_cv_95, -n * ln(1 - lam) > cv AS trace_reject_95,
 CASE WHEN -n * ln(1 - lam) > cv THEN 1 ELSE 0 END AS trace_rank FROM (
 SELECT series, -1 AS det_order, count(*) AS n, pow(sum(dy * y1), 2) / (sum(dy * dy) * sum(y1 * y1)) AS lam, 4.1296 AS cv FROM src WHERE y1 IS NOT NULL GROUP BY 1
 UNION ALL SELECT series, 0, count(*), pow(corr(dy, y1), 2), 3.8415 FROM src WHERE y1 IS NOT NULL GROUP BY 1)""", "daily_region", src=_LAGGED).replace("4.1296 AS cv", "CAST(4.1296 AS DOUBLE) AS cv").replace("3.8415 FROM", "CAST(3.8415 AS DOUBLE) FROM"))
def johansen_single(spark, folder):
    """Rank tests of one variable without lags: the eigenvalue is a squared correlation."""
    tests = co.johansen(v.daily_region(spark, folder).select("series", "date", "y"), SPEC, ["y"], 0).filter("det_order < 1")
    out = tests.select("series", "det_order", F.round("eigenvalue", 6).alias("eigenvalue"), F.round("trace_stat", 4).alias("trace_stat"), "trace_cv_95", "trace_reject_95", F.col("trace_rank").cast("int").alias("trace_rank"))
    return rounded(out)


def _given_rank(df):
    return df.select("series").distinct().withColumn("rank", F.lit(1).cast("long"))


@query("error_correction_single", sql_with(f"""
SELECT series, variable, round(CASE variable WHEN 'y' THEN 1 ELSE regr_intercept(dy, y1) / regr_slope(dy, y1) END, 4) + 0.0 AS beta, CASE variable WHEN 'y' THEN round(regr_slope(dy, y1), 4) + 0.0 END AS alpha
FROM src, (SELECT unnest(['y', 'constant']) AS variable) GROUP BY 1, 2""", "daily_region", src=_LAGGED))
def error_correction_single(spark, folder):
    """One variable of rank 1: the adjustment is a regression slope, the constant stands inside the relation."""
    data = stored(v.daily_region(spark, folder).select("series", "date", "y"), "panel")
    return rounded(co.error_correction(data, SPEC, ["y"], 0, _given_rank(data)).select("series", "variable", "beta", "alpha"), 4)


@query("irf_single", sql_with(f"""
SELECT series, CAST(h AS BIGINT) AS horizon, {r("pow(1 + b, h) * s", "response", 5)}, round(sum(pow(1 + b, h) * s) OVER (PARTITION BY series ORDER BY h ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS cumulative_response
FROM (SELECT series, regr_slope(dy, y1) AS b, sqrt((regr_syy(dy, y1) - regr_slope(dy, y1) * regr_sxy(dy, y1)) / regr_count(dy, y1)) AS s FROM src GROUP BY 1), (SELECT unnest(range(21)) AS h)""", "daily_region", src=_LAGGED))
def irf_single(spark, folder):
    """Responses of one variable of rank 1 fall by one factor per step."""
    data = stored(v.daily_region(spark, folder).select("series", "date", "y"), "panel")
    return rounded(co.impulse_responses(data, SPEC, ["y"], 0, _given_rank(data)).select("series", "horizon", "response", "cumulative_response"), 5)


@query("vecm_single", sql_with(f"""
SELECT series, date AS origin_date, CAST(h AS BIGINT) AS horizon, {r("y * pow(1 + b, h) + a * (pow(1 + b, h) - 1) / b", "pred", 5)},
 round({vm.Z90!r} * sqrt(s2 * (pow(1 + b, 2 * h) - 1) / (pow(1 + b, 2) - 1)), 5) + 0.0 AS half90 FROM (
 SELECT *, regr_slope(dy, y1) OVER e AS b, regr_intercept(dy, y1) OVER e AS a,
  (regr_syy(dy, y1) OVER e - regr_slope(dy, y1) OVER e * regr_sxy(dy, y1) OVER e) / regr_count(dy, y1) OVER e AS s2,
  row_number() OVER (PARTITION BY series ORDER BY date) AS rn, count(*) OVER (PARTITION BY series) AS n_rows FROM src
 WINDOW e AS (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING)), (SELECT unnest([1, 5, 20]) AS h)
WHERE rn >= {MIN_TRAIN} AND (rn - {MIN_TRAIN}) % {STEP} = 0 AND rn < n_rows - 20""", "daily_region", src=_LAGGED))
def vecm_single(spark, folder):
    """Walk-forward error correction of one variable, with its band, against SQL's regression aggregates."""
    data = stored(v.daily_region(spark, folder).select("series", "date", "y"), "panel")
    out = co.vecm_forecasts(data, SPEC, ["y"], "y", 0, _given_rank(data), HORIZONS, MIN_TRAIN, STEP)
    return rounded(out.select("series", "origin_date", "horizon", "pred", (F.col("hi90") - F.col("pred")).alias("half90")), 5)


def _granger_sql() -> str:
    """The squared t of one lag after the other regressors are taken out of it, one after the other."""
    lag = lambda c, k: f"lag({c}, {k}) OVER (PARTITION BY series ORDER BY date)"
    pair = lambda z, x: (f"SELECT series, '{x}' AS causing, '{z}' AS caused, CAST({z} AS DOUBLE) AS z, {lag(z, 1)} AS a, {lag(z, 2)} AS b, {lag(x, 2)} AS c, {lag(x, 1)} AS t FROM both_")
    ctes = {"both_": "SELECT series, date, y, CAST(n AS DOUBLE) AS n FROM daily_region", "s0": f"SELECT * FROM ({pair('y', 'n')} UNION ALL {pair('n', 'y')}) WHERE b IS NOT NULL"}
    part = "OVER (PARTITION BY series, causing)"
    ctes["s1"] = "SELECT series, causing, caused, count(*) " + part + " AS n, " + ", ".join(f"{x} - avg({x}) {part} AS {x}" for x in "zabct") + " FROM s0"
    for i, used in enumerate("abc", start=2):
        left = [x for x in "zabct" if x != used and x >= used or x in "zt"]
        ctes[f"s{i}"] = f"SELECT series, causing, caused, n, {', '.join(f'{x} - {used} * sum({x} * {used}) {part} / sum({used} * {used}) {part} AS {x}' for x in left)} FROM s{i - 1}"
    return sql_with("""
SELECT series, causing, caused, round(pow(b, 2) * tt / ((zz - b * zt) / (n - 5)), 3) + 0.0 AS test_statistic, CAST(1 AS BIGINT) AS df_num, CAST(2 * (n - 5) AS BIGINT) AS df_denom
FROM (SELECT series, causing, caused, n, sum(z * t) / sum(t * t) AS b, sum(t * t) AS tt, sum(z * z) AS zz, sum(z * t) AS zt FROM s4 GROUP BY ALL)""", "daily_region", **ctes)


@query("granger_pair", _granger_sql())
def granger_pair(spark, folder):
    """Causality between order value and count with one tested lag each way."""
    data = v.daily_region(spark, folder).select("series", "date", "y", F.col("n").cast("double").alias("n"))
    out = co.granger(stored(data, "panel"), SPEC, ["y", "n"], 0)
    return rounded(out.select("series", "causing", "caused", "test_statistic", "df_num", "df_denom"), 3)


# Yearly mean discounts by line status and return flag serve as a response table that SQL can build too.
_RESP = """SELECT l_linestatus AS shock, l_returnflag AS response_variable, CAST(year(l_shipdate) - 1995 AS BIGINT) AS horizon,
 avg(l_discount) - 0.05 AS response FROM lineitem GROUP BY 1,2,3"""


def response_table(spark, folder):
    li = v.table(spark, folder, "lineitem")
    return li.groupBy(F.col("l_linestatus").alias("shock"), F.col("l_returnflag").alias("response_variable"), (F.year("l_shipdate") - 1995).cast("long").alias("horizon")).agg(
        (F.avg("l_discount") - 0.05).alias("response"))


@query("fevd_from_irf", sql_with(f"""
SELECT horizon, response_variable, shock, {r('c / sum(c) OVER (PARTITION BY response_variable, horizon)','proportion')} FROM (
 SELECT *, sum(response*response) OVER (PARTITION BY shock, response_variable ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS c FROM resp)""", resp=_RESP))
def fevd_from_irf(spark, folder):
    """The variance-share windows over a response table made from line items."""
    return rounded(co.variance_shares(response_table(spark, folder), []))


@query("irf_peak_summary", sql_with(f"""
SELECT shock, response_variable, {r('peak','peak')}, {r('final','final')}, CASE WHEN peak > 0 THEN 'rises' ELSE 'falls' END AS direction,
 CASE WHEN abs(peak) < 1e-9 OR abs(final) < 0.25*abs(peak) THEN 'fades out' ELSE 'stays away' END AS persistence FROM (
 SELECT shock, response_variable, arg_max(response, (round(abs(response),12), -horizon)) AS peak, arg_max(response, horizon) AS final FROM resp GROUP BY 1,2)""", resp=_RESP))
def irf_peak_summary(spark, folder):
    return rounded(co.response_summary(response_table(spark, folder), []).drop("peak_horizon"))


@query("running_response", sql_with(f"SELECT shock, response_variable, horizon, {r('sum(response) OVER (PARTITION BY shock, response_variable ORDER BY horizon ROWS UNBOUNDED PRECEDING)','cumulative_response')} FROM resp", resp=_RESP))
def running_response(spark, folder):
    return rounded(co.with_running_response(response_table(spark, folder), []).drop("response"))


@query("var_forecast")
def var_forecast(spark, folder):
    """VAR(2) of order value and supply differences with the order count as exogenous path."""
    both = v.daily_region(spark, folder).join(v.daily_supply(spark, folder).select("series", "date", "s"), ["series", "date"])
    out = vm.iterated_var(stored(both, "panel"), SPEC, ["y", "s"], "y", 2, HORIZONS, MIN_TRAIN, STEP, exogenous=["n"])
    return rounded(out)


@query("direct_regression_many")
def direct_regression_many(spark, folder):
    both = v.daily_region(spark, folder).join(v.daily_supply(spark, folder).select("series", "date", "s"), ["series", "date"])
    return rounded(vm.direct_regression(stored(both, "panel"), SPEC, ["y", "s"], "y", 2, HORIZONS, MIN_TRAIN, STEP))


@query("feature_set_comparison")
def feature_set_comparison(spark, folder):
    from tideframe.operators.accuracy_tests import diebold_mariano, model_pairs

    both = v.daily_region(spark, folder).join(v.daily_supply(spark, folder).select("series", "date", "s"), ["series", "date"])
    f = vm.feature_set_comparison(stored(both, "panel"), SPEC, ["y"], ["s"], "y", 2, HORIZONS, MIN_TRAIN, STEP)
    return rounded(diebold_mariano(model_pairs(stored(f, "forecasts"), ["series"]), ["series"], HORIZONS), 4)


@query("var_interval_coverage")
def var_interval_coverage(spark, folder):
    out = vm.iterated_var(stored(v.daily_region(spark, folder), "panel"), SPEC, ["y"], "y", 2, HORIZONS, MIN_TRAIN, STEP)
    return rounded(interval_coverage(out, ["series", "horizon"], {90: "lo90", 95: "lo95"}, {90: "hi90", 95: "hi95"}), 4)


@query("arma_hr")
def arma_hr(spark, folder):
    """Order by AIC per region, then walk-forward; unstable fits are flagged."""
    data = stored(v.daily_region(spark, folder).select("series", "date", "y"), "panel")
    best = stored(vm.arma_orders(data, SPEC, "y").filter("best_aic"), "orders")
    return rounded(vm.arma_forecasts(data, SPEC, "y", best, HORIZONS, MIN_TRAIN, STEP))


@query("arma_orders")
def arma_orders(spark, folder):
    return rounded(vm.arma_orders(v.daily_region(spark, folder).select("series", "date", "y"), SPEC, "y"), 4)


# ---- trees and sequence data -----------------------------------------------

TREE_LAGS, FOLDS, SEEDS = (1, 2, 3, 4, 5, 10, 20), 5, (42, 0, 1, 7, 2024)


def search_space():
    """Three rates with their number of trees, three depths, three strengths of sampling and penalty, and the settings before any search."""
    from tideframe.operators.boosting import Setting
    from tideframe.operators.trees import CANONICAL

    space = [Setting(depth=depth, rate=rate, trees=n, rows=share, columns=share, least=least, l2=l2) for rate, n in ((0.01, 600), (0.03, 300), (0.10, 150)) for depth in (2, 3, 4)
             for share, least, l2 in ((0.7, 5.0, 5.0), (0.8, 1.0, 1.0), (1.0, 1.0, 0.5))]
    return space if CANONICAL in space else [*space, CANONICAL]


def tree_frame(spark, folder, horizons=(1, 5), lags=(1, 2, 5)):
    from tideframe.operators.trees import tabular_features

    both = v.daily_region(spark, folder).join(v.daily_supply(spark, folder).select("series", "date", "s"), ["series", "date"])
    data, names = tabular_features(both, SPEC, "y", ["n", "s"], list(lags), horizons)
    return stored(data, "features"), names


def _tabular_sql() -> str:
    """The feature table of the tree arm: lags, momentum, deviation, targets, trimmed at both ends."""
    part, changes = "PARTITION BY series ORDER BY date", ("d_y", "d_n", "d_s")
    frame = lambda fn, c, n: f"CASE WHEN count({c}) OVER ({part} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN {fn}({c}) OVER ({part} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
    cells = {f"{c}_lag{k}": f"lag({c},{k}) OVER ({part})" for c in changes for k in (1, 2, 5)}
    for n in (5, 20):
        cells[f"mom_{n}"] = frame("sum", "d_y", n)
        cells.update({f"vol_{c}_{n}": frame("stddev_samp", c, n) for c in changes})
    names = list(cells)
    for h in (1, 5):
        ahead = f"OVER ({part} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        cells[f"target_h{h}"] = f"CASE WHEN count(d_y) {ahead} = {h} THEN sum(d_y) {ahead} END"
        cells[f"actual_h{h}"] = f"lead(y,{h}) OVER ({part})"
    shown = ", ".join(r(c, c) for c in ("y", "d_y", "d_s", *cells) if c not in [f"d_n_lag{k}" for k in (1, 2, 5)])
    return sql_with(
        f"SELECT series, date, d_n, d_n_lag1, d_n_lag2, d_n_lag5, target_date_h1, target_date_h5, {shown} FROM f WHERE i > 21 AND i <= c - 5 AND {' AND '.join(f'{n} IS NOT NULL' for n in names)}",
        "daily_region", "daily_supply",
        d=f"SELECT series, date, y, y-lag(y) OVER ({part}) AS d_y, n-lag(n) OVER ({part}) AS d_n, s-lag(s) OVER ({part}) AS d_s FROM daily_region JOIN daily_supply USING (series, date)",
        f=f"SELECT *, lead(date,1) OVER ({part}) AS target_date_h1, lead(date,5) OVER ({part}) AS target_date_h5, row_number() OVER ({part}) AS i, count(*) OVER (PARTITION BY series) AS c, "
          + ", ".join(f"{e} AS {n}" for n, e in cells.items()) + " FROM d")


@query("tabular_features", _tabular_sql())
def tabular_features(spark, folder):
    return rounded(tree_frame(spark, folder)[0].drop("n", "s"))


@query("gbt_walk_forward")
def gbt_walk_forward(spark, folder):
    from tideframe.operators.trees import CANONICAL, walk_forward

    data, names = tree_frame(spark, folder, HORIZONS, TREE_LAGS)
    return rounded(walk_forward(data, names, SPEC, "y", HORIZONS, MIN_TRAIN, FOLDS, CANONICAL), 5)


@query("gbt_search")
def gbt_search(spark, folder):
    """All 28 settings over five seeds and three horizons, ranked, on rows before the first scored origin."""
    from tideframe.operators.trees import CANONICAL, search

    data, names = tree_frame(spark, folder, HORIZONS, TREE_LAGS)
    return rounded(search(data, names, SPEC, HORIZONS, 150, search_space(), SEEDS, CANONICAL), 5)


def _whole_sample(spark, folder):
    from tideframe.operators.trees import CANONICAL, whole_sample

    data, names = tree_frame(spark, folder, HORIZONS, TREE_LAGS)
    return (*whole_sample(data, names, SPEC, HORIZONS, CANONICAL), names)


@query("permutation_importance")
def permutation_importance(spark, folder):
    from tideframe.operators.trees import permutation_importance as shuffled

    rows, fitted, names = _whole_sample(spark, folder)
    return rounded(shuffled(rows, fitted, names, SPEC, HORIZONS))


@query("split_importance")
def split_importance(spark, folder):
    from tideframe.operators.trees import split_importance as by_gain

    _, fitted, names = _whole_sample(spark, folder)
    return rounded(by_gain(fitted, names, HORIZONS))


@query("tree_attribution")
def tree_attribution(spark, folder):
    """What each feature adds to each row's forecast at each horizon."""
    from tideframe.operators.trees import attribution

    rows, fitted, names = _whole_sample(spark, folder)
    return rounded(attribution(rows, fitted, names, SPEC, HORIZONS))


@query("attribution_summary")
def attribution_summary(spark, folder):
    from tideframe.operators.trees import attribution, mean_attribution

    rows, fitted, names = _whole_sample(spark, folder)
    return rounded(mean_attribution(attribution(rows, fitted, names, SPEC, HORIZONS)))


# The stump splits on bins whose cut points are given, so SQL can try them all.
_STUMP_CUTS = {"l_quantity": [5.0 * k for k in range(1, 10)], "l_discount": [k / 100 for k in range(0, 10)], "l_tax": [k / 100 for k in range(0, 8)]}


@query("boosted_stump", sql_with("""
SELECT l_returnflag, feature, CAST(cut AS DOUBLE) AS cut, round(gain, 4) + 0.0 AS gain, round(gl / (nl + 1), 6) + 0.0 AS left_value, round((g - gl) / (n - nl + 1), 6) + 0.0 AS right_value, nl AS n_left, n - nl AS n_right FROM (
 SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(gain, 4) DESC, place, cut) AS best FROM (
  SELECT *, (gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) - g * g / (n + 1)) / 2 AS gain FROM sides WHERE nl > 0 AND nl < n)) WHERE best = 1""",
    rows="SELECT l_returnflag, l_quantity, l_discount, l_tax, l_extendedprice / 1000 - avg(l_extendedprice / 1000) OVER (PARTITION BY l_returnflag) AS y FROM lineitem",
    cuts=" UNION ALL ".join(f"SELECT {i} AS place, '{n}' AS feature, unnest({c}) AS cut" for i, (n, c) in enumerate(_STUMP_CUTS.items())),
    cells=" UNION ALL ".join(f"SELECT l_returnflag, '{n}' AS feature, {n} AS x, sum(y) AS g, count(*) AS n FROM rows GROUP BY ALL" for n in _STUMP_CUTS),
    sides="SELECT l_returnflag, place, cuts.feature, cut, sum(CASE WHEN x <= cut THEN g ELSE 0 END) AS gl, sum(CASE WHEN x <= cut THEN n ELSE 0 END) AS nl, sum(g) AS g, sum(n) AS n "
          "FROM cells JOIN cuts USING (feature) GROUP BY ALL"))
def boosted_stump(spark, folder):
    """One split per return flag over all line items, each flag a model of its own, grown together."""
    from tideframe.operators import boosting as bo

    names, flags = list(_STUMP_CUTS), ["A", "N", "R"]
    li = v.table(spark, folder, "lineitem").select("l_returnflag", *names, (F.col("l_extendedprice") / 1000).alias("price"), F.xxhash64("l_orderkey", "l_linenumber").alias("number"))
    rows = bo.binned(li, names, list(_STUMP_CUTS.values())).select(
        "bins", F.array("price").alias("targets"), bo.marks([(F.col("l_returnflag") == f, F.lit(False)) for f in flags]).alias("use"), "number")
    fitted = bo.fit_trees(rows, [bo.Setting(mark=i, trees=1, depth=1, rate=1.0) for i in range(len(flags))])
    cut = F.get(F.get(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in _STUMP_CUTS.values()]), F.get("feature", F.lit(0))), F.get("cut", F.lit(0)))
    value, cover = (lambda i: F.get("value", F.lit(i))), (lambda i: F.get("cover", F.lit(i)).cast("long"))
    out = fitted.filter("tree = 1").select(
        F.get(F.array(*[F.lit(f) for f in flags]), F.col("model")).alias("l_returnflag"), F.get(F.array(*[F.lit(n) for n in names]), F.get("feature", F.lit(0))).alias("feature"), cut.alias("cut"),
        F.round(F.get("gain", F.lit(0)), 4).alias("gain"), value(1).alias("left_value"), value(2).alias("right_value"), cover(1).alias("n_left"), cover(2).alias("n_right"))
    return rounded(out)


_SEQ = "PARTITION BY series ORDER BY date"


@query("sequence_dataset", sql_with(f"""
SELECT series, fold, role, count(*) AS n_windows, min(date) AS first_date, max(date) AS last_date, {r('avg(t1)','mean_target_h1')}, {r('avg(t5)','mean_target_h5')} FROM lab GROUP BY 1,2,3""",
    "daily_region",
    d=f"SELECT * FROM (SELECT series, date, y, y-lag(y) OVER ({_SEQ}) AS dy, n-lag(n) OVER ({_SEQ}) AS dn FROM daily_region) WHERE dy IS NOT NULL",
    wn=f"SELECT *, count(*) OVER ({_SEQ} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS c, lead(dy) OVER ({_SEQ}) AS t1, CASE WHEN count(dy) OVER ({_SEQ} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)=5 THEN sum(dy) OVER ({_SEQ} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END AS t5 FROM d",
    num=f"SELECT *, row_number() OVER ({_SEQ}) AS rn, count(*) OVER (PARTITION BY series) AS n_rows FROM wn WHERE c=20 AND t5 IS NOT NULL",
    fb="SELECT series, f.fold, 100+f.fold*((n_rows-100)//3) AS te, CASE WHEN f.fold=2 THEN n_rows ELSE 100+(f.fold+1)*((n_rows-100)//3) END AS stop FROM (SELECT DISTINCT series, n_rows FROM num), (SELECT unnest(range(3)) AS fold) f",
    lab="SELECT num.series, fb.fold, date, t1, t5, CASE WHEN rn-1 >= te THEN 'test' WHEN rn-1 >= te - greatest(CAST(floor(te*0.15) AS BIGINT),50) THEN 'val' ELSE 'train' END AS role FROM num JOIN fb ON num.series=fb.series WHERE rn-1 < stop"))
def sequence_dataset(spark, folder):
    from tideframe.operators.trees import sequence_dataset as build

    out = build(v.daily_region(spark, folder), SPEC, "y", ["n"], 20, (1, 5), 100, 3)
    return rounded(out.groupBy("series", "fold", "role").agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.avg("target_h1").alias("mean_target_h1"), F.avg("target_h5").alias("mean_target_h5")))


@query("scaled_windows")
def scaled_windows(spark, folder):
    """The scaled windows themselves; nested arrays have no portable hash, so no SQL twin."""
    from tideframe.operators.trees import sequence_dataset as build

    return build(v.daily_region(spark, folder), SPEC, "y", ["n"], 20, (1, 5), 100, 3)


@query("direct_regression", sql_with(f"""
SELECT series, date AS origin_date, {r('y + a + b*d','pred')} FROM (
 SELECT *, regr_slope(c5, x5) OVER e AS b, regr_intercept(c5, x5) OVER e AS a, row_number() OVER ({_SEQ}) AS rn, count(*) OVER (PARTITION BY series) AS n_rows FROM (
  SELECT *, lag(d,5) OVER ({_SEQ}) AS x5 FROM (SELECT series, date, y, y-lag(y) OVER ({_SEQ}) AS d, y-lag(y,5) OVER ({_SEQ}) AS c5 FROM daily_region))
 WINDOW e AS ({_SEQ} ROWS UNBOUNDED PRECEDING)) WHERE rn >= {MIN_TRAIN} AND (rn-{MIN_TRAIN}) % {STEP} = 0 AND rn < n_rows - 5""", "daily_region"))
def direct_regression(spark, folder):
    """The moment-matrix arm with one regressor against SQL's regression aggregates."""
    data = stored(v.daily_region(spark, folder).select("series", "date", "y"), "panel")
    out = vm.direct_regression(data, SPEC, ["y"], "y", 1, (5,), MIN_TRAIN, STEP)
    return rounded(out.select("series", "origin_date", "pred"))


@query("ar1_iterated", sql_with(f"""
SELECT series, date AS origin_date, {r('y + 5*m + (d-m)*b*(1-pow(b,5))/(1-b)','pred')}, {r(f'{vm.Z90!r}*sqrt(s2*list_sum(list_transform(range(5), lambda q: pow((1-pow(b,q+1))/(1-b),2))))','half90')} FROM (
 SELECT *, a/(1-b) AS m, (syy-b*sxy)/(rc-2) AS s2 FROM (
 SELECT *, regr_slope(d, d1) OVER e AS b, regr_intercept(d, d1) OVER e AS a, regr_syy(d,d1) OVER e AS syy, regr_sxy(d,d1) OVER e AS sxy, regr_count(d,d1) OVER e AS rc,
  row_number() OVER ({_SEQ}) AS rn, count(*) OVER (PARTITION BY series) AS n_rows FROM (
  SELECT *, lag(d) OVER ({_SEQ}) AS d1 FROM (SELECT series, date, y, y-lag(y) OVER ({_SEQ}) AS d FROM daily_region))
 WINDOW e AS ({_SEQ} ROWS UNBOUNDED PRECEDING))) WHERE rn >= {MIN_TRAIN} AND (rn-{MIN_TRAIN}) % {STEP} = 0 AND rn < n_rows - 5""", "daily_region"))
def ar1_iterated(spark, folder):
    """The vector arm with one variable and one lag, with its band, against SQL's regression aggregates."""
    data = stored(v.daily_region(spark, folder).select("series", "date", "y"), "panel")
    out = vm.iterated_var(data, SPEC, ["y"], "y", 1, (5,), MIN_TRAIN, STEP)
    return rounded(out.select("series", "origin_date", "pred", (F.col("hi90") - F.col("pred")).alias("half90")))
