"""Queries: walk-forward forecasts, error metrics, intervals, comparison tests, regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.functions.distributions import normal_tail_sql
from tideframe.functions.scalars import improvement_pct
from tideframe.functions.wording import nested_verdict
from tideframe.operators import accuracy_tests as at
from tideframe.operators import intervals as iv
from tideframe.operators import order_statistics as os_
from tideframe.operators import scoring as sc
from tideframe.operators.arms import Z90, Z95, linear_forecasts
from tideframe.plans import views as v
from tideframe.plans.catalogue import query, r, rounded
from tideframe.session import stored
from tideframe.plans.views import HORIZONS, MAX_H, MIN_TRAIN, REGIMES, SPEC, STEP, sql_with

_P = "PARTITION BY series ORDER BY date"


def forecasts(spark, folder):
    """Four linear arms per region, origin and horizon."""
    return linear_forecasts(v.daily_region(spark, folder), SPEC, "y", HORIZONS, MIN_TRAIN, STEP)


def _forecast_sql() -> dict[str, str]:
    hs = HORIZONS
    base = f"""SELECT series, date, y, y - lag(y) OVER w AS d, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series) AS n_rows,
 {', '.join(f'lead(y,{h}) OVER w AS a{h}, lead(date,{h}) OVER w AS t{h}, y - lag(y,{h}) OVER w AS c{h}' for h in hs)}
 FROM daily_region WINDOW w AS ({_P})"""
    lagged = f"SELECT *, lag(d) OVER w AS d1, {', '.join(f'lag(d,{h}) OVER w AS x{h}' for h in hs)} FROM base WINDOW w AS ({_P})"
    e = f"({_P} ROWS UNBOUNDED PRECEDING)"
    fit = f"""SELECT *, avg(d) OVER {e} AS mu, stddev_samp(d) OVER {e} AS sd,
 regr_slope(d,d1) OVER {e} AS b, regr_intercept(d,d1) OVER {e} AS a, regr_count(d,d1) OVER {e} AS rc,
 regr_syy(d,d1) OVER {e} AS syy, regr_sxy(d,d1) OVER {e} AS sxy,
 {', '.join(f'regr_slope(c{h},x{h}) OVER {e} AS b{h}, regr_intercept(c{h},x{h}) OVER {e} AS i{h}' for h in hs)} FROM lagged"""
    origins = f"SELECT *, (syy - b*sxy)/(rc-2) AS s2, a/(1-b) AS m FROM fit WHERE rn >= {MIN_TRAIN} AND (rn-{MIN_TRAIN}) % {STEP} = 0 AND rn < n_rows - {MAX_H}"
    parts = []
    for h in hs:
        cum = f"(y + {h}*m + (d-m)*b*(1-pow(b,{h}))/(1-b))"
        sd = f"sqrt(s2*list_sum(list_transform(range({h}), lambda q: pow((1-pow(b,q+1))/(1-b),2))))"
        for model, pred, dev in (("naive", "y", None), ("drift", f"(y+{h}*mu)", f"(sd*sqrt({h}))"), ("ar1", cum, sd), ("direct", f"(y+i{h}+b{h}*d)", None)):
            bands = ", ".join(
                f"{'CAST(NULL AS DOUBLE)' if dev is None else f'{pred} {s} {z!r}*{dev}'} AS {name}"
                for name, s, z in (("lo90", "-", Z90), ("hi90", "+", Z90), ("lo95", "-", Z95), ("hi95", "+", Z95)))
            parts.append(f"SELECT series, '{model}' AS model, date AS origin_date, {h} AS horizon, t{h} AS target_date, a{h} AS actual, y AS naive, {pred} AS pred, {bands} FROM origins")
    return {"base": base, "lagged": lagged, "fit": fit, "origins": origins, "fc": " UNION ALL ".join(parts)}


FC = _forecast_sql()


def fc_sql(body: str, **extra: str) -> str:
    return sql_with(body, "daily_region", **FC, **extra)


_MET = """SELECT {g}, count(*) AS n_forecasts, sqrt(avg((actual-pred)*(actual-pred))) AS rmse, avg(abs(actual-pred)) AS mae,
 sqrt(avg((actual-naive)*(actual-naive))) AS naive_rmse, avg(abs(actual-naive)) AS naive_mae
 FROM {src} WHERE actual IS NOT NULL AND naive IS NOT NULL AND pred IS NOT NULL GROUP BY ALL"""
_IMP = "CASE WHEN naive_{m} > 0 THEN (naive_{m}-{m})/naive_{m}*100 ELSE 0 END"


@query("linear_forecasts", fc_sql("SELECT series, model, origin_date, horizon, target_date, " + ", ".join(
    r(c, c) for c in ("actual", "naive", "pred", "lo90", "hi90", "lo95", "hi95")) + " FROM fc"))
def linear_arms(spark, folder):
    return rounded(forecasts(spark, folder).drop("fit_ok"))


@query("naive_drift_metrics", fc_sql(
    f"SELECT series, model, horizon, n_forecasts, {r('rmse','rmse')}, {r('mae','mae')}, {r('naive_rmse','naive_rmse')}, {r('naive_mae','naive_mae')}, "
    f"{r(_IMP.format(m='rmse'),'rmse_improvement_pct')}, {r(_IMP.format(m='mae'),'mae_improvement_pct')} FROM met",
    met=_MET.format(g="series, model, horizon", src="fc WHERE model IN ('naive','drift')").replace("') WHERE", "') AND")))
def naive_drift_metrics(spark, folder):
    """The flagship slice: panel, differences, expanding mean, origins, targets, errors."""
    two = forecasts(spark, folder).filter(F.col("model").isin("naive", "drift"))
    return rounded(sc.error_metrics(two, ["series", "model", "horizon"]).drop("beats_naive_rmse", "beats_naive_mae"))


@query("error_metrics", fc_sql(
    f"SELECT model, horizon, n_forecasts, {r('rmse','rmse')}, {r('mae','mae')}, {r('naive_rmse','naive_rmse')}, {r('naive_mae','naive_mae')} FROM met",
    met=_MET.format(g="model, horizon", src="fc")))
def error_metrics(spark, folder):
    out = sc.error_metrics(forecasts(spark, folder), ["model", "horizon"], improvement=False)
    return rounded(out.drop("beats_naive_rmse", "beats_naive_mae"))


@query("improvement_pct", fc_sql(
    f"SELECT series, model, horizon, {r(_IMP.format(m='rmse'),'rmse_improvement_pct')}, {r(_IMP.format(m='mae'),'mae_improvement_pct')}, "
    "rmse < naive_rmse AS beats_naive_rmse, mae < naive_mae AS beats_naive_mae FROM met WHERE model <> 'naive'",
    met=_MET.format(g="series, model, horizon", src="fc")))
def improvement(spark, folder):
    out = sc.error_metrics(forecasts(spark, folder).filter("model <> 'naive'"), ["series", "model", "horizon"])
    return rounded(out.select("series", "model", "horizon", "rmse_improvement_pct", "mae_improvement_pct", "beats_naive_rmse", "beats_naive_mae"))


_LEVELS = {90: "lo90", 95: "lo95"}, {90: "hi90", 95: "hi95"}


@query("interval_coverage", fc_sql("SELECT series, model, horizon, count(*) AS n_forecasts, " + ", ".join(
    r(f"avg(CASE WHEN actual BETWEEN lo{q} AND hi{q} THEN 100.0 ELSE 0.0 END) FILTER (lo{q} IS NOT NULL AND hi{q} IS NOT NULL AND actual IS NOT NULL)", f"coverage_{q}")
    + ", " + r(f"avg(hi{q}-lo{q})", f"width_{q}") for q in (90, 95)) + " FROM fc GROUP BY 1,2,3"))
def interval_coverage(spark, folder):
    return rounded(sc.interval_coverage(forecasts(spark, folder), ["series", "model", "horizon"], *_LEVELS))


@query("coverage_by_level", fc_sql("SELECT series, model, horizon, n_forecasts, nominal, " + ", ".join([r("coverage", "coverage"), r("width", "width"), r("nominal - coverage", "shortfall")]) + " FROM (" + " UNION ALL ".join(
    f"SELECT series, model, horizon, count(*) AS n_forecasts, CAST({q} AS DOUBLE) AS nominal, avg(CASE WHEN actual BETWEEN lo{q} AND hi{q} THEN 100.0 ELSE 0.0 END) FILTER (lo{q} IS NOT NULL AND hi{q} IS NOT NULL AND actual IS NOT NULL) AS coverage,"
    f" avg(hi{q}-lo{q}) AS width FROM fc GROUP BY 1,2,3" for q in (90, 95)) + ")"))
def coverage_by_level(spark, folder):
    groups = ["series", "model", "horizon"]
    return rounded(sc.coverage_by_level(sc.interval_coverage(forecasts(spark, folder), groups, *_LEVELS), groups, (90, 95)))


@query("convergence_rate", fc_sql(
    f"SELECT model, horizon, count(*) AS n_fits, count(pred) AS n_ok, {r('count(pred)*100.0/count(*)','ok_pct')} FROM fc GROUP BY 1,2"))
def convergence_rate(spark, folder):
    return rounded(sc.convergence_rate(forecasts(spark, folder), ["model", "horizon"]))


@query("converged_subset", fc_sql(f"""
SELECT sample, model, horizon, n_forecasts, {r('rmse','rmse')}, {r('naive_rmse','naive_rmse')} FROM met""",
    both_samples="SELECT 'all' AS sample, * FROM fc UNION ALL SELECT 'converged' AS sample, * FROM fc WHERE pred IS NOT NULL",
    met=_MET.format(g="sample, model, horizon", src="both_samples")))
def converged_subset(spark, folder):
    out = sc.error_metrics(sc.converged_and_all(forecasts(spark, folder)), ["sample", "model", "horizon"])
    return rounded(out.select("sample", "model", "horizon", "n_forecasts", "rmse", "naive_rmse"))


@query("coverage_counts", fc_sql("""
SELECT series, min(CASE WHEN n > 0 THEN n END) AS min_covered, CASE WHEN min(CASE WHEN n > 0 THEN n END) >= 30 THEN 'show' ELSE 'too few paired origins' END AS gate
FROM (SELECT series, model, horizon, count(*) FILTER (actual IS NOT NULL AND pred IS NOT NULL) AS n FROM fc GROUP BY 1,2,3) GROUP BY 1"""))
def coverage_counts(spark, folder):
    counts = sc.paired_counts(forecasts(spark, folder), ["series", "model", "horizon"])
    return sc.distribution_gate(counts, ["series"])


@query("paired_counts", fc_sql("SELECT series, model, horizon, count(*) FILTER (actual IS NOT NULL AND pred IS NOT NULL) AS n_paired FROM fc GROUP BY 1,2,3"))
def paired_counts(spark, folder):
    return sc.paired_counts(forecasts(spark, folder), ["series", "model", "horizon"])


# The direct arm of regions is scored from 1996 on only, so the arms cover different origins.
_UNEVEN = "SELECT * FROM fc WHERE NOT (model='direct' AND origin_date < DATE '1996-06-01')"


def uneven(spark, folder):
    early = (F.col("model") == "direct") & (F.col("origin_date") < F.lit("1996-06-01").cast("date"))
    return forecasts(spark, folder).filter(~early)


@query("origin_sets", fc_sql("""
SELECT series, horizon, count(*) AS n_models, min(n) AS min_origins, max(n) AS max_origins, count(DISTINCT origins) = 1 AS is_paired FROM (
 SELECT series, horizon, model, count(DISTINCT origin_date) AS n, list_sort(list(DISTINCT origin_date)) AS origins FROM uneven WHERE pred IS NOT NULL GROUP BY 1,2,3) GROUP BY 1,2""", uneven=_UNEVEN))
def origin_sets(spark, folder):
    return sc.origin_fingerprints(uneven(spark, folder), ["series", "horizon"])


@query("common_origins", fc_sql("""
SELECT series, model, horizon, origin_date FROM uneven u WHERE (series, origin_date) IN
 (SELECT (series, origin_date) FROM uneven GROUP BY series, origin_date HAVING count(DISTINCT model)=4)""", uneven=_UNEVEN))
def common_origins(spark, folder):
    return sc.common_origins(uneven(spark, folder), ["series"]).select("series", "model", "horizon", "origin_date")


@query("common_sample", fc_sql(f"""
SELECT series, origin_date, horizon, {r('max(actual)','actual')}, {r('max(naive)','naive')}, true AS parity_ok,
 {', '.join(r(f"max(pred) FILTER (model='{m}')", m) for m in ('drift','ar1','direct'))} FROM uneven GROUP BY 1,2,3
 HAVING max(pred) FILTER (model='drift') IS NOT NULL AND max(pred) FILTER (model='ar1') IS NOT NULL""", uneven=_UNEVEN))
def common_sample(spark, folder):
    return rounded(sc.common_sample(uneven(spark, folder), ["series"], ["drift", "ar1"], ["direct"]))


@query("lost_rows_contract", fc_sql("""
SELECT series, origin_date, horizon FROM fc WHERE model='drift' EXCEPT SELECT series, origin_date, horizon FROM uneven WHERE model='direct'""", uneven=_UNEVEN))
def lost_rows_contract(spark, folder):
    f = uneven(spark, folder)
    return sc.assert_rows_kept(f.filter("model='direct'"), f.filter("model='drift'"), ["series", "origin_date", "horizon"])


@query("window_labels", fc_sql("SELECT series, model, min(origin_date) AS first_origin, max(origin_date) AS last_origin, count(DISTINCT origin_date) AS n_origins FROM uneven GROUP BY 1,2", uneven=_UNEVEN))
def window_labels(spark, folder):
    return sc.window_label(uneven(spark, folder), ["series", "model"])


@query("dataset_metadata", fc_sql("""
SELECT series, min(n) AS origins_per_horizon, CAST(sum(n) AS BIGINT) AS n_rows, min(lo) AS first_origin, max(hi) AS last_origin FROM (
 SELECT series, horizon, count(*) AS n, min(origin_date) AS lo, max(origin_date) AS hi FROM uneven GROUP BY 1,2) GROUP BY 1""", uneven=_UNEVEN))
def dataset_metadata(spark, folder):
    return sc.dataset_metadata(uneven(spark, folder), ["series"])


@query("forecast_audit", fc_sql(f"""
SELECT model, horizon, count(*) AS n_rows, count(*) FILTER (pred IS NULL) AS n_null, count(*) FILTER (isnan(pred)) AS n_nan,
 count(*) FILTER (isinf(pred)) AS n_infinite, {r('min(pred)','min_pred')}, {r('max(pred)','max_pred')} FROM fc GROUP BY 1,2"""))
def forecast_audit(spark, folder):
    return rounded(sc.forecast_audit(forecasts(spark, folder), ["model", "horizon"]))


# ---- comparison tests ------------------------------------------------------


def _dm_sql(pairs: str, groups: str) -> dict[str, str]:
    loss = {"squared": "pow(actual-pred_a,2)-pow(actual-pred_b,2)", "absolute": "abs(actual-pred_a)-abs(actual-pred_b)"}
    lags = ", ".join(f"lag(z_{k},{i}) OVER w AS z_{k}_{i}" for k in loss for i in range(1, MAX_H))
    sums = ", ".join(f"sum(z_{k}*z_{k}) AS g_{k}_0, avg(d_{k}) AS m_{k}" for k in loss)
    sums += ", " + ", ".join(f"coalesce(sum(z_{k}*z_{k}_{i}),0) AS g_{k}_{i}" for k in loss for i in range(1, MAX_H))
    var = {k: "(" + f"g_{k}_0/n" + "".join(f" + CASE WHEN horizon > {i} THEN 2*(1-{i}/horizon)*g_{k}_{i}/n ELSE 0 END" for i in range(1, MAX_H)) + ")/n" for k in loss}
    harvey = "sqrt(greatest((n+1-2*horizon+horizon*(horizon-1)/n)/n, 0))"
    stats = ", ".join(f"CASE WHEN n > horizon AND {var[k]} > 1e-20 THEN m_{k}/sqrt({var[k]})*{harvey} END AS s_{k}" for k in loss)
    return {
        "pairs": pairs,
        "dl": f"SELECT *, {', '.join(f'{x} AS d_{k}' for k, x in loss.items())} FROM pairs",
        "zl": f"SELECT *, {', '.join(f'd_{k} - avg(d_{k}) OVER (PARTITION BY {groups}) AS z_{k}' for k in loss)} FROM dl",
        "ll": f"SELECT *, {lags} FROM zl WINDOW w AS (PARTITION BY {groups} ORDER BY origin_date)",
        "agg": f"SELECT {groups}, CAST(count(*) AS DOUBLE) AS n, {sums} FROM ll GROUP BY {groups}",
        "dm": f"SELECT {groups}, CAST(n AS BIGINT) AS n_forecasts, (s_squared IS NULL OR s_absolute IS NULL) AS insufficient_sample, "
              "CASE WHEN s_absolute IS NOT NULL THEN s_squared END AS dm_squared, CASE WHEN s_squared IS NOT NULL THEN s_absolute END AS dm_absolute "
              f"FROM (SELECT *, {stats} FROM agg)",
    }


_PAIRS = """SELECT a.series, a.origin_date, a.horizon, a.actual, a.model AS model_a, b.model AS model_b, a.pred AS pred_a, b.pred AS pred_b
 FROM fc a JOIN fc b ON a.series=b.series AND a.origin_date=b.origin_date AND a.horizon=b.horizon AND a.model < b.model"""
_PG = "series, model_a, model_b, horizon"


@query("pairwise_dm", fc_sql(f"SELECT {_PG}, n_forecasts, insufficient_sample, {r('dm_squared','dm_squared',5)}, {r('dm_absolute','dm_absolute',5)} FROM dm", **_dm_sql(_PAIRS, _PG)))
def pairwise_dm(spark, folder):
    """All pairs of arms per region and horizon; p-values are tested apart, see ``dm_p_values``."""
    pairs = at.model_pairs(forecasts(spark, folder), ["series"])
    return rounded(at.diebold_mariano(pairs, ["series"], HORIZONS, p_values=False), 5)


_VSN = "SELECT series, origin_date, horizon, actual, model AS model_a, 'naive' AS model_b, pred AS pred_a, naive AS pred_b FROM fc WHERE model <> 'naive'"


@query("dm_statistic", fc_sql(f"SELECT {_PG}, n_forecasts, insufficient_sample, {r('dm_squared','dm_squared',5)}, {r('dm_absolute','dm_absolute',5)} FROM dm", **_dm_sql(_VSN, _PG)))
def dm_statistic(spark, folder):
    pairs = at.against_naive(forecasts(spark, folder).filter("model <> 'naive'"), ["series"])
    return rounded(at.diebold_mariano(pairs, ["series"], HORIZONS, p_values=False), 5)


RIVALS = ("naive", "ar1", "direct")
_RIVAL = "SELECT a.series, a.origin_date, a.horizon, a.actual, a.model AS model_a, b.model AS model_b, a.pred AS pred_a, b.pred AS pred_b FROM fc a JOIN fc b USING (series, origin_date, horizon) WHERE a.model = 'drift' AND b.model IN " + repr(RIVALS)


@query("rivals_statistics", fc_sql("SELECT series, model_a, horizon, " + ", ".join(
    r(f"max(dm_{k}) FILTER (model_b = '{m}')", f"{m}_dm_{k}", 5) for m in RIVALS for k in ("squared", "absolute")) + " FROM dm GROUP BY 1,2,3", **_dm_sql(_RIVAL, _PG)))
def rivals_statistics(spark, folder):
    """One arm against three rivals under both losses, one row per region and horizon."""
    pairs = at.against_rivals(forecasts(spark, folder), ["series"], "drift", RIVALS)
    return rounded(at.rivals_report(at.diebold_mariano(pairs, ["series"], HORIZONS, p_values=False), ["series"], RIVALS), 5)


@query("rivals_report")
def rivals_report(spark, folder):
    """The same with p-values, flags and how many rivals are beaten; SQL has no Student tail."""
    pairs = at.against_rivals(forecasts(spark, folder), ["series"], "drift", RIVALS)
    return rounded(at.rivals_report(at.diebold_mariano(pairs, ["series"], HORIZONS), ["series"], RIVALS), 5)


@query("dm_p_values")
def dm_p_values(spark, folder):
    """With Student tails, flags and verdict; SQL has no such tail, so no twin."""
    from tideframe.functions.wording import pairwise_verdict

    pairs = at.model_pairs(forecasts(spark, folder), ["series"])
    tests = stored(at.overall_winner(at.diebold_mariano(pairs, ["series"], HORIZONS)), "tests")
    out = at.fdr_adjust(tests, "p_squared", "p_adj_squared", ["series"])
    return rounded(out.withColumn("verdict", pairwise_verdict(F.col("model_a"), F.col("model_b"))))


def _cw_sql(src: str, groups: str) -> dict[str, str]:
    """Clark-West per group as CTEs ``c1``..``cw``."""
    lags = ", ".join(f"lag(z,{k}) OVER w AS z{k}" for k in range(1, MAX_H))
    sums = ", ".join(f"coalesce(sum(z*z{k})/nullif(count(z*z{k}),0),0) AS g{k}" for k in range(1, MAX_H))
    omega = "greatest(g0" + "".join(f" + CASE WHEN horizon > {k} THEN 2*(1-{k}/horizon)*g{k} ELSE 0 END" for k in range(1, MAX_H)) + ", 1e-14)"
    return {
        "c1": f"SELECT *, pow(actual-naive,2) AS q1, pow(actual-pred,2) AS q2, pow(naive-pred,2) AS ad FROM {src}",
        "c2": "SELECT *, q1-(q2-ad) AS f FROM c1",
        "c3": f"SELECT *, f - avg(f) OVER (PARTITION BY {groups}) AS z FROM c2",
        "c4": f"SELECT *, {lags} FROM c3 WINDOW w AS (PARTITION BY {groups} ORDER BY origin_date)",
        "c5": f"SELECT {groups}, CAST(count(f) AS DOUBLE) AS n, avg(q1) AS mspe_naive, avg(q2) AS mspe_model, avg(ad) AS cw_adjustment, avg(f) AS mean_f, sum(z*z)/count(f) AS g0, {sums} FROM c4 GROUP BY {groups}",
        "c6": f"SELECT *, sqrt({omega}/n/((n-horizon)*(n-horizon+1)/(n*n))) AS se_f FROM c5 WHERE n > horizon AND n >= 3",
        "cw": f"SELECT *, CAST(n AS BIGINT) AS n_forecasts, mspe_model - cw_adjustment AS mspe_model_adj, CASE WHEN mspe_naive > 1e-12 THEN 1-mspe_model/mspe_naive END AS r2_oos, "
              f"CASE WHEN mspe_naive > 1e-12 THEN mean_f/mspe_naive END AS r2_oos_adj, mean_f/se_f AS cw_stat, {normal_tail_sql('(mean_f/se_f)')} AS cw_p_value FROM c6",
    }


_CWG = "series, model, horizon"
_CWCOLS = ["mspe_naive", "mspe_model", "cw_adjustment", "mspe_model_adj", "r2_oos", "r2_oos_adj", "mean_f", "se_f", "cw_stat", "cw_p_value"]
_NOTNAIVE = "(SELECT * FROM fc WHERE model <> 'naive')"


def cw_tests(spark, folder):
    return at.clark_west(forecasts(spark, folder).filter("model <> 'naive'"), ["series", "model"], longest=MAX_H)


@query("clark_west_statistic", fc_sql(
    f"SELECT {_CWG}, n_forecasts, {', '.join(r(c, c, 5) for c in _CWCOLS)}, (cw_p_value < 0.05 AND cw_stat > 0) AS significant FROM cw", **_cw_sql(_NOTNAIVE, _CWG)))
def clark_west_statistic(spark, folder):
    return rounded(cw_tests(spark, folder).drop("insufficient_sample"), 5)


def _bh_sql(src: str, part: str, alias: str) -> str:
    """BH by its definition: the smallest p*m/rank over all p at least as large."""
    same = " AND ".join(f"a.{g}=b.{g}" for g in part.split(", ")) if part else "true"
    on = ", ".join(f"a.{g}" for g in part.split(", ")) if part else ""
    p = f"PARTITION BY {part}" if part else ""
    return f"""SELECT *, least(1, min(raw_{alias}) OVER ({p} ORDER BY cw_p_value DESC RANGE UNBOUNDED PRECEDING)) AS {alias} FROM (
 SELECT *, cw_p_value * count(*) OVER ({p}) / (rank() OVER ({p} ORDER BY cw_p_value) + count(*) OVER (PARTITION BY {part + ', ' if part else ''}cw_p_value) - 1) AS raw_{alias} FROM {src})"""


@query("bh_global_horizon", fc_sql(
    f"SELECT {_CWG}, {r('cw_p_value','cw_p_value',5)}, {r('p_adj_global','p_adj_global',5)}, {r('p_adj_horizon','p_adj_horizon',5)} FROM b2",
    **_cw_sql(_NOTNAIVE, _CWG), b1=_bh_sql("cw", "", "p_adj_global"), b2=_bh_sql("b1", "horizon", "p_adj_horizon")))
def bh_global_horizon(spark, folder):
    """Every region, arm and horizon is one test of the global family."""
    out = at.fdr_two_tiers(cw_tests(spark, folder))
    return rounded(out.select("series", "model", "horizon", "cw_p_value", "p_adj_global", "p_adj_horizon"), 5)


_FAM = "CASE WHEN model='direct' THEN 'sensitivity' ELSE 'primary' END"


@query("test_battery", fc_sql(
    f"SELECT {_CWG}, family, n_forecasts, {r('cw_stat','cw_stat',5)}, {r('cw_p_value','cw_p_value',5)}, {r('p_adj_global','p_adj_global',5)}, {r('p_adj_horizon','p_adj_horizon',5)} FROM b2",
    uneven=_UNEVEN,
    battery=f"SELECT *, {_FAM} AS family FROM uneven u WHERE model <> 'naive' AND (series, origin_date) IN (SELECT (series, origin_date) FROM uneven GROUP BY series, origin_date HAVING count(DISTINCT model)=4)",
    **_cw_sql("battery", "series, model, family, horizon"), b1=_bh_sql("cw", "family", "p_adj_global"), b2=_bh_sql("b1", "family, horizon", "p_adj_horizon")))
def test_battery(spark, folder):
    """Common origins of all arms, then the test per arm and horizon, corrected within each family."""
    shared = sc.common_origins(uneven(spark, folder), ["series"]).filter("model <> 'naive'")
    family = F.when(F.col("model") == "direct", "sensitivity").otherwise("primary")
    tests = at.clark_west(shared.withColumn("family", family), ["series", "model", "family"], longest=MAX_H)
    out = at.fdr_two_tiers(tests, ["family"])
    return rounded(out.select("series", "model", "horizon", "family", "n_forecasts", "cw_stat", "cw_p_value", "p_adj_global", "p_adj_horizon"), 5)


def _verdict_sql(significant: str, p: str, alias: str) -> str:
    # Halves round up, as in the formatter of the sentences.
    five = lambda c: f"coalesce(CAST(CAST(round(CAST(round({c}, 6) AS DECIMAL(20,6)), 5) AS DECIMAL(20,5)) AS VARCHAR), 'N/A')"
    shown = lambda label, c: f"printf('(CW=%.3f, p=%.4f; MSPE_naive=%s, {label}=%s)', round(cw_stat, 3), round({p}, 4), {five('mspe_naive')}, {five(c)})"
    m = "series || ' ' || model"
    return (
        f"CASE WHEN round(cw_stat, 3) IS NULL OR {p} IS NULL THEN 'insufficient data to compute verdict' "
        f"WHEN {significant} THEN {m} || ' significantly outperforms Naïve benchmark after Clark-West MSPE adjustment ' || {shown('MSPE_adj', 'mspe_model_adj')} "
        f"WHEN round(cw_stat, 3) <= 0 THEN 'No significant improvement: ' || {m} || ' does not beat Naïve under Clark-West ' || {shown('MSPE_model', 'mspe_model')} "
        f"ELSE 'Positive point gain not statistically significant: ' || {m} || ' fails to reject equal accuracy ' || {shown('MSPE_adj', 'mspe_model_adj')} END AS {alias}")


@query("verdict_text", fc_sql(
    f"SELECT {_CWG}, {_verdict_sql('cw_p_value < 0.05 AND cw_stat > 0', 'cw_p_value', 'verdict')}, {_verdict_sql('p_adj_global <= 0.05 AND cw_stat > 0', 'p_adj_global', 'verdict_fdr_global')}, "
    f"{_verdict_sql('p_adj_horizon <= 0.05 AND cw_stat > 0', 'p_adj_horizon', 'verdict_fdr_horizon')} FROM b2",
    **_cw_sql(_NOTNAIVE, _CWG), b1=_bh_sql("cw", "", "p_adj_global"), b2=_bh_sql("b1", "horizon", "p_adj_horizon")))
def verdict_text(spark, folder):
    """Sentences per test, raw and under both corrections."""
    out = at.fdr_two_tiers(cw_tests(spark, folder))
    m = F.concat_ws(" ", "series", "model")
    return out.select(
        "series", "model", "horizon", nested_verdict(m, F.col("significant"), F.col("cw_p_value")).alias("verdict"),
        nested_verdict(m, F.col("significant_fdr_global"), F.col("p_adj_global")).alias("verdict_fdr_global"),
        nested_verdict(m, F.col("significant_fdr_horizon"), F.col("p_adj_horizon")).alias("verdict_fdr_horizon"))


_REG = "SELECT *, CASE " + " ".join(f"WHEN origin_date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in REGIMES) + " END AS regime FROM fc WHERE model <> 'naive'"


@query("regime_metrics", fc_sql(f"""
SELECT m.series, m.model, m.regime, m.horizon, m.n_forecasts, {r('m.rmse','rmse',5)}, {r('m.naive_rmse','naive_rmse',5)}, {r(_IMP.format(m='rmse'),'rmse_improvement_pct',5)},
 m.n_forecasts < 5*m.horizon AS insufficient_sample, {r('c.r2_oos','r2_oos',5)},
 {r('CASE WHEN m.n_forecasts >= 5*m.horizon THEN c.cw_stat END','cw_stat',5)}, {r('CASE WHEN m.n_forecasts >= 5*m.horizon THEN c.cw_p_value END','cw_p_value',5)}
FROM met m LEFT JOIN cw c USING (series, model, regime, horizon) WHERE m.n_forecasts >= 3""",
    tagged=_REG, tagged2="SELECT * FROM tagged WHERE regime IS NOT NULL", met=_MET.format(g="series, model, regime, horizon", src="tagged2"), **_cw_sql("tagged2", "series, model, regime, horizon")))
def regime_metrics(spark, folder):
    tagged = stored(sc.tag_regime(forecasts(spark, folder).filter("model <> 'naive'"), REGIMES, "origin_date"), "tagged")
    groups = ["series", "model", "regime"]
    metrics = sc.error_metrics(tagged, [*groups, "horizon"])
    out = at.regime_report(tagged, groups, metrics, longest=MAX_H)
    return rounded(out.select(*groups, "horizon", "n_forecasts", "rmse", "naive_rmse", "rmse_improvement_pct", "insufficient_sample", "r2_oos", "cw_stat", "cw_p_value"), 5)


@query("regime_join", sql_with("SELECT series, date, " + "CASE " + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in REGIMES) + " END AS regime FROM daily_region WHERE date <= DATE '2001-12-31'", "daily_region"))
def regime_join(spark, folder):
    """Intervals as literals of the plan: no join is left."""
    d = v.daily_region(spark, folder).select("series", "date")
    return sc.join_regimes(d, REGIMES, "date")


@query("mspe_decomposition", fc_sql(
    f"SELECT {_CWG}, {r('mspe_naive-mspe_model','raw_diff')}, {r('mspe_naive-mspe_model_adj','adjusted_diff')}, {r('CASE WHEN mspe_model > 1e-12 THEN cw_adjustment/mspe_model*100 END','adjustment_share_pct')} FROM cw", **_cw_sql(_NOTNAIVE, _CWG)))
def mspe_decomposition(spark, folder):
    out = at.mspe_decomposition(cw_tests(spark, folder))
    return rounded(out.select("series", "model", "horizon", "raw_diff", "adjusted_diff", "adjustment_share_pct"))


@query("decision_summary", fc_sql(f"""
SELECT m.series, m.horizon, best_rmse_model, {r('best_rmse','best_rmse')}, best_mae_model, {r('best_mae','best_mae')}, strongest_model, {r('strongest_p','strongest_p',5)}, any_significant FROM
 (SELECT series, horizon, arg_min(model, (round(rmse,9), model)) AS best_rmse_model, min(rmse) AS best_rmse, arg_min(model, (round(mae,9), model)) AS best_mae_model, min(mae) AS best_mae FROM met GROUP BY 1,2) m
 LEFT JOIN (SELECT series, horizon, arg_min(model, (round(cw_p_value,9), model)) AS strongest_model, min(cw_p_value) AS strongest_p, bool_or(p_adj_horizon <= 0.05 AND cw_stat > 0) AS any_significant FROM b2 GROUP BY 1,2) t USING (series, horizon)""",
    met=_MET.format(g="series, model, horizon", src="fc WHERE model <> 'naive'").replace("'naive' WHERE", "'naive' AND"),
    **_cw_sql(_NOTNAIVE, _CWG), b1=_bh_sql("cw", "", "p_adj_global"), b2=_bh_sql("b1", "horizon", "p_adj_horizon")))
def decision_summary(spark, folder):
    f = stored(forecasts(spark, folder).filter("model <> 'naive'"), "forecasts")
    tests = at.fdr_two_tiers(at.clark_west(f, ["series", "model"], longest=MAX_H))
    out = sc.decision_summary(sc.error_metrics(f, ["series", "model", "horizon"]), tests, ["series", "horizon"])
    return rounded(rounded(out.withColumn("p5", F.col("strongest_p"))).withColumn("strongest_p", F.round("p5", 5) + 0.0).drop("p5"))


@query("conformal_quantile", fc_sql(f"""
SELECT series, horizon, n_cal, {r('max(e) FILTER (i = ceil(round((n_cal+1)*0.90,9)))','q90')}, {r('max(e) FILTER (i = ceil(round((n_cal+1)*0.95,9)))','q95')} FROM (
 SELECT series, horizon, abs(actual-pred) AS e, row_number() OVER (PARTITION BY series, horizon ORDER BY abs(actual-pred)) AS i, count(*) OVER (PARTITION BY series, horizon) AS n_cal
 FROM fc WHERE model='drift') GROUP BY 1,2,3"""))
def conformal_quantile(spark, folder):
    res = stored(forecasts(spark, folder).filter("model = 'drift'").select("series", "horizon", (F.col("actual") - F.col("pred")).alias("e")), "residuals")
    return rounded(iv.conformal_quantiles(res, ["series", "horizon"], "e", {"q90": 0.90, "q95": 0.95}))


@query("conformal_pooled", f"""
SELECT l_returnflag AS series, n_cal, {r('max(e) FILTER (i = ceil(round((n_cal+1)*0.90,9)))','q90')}, {r('max(e) FILTER (i = ceil(round((n_cal+1)*0.95,9)))','q95')} FROM (
 SELECT l_returnflag, e, row_number() OVER (PARTITION BY l_returnflag ORDER BY e) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n_cal FROM (
  SELECT l_returnflag, abs(ln(l_extendedprice) - ln(l_quantity) - 7) AS e FROM lineitem)) GROUP BY 1,2""")
def conformal_pooled(spark, folder):
    """Band of a fixed rule (price from quantity) pooled over all line items of a flag: groups without a size bound."""
    li = v.table(spark, folder, "lineitem")
    res = li.select(F.col("l_returnflag").alias("series"), (F.ln("l_extendedprice") - F.ln("l_quantity") - 7).alias("e"))
    return rounded(iv.conformal_quantiles(res, ["series"], "e", {"q90": 0.90, "q95": 0.95}))


@query("distribution_quantiles", f"""
SELECT l_returnflag AS series, {', '.join(r(f'quantile_cont(ln(l_extendedprice), {p})', f'q{round(p*100)}') for p in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM lineitem GROUP BY 1""")
def distribution_quantiles(spark, folder):
    li = v.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("series"), F.ln("l_extendedprice").alias("x"))
    return rounded(os_.exact_quantiles(li, ["series"], "x", (0.05, 0.25, 0.5, 0.75, 0.95)))


@query("coverage_disclosure", fc_sql("""
SELECT series, 'bands of 90% held ' || string_agg(printf('%.1f', c), '/' ORDER BY horizon) || '% of the outcomes at horizons ' || string_agg(CAST(horizon AS VARCHAR), '/' ORDER BY horizon) AS disclosure
FROM (SELECT series, horizon, avg(CASE WHEN actual BETWEEN lo90 AND hi90 THEN 100.0 ELSE 0.0 END) FILTER (lo90 IS NOT NULL AND hi90 IS NOT NULL AND actual IS NOT NULL) AS c FROM fc WHERE model='drift' GROUP BY 1,2) GROUP BY 1"""))
def coverage_disclosure(spark, folder):
    cov = sc.interval_coverage(forecasts(spark, folder).filter("model = 'drift'"), ["series", "horizon"], *_LEVELS)
    return sc.coverage_disclosure(cov, ["series"])
