"""Queries: profiles, rankings, attribution tables and the tables behind each chart."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideframe.operators import accuracy_tests as at
from tideframe.operators import profile as pf
from tideframe.operators import scoring as sc
from tideframe.operators import splits as sp
from tideframe.operators.align import outer_calendar
from tideframe.operators.features import difference
from tideframe.panel import framed
from tideframe.plans import queries_evaluation as ev
from tideframe.plans import views as v
from tideframe.plans.catalogue import query, r, rounded
from tideframe.plans.queries_align import GOLD_SQL, gold_frame
from tideframe.plans.views import HORIZONS, SPEC, sql_with
from tideframe.session import stored

_OUTER = "SELECT * FROM daily_region FULL JOIN daily_supply USING (series, date)"


def outer(spark, folder):
    return outer_calendar(v.daily_region(spark, folder), v.daily_supply(spark, folder), SPEC)


@query("frame_summary", sql_with(" UNION ALL ".join(
    f"""SELECT series, '{c}' AS "column", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, {r(f'count(*) FILTER ({c} IS NULL)*100.0/count(*)', 'null_pct')},
 {r(f'avg({c})','mean')}, {r(f'stddev_samp({c})','std')}, {r(f'min({c})','min')}, {r(f'max({c})','max')} FROM o GROUP BY 1""" for c in ("y", "s", "q")), "daily_region", "daily_supply", o=_OUTER))
def frame_summary(spark, folder):
    return rounded(pf.summary(outer(spark, folder), ["series"], ["y", "s", "q"]))


@query("missingness", sql_with(" UNION ALL ".join(
    f"""SELECT series, CAST(date_trunc('month', date) AS DATE) AS bucket, '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS n_null FROM o GROUP BY 1,2""" for c in ("y", "n", "s")), "daily_region", "daily_supply", o=_OUTER))
def missingness(spark, folder):
    return pf.missing_map(outer(spark, folder), F.trunc("date", "month"), ["series"], ["y", "n", "s"])


@query("constant_columns", sql_with(" UNION ALL ".join(
    f"""SELECT l_returnflag AS series, '{c}' AS "column", min({c}) = max({c}) AS is_constant FROM lineitem GROUP BY 1""" for c in ("l_quantity", "l_returnflag", "l_tax"))))
def constant_columns(spark, folder):
    li = v.table(spark, folder, "lineitem").withColumn("series", F.col("l_returnflag"))
    return pf.constant_columns(li, ["series"], ["l_quantity", "l_returnflag", "l_tax"])


@query("release_sparsity", sql_with(f"SELECT series, count(d_v_yoy) AS n_obs, {r('avg(CAST(d_v_yoy = 0 AS DOUBLE))','zero_share')} FROM diffed WHERE d_v_yoy IS NOT NULL GROUP BY 1",
                                    "daily_region", "daily_supply", "monthly_region", **GOLD_SQL))
def release_sparsity(spark, folder):
    """Share of days on which the published index does not change; complete rows only start with the first year-over-year value."""
    from tideframe.operators.align import asof_release
    from tideframe.operators.features import bounded_fill, year_over_year
    from tideframe.plans.views import MONTHLY

    daily = framed(outer(spark, folder), SPEC, bounded_fill(["y", "n", "s", "q"], 2))
    published = year_over_year(v.monthly_region(spark, folder), MONTHLY, "v", "v_yoy")
    known = asof_release(daily, published, SPEC, "release_date", ["v_yoy"], tie=["month"])
    d = framed(known, SPEC, difference("v_yoy")).filter("d_v_yoy is not null")
    return rounded(pf.zero_share(d, ["series"], "d_v_yoy"))


@query("histogram", """
SELECT l_returnflag AS series, CASE WHEN x < 7 THEN 0 WHEN x >= 12 THEN 21 ELSE CAST(floor((x-7)/5*20) AS BIGINT) + 1 END AS bin, count(*) AS n_rows
FROM (SELECT l_returnflag, ln(l_extendedprice) AS x FROM lineitem) GROUP BY 1,2""")
def histogram(spark, folder):
    li = v.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("series"), F.ln("l_extendedprice").alias("x"))
    return pf.histogram(li, ["series"], "x", 7, 12, 20)


@query("distribution_profile", f"""
WITH x AS (SELECT l_returnflag AS series, ln(l_extendedprice) AS x FROM lineitem),
q AS (SELECT series, quantile_cont(x,0.25) AS q25, quantile_cont(x,0.5) AS q50, quantile_cont(x,0.75) AS q75 FROM x GROUP BY 1)
SELECT series, {r('any_value(q25)','q25')}, {r('any_value(q50)','q50')}, {r('any_value(q75)','q75')}, {r('avg(x)','mean')},
 {r('min(x) FILTER (x BETWEEN q25-1.5*(q75-q25) AND q75+1.5*(q75-q25))','whisker_low')}, {r('max(x) FILTER (x BETWEEN q25-1.5*(q75-q25) AND q75+1.5*(q75-q25))','whisker_high')},
 count(*) FILTER (NOT (x BETWEEN q25-1.5*(q75-q25) AND q75+1.5*(q75-q25))) AS n_outside FROM x JOIN q USING (series) GROUP BY 1""")
def distribution_profile(spark, folder):
    li = v.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("series"), F.ln("l_extendedprice").alias("x"))
    return rounded(pf.box_statistics(li, ["series"], "x"))


@query("extreme_rows", "SELECT event_type, arg_min(event_id, (value, event_id)) AS lowest_id, arg_max(event_id, (value, event_id)) AS highest_id FROM events GROUP BY 1")
def extreme_rows(spark, folder):
    order = F.struct("value", "event_id")
    return v.table(spark, folder, "events").groupBy("event_type").agg(
        F.min_by("event_id", order).alias("lowest_id"), F.max_by("event_id", order).alias("highest_id"))


@query("head_rows", sql_with(f"SELECT series, date, {r('y','y')} FROM daily_region ORDER BY series, date LIMIT 20", "daily_region"))
def head_rows(spark, folder):
    """The inspection view: the first rows in order. The limit is the feature."""
    return rounded(v.daily_region(spark, folder).orderBy("series", "date").limit(20).select("series", "date", "y"))


# Attributions: contribution of each price component to a line item's charge.
_ATTR = """SELECT l_returnflag AS series, l_extendedprice/1e4 AS price, -l_extendedprice*l_discount/1e4 AS discount, l_extendedprice*(1-l_discount)*l_tax/1e4 AS tax FROM lineitem"""


def attributions(spark, folder):
    e, d = F.col("l_extendedprice"), F.col("l_discount")
    return v.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("series"), (e / 1e4).alias("price"), (-e * d / 1e4).alias("discount"), (e * (1 - d) * F.col("l_tax") / 1e4).alias("tax"))


@query("mean_attribution", sql_with(" UNION ALL ".join(f"SELECT series, '{c}' AS feature, {r(f'avg(abs({c}))','mean_abs')} FROM a GROUP BY 1" for c in ("price", "discount", "tax")), a=_ATTR))
def mean_attribution(spark, folder):
    return rounded(pf.mean_absolute(attributions(spark, folder), ["series"], ["price", "discount", "tax"]))


@query("topn_importance", sql_with("SELECT * FROM (SELECT series, feature, mean_abs, row_number() OVER (PARTITION BY series ORDER BY mean_abs DESC, feature) AS place FROM ("
    + " UNION ALL ".join(f"SELECT series, '{c}' AS feature, {r(f'avg(abs({c}))','mean_abs')} FROM a GROUP BY 1" for c in ("price", "discount", "tax")) + ")) WHERE place <= 2", a=_ATTR))
def topn_importance(spark, folder):
    return pf.top_n(rounded(pf.mean_absolute(attributions(spark, folder), ["series"], ["price", "discount", "tax"])), ["series"], "mean_abs", "feature", 2)


@query("attribution_over_steps", sql_with(
    f"SELECT series, date, {r('list_sum(win)','total')} FROM (SELECT series, date, list(y) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS win FROM daily_region) WHERE len(win)=10", "daily_region"))
def attribution_over_steps(spark, folder):
    from tideframe.operators.features import sequence_window

    w = framed(v.daily_region(spark, folder), SPEC, sequence_window(["y"], 10)).filter("window is not null")
    steps = w.select("series", "date", F.transform("window", lambda row: row[0]).alias("steps"))
    return rounded(pf.sum_steps(steps, "steps", "total").select("series", "date", "total"))


@query("recent_and_background", sql_with("""
SELECT series, date, CASE WHEN b <= 30 THEN 'recent' ELSE 'background' END AS role FROM (
 SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS b FROM daily_region) WHERE b <= 130""", "daily_region"))
def recent_and_background(spark, folder):
    return pf.recent_and_background(v.daily_region(spark, folder).select("series", "date"), ["series"], "date", 30, 100)


# A search table made from line items: flags as searches, supplier groups as configurations, line numbers as seeds.
_RUNS = "SELECT l_returnflag AS search, CAST(length(p_type) AS BIGINT) AS depth, p_size AS size, l_linenumber AS seed, avg(ln(l_extendedprice)) AS score FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3,4"
_SEEDS = "SELECT search, depth, size, avg(score) AS mean_score, coalesce(stddev_samp(score),0) AS std_score, count(*) AS n_seeds FROM runs GROUP BY 1,2,3"
_RANKED = """SELECT *, row_number() OVER (PARTITION BY search ORDER BY in_band DESC, CASE WHEN in_band THEN depth END, CASE WHEN in_band THEN size END, mean_score, depth, size) AS rank FROM (
 SELECT *, mean_score <= lead + band AS in_band FROM (SELECT *, coalesce(median(CASE WHEN std_score <> 0 THEN std_score END) OVER (PARTITION BY search),0) AS band, min(mean_score) OVER (PARTITION BY search) AS lead FROM seeds))"""


def search_runs(spark, folder):
    li = v.table(spark, folder, "lineitem").select("l_returnflag", "l_partkey", "l_linenumber", "l_extendedprice")
    part = v.table(spark, folder, "part").select("p_partkey", "p_type", "p_size")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_returnflag").alias("search"), F.length("p_type").cast("long").alias("depth"), F.col("p_size").alias("size"), F.col("l_linenumber").alias("seed")
    ).agg(F.avg(F.ln("l_extendedprice")).alias("score"))


@query("seed_summary", sql_with(f"SELECT search, depth, size, {r('mean_score','mean_score')}, {r('std_score','std_score')}, n_seeds FROM seeds", runs=_RUNS, seeds=_SEEDS))
def seed_summary(spark, folder):
    return rounded(pf.seed_summary(search_runs(spark, folder), ["search", "depth", "size"], "score"))


@query("fold_summary", sql_with(f"SELECT search, depth, {r('avg(score)','mean_loss')}, {r('stddev_pop(score)','std_loss')}, {r('avg(seed)','mean_epochs')} FROM runs GROUP BY 1,2", runs=_RUNS))
def fold_summary(spark, folder):
    return rounded(pf.fold_summary(search_runs(spark, folder), ["search", "depth"], "score", "seed"))


def ranked_search(spark, folder):
    seeds = pf.seed_summary(search_runs(spark, folder), ["search", "depth", "size"], "score")
    return pf.rank_in_band(seeds, ["depth", "size"], ["search"])


@query("rank_with_band", sql_with(f"SELECT search, depth, size, {r('mean_score','mean_score')}, {r('band','band')}, in_band, rank FROM ranked", runs=_RUNS, seeds=_SEEDS, ranked=_RANKED))
def rank_with_band(spark, folder):
    return rounded(ranked_search(spark, folder).select("search", "depth", "size", "mean_score", "band", "in_band", "rank"))


@query("best_vs_canonical", sql_with(f"""
SELECT search, {r('max(mean_score) FILTER (rank=1)','best_score')}, {r('max(mean_score) FILTER (c)','canonical_score')}, max(rank) FILTER (c) AS canonical_rank,
 {r('(max(mean_score) FILTER (c) - max(mean_score) FILTER (rank=1))/max(mean_score) FILTER (c)*100','relative_gain_pct')}, NOT bool_or(rank=1 AND c) AS is_new_best
FROM (SELECT *, depth=8 AND size=10 AS c FROM ranked) GROUP BY 1""", runs=_RUNS, seeds=_SEEDS, ranked=_RANKED))
def best_vs_canonical(spark, folder):
    flagged = ranked_search(spark, folder).withColumn("is_canonical", (F.col("depth") == 8) & (F.col("size") == 10))
    return rounded(pf.best_against_canonical(flagged, ["search"]))


@query("param_grid", """SELECT n_name AS series, depth, rate FROM nation, (SELECT unnest([2,3,4]) AS depth), (SELECT CAST(unnest([0.01,0.03,0.1]) AS DOUBLE) AS rate)""")
def param_grid(spark, folder):
    """A grid of settings for every series; its size is fixed by the arguments."""
    series = v.table(spark, folder, "nation").select(F.col("n_name").alias("series"))
    return sp.with_parameters(series, depth=[2, 3, 4], rate=[0.01, 0.03, 0.1])


# ---- the table behind each chart ------------------------------------------


@query("chart_forecast_vs_actual", ev.fc_sql(f"""
SELECT series, origin_date, target_date, horizon, model, {r('actual','actual')}, {r('pred','pred')}, {r('lo90','lo90')}, {r('hi90','hi90')} FROM fc
WHERE model IN ('drift','ar1') AND origin_date >= DATE '1997-01-01' AND origin_date < DATE '1999-01-01'"""))
def chart_forecast_vs_actual(spark, folder):
    f = ev.forecasts(spark, folder)
    shown = f.filter(F.col("model").isin("drift", "ar1") & (F.col("origin_date") >= F.lit("1997-01-01").cast("date")) & (F.col("origin_date") < F.lit("1999-01-01").cast("date")))
    return rounded(shown.select("series", "origin_date", "target_date", "horizon", "model", "actual", "pred", "lo90", "hi90"))


@query("chart_metric_bars", ev.fc_sql(f"""
SELECT series, horizon, model, {r('rmse','rmse')}, row_number() OVER (PARTITION BY series, horizon ORDER BY round(rmse,6), model) AS place FROM met""",
    met=ev._MET.format(g="series, model, horizon", src="fc")))
def chart_metric_bars(spark, folder):
    from pyspark.sql import Window

    m = rounded(sc.error_metrics(ev.forecasts(spark, folder), ["series", "model", "horizon"]).select("series", "horizon", "model", "rmse"))
    w = Window.partitionBy("series", "horizon").orderBy("rmse", "model")
    return m.withColumn("place", F.row_number().over(w).cast("long"))


@query("chart_p_and_q", ev.fc_sql(f"SELECT series, model, {r('cw_p_value','cw_p_value',5)}, {r('p_adj_horizon','p_adj_horizon',5)} FROM b1 WHERE horizon=5",
                                  **ev._cw_sql(ev._NOTNAIVE, ev._CWG), b1=ev._bh_sql("cw", "horizon", "p_adj_horizon")))
def chart_p_and_q(spark, folder):
    tests = stored(ev.cw_tests(spark, folder), "tests")
    out = at.fdr_adjust(tests, "cw_p_value", "p_adj_horizon", ["horizon"]).filter("horizon = 5")
    return rounded(out.select("series", "model", "cw_p_value", "p_adj_horizon"), 5)


@query("chart_error_distribution", ev.fc_sql(f"""
SELECT model, horizon, {', '.join(r(f'quantile_cont(actual-pred, {p})', f'q{round(p*100)}') for p in (0.25, 0.5, 0.75))} FROM fc GROUP BY 1,2"""))
def chart_error_distribution(spark, folder):
    e = stored(ev.forecasts(spark, folder).select("model", "horizon", (F.col("actual") - F.col("pred")).alias("e")), "errors")
    from tideframe.operators.order_statistics import exact_quantiles

    return rounded(exact_quantiles(e, ["model", "horizon"], "e", (0.25, 0.5, 0.75)))


@query("chart_regime_by_model", ev.fc_sql("SELECT series, horizon, regime, " + ", ".join(r(f"max(rmse) FILTER (model='{m}')", m) for m in ("ar1", "direct", "drift")) + " FROM met GROUP BY 1,2,3",
    tagged=ev._REG, tagged2="SELECT * FROM tagged WHERE regime IS NOT NULL", met=ev._MET.format(g="series, model, regime, horizon", src="tagged2")))
def chart_regime_by_model(spark, folder):
    tagged = sc.tag_regime(ev.forecasts(spark, folder).filter("model <> 'naive'"), v.REGIMES, "origin_date")
    m = sc.error_metrics(tagged, ["series", "model", "regime", "horizon"])
    return rounded(m.groupBy("series", "horizon", "regime").pivot("model", ["ar1", "direct", "drift"]).agg(F.max("rmse")))


@query("chart_variance_stack", sql_with(f"""
SELECT horizon, response_variable, {r("coalesce(max(p) FILTER (shock='F'),0)",'f')}, {r("coalesce(max(p) FILTER (shock='O'),0)",'o')} FROM (
 SELECT horizon, response_variable, shock, c / sum(c) OVER (PARTITION BY response_variable, horizon) AS p FROM (
 SELECT *, sum(response*response) OVER (PARTITION BY shock, response_variable ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS c FROM resp)) GROUP BY 1,2""",
    resp="SELECT l_linestatus AS shock, l_returnflag AS response_variable, CAST(year(l_shipdate) - 1995 AS BIGINT) AS horizon, avg(l_discount) - 0.05 AS response FROM lineitem GROUP BY 1,2,3"))
def chart_variance_stack(spark, folder):
    from tideframe.operators.cointegration import variance_shares
    from tideframe.plans.queries_models import response_table

    shares = variance_shares(response_table(spark, folder), [])
    wide = shares.groupBy("horizon", "response_variable").pivot("shock", ["F", "O"]).agg(F.max("proportion"))
    return rounded(wide.select("horizon", "response_variable", F.coalesce("F", F.lit(0.0)).alias("f"), F.coalesce("O", F.lit(0.0)).alias("o")))


@query("chart_target_history", sql_with(f"SELECT series, date, {r('spread_ys','spread_ys')}, spread_ys < 0 AS inverted FROM diffed WHERE y IS NOT NULL AND n IS NOT NULL AND s IS NOT NULL AND q IS NOT NULL AND v IS NOT NULL AND v_yoy IS NOT NULL AND d_y IS NOT NULL AND d_n IS NOT NULL AND d_s IS NOT NULL AND d_q IS NOT NULL AND d_v_yoy IS NOT NULL",
                                        "daily_region", "daily_supply", "monthly_region", **GOLD_SQL))
def chart_target_history(spark, folder):
    return rounded(gold_frame(spark, folder).select("series", "date", "spread_ys", (F.col("spread_ys") < 0).alias("inverted")))
