"""Moment-matrix arms against fits from the raw rows with numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tideframe.operators import cointegration as co
from tideframe.operators import diagnostics as dg
from tideframe.operators import vector_models as vm
from tideframe.operators.moments import gramian, square
from tideframe.panel import PanelSpec
from pyspark.sql import functions as F

SPEC = PanelSpec()
DAY = dt.date(2020, 1, 1)


def panel(spark, **series):
    out = []
    for name, values in series.items():
        for i, row in enumerate(values):
            out.append((name, DAY + dt.timedelta(days=i), *map(float, row)))
    k = len(next(iter(series.values()))[0])
    return spark.createDataFrame(out, "series string, date date, " + ", ".join(f"x{i} double" for i in range(k)))


@pytest.fixture(scope="module")
def system():
    """Two cointegrated series and an independent walk."""
    rng = np.random.default_rng(123)
    w = np.cumsum(rng.normal(size=400))
    return np.column_stack([w + rng.normal(size=400) * 0.5, 2 * w + rng.normal(size=400) * 0.5, np.cumsum(rng.normal(size=400))])


@pytest.fixture(scope="module")
def two(spark, system):
    rng = np.random.default_rng(5)
    other = np.cumsum(rng.normal(size=(310, 3)), axis=0)
    return panel(spark, a=system, b=other).repartition(4).cache()


def test_gramian(spark, system):
    df = panel(spark, a=system, b=system[:50]).withColumn("w", F.array("x0", "x1", "x2")).repartition(6)
    got = {r["series"]: square(r["g"]) for r in gramian(df, ["series"], "w").collect()}
    np.testing.assert_allclose(got["a"], system.T @ system, rtol=1e-10)
    np.testing.assert_allclose(got["b"], system[:50].T @ system[:50], rtol=1e-10)


def var_by_hand(y, p, at, h_max, exog=None):
    d = np.diff(y, axis=0)
    rows = range(p, len(d))
    z = [np.concatenate([[1.0], *( [exog[t]] if exog is not None else []), *[d[t - i] for i in range(1, p + 1)]]) for t in rows]
    z, target = np.array(z), d[p:]
    b, *_ = np.linalg.lstsq(z, target, rcond=None)
    e = target - z @ b
    sigma = e.T @ e / (len(z) - z.shape[1])
    off = 1 + (exog.shape[1] if exog is not None else 0)
    k = y.shape[1]
    lags = [b[off + (i - 1) * k: off + i * k].T for i in range(1, p + 1)]
    fixed = b[0] + (exog.mean(axis=0) @ b[1:off] if exog is not None else 0)
    path = list(d)
    for _ in range(h_max):
        path.append(fixed + sum(a @ path[-i] for i, a in enumerate(lags, 1)))
    level = y[-1, at] + np.cumsum(np.array(path[len(d):])[:, at])
    phi = [np.eye(k)]
    for j in range(1, h_max):
        phi.append(sum(phi[j - i] @ lags[i - 1] for i in range(1, min(j, p) + 1)))
    psi, total, sd = np.zeros((k, k)), 0.0, []
    for m in range(h_max):
        psi = psi + phi[m]
        total += (psi @ sigma @ psi.T)[at, at]
        sd.append(np.sqrt(total))
    return level, np.array(sd)


def test_iterated_var_with_exogenous(two, system):
    out = vm.iterated_var(two, SPEC, ["x0", "x1"], "x0", 3, (1, 5), 100, 50, exogenous=["x2"]).toPandas()
    mine = out[out["series"] == "a"].sort_values(["origin_date", "horizon"])
    origins = [o for o in range(100, 400 - 5, 50)]
    assert len(mine) == 2 * len(origins) and mine["fit_ok"].all()
    for o in origins:
        level, sd = var_by_hand(system[:o, :2], 3, 0, 5, exog=np.diff(system[:o, 2:], axis=0))
        rows = mine[mine["origin_date"] == DAY + dt.timedelta(days=o - 1)].set_index("horizon")
        for h in (1, 5):
            assert rows.loc[h, "pred"] == pytest.approx(level[h - 1], rel=1e-8)
            assert rows.loc[h, "hi90"] - rows.loc[h, "pred"] == pytest.approx(vm.Z90 * sd[h - 1], rel=1e-8)
            assert rows.loc[h, "actual"] == pytest.approx(system[o - 1 + h, 0])


def test_level_deviation_by_hand():
    sd = vm.level_deviation([np.array([[0.5]])], np.eye(1), 0, 2)
    np.testing.assert_allclose(sd**2, [1.0, 3.25])


def test_direct_regression(two, system):
    out = vm.direct_regression(two, SPEC, ["x0", "x1"], "x0", 2, (1, 5), 100, 60).toPandas()
    mine = out[out["series"] == "a"].set_index(["origin_date", "horizon"])
    d = np.diff(system[:, :2], axis=0)
    for o in range(100, 395, 60):
        for h in (1, 5):
            idx = range(1, o - 1 - h)
            z = np.array([np.concatenate([[1.0], d[i - 1], d[i]]) for i in idx])
            y = np.array([system[i + 1 + h, 0] - system[i + 1, 0] for i in idx])
            if o - 1 <= 395 - 5:
                b, *_ = np.linalg.lstsq(z, y, rcond=None)
                want = system[o - 1, 0] + np.concatenate([[1.0], d[o - 3], d[o - 2]]) @ b
                key = (DAY + dt.timedelta(days=o - 1), h)
                if key in mine.index:
                    assert mine.loc[key, "pred"] == pytest.approx(want, rel=1e-7)


def vecm_by_hand(y, p, r, steps):
    """Reduced-rank regression from residual rows, constant inside the relation."""
    k, d = y.shape[1], np.diff(y, axis=0)
    rows = range(p, len(d))
    dy = d[p:]
    lev = np.column_stack([y[p:-1], np.ones(len(dy))])
    past = np.array([np.concatenate([d[t - i] for i in range(1, p + 1)]) for t in rows])
    res = lambda m: m - past @ np.linalg.lstsq(past, m, rcond=None)[0]
    r0, r1 = res(dy), res(lev)
    n = len(dy)
    s00, s01, s11 = r0.T @ r0 / n, r0.T @ r1 / n, r1.T @ r1 / n
    lam, vec = np.linalg.eig(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01)))
    order = np.argsort(lam.real)[::-1]
    beta = vec[:, order[:r]].real
    beta = beta @ np.linalg.inv(beta[:r])
    x = r1 @ beta
    alpha = np.linalg.lstsq(x, r0, rcond=None)[0].T
    rest = dy - lev @ beta @ alpha.T
    gamma = np.linalg.lstsq(past, rest, rcond=None)[0].T
    e = rest - past @ gamma.T
    hist, out = list(d), []
    level = y[-1].copy()
    for _ in range(steps):
        step = alpha @ beta.T @ np.append(level, 1.0) + gamma @ np.concatenate([hist[-i] for i in range(1, p + 1)])
        hist.append(step)
        level = level + step
        out.append(level.copy())
    return lam.real[order], beta, alpha, np.array(out), e.T @ e / n


def test_vecm_and_johansen(spark, two, system):
    tests = co.johansen(two, SPEC, ["x0", "x1", "x2"], 2).toPandas()
    lam, beta, alpha, _, _ = vecm_by_hand(system, 2, 1, 5)
    primary = tests[(tests["series"] == "a") & (tests["det_order"] == 0)].sort_values("r_null")
    assert primary["trace_rank"].iloc[0] == 1 and primary["max_eig_rank"].iloc[0] == 1
    for (_, _), block in tests.groupby(["series", "det_order"]):
        block = block.sort_values("r_null")
        np.testing.assert_allclose(block["trace_stat"], np.cumsum(block["max_eig_stat"].to_numpy()[::-1])[::-1], rtol=1e-9)
        assert block["eigenvalue"].is_monotonic_decreasing
    ranks = spark.createDataFrame([("a", 1), ("b", 0)], "series string, rank long")
    fit = co.error_correction(two, SPEC, ["x0", "x1", "x2"], 2, ranks).toPandas().set_index("variable")
    np.testing.assert_allclose(fit.loc[["x0", "x1", "x2", "constant"], "beta"], beta[:, 0], rtol=1e-6)
    np.testing.assert_allclose(fit.loc[["x0", "x1", "x2"], "alpha"], alpha[:, 0], rtol=1e-6)
    assert fit.loc["x1", "beta"] == pytest.approx(-0.5, abs=0.05)
    out = co.vecm_forecasts(two, SPEC, ["x0", "x1", "x2"], "x1", 2, ranks, (1, 5), 150, 100).toPandas()
    assert set(out.loc[out["fit_ok"], "series"]) == {"a"} and out.loc[~out["fit_ok"], "series"].tolist() == ["b", "b"]
    out = out[out["fit_ok"]]
    for o in range(150, 395, 100):
        *_, path, _ = vecm_by_hand(system[:o], 2, 1, 5)
        rows = out[out["origin_date"] == DAY + dt.timedelta(days=o - 1)].set_index("horizon")
        for h in (1, 5):
            assert rows.loc[h, "pred"] == pytest.approx(path[h - 1, 1], rel=1e-6)
            assert rows.loc[h, "lo95"] < rows.loc[h, "lo90"] < rows.loc[h, "pred"] < rows.loc[h, "hi90"]


def test_johansen_with_no_lags_and_demeaning(spark, system):
    """The trace statistic with a constant equals the one from demeaned rows."""
    got = co.johansen(panel(spark, a=system), SPEC, ["x0", "x1", "x2"], 0).toPandas()
    d, lev = np.diff(system, axis=0), system[:-1]
    d0, l0 = d - d.mean(0), lev - lev.mean(0)
    lam = np.linalg.eigvals(np.linalg.solve(l0.T @ l0, l0.T @ d0) @ np.linalg.solve(d0.T @ d0, d0.T @ l0)).real
    want = -len(d) * np.log(1 - np.sort(lam)[::-1])
    mine = got[got["det_order"] == 0].sort_values("r_null")
    np.testing.assert_allclose(mine["max_eig_stat"], want, rtol=1e-8)


def test_responses_and_shares(spark, two):
    ranks = spark.createDataFrame([("a", 1)], "series string, rank long")
    irf = co.impulse_responses(two, SPEC, ["x0", "x1", "x2"], 2, ranks, periods=10).cache()
    shares = co.variance_shares(irf, ["series"]).toPandas()
    np.testing.assert_allclose(shares.groupby(["horizon", "response_variable"])["proportion"].sum(), 1.0)
    table = irf.toPandas().sort_values("horizon")
    first = table[table["horizon"] == 0].pivot(index="response_variable", columns="shock", values="response")
    assert first.loc["x0", "x1"] == 0 and first.loc["x0", "x2"] == 0 and first.loc["x0", "x0"] > 0
    for _, g in table.groupby(["shock", "response_variable"]):
        np.testing.assert_allclose(g["cumulative_response"], g["response"].cumsum())
    top = co.top_contributors(co.variance_shares(irf, ["series"]), ["series"], 0).toPandas().set_index("response_variable")
    assert top.loc["x0", "top_shock"] == "x0" and top.loc["x0", "own_share"] == pytest.approx(1.0)


def test_a_series_without_a_fit_has_a_row(spark, system):
    df = panel(spark, good=system, short=system[:4], flat=np.ones((300, 3)))
    names, bad = ["x0", "x1", "x2"], {"short", "flat"}
    ranks = co.primary_rank(co.johansen(df, SPEC, names, 2), ["series"])
    assert {r.series: r.rank for r in ranks.collect()} == {"good": 1, "short": None, "flat": None}
    irf = co.impulse_responses(df, SPEC, names, 2, ranks, periods=3)
    shares = co.variance_shares(irf, ["series"])
    tables = [co.johansen(df, SPEC, names, 2), co.error_correction(df, SPEC, names, 2, ranks), co.granger(df, SPEC, names, 2), irf, shares,
              co.response_summary(irf, ["series"]), co.top_contributors(shares, ["series"], 3), vm.arma_orders(df, SPEC, "x0", widest=2), dg.lag_order(df, SPEC, names, 3)]
    for k, table in enumerate(tables):
        rows = table.collect()
        # A constant alone fits the differences of a flat series, so two of its ARMA and no VAR orders may be sound.
        assert {r.series for r in rows} == bad | {"good"}, k
        assert all(r.fit_ok and r.reason is None for r in rows if r.series == "good"), k
        failed = [r for r in rows if not r.fit_ok]
        assert {r.series for r in failed} == bad and all(r.reason for r in failed), k


def test_dependent_columns_are_named(spark, system):
    from tideframe.operators.moments import Collinear, dependent, least_squares

    x = np.column_stack([np.ones(50), np.arange(50.0), np.arange(50.0) ** 2, 3 - 2 * np.arange(50.0), np.zeros(50)])
    assert dependent(x.T @ x) == [1, 4] and dependent(x[:, :3].T @ x[:, :3]) == []
    with pytest.raises(Collinear, match="rank 3 of 5, dependent: b, e"):
        least_squares(np.pad(x.T @ x, (0, 1), constant_values=1.0), 5, list("abcde"))
    twins = np.column_stack([system[:, 0], system[:, 1], 2 * system[:, 0] - system[:, 1]])
    rows = co.johansen(panel(spark, a=twins, good=system), SPEC, ["x0", "x1", "x2"], 2).collect()
    assert {r.series for r in rows if r.fit_ok} == {"good"}
    assert all("collinear lags" in r.reason and "dependent: change of x" in r.reason for r in rows if r.series == "a")


def test_series_without_forecasts_have_status_rows(spark, system):
    rng = np.random.default_rng(31)
    df = panel(spark, good=system, walks=np.cumsum(rng.normal(size=(300, 3)), axis=0), short=system[:5])
    ranks = spark.createDataFrame([("good", 1), ("walks", 0)], "series string, rank long")
    out = co.vecm_forecasts(df, SPEC, ["x0", "x1", "x2"], "x0", 1, ranks, (1, 5), 100, 10).collect()
    assert {(r.series, r.horizon, r.reason) for r in out if not r.fit_ok} == {
        (s, h, why) for s, why in (("walks", "rank 0: no cointegration"), ("short", "no cointegration rank")) for h in (1, 5)}
    assert all(r.pred is not None and r.reason is None for r in out if r.fit_ok) and {r.series for r in out if r.fit_ok} == {"good"}


def test_registered_models_run_the_whole_job():
    from tideframe.operators.trees import CANONICAL
    from tideframe.plans import queries_models as q

    space = q.search_space()
    assert len(space) == len(set(space)) == 28 and CANONICAL in space
    assert (len(q.WALKS), q.LAGS, q.FOLDS, q.HORIZONS, len(q.SEEDS), q.TREE_LAGS) == (6, 10, 5, (1, 5, 20), 5, (1, 2, 3, 4, 5, 10, 20))


def test_granger_finds_the_driver(spark):
    rng = np.random.default_rng(9)
    x = np.cumsum(rng.normal(size=500))
    y = np.zeros(500)
    for t in range(1, 500):
        y[t] = y[t - 1] + 0.8 * (x[t - 1] - x[t - 2] if t > 1 else 0) + rng.normal() * 0.3
    out = co.granger(panel(spark, a=np.column_stack([x, y])), SPEC, ["x0", "x1"], 1).toPandas().set_index(["causing", "caused"])
    assert out.loc[("x0", "x1"), "reject_h0"] and out.loc[("x0", "x1"), "p_value"] < 1e-6
    assert out["p_value"].between(0, 1).all() and (out["df_num"] == 2).all()
    assert out.loc[("x1", "x0"), "p_value"] > 0.01


def adf_by_hand(y):
    d = np.diff(y)
    top = dg.max_lag(len(y))

    def fit(k, start):
        z = np.array([[1.0, y[t], *[d[t - i] for i in range(1, k + 1)]] for t in range(start, len(d))])
        t = d[start:]
        b, *_ = np.linalg.lstsq(z, t, rcond=None)
        e = t - z @ b
        n, m = z.shape
        return n * (np.log(2 * np.pi * (e @ e) / n) + 1) + 2 * m, b[1] / np.sqrt(np.linalg.inv(z.T @ z)[1, 1] * (e @ e) / (n - m)), n

    best = min((fit(k, top)[0], k) for k in range(top + 1))[1]
    return best, *fit(best, best)[1:]


def test_unit_root(spark):
    rng = np.random.default_rng(2)
    noise, walk = rng.normal(size=200), np.cumsum(rng.normal(size=350))
    df = panel(spark, noise=noise[:, None], walk=walk[:, None], tiny=np.arange(4.0)[:, None])
    got = dg.unit_root_tests(df, SPEC, "x0").toPandas().set_index("series")
    for name, y in (("noise", noise), ("walk", walk)):
        lag, tau, n = adf_by_hand(y)
        assert got.loc[name, "used_lag"] == lag and got.loc[name, "n_obs"] == n
        assert got.loc[name, "stat"] == pytest.approx(tau, rel=1e-7)
    assert got.loc["noise", "p_value"] < 0.01 and got.loc["walk", "p_value"] > 0.05 and not got.loc["tiny", "fit_ok"]
    assert dg.unit_root_p(-2.86154) == pytest.approx(0.05, abs=0.002) and dg.unit_root_p(-3.43035) == pytest.approx(0.01, abs=0.001)
    report = dg.integration_report(panel(spark, a=np.column_stack([walk[:200], noise])), SPEC, ["x0", "x1"]).toPandas().set_index("variable")
    assert report.loc["x0", "is_i1"] and not report.loc["x1", "is_i1"]
    with pytest.raises(Exception, match="x1"):
        dg.require_i1(dg.integration_report(panel(spark, a=np.column_stack([walk[:200], noise])), SPEC, ["x0", "x1"])).collect()


def test_lag_order(spark):
    rng = np.random.default_rng(4)
    y = np.zeros((400, 2))
    for t in range(2, 400):
        y[t] = 0.5 * y[t - 1] + np.array([[0.0, 0.3], [-0.3, 0.0]]) @ y[t - 2] + rng.normal(size=2)
    out = dg.lag_order(panel(spark, a=y), SPEC, ["x0", "x1"], 6).toPandas().sort_values("order")
    for p in range(7):
        z = np.array([np.concatenate([[1.0], *[y[t - i] for i in range(1, p + 1)]]) for t in range(6, 400)])
        e = y[6:] - z @ np.linalg.lstsq(z, y[6:], rcond=None)[0]
        n = len(z)
        ld = np.linalg.slogdet(e.T @ e / n)[1]
        row = out[out["order"] == p].iloc[0]
        assert row["aic"] == pytest.approx(ld + 2 / n * (4 * p + 2), rel=1e-8)
        assert row["bic"] == pytest.approx(ld + np.log(n) / n * (4 * p + 2), rel=1e-8)
    assert out.loc[out["best_bic"], "order"].tolist() == [2]


def test_vif(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    got = dg.variance_inflation(panel(spark, a=x), ["series"], ["x0", "x1", "x2"]).toPandas()
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    np.testing.assert_allclose(got.sort_values("feature")["vif"], want, rtol=1e-9)
    dependent = np.column_stack([x[:, 0], x[:, 1], x[:, 0] - x[:, 1], rng.normal(size=500)])
    inf = dg.variance_inflation(panel(spark, a=dependent), ["series"], ["x0", "x1", "x2", "x3"]).toPandas().set_index("feature")["vif"]
    assert np.isinf(inf[["x0", "x1", "x2"]]).all() and inf["x3"] < 1.1
    for bad in (np.column_stack([x[:3]]), np.column_stack([x[:, :2], np.ones(500)])):
        with pytest.raises(Exception):
            dg.variance_inflation(panel(spark, a=bad), ["series"], ["x0", "x1", "x2"]).collect()


def test_arma_recovers_order_and_is_causal(spark):
    rng = np.random.default_rng(8)
    d = np.zeros(600)
    for t in range(1, 600):
        d[t] = 0.6 * d[t - 1] + rng.normal()
    y = np.cumsum(d)
    df = panel(spark, a=y[:, None])
    best = vm.arma_orders(df, SPEC, "x0", widest=2).filter("best_bic").toPandas()
    assert (best["p"].iloc[0], best["q"].iloc[0]) == (1, 0)
    orders = spark.createDataFrame([("a", 1, 0)], "series string, p long, q long")
    out = vm.arma_forecasts(df, SPEC, "x0", orders, (1, 5), 100, 50, widest=2).toPandas()
    changed = y.copy()
    changed[400:] += 100
    later = vm.arma_forecasts(panel(spark, a=changed[:, None]), SPEC, "x0", orders, (1, 5), 100, 50, widest=2).toPandas()
    early = DAY + dt.timedelta(days=395)
    key = ["origin_date", "horizon"]
    a, b = (o[o["origin_date"] <= early].sort_values(key)["pred"].to_numpy() for o in (out, later))
    np.testing.assert_allclose(a, b, rtol=1e-9)
    assert out["fit_ok"].all()
    one = out[out["horizon"] == 1].set_index("origin_date")
    diffs = np.diff(y)
    for o in range(150, 595, 50):
        # Rows that have all residual lags of the widest order: ten for the long AR, two for the residuals.
        z = np.column_stack([np.ones(o - 13), diffs[11:o - 2]])
        b, *_ = np.linalg.lstsq(z, diffs[12:o - 1], rcond=None)
        want = y[o - 1] + b[0] + b[1] * diffs[o - 2]
        assert one.loc[DAY + dt.timedelta(days=o - 1), "pred"] == pytest.approx(want, rel=1e-8)


def test_singular_fit_is_a_row_not_an_error(spark):
    y = np.column_stack([np.arange(60.0), np.arange(60.0) * 2])
    out = vm.iterated_var(panel(spark, a=y), SPEC, ["x0", "x1"], "x0", 1, (1,), 30, 10).toPandas()
    assert len(out) == 3 and not out["fit_ok"].any() and out["pred"].isna().all()


def test_chunk_size_does_not_matter(spark, two):
    import tideframe.operators.moments as mo

    base = vm.iterated_var(two, SPEC, ["x0"], "x0", 2, (1,), 50, 7).toPandas().sort_values(["series", "origin_date"])
    original = mo.expanding_solve.__defaults__
    try:
        mo.expanding_solve.__defaults__ = (23,)
        small = vm.iterated_var(two, SPEC, ["x0"], "x0", 2, (1,), 50, 7).toPandas().sort_values(["series", "origin_date"])
    finally:
        mo.expanding_solve.__defaults__ = original
    np.testing.assert_allclose(base["pred"], small["pred"], rtol=1e-9)
    assert pd.Series(base["series"].unique()).tolist() == ["a", "b"]


def test_order_zero_is_drift(spark, two, system):
    out = vm.iterated_var(two, SPEC, ["x0", "x1"], "x0", 0, (1, 5), 100, 90).toPandas()
    mine = out[(out["series"] == "a") & (out["horizon"] == 5)].set_index("origin_date")
    for o in range(100, 395, 90):
        d = np.diff(system[:o, 0])
        row = mine.loc[DAY + dt.timedelta(days=o - 1)]
        assert row["pred"] == pytest.approx(system[o - 1, 0] + 5 * d.mean(), rel=1e-9)
        assert row["hi95"] - row["pred"] == pytest.approx(vm.Z95 * d.std(ddof=1) * np.sqrt(5), rel=1e-9)
