"""Tests, corrections, intervals and quantiles against brute force."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideframe.functions import distributions as ds
from tideframe.operators import accuracy_tests as at
from tideframe.operators import intervals as iv
from tideframe.operators import order_statistics as os_
from tideframe.operators import scoring as sc

DAY = dt.date(2020, 1, 1)


def frame(spark, parts):
    """Long frame from (model, horizon, actual, naive, pred) arrays; NaN becomes null."""
    out = []
    for model, h, a, n, p in parts:
        for i in range(len(a)):
            row = [None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) for v in (a[i], n[i], p[i])]
            out.append(("s", model, DAY + dt.timedelta(days=i), h, *row))
    return spark.createDataFrame(out, "series string, model string, origin_date date, horizon int, actual double, naive double, pred double")


def test_normal_tail(spark):
    z = np.linspace(-6, 6, 61)
    got = spark.createDataFrame([(float(v),) for v in z], "z double").select(ds.normal_tail(F.col("z")).alias("p")).toPandas()["p"]
    want = [0.5 * math.erfc(v / math.sqrt(2)) for v in z]
    np.testing.assert_allclose(got, want, rtol=3e-7)


def test_student_and_f_tails(spark):
    # Exact closed forms: one and two degrees of freedom.
    t = np.array([0.3, 1.0, 2.5, 8.0])
    df = spark.createDataFrame([(float(v), float(n)) for v in t for n in (1, 2)] + [(None, 5.0)], "t double, n double")
    got = df.select("t", "n", ds.student_two_sided("t", "n").alias("p")).toPandas()
    assert got["p"].isna().sum() == 1
    for _, row in got.dropna().iterrows():
        want = 1 - 2 * math.atan(row["t"]) / math.pi if row["n"] == 1 else 1 - row["t"] / math.sqrt(2 + row["t"] ** 2)
        assert row["p"] == pytest.approx(want, rel=1e-10)
    assert ds.f_tail(3.0, 2, 10) == pytest.approx((1 + 2 * 3.0 / 10) ** -5, rel=1e-10)


def dm_by_definition(d, h):
    n, z = len(d), d - d.mean()
    gamma = [np.sum(z[k:] * z[: n - k]) / n for k in range(h)]
    var = (gamma[0] + 2 * sum((1 - k / h) * gamma[k] for k in range(1, h))) / n
    return d.mean() / math.sqrt(var) * math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)


@pytest.mark.parametrize("h", [1, 5, 20])
def test_diebold_mariano(spark, h):
    rng = np.random.default_rng(h)
    a = np.cumsum(rng.normal(size=90))
    p1, p2 = a + rng.normal(size=90), a + 1.3 * rng.normal(size=90)
    f = frame(spark, [("m1", h, a, a, p1), ("m2", h, a, a, p2)])
    row = at.diebold_mariano(at.model_pairs(f, ["series"]), ["series"], [1, 5, 20]).first()
    assert row["dm_squared"] == pytest.approx(dm_by_definition((a - p1) ** 2 - (a - p2) ** 2, h), rel=1e-9)
    assert row["dm_absolute"] == pytest.approx(dm_by_definition(np.abs(a - p1) - np.abs(a - p2), h), rel=1e-9)
    assert 0 <= row["p_squared"] <= 1


def test_diebold_mariano_short_and_degenerate(spark):
    a = np.arange(5.0)
    f = frame(spark, [("m1", 5, a, a, a + 1), ("m2", 5, a, a, a + 2), ("m1", 1, a, a, a + 1), ("m2", 1, a, a, a + 1)])
    rows = at.diebold_mariano(at.model_pairs(f, ["series"]), ["series"], [1, 5]).collect()
    assert len(rows) == 2 and all(r["insufficient_sample"] and r["dm_squared"] is None and not r["a_better_rmse"] for r in rows)


def clark_west_by_definition(a, n, p, h):
    ok = np.isfinite(a) & np.isfinite(n) & np.isfinite(p)
    f = (a - n) ** 2 - ((a - p) ** 2 - (n - p) ** 2)
    m = ok.sum()
    z = np.where(ok, f - f[ok].mean(), 0.0)
    omega = np.sum(z[ok] ** 2) / m
    for k in range(1, h):
        pair = ok[k:] & ok[:-k]
        if pair.sum():
            omega += 2 * (1 - k / h) * np.sum((z[k:] * z[:-k])[pair]) / pair.sum()
    var = max(omega, 1e-14) / m / ((m - h) * (m - h + 1) / m**2)
    return m, f[ok].mean() / math.sqrt(var)


@pytest.mark.parametrize("h", [1, 5, 20])
def test_clark_west_with_gaps(spark, h):
    rng = np.random.default_rng(3)
    a = rng.normal(size=80)
    n, p = a + rng.normal(size=80), a + rng.normal(size=80)
    a[:3] = np.nan
    p[30:35] = np.nan
    n[-2:] = np.nan
    row = at.clark_west(frame(spark, [("m", h, a, n, p)]), ["series", "model"]).first()
    m, stat = clark_west_by_definition(a, n, p, h)
    assert row["n_forecasts"] == m == 70
    assert row["cw_stat"] == pytest.approx(stat, rel=1e-9)
    assert row["cw_p_value"] == pytest.approx(0.5 * math.erfc(stat / math.sqrt(2)), rel=1e-6)


def test_clark_west_insufficient(spark):
    a = np.array([1.0, 2.0])
    row = at.clark_west(frame(spark, [("m", 1, a, a, a)]), ["series", "model"]).first()
    assert row["insufficient_sample"] and row["cw_stat"] is None and row["r2_oos"] is None and not row["significant"]


def bh(p):
    p = np.asarray(p)
    order = np.argsort(p)
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    return out


def test_fdr_with_ties_nulls_and_tiny_values(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(400) ** 3, np.repeat([1e-12, 0.01, 0.5, 1.0], 20), [0.0]])
    rows = [(i, "g" if i % 3 else "h", float(v)) for i, v in enumerate(p)] + [(9999, "g", None)]
    df = spark.createDataFrame(rows, "i int, grp string, p double")
    got = at.fdr_adjust(df, "p", "q").toPandas().set_index("i")
    np.testing.assert_allclose(got.loc[range(len(p)), "q"], bh(p), rtol=1e-9)
    assert pd.isna(got.loc[9999, "q"])
    by = at.fdr_adjust(df, "p", "q", ["grp"]).toPandas().dropna()
    for _, part in by.groupby("grp"):
        np.testing.assert_allclose(part["q"], bh(part["p"]), rtol=1e-9)


def test_verdicts(spark):
    from tideframe.functions.wording import nested_verdict, pairwise_verdict

    base = dict(n_forecasts=9, insufficient_sample=False, a_better_rmse=False, b_better_rmse=False, a_better_mae=False, b_better_mae=False, p_squared=0.01, p_absolute=0.2)
    cases = [
        (dict(insufficient_sample=True), "insufficient sample (n=9) to run the DM test at this horizon"),
        (dict(a_better_rmse=True, a_better_mae=True), "A significantly better than B (RMSE and MAE agree)"),
        (dict(b_better_rmse=True, b_better_mae=True), "B significantly better than A (RMSE and MAE agree)"),
        (dict(b_better_rmse=True), "B significantly better than the rival on RMSE only (p=0.0100); MAE not significant"),
        (dict(a_better_mae=True), "A significantly better than the rival on MAE only (p=0.2000); RMSE not significant"),
        (dict(), "no significant difference on either RMSE or MAE")]
    df = spark.createDataFrame([{**base, **c} for c, _ in cases])
    got = [r[0] for r in df.coalesce(1).select(pairwise_verdict(F.lit("A"), F.lit("B"))).collect()]
    assert got == [t for _, t in cases]
    mixed = spark.createDataFrame([{**base, "a_better_rmse": True, "b_better_mae": True}]).select(pairwise_verdict(F.lit("A"), F.lit("B"))).first()[0]
    assert mixed.startswith("mixed result") and "A/B" in mixed
    cw = spark.createDataFrame(
        [(False, 50, True, 2.0, 0.02, 0.5, 0.4, 0.3), (False, 50, False, -1.0, 0.84, 0.5, 0.6, 0.55), (False, 50, False, 0.5, 0.3, 0.5, 0.5, 0.45), (True, 2, False, None, None, None, None, None)],
        "insufficient_sample boolean, n_forecasts int, significant boolean, cw_stat double, cw_p_value double, mspe_naive double, mspe_model double, mspe_model_adj double")
    texts = [r[0] for r in cw.coalesce(1).select(nested_verdict(F.lit("M"), F.col("significant"), F.col("cw_p_value"))).collect()]
    assert texts[0].startswith("M significantly outperforms") and "(CW=2.000, p=0.0200; MSPE_naive=0.50000, MSPE_adj=0.30000)" in texts[0]
    assert texts[1].startswith("No significant improvement: M") and "MSPE_model=0.60000" in texts[1]
    assert texts[2].startswith("Positive point gain not statistically significant: M")
    assert texts[3] == "insufficient sample (n=2) to run Clark-West test"


def test_coverage(spark):
    rows = [("s", 1, 1.0, 0.0, 2.0, -1.0, 3.0), ("s", 1, 5.0, 4.0, 6.0, 9.0, 10.0), ("s", 5, 1.0, 2.0, 3.0, 2.0, 3.0), ("s", 5, 9.0, None, 3.0, None, None)]
    df = spark.createDataFrame(rows, "series string, horizon int, actual double, l90 double, h90 double, l95 double, h95 double")
    got = {r["horizon"]: r for r in sc.interval_coverage(df, ["horizon"], {90: "l90", 95: "l95"}, {90: "h90", 95: "h95"}).collect()}
    assert (got[1]["coverage_90"], got[1]["coverage_95"], got[5]["coverage_90"], got[5]["coverage_95"]) == (100, 50, 0, 0)
    empty = sc.interval_coverage(df.limit(0), ["horizon"], {90: "l90"}, {90: "h90"})
    assert empty.columns == ["horizon", "n_forecasts", "coverage_90", "width_90"] and empty.count() == 0
    with pytest.raises(ValueError):
        sc.interval_coverage(df, ["horizon"], {90: "l90"}, {95: "h95"})


def test_metrics_pairing_and_zero_naive(spark):
    a = np.array([1.0, 2.0, 3.0, 4.0])
    p = np.array([1.0, np.nan, 2.0, 4.5])
    row = sc.error_metrics(frame(spark, [("m", 1, a, a, p)]), ["model", "horizon"]).first()
    assert row["n_forecasts"] == 3 and row["naive_rmse"] == 0 and row["rmse_improvement_pct"] == 0
    assert row["rmse"] == pytest.approx(math.sqrt((1 + 0.25) / 3))


def test_origin_sets_of_equal_size_but_different(spark):
    a = np.arange(6.0)
    gap1, gap2 = a.copy(), a.copy()
    gap1[0], gap2[5] = np.nan, np.nan
    same = sc.origin_fingerprints(frame(spark, [("x", 1, a, a, gap1), ("y", 1, a, a, gap1)]), ["horizon"]).first()
    other = sc.origin_fingerprints(frame(spark, [("x", 1, a, a, gap1), ("y", 1, a, a, gap2)]), ["horizon"]).first()
    assert same["is_paired"] and not other["is_paired"] and other["min_origins"] == other["max_origins"] == 5


def test_min_covered(spark):
    counts = spark.createDataFrame([("a", 0), ("b", 12), ("c", 40)], "model string, n_paired long")
    assert sc.min_covered(counts).first()[0] == 12
    assert sc.min_covered(counts.filter("model = 'a'")).first()[0] == 0


@pytest.mark.parametrize("n", [20, 74, 300])
def test_conformal_is_the_exact_order_statistic(spark, n):
    rng = np.random.default_rng(n)
    e = np.round(rng.normal(size=n), 2)
    df = spark.createDataFrame([("g", float(v)) for v in e], "g string, e double")
    row = iv.conformal_quantiles(df, ["g"], "e", {"q90": 0.9, "q95": 0.95}).first()
    ranked = np.sort(np.abs(e))
    assert row["q90"] == ranked[math.ceil(round((n + 1) * 0.9, 9)) - 1] and row["q95"] == ranked[math.ceil(round((n + 1) * 0.95, 9)) - 1]


def test_conformal_refuses_too_few(spark):
    df = spark.createDataFrame([("g", float(v)) for v in range(10)], "g string, e double")
    with pytest.raises(Exception, match="cannot support"):
        iv.conformal_quantiles(df, ["g"], "e", {"q95": 0.95}).collect()
    assert iv.conformal_quantiles(df, ["g"], "e", {"q95": 0.95}, strict=False).first()["q95"] is None


def test_conformal_coverage_by_simulation():
    rng = np.random.default_rng(0)
    n, k = 74, math.ceil(75 * 0.9)
    draws = np.abs(rng.normal(size=(4000, n + 1)))
    covered = np.mean(draws[:, -1] <= np.sort(draws[:, :n], axis=1)[:, k - 1])
    assert covered > 0.885


def test_exact_quantiles_on_hostile_values(spark):
    rng = np.random.default_rng(5)
    sets = {"heavy": np.concatenate([np.exp(rng.normal(size=300) * 4), [1e12]]), "ties": np.repeat([0.0, 1.0, 1.0, 2.0], 50),
            "signed": rng.normal(size=301) * 1e-3, "one": np.array([4.2])}
    rows = [(g, float(v)) for g, vs in sets.items() for v in vs]
    got = os_.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", (0.05, 0.25, 0.5, 0.9)).toPandas().set_index("g")
    for g, vs in sets.items():
        np.testing.assert_allclose(got.loc[g, ["q5", "q25", "q50", "q90"]].astype(float), np.quantile(vs, [0.05, 0.25, 0.5, 0.9]), rtol=1e-9)
