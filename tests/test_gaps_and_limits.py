"""Null keys in both physical forms, values that are not finite, and limits that must not decide what is computed."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.operators import accuracy_tests as at
from tideframe.operators import archive as ar
from tideframe.operators import contracts as ct
from tideframe.operators import scoring as sc
from tideframe.operators.diagnostics import max_lag, unit_root_tests
from tideframe.operators.intervals import conformal_quantiles
from tideframe.operators.order_statistics import exact_quantiles
from tideframe.panel import Framed, PanelSpec, Running, framed, running, series_length, with_position
from tideframe.sources import feeds as fd
from tideframe.sources import tables as tb

KEYS = ["series", "reference_month"]


def month(i):
    return dt.date(2020 + i // 12, i % 12 + 1, 1)


@pytest.mark.parametrize("grain", [None, "hour"])
def test_null_keys_times_and_ties(spark, grain):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, 1, 1.0), ("a", t, 2, None), (None, t, 3, 3.0), (None, None, 4, 4.0), ("a", None, 5, 5.0), ("a", t + dt.timedelta(hours=3), 6, 6.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, x double")
    spec = PanelSpec(keys=("k",), time="ts", tie=("id",), grain=grain, block_rows=2)
    out = series_length(with_position(df, spec), spec)
    out = running(framed(out, spec, Framed(1, 0, lambda w: {"before": F.lag("x").over(w)})), spec, Running("sum", "x", "total"), Running("last", "x", "latest"))
    got = {r.id: (r.pos, r.n_rows, r.before, r.total, r.latest) for r in out.collect()}
    assert got == {5: (1, 4, None, 5.0, 5.0), 1: (2, 4, 5.0, 6.0, 1.0), 2: (3, 4, 1.0, 6.0, 1.0), 6: (4, 4, None, 12.0, 6.0), 4: (1, 2, None, 4.0, 4.0), 3: (2, 2, 4.0, 7.0, 3.0)}


def test_not_finite_values(spark):
    rows = [("g", float(i)) for i in range(9)] + [("g", float("nan")), ("g", float("inf")), (None, 2.0), (None, None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.q50 for r in exact_quantiles(df, ["g"], "x", (0.5,)).collect()}
    assert got == {"g": 4.0, None: 2.0}
    bands = {r.g: (r.n_cal, r.half) for r in conformal_quantiles(df, ["g"], "x", {"half": 0.5}).collect()}
    assert bands == {"g": (9, 4.0), None: (1, 2.0)}
    cover = spark.createDataFrame([(1.0, 0.5, 1.5), (float("nan"), 0.5, 1.5), (1.0, float("nan"), 1.5), (1.0, 0.0, float("inf"))], "actual double, lo double, hi double")
    row = sc.interval_coverage(cover, [], {90: "lo"}, {90: "hi"}).first()
    assert (row.coverage_90, row.width_90) == (100.0, 1.0)


def test_fdr_with_a_null_group(spark):
    rows = [("a", 0.01), ("a", 0.04), (None, 0.02), (None, 0.5), (None, None)]
    got = at.fdr_adjust(spark.createDataFrame(rows, "g string, p double"), "p", "q", ["g"]).collect()
    assert sorted((r.g or "", r.p or -1, round(r.q, 9) if r.q is not None else None) for r in got) == [("", -1, None), ("", 0.02, 0.04), ("", 0.5, 0.5), ("a", 0.01, 0.02), ("a", 0.04, 0.04)]


def test_long_horizon(spark):
    rng = np.random.default_rng(1)
    n, h = 400, 100
    actual, naive, pred = rng.normal(size=(3, n))
    df = spark.createDataFrame([("s", dt.date(2000, 1, 1) + dt.timedelta(days=i), h, *map(float, v)) for i, v in enumerate(zip(actual, naive, pred))], "series string, origin_date date, horizon int, actual double, naive double, pred double")
    row = at.clark_west(df, ["series"]).first()
    f = (actual - naive) ** 2 - ((actual - pred) ** 2 - (naive - pred) ** 2)
    z = f - f.mean()
    omega = z @ z / n + sum(2 * (1 - k / h) * (z[k:] @ z[:-k]) / (n - k) for k in range(1, h))
    factor = (n - h) * (n - h + 1) / n**2
    assert row.cw_stat == pytest.approx(f.mean() / np.sqrt(max(omega, 1e-14) / n / factor), rel=1e-6)


def test_unit_root_of_a_long_series(spark):
    n = 100_000
    assert max_lag(n) > 64
    df = spark.range(n).select(F.lit("s").alias("series"), F.col("id").alias("date"), F.sum(F.randn(3)).over(__import__("pyspark").sql.Window.orderBy("id")).alias("y"))
    row = unit_root_tests(df, PanelSpec(), "y").first()
    assert row.fit_ok and row.p_value > 0.001 and row.n_obs > n - 200


def test_long_section(spark):
    pairs = " ".join(f"{month(i + 1).strftime('%B')} 19, {month(i + 1).year} {month(i).strftime('%B')} {month(i).year}" for i in range(400))
    df = spark.createDataFrame([(1, "Intro Heading " + pairs)], "id int, text string")
    assert len(fd.with_section(df, "text", "Heading", "Stop").first().section) == len(pairs) + 8
    assert len(fd.with_section(df, "text", "Heading", "Stop", fallback=100).first().section) == 100


def test_guarded_rebuild_and_archive_rules(spark):
    rows = [("s", month(i), 10.0 + i, "p1") for i in range(3)] + [("s", month(2), 99.0, "p2")]
    pulls = spark.createDataFrame(rows, "series string, reference_month date, value double, source_pull string")
    assert ar.rebuild(pulls, KEYS).count() == 3 and ar.rebuild(pulls, KEYS, limit=100.0).count() == 3
    with pytest.raises(ct.ContractError):
        ar.rebuild(pulls, KEYS, limit=5.0)
    whole = pulls.filter("source_pull = 'p1'")
    assert all(r.passed for r in ct.archive_checks(whole, KEYS).collect())
    broken = {r["check"]: r.passed for r in ct.archive_checks(pulls.filter("value <> 11.0"), KEYS).collect()}
    assert broken == {"key_present": True, "value_present": True, "key_unique": False, "months_contiguous": False}
    assert not any(r.passed for r in ct.archive_checks(whole.filter("false"), KEYS).filter("n_rows is not null").collect())
    with pytest.raises(ct.ContractError, match="30 failed"):
        ct.enforce(spark.range(30).select(F.col("id").alias("check"), F.lit(False).alias("passed")))


def test_interrupted_swap_is_undone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path + ".old")
    tb.replace_table(spark, spark.range(5), path, lambda df: None)
    assert spark.read.parquet(path).count() == 5
    (tmp_path / "t").rename(tmp_path / "t.old")

    def refuse(df):
        raise ValueError("bad")

    with pytest.raises(ValueError):
        tb.replace_table(spark, spark.range(1), path, refuse)
    assert spark.read.parquet(path).count() == 5


def test_overlapping_regimes_leave_no_join(spark):
    df = spark.range(10).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    out = sc.join_regimes(df, [("a", "2020-01-01", "2020-01-04"), ("b", "2020-01-03", "2020-01-05")], "date")
    assert sorted((r.date.day, r.regime) for r in out.collect()) == [(1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "a"), (4, "b"), (5, "b")]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
