"""Archive, snapshots, contracts, sinks, the feature table, splits and trees."""

import datetime as dt
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.functions import scalars as sc
from tideframe.operators import archive as ar
from tideframe.operators import contracts as ct
from tideframe.operators import profile as pf
from tideframe.operators import splits as sp
from tideframe.operators.align import merge_by_target, splice
from tideframe.panel import PanelSpec
from tideframe.plans.gold import build_gold
from tideframe.sources import feeds as fd
from tideframe.sources import snapshots as sn
from tideframe.sources import tables as tb
from tideframe.sources import versions as vs
from tideframe.streaming import archive_stream as st

KEYS = ["reference_month"]
D = dt.date


def pull(spark, stamp, **values):
    rows = [(D(int(k[1:5]), int(k[5:]), 1), v, stamp) for k, v in values.items()]
    return spark.createDataFrame(rows, "reference_month date, value double, source_pull string")


def as_dict(df):
    return {r["reference_month"]: (r["value"], r["source_pull"]) for r in df.collect()}


def test_merge_newest_wins_null_never_overwrites(spark):
    old = pull(spark, "p1", m202001=100.0, m202002=101.0, m202003=102.0)
    new = pull(spark, "p2", m202002=101.5, m202003=None, m202004=103.0)
    got = as_dict(ar.guarded_merge(old, new, KEYS, 1.0))
    assert got == {D(2020, 1, 1): (100.0, "p1"), D(2020, 2, 1): (101.5, "p2"), D(2020, 3, 1): (102.0, "p1"), D(2020, 4, 1): (103.0, "p2")}


def test_guard_rejects_rebasing(spark):
    old = pull(spark, "p1", m202001=100.0, m202002=101.0)
    with pytest.raises(ct.ContractError, match="2 archived values"):
        ar.guarded_merge(old, pull(spark, "p2", m202001=137.0, m202002=138.0), KEYS, 1.0)
    ar.guard(ar.revisions(old, pull(spark, "p2", m202001=101.0), KEYS), 1.0)


def test_rebuild_equals_fold_and_seed_is_overridden(spark):
    pulls = [pull(spark, f"p{i}", **{f"m20200{m}": 100.0 + m + i / 10 for m in range(i, i + 4)}) for i in range(1, 5)]
    folded = pulls[0]
    for p in pulls[1:]:
        folded = ar.merge(folded, p, KEYS)
    union = pulls[0]
    for p in pulls[1:]:
        union = union.unionByName(p)
    assert as_dict(ar.rebuild(union, KEYS)) == as_dict(folded)
    seeded = as_dict(ar.rebuild(union, KEYS, seed=pull(spark, "zz", m201901=90.0, m202001=1.0)))
    assert seeded[D(2019, 1, 1)] == (90.0, "zz") and seeded[D(2020, 1, 1)][1] == "p1"
    log = ar.revision_log(union, KEYS, 0.05).collect()
    assert log and all(r["rejected"] and r["pull_old"] < r["pull_new"] for r in log)


def test_prioritised_union_fills_gaps_only(spark):
    feed, calendar = pull(spark, "feed", m202001=1.0, m202002=2.0), pull(spark, "calendar", m202002=9.0, m202003=3.0)
    got = {r["reference_month"].month: (r["value"], r["priority"]) for r in ar.prioritised_union([feed, calendar], KEYS).collect()}
    assert got == {1: (1.0, 0), 2: (2.0, 0), 3: (3.0, 1)}


def test_replace_table_keeps_good_data(spark, tmp_path):
    path = str(tmp_path / "archive")

    def check(df):
        ct.enforce(ct.check_table(df, {"positive": F.col("value") > 0}))

    tb.replace_table(spark, pull(spark, "p1", m202001=1.0), path, check)
    with pytest.raises(ct.ContractError):
        tb.replace_table(spark, pull(spark, "p2", m202001=-1.0), path, check)
    assert spark.read.parquet(path).first()["value"] == 1.0
    tb.replace_table(spark, pull(spark, "p3", m202001=2.0), path, check)
    assert spark.read.parquet(path).first()["value"] == 2.0


def test_read_archive_absent_and_old(spark, tmp_path):
    assert tb.read_archive(spark, str(tmp_path / "none")).columns == ["reference_month", "value", "source_pull"]
    old = str(tmp_path / "old")
    pull(spark, "p", m202001=1.0).drop("source_pull").write.parquet(old)
    assert tb.read_archive(spark, old).first()["source_pull"].startswith("unknown")
    assert tb.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0


def test_write_mapping_never_truncates(spark, tmp_path):
    mapping = spark.createDataFrame([(D(2020, m, 1), D(2020, m, 20)) for m in range(1, 10)], "reference_month date, release_date date")
    assert tb.write_mapping(mapping, str(tmp_path / "m"), "2020-03-01", "2020-05-01") == 7


def test_reports(spark, tmp_path):
    path = str(tmp_path / "report")
    tb.write_report(spark.createDataFrame([("ok", 3)], "status string, n int"), path)
    assert tb.read_report(spark, path, "status string, n int").first()["n"] == 3
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{not json")
    assert tb.read_report(spark, str(tmp_path / "bad"), "status string, n int").count() == 0
    assert tb.read_report(spark, str(tmp_path / "none"), "status string, n int").count() == 0
    tb.export_tables({"t": spark.createDataFrame([(1, 2)], "a int, a_raw int")}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "t")).columns == ["a"]


def test_snapshots_by_stamp_and_by_file_time(spark, tmp_path):
    old, new = tmp_path / "src_a_20240101_000000.json", tmp_path / "src_a_20240201_000000.json"
    new.write_text(json.dumps({"observations": [{"date": "2024-01-01", "value": "2"}, {"date": "bad", "value": "9"}, {"date": "2024-01-02", "value": "."}]}))
    old.write_text(json.dumps({"observations": [{"date": "2024-01-01", "value": "1"}]}))
    later = time.time() + 60
    os.utime(old, (later, later))
    rows = fd.read_json(spark, str(tmp_path), fd.LONG_SCHEMA).withColumn("series", F.lit("a"))
    by_stamp = fd.long_observations(sn.newest_by_stamp(rows, ["series"])).orderBy("date").collect()
    assert [(r["date"].day, r["value"]) for r in by_stamp] == [(1, 2.0), (2, None)]
    by_time = fd.long_observations(sn.newest_by_file_time(rows, ["series"])).collect()
    assert [r["value"] for r in by_time] == [1.0]
    with pytest.raises(ValueError):
        sn.select_snapshots(["a", "b"], {"a": "x"})
    with pytest.raises(ValueError):
        fd.long_observations(spark.createDataFrame([], "observations array<struct<date:string>>"))


def test_vector_feed_status(spark):
    good = ("SUCCESS", ([("2024-03-01", 1.5)],))
    schema = fd.VECTOR_SCHEMA
    assert fd.vector_observations(spark.createDataFrame([good], schema)).first()["value"] == 1.5
    for bad in (("FAILED", ([("2024-03-01", 1.5)],)), ("SUCCESS", ([],))):
        with pytest.raises(Exception, match="response without data"):
            fd.vector_observations(spark.createDataFrame([good, bad], schema)).collect()


def test_redaction_and_ids(spark):
    df = spark.createDataFrame([("x?api_key=abc123&y=1 TOKEN=zz end",), (None,)], "t string")
    assert [r[0] for r in df.select(sc.redact(F.col("t"))).collect()] == ["x?api_key=***REDACTED***&y=1 TOKEN=***REDACTED*** end", ""]
    assert df.select(sc.safe_id(F.lit("a/b.c"))).first()[0] == "a_b_c"


def test_section_falls_back_to_first_heading(spark):
    text = "Consumer Price Index x January 5, 2000 December 1999 end"
    df = spark.createDataFrame([(1, text), (2, "nothing here")], "i int, t string")
    got = fd.calendar_pairs(df, ["i"], "t", "Consumer Price Index", "Employment Insurance").collect()
    assert [(r["i"], r["release_date"], r["reference_month"]) for r in got] == [(1, D(2000, 1, 5), D(1999, 12, 1))]


# ---- stream ------------------------------------------------------------------


def test_stream_late_pulls_quarantine_and_restart(spark, tmp_path):
    landed, root = tmp_path / "landed", str(tmp_path / "archive")
    landed.mkdir()

    def land(stamp, *rows):
        (landed / f"cpi_{stamp}.json").write_text("\n".join(json.dumps({"reference_month": m, "value": v}) for m, v in rows))

    def run():
        rows = st.read_pulls(spark, str(landed), "reference_month DATE, value DOUBLE")
        job = st.run_archive_stream(spark, rows, root, KEYS, 1.0)
        job.awaitTermination()
        return job

    land("20240201_000000", ("2024-01-01", 100.0), ("2024-02-01", 101.0))
    run()
    land("20240101_000000", ("2024-01-01", 99.5), ("2023-12-01", 98.0))
    run()
    land("20240301_000000", ("2024-01-01", 180.0), ("2024-03-01", 190.0))
    run()
    run()
    got = as_dict(st.latest_archive(spark, root, KEYS))
    assert got == {D(2024, 1, 1): (100.0, "20240201_000000"), D(2024, 2, 1): (101.0, "20240201_000000"), D(2023, 12, 1): (98.0, "20240101_000000")}
    assert {r.source_pull for r in st.accepted(spark, root, KEYS, "quarantine").collect()} == {"20240301_000000"} and st.accepted(spark, root, KEYS, "quarantine").count() == 2


@pytest.mark.parametrize("per_trigger", [1, 1000])
def test_stream_does_not_depend_on_batches(spark, tmp_path, per_trigger):
    landed, root = tmp_path / "landed", str(tmp_path / "archive")
    landed.mkdir()
    pulls = {"20240101_000000": [10.0, 20.0, 30.0], "20240201_000000": [10.5, 99.0, 30.5], "20240301_000000": [11.0, 20.5, 31.0]}
    for stamp, values in pulls.items():
        for k, value in enumerate(values):
            (landed / f"part{k}_{stamp}.json").write_text(json.dumps({"reference_month": f"2024-0{k + 1}-01", "value": value}))
    rows = st.read_pulls(spark, str(landed), "reference_month DATE, value DOUBLE", per_trigger)
    st.run_archive_stream(spark, rows, root, KEYS, 5.0).awaitTermination()
    assert as_dict(st.latest_archive(spark, root, KEYS)) == {D(2024, k + 1, 1): (v, "20240301_000000") for k, v in enumerate(pulls["20240301_000000"])}
    assert [r.source_pull for r in st.accepted(spark, root, KEYS, "quarantine").collect()] == ["20240201_000000"] * 3
    before = vs.current(spark, root)
    st.run_archive_stream(spark, rows, root, KEYS, 5.0).awaitTermination()
    assert vs.current(spark, root) == before


# ---- feature table -----------------------------------------------------------


def gold_inputs(spark):
    days = [D(2023, 1, 2) + dt.timedelta(days=i) for i in range(60)]
    days = [d for d in days if d.weekday() < 5][:40]
    left = spark.createDataFrame([("s", d, 2.0 + 0.01 * i, 3.0 + 0.02 * i) for i, d in enumerate(days)], "series string, date date, y2 double, y10 double")
    right = spark.createDataFrame([("s", d, 1.0 + 0.03 * i) for i, d in enumerate(days)], "series string, date date, us double")
    months = [D(2021 + (5 + i) // 12, (5 + i) % 12 + 1, 1) for i in range(24)]
    monthly = spark.createDataFrame([("s", m, m + dt.timedelta(days=20), 100 + 0.5 * i) for i, m in enumerate(months)], "series string, month date, release_date date, cpi double")
    return left, right, monthly


def test_gold_shape_and_edge_rule(spark):
    left, right, monthly = gold_inputs(spark)
    args = dict(index="cpi", spreads={"spread": ("y10", "y2")}, diffs=["y2", "y10", "us"])
    got = build_gold(left, right, monthly, PanelSpec(), **args).toPandas()
    assert len(got) == 24 and not got.isna().any().any()
    np.testing.assert_allclose(got["spread"], got["y10"] - got["y2"])
    carried = build_gold(left, right, monthly, PanelSpec(), carry_in=True, **args)
    assert carried.count() == 39
    levels = build_gold(left, right, monthly, PanelSpec(), family="levels", **args).columns
    stationary = build_gold(left, right, monthly, PanelSpec(), family="stationary", **args).columns
    assert not any(c.startswith("d_") for c in levels) and all(c.startswith("d_") for c in stationary[2:])
    with pytest.raises(ValueError):
        build_gold(left, right, monthly, PanelSpec(), family="nonsense", **args)
    with pytest.raises(ct.ContractError):
        build_gold(left.drop("date"), right, monthly, PanelSpec(), **args)


def test_splice_keeps_both(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), 1.0, 2.0), (D(2020, 1, 2), 1.0, 2.0)], "date date, old double, new double")
    assert [(r["both"], r["old"], r["new"]) for r in splice(df, "date", "2020-01-02", "old", "new", "both").orderBy("date").collect()] == [(1.0, 1.0, 2.0), (2.0, 1.0, 2.0)]


def test_cross_calendar_merge(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    short = [d for d in days if d != D(2024, 1, 15)]
    cal = lambda ds: spark.createDataFrame([("s", d) for d in ds], "series string, date date")

    def arm(ds, name, wrong=0.0):
        rows = [("s", d, 2, float(ds[i + 2].toordinal()) + wrong, 0.0, 1.0) for i, d in enumerate(ds[:-2])]
        return spark.createDataFrame(rows, f"series string, origin_date date, horizon int, actual double, naive double, {name} double")

    merged = merge_by_target(arm(days, "a"), "a", cal(days), arm(short, "b"), "b", cal(short), PanelSpec())
    got = {r["origin_date"] for r in merged.collect()}
    assert got == {d for d in days[:-2]} - {D(2024, 1, 13), D(2024, 1, 14), D(2024, 1, 15)}
    with pytest.raises(Exception, match="different actual"):
        merge_by_target(arm(days, "a"), "a", cal(days), arm(short, "b", 1.0), "b", cal(short), PanelSpec()).collect()
    for x, y in (("a", "a"), ("naive", "b")):
        with pytest.raises(ValueError):
            merge_by_target(arm(days, "a"), x, cal(days), arm(short, "b"), y, cal(short), PanelSpec())


# ---- splits and trees ---------------------------------------------------------


def line(spark, n):
    rng = np.random.default_rng(42)
    y, z = np.cumsum(rng.normal(size=n)), rng.normal(size=n)
    return spark.createDataFrame([("s", D(2020, 1, 1) + dt.timedelta(days=i), float(y[i]), float(z[i])) for i in range(n)], "series string, date date, y double, z double")


def test_folds_cover_and_embargo_holds(spark):
    df, spec = line(spark, 203), PanelSpec()
    bounds = sp.fold_bounds(df, spec, 100, 5)
    b = bounds.orderBy("fold").toPandas()
    assert b["train_end"].tolist() == [100, 120, 140, 160, 180] and b["test_end"].tolist() == [120, 140, 160, 180, 203]
    roles = sp.embargo_roles(df, spec, bounds, (1, 5, 20))
    report = sp.leakage_report(roles, ["fold", "horizon"]).collect()
    assert len(report) == 15 and all(r["leak_free"] for r in report)
    assert sp.leakage_report(roles.withColumn("horizon", F.lit(40)), ["fold"]).filter("leak_free").count() == 0
    sizes = roles.filter("fold = 0 and horizon = 5").groupBy("role").count().toPandas().set_index("role")["count"]
    assert sizes.to_dict() == {"fit": 70, "gap": 5, "calibration": 20, "embargo": 5, "test": 20}
    with pytest.raises(Exception, match="too few"):
        sp.fold_bounds(df, spec, 200, 5).collect()
    both = df.unionByName(df.limit(30).withColumn("series", F.lit("short")))
    told = sp.fold_bounds(both, spec, 100, 5, strict=False).collect()
    assert [(r.fold, r.train_end, r.reason) for r in told if r.series == "short"] == [(None, None, "30 rows are too few for min_train=100 and 5 folds")]
    assert sorted(r.fold for r in told if r.series == "s") == [0, 1, 2, 3, 4] and all(r.reason is None for r in told if r.series == "s")
    with pytest.raises(Exception, match="too small"):
        sp.search_roles(df, spec, 50, (1,)).collect()


def test_trees_walk_forward_search_importance(spark):
    from tideframe.operators import trees
    from tideframe.operators.boosting import Setting
    from tideframe.operators.profile import best_against_canonical

    spec, params = PanelSpec(), Setting(depth=2, rate=0.2, trees=3)
    data, names = trees.tabular_features(line(spark, 330), spec, "y", ["z"], [1, 2], (1, 5))
    data = data.cache()
    raw = line(spark, 330).toPandas()
    row = data.orderBy("date").first()
    at = raw.index[raw["date"] == row["date"]][0]
    assert row["target_h5"] == pytest.approx(raw["y"][at + 5] - raw["y"][at]) and row["d_y_lag1"] == pytest.approx(raw["y"][at - 1] - raw["y"][at - 2])
    out = trees.walk_forward(data, names, spec, "y", (1, 5), 150, 2, params).toPandas()
    again = trees.walk_forward(data, names, spec, "y", (1, 5), 150, 2, params).toPandas()
    key = ["horizon", "origin_date"]
    np.testing.assert_allclose(out.sort_values(key)["pred"], again.sort_values(key)["pred"])
    assert len(out) == 2 * (data.count() - 150) and (out["hi95"] >= out["hi90"]).all() and out["actual"].notna().all()
    mixed = data.unionByName(data.orderBy("date").limit(60).withColumn("series", F.lit("short")))
    told = trees.walk_forward(mixed, names, spec, "y", (1, 5), 150, 2, params)
    assert {(r.horizon, r.fit_ok, "too few" in r.reason) for r in told.filter("series = 'short'").collect()} == {(1, False, True), (5, False, True)}
    assert told.filter("series = 's' and fit_ok").count() == len(out)
    ranked = trees.search(data, names, spec, (1,), 140, [params, Setting(depth=1, rate=0.2, trees=3)], (1, 2), params).toPandas()
    assert sorted(ranked["rank"]) == [1, 2] and (ranked["n_seeds"] == 1).all() and (ranked["std_score"] == 0).all()
    best = best_against_canonical(trees.search(data, names, spec, (1,), 140, [params], (1,), params)).first()
    assert best["canonical_rank"] == 1 and not best["is_new_best"] and best["relative_gain_pct"] == 0
    rows, fitted = trees.whole_sample(data, names, spec, (1,), params)
    imp = trees.permutation_importance(rows, fitted, names, spec, (1,)).toPandas().set_index("feature")
    split = trees.split_importance(fitted, names, (1,)).toPandas().set_index("feature")
    unused = split.index[split["importance"] == 0]
    assert set(imp.index) == set(names) and np.allclose(imp.loc[unused, "importance"], 0)
    assert imp["importance"].max() > 0


def test_sequence_scaling_uses_training_rows_only(spark):
    from tideframe.operators.trees import sequence_dataset

    out = sequence_dataset(line(spark, 300), PanelSpec(), "y", ["z"], 10, (1,), 100, 2).toPandas()
    train = out[(out["fold"] == 0) & (out["role"] == "train")]
    steps = np.array([[list(r) for r in w] for w in train["window"]])
    np.testing.assert_allclose(steps.mean(axis=(0, 1)), 0, atol=1e-8)
    np.testing.assert_allclose(steps.std(axis=(0, 1)), 1, atol=1e-6)
    np.testing.assert_allclose(train["scaled_target_h1"].mean(), 0, atol=1e-8)
    assert len(out[(out["fold"] == 0) & (out["role"] == "val")]) == 50


def test_rank_band_and_constant_columns(spark):
    rows = [(0, 1.00, 0.02, 300, 3), (1, 1.01, 0.02, 150, 2), (2, 1.05, 0.02, 50, 1), (3, 1.20, 0.0, 10, 1)]
    df = spark.createDataFrame(rows, "config int, mean_score double, std_score double, maxIter int, maxDepth int")
    ranked = pf.rank_in_band(df, ["maxIter", "maxDepth"]).orderBy("rank").toPandas()
    assert ranked["config"].tolist() == [1, 0, 2, 3] and ranked["in_band"].tolist() == [True, True, False, False]
    flagged = pf.rank_in_band(df, ["maxIter", "maxDepth"]).withColumn("is_canonical", F.col("config") == 3)
    assert pf.best_against_canonical(flagged).first()["is_new_best"]


def test_status_rules(spark):
    live = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "source string, passed boolean")
    cached = spark.createDataFrame([("b", True), ("c", False)], "source string, passed boolean")
    status = ct.source_status(live, cached)
    assert {r["source"]: r["status"] for r in status.collect()} == {"a": "success", "b": "warning", "c": "failed"}
    assert ct.run_status(status).first()["gold"] == "skipped"
    assert ct.run_status(status.filter("source <> 'c'")).first()["status"] == "warning"


def test_silver_job_replay_and_refusal(spark, tmp_path):
    from tideframe.plans.silver import run_silver
    old, new = pull(spark, "p1", m202001=100.0, m202002=100.5), pull(spark, "p2", m202002=100.6, m202003=101.0)
    mapping = spark.createDataFrame([(D(2020, m, 1), D(2020, m, 25)) for m in (1, 2)], "reference_month date, release_date date")
    allowed = spark.createDataFrame([(D(2020, 3, 1),)], "reference_month date")
    none = allowed.limit(0)
    root = str(tmp_path / "index")
    job = lambda **kw: run_silver(spark, old, new, mapping, keys=KEYS, start="2020-01-01", end="2020-12-31", limit=1.0, root=root, **kw)
    with pytest.raises(ct.ContractError, match="mapped_or_allowed"):
        job(allowed=none, replay=False)
    assert vs.current(spark, root) == (0, {})
    assert job(allowed=allowed, replay=True).count() == 3
    assert set(vs.current(spark, root)[1]) == {"silver"}
    job(allowed=allowed, replay=False)
    assert vs.read_version(spark, root, "archive").count() == 3


def test_versions_change_all_tables_or_none(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "v")
    assert vs.commit(spark, root, {"a": spark.range(2), "b": spark.range(3)}) == 1
    # A job that dies between its tables, and one whose manifest is torn, leave the old pair.
    real = vs.publish
    monkeypatch.setattr(vs, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        vs.commit(spark, root, {"a": spark.range(20), "b": spark.range(30)})
    monkeypatch.setattr(vs, "publish", real)
    (tmp_path / "v" / "versions" / "0000000002.json").write_text('{"tables": {"a": "x')
    sizes = lambda **kw: {n: vs.read_version(spark, root, n, **kw).count() for n in "ab"}
    assert sizes() == {"a": 2, "b": 3} and vs.current(spark, root)[0] == 1
    assert vs.commit(spark, root, {"b": spark.range(7)}) == 3 and sizes() == {"a": 2, "b": 7} and sizes(version=1) == {"a": 2, "b": 3}
    assert vs.read_version(spark, root, "c", "x long").count() == 0
    with pytest.raises(FileNotFoundError):
        vs.read_version(spark, root, "c")
    monkeypatch.setattr(vs, "_versions", lambda *a: [2, 1])
    with pytest.raises(vs.ConcurrentCommit):
        vs.commit(spark, root, {"a": spark.range(1)})
    monkeypatch.undo()
    assert len(vs.forget(spark, root)) == 4 and sizes() == {"a": 2, "b": 7}


def test_digests_and_data_files(spark, tmp_path):
    import hashlib

    from tideframe.sources import digests as dg
    from tideframe.sources.tables import manifest

    folder = tmp_path / "many files"
    folder.mkdir()
    raw = {"a.bin": b"x" * (9 << 20), "b.bin": b"", "_SUCCESS": b"no"}
    for name, content in raw.items():
        (folder / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[-1]: (r.bytes, r.sha256) for r in dg.file_digests(spark, dg.data_files(spark, str(folder))).collect()}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in raw.items() if n != "_SUCCESS"}
    table = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 1, 5),)], "day date")
    rows = manifest(spark, {"one": str(folder / "a.bin"), "other": str(folder / "b*")}, {"one": (table, "day")}).collect()
    assert {(r.input, r.bytes, r.n_rows, r.last_date) for r in rows} == {("one", 9 << 20, 2, D(2020, 1, 5)), ("other", 0, None, None)}
