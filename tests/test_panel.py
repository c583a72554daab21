"""Blocked windows give what plain windows give, also when one series dominates."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideframe.operators import features as ft
from tideframe.operators.align import asof_release, fill_forward, join_one_to_one
from tideframe.panel import PanelSpec, Running, framed, keep_one, running, with_position

PLAIN = PanelSpec(keys=("k",), time="ts")
BLOCKED = replace(PLAIN, grain="hour", block_rows=40)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    start = dt.datetime(2024, 1, 1)
    out = []
    for key, n in (("hot", 700), ("cold", 9), ("mid", 120)):
        seconds = np.sort(rng.choice(400_000, n, replace=False))
        for s in seconds:
            x = None if rng.random() < 0.3 else float(rng.normal())
            out.append((key, start + dt.timedelta(seconds=int(s)), x))
    return spark.createDataFrame(pd.DataFrame(out, columns=["k", "ts", "x"]).astype({"x": object}).where(lambda d: d.notna(), None),
                                 "k string, ts timestamp, x double").repartition(5).cache()


def same(a, b):
    key = ["k", "ts"]
    cols = a.columns
    left = a.select(*cols).toPandas().sort_values(key).reset_index(drop=True)
    right = b.select(*cols).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(left, right, check_exact=False, rtol=1e-9, atol=1e-12)


def test_position(rows):
    same(with_position(rows, PLAIN), with_position(rows, BLOCKED))


def test_bounded_frames(rows):
    items = [
        ft.difference("x"), ft.lagged(["x"], [1, 7]), ft.rolling("x", 5, "std", "vol"), ft.rolling("x", 20, "sum", "mom"),
        ft.forward_sum("x", [1, 5]), ft.forward_value("x", [3], "ahead"), ft.sequence_window(["x"], 4, "seq")]
    drop_seq = lambda df: df.withColumn("seq", F.to_json("seq"))
    same(drop_seq(framed(rows, PLAIN, *items)), drop_seq(framed(rows, BLOCKED, *items)))


def test_bounded_fill_against_pandas(rows):
    got = framed(rows, BLOCKED, ft.bounded_fill(["x"], 2)).toPandas().sort_values(["k", "ts"])
    raw = rows.toPandas().sort_values(["k", "ts"])
    want = raw.groupby("k")["x"].ffill(limit=2)
    np.testing.assert_allclose(got["x"].to_numpy(float), want.to_numpy(float))


def test_rolling_against_pandas(rows):
    dense = rows.fillna(0.5)
    got = framed(dense, PLAIN, ft.rolling("x", 5, "std", "vol"), ft.rolling("x", 5, "sum", "mom")).toPandas().sort_values(["k", "ts"])
    raw = dense.toPandas().sort_values(["k", "ts"])
    shifted = raw.groupby("k")["x"].shift(1)
    np.testing.assert_allclose(got["vol"].to_numpy(float), shifted.groupby(raw["k"]).rolling(5).std().to_numpy()[np.argsort(np.argsort(raw["k"].to_numpy(), kind="stable"), kind="stable")], rtol=1e-9)


def test_running(rows):
    items = [Running(k, "x", k) for k in ("sum", "count", "mean", "last")]
    items = [replace(i, alias=f"r_{i.kind}") for i in items]
    same(running(rows, PLAIN, *items), running(rows, BLOCKED, *items))


def test_fill_and_trim(rows):
    same(fill_forward(rows, PLAIN, ["x"]), fill_forward(rows, BLOCKED, ["x"]))
    same(ft.trim_edges(rows, PLAIN, 5, 3), ft.trim_edges(rows, BLOCKED, 5, 3))


def test_frame_wider_than_block(rows):
    with pytest.raises(ValueError):
        framed(rows, replace(BLOCKED, block_rows=3), ft.lagged(["x"], [5]))


def test_lags_look_back_only():
    with pytest.raises(ValueError):
        ft.lagged(["x"], [0, 1])


def test_asof_paths_agree(spark, rows):
    releases = spark.createDataFrame(
        [("hot", dt.datetime(2023, 12, 31), 1.0), ("hot", dt.datetime(2024, 1, 2), 2.0), ("hot", dt.datetime(2024, 1, 3), None),
         ("mid", dt.datetime(2024, 1, 1), 5.0), ("cold", dt.datetime(2024, 1, 2, 12), 7.0)], "k string, known timestamp, v double")
    for carry in (False, True):
        a = asof_release(rows, releases, PLAIN, "known", ["v"], carry_in=carry)
        b = asof_release(rows, releases, BLOCKED, "known", ["v"], carry_in=carry)
        same(a, b)
    carried = asof_release(rows, releases, PLAIN, "known", ["v"], carry_in=True).toPandas().sort_values("ts")
    plain = asof_release(rows, releases, PLAIN, "known", ["v"]).toPandas().sort_values("ts")
    hot = lambda d: d[d["k"] == "hot"]["v"]
    assert hot(carried).iloc[0] == 1.0 and pd.isna(hot(plain).iloc[0])
    assert hot(plain).iloc[-1] == 2.0


def test_keep_one(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], "k string, t int, v string")
    assert {tuple(r) for r in keep_one(df, ["k"], [F.col("t")], "last").collect()} == {("a", 2, "y"), ("b", 5, "z")}
    assert {tuple(r) for r in keep_one(df, ["k"], [F.col("t")], "first").collect()} == {("a", 1, "x"), ("b", 5, "z")}


def test_one_to_one_join_refuses_duplicates(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, r string")
    with pytest.raises(Exception, match="duplicate key"):
        join_one_to_one(left, right, ["k"]).collect()
    assert join_one_to_one(left, right.limit(1), ["k"]).count() == 2


@pytest.mark.parametrize("hot", [1_000_000, 2])
def test_interval_join(spark, hot):
    from tideframe.operators.align import interval_join

    day = lambda i: None if i is None else dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rng = np.random.default_rng(3)
    points = [(k, i, day(int(rng.integers(0, 200)))) for i, k in enumerate(rng.choice(["a", "b", "x"], 120).tolist())] + [("a", 900, None), (None, 901, day(5)), ("x", 902, day(5)), ("x", 902, day(5))]
    spans = [(k, 1000 + i, *(day(int(x)) for x in sorted(rng.integers(-50, 250, 2)))) for i, k in enumerate(rng.choice(["a", "b", "y"], 40).tolist())]
    spans += [("a", 1, None, day(30)), ("a", 2, day(150), None), ("b", 3, None, None), ("b", 4, day(90), day(80)), (None, 5, day(0), day(9)), ("a", 6, day(500), day(600))]
    got = interval_join(spark.createDataFrame(points, "k string, i int, at date"), spark.createDataFrame(spans, "k string, s int, start date, stop date"), ["k"], "at", "start", "stop", 16, hot)
    want = sorted((i, s) for k, i, at in points for q, s, start, stop in spans
                  if k == q and at is not None and (start is None or at >= start) and (stop is None or at <= stop) and not (start and stop and start > stop))
    assert sorted((r.i, r.s) for r in got.collect()) == want and got.columns == ["k", "i", "at", "s", "start", "stop"]


def test_interval_join_moves_each_side_once(spark):
    from tideframe.operators.align import interval_join

    points = spark.range(40).selectExpr("id % 3 AS k", "id AS i", "date_add(DATE '2020-01-01', int(id)) AS at")
    spans = spark.range(9).selectExpr("id % 3 AS k", "id AS s", "date_add(DATE '2020-01-01', int(3 * id)) AS start", "date_add(DATE '2020-01-01', int(5 * id)) AS stop")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = interval_join(points, spans, ["k"], "at", "start", "stop")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_one_to_one_join_keeps_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(None, 2.0), (3, 3.0), (4, 4.0)], "k int, w double")
    assert {tuple(r) for r in join_one_to_one(left, right, ["k"]).collect()} == {(1, "a", None), (None, "b", 2.0), (3, "c", 3.0)}
