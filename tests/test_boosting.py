"""Boosted trees: a plain restatement, the lockstep form, exact Shapley values by subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.operators import boosting as bo

NAMES = ["a", "b", "c", "d"]


def sample(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 6, n), rng.integers(0, 4, n), rng.integers(0, 9, n), rng.integers(0, 2, n)]).astype(np.uint8)
    y = 2.0 * (x[:, 0] > 2) - 1.5 * (x[:, 1] > 1) * (x[:, 2] > 4) + rng.normal(size=n) * 0.3
    return x, y


def plain_tree(x, residual, s, depth):
    """One tree by trying every cut of every node on the rows themselves; nested (feature, cut, left, right) or a value."""
    score = lambda r: max(abs(r.sum()) - s.l1, 0.0) ** 2 / (len(r) + s.l2)
    leaf = s.rate * np.sign(residual.sum()) * max(abs(residual.sum()) - s.l1, 0.0) / (len(residual) + s.l2)
    best = None
    if depth:
        for f in range(x.shape[1]):
            for cut in range(bo.BINS):
                left = x[:, f] <= cut
                if left.sum() < max(s.least, 1) or (~left).sum() < max(s.least, 1):
                    continue
                gain = round((score(residual[left]) + score(residual[~left]) - score(residual)) / 2, 10)
                if gain > 1e-10 and (best is None or gain > best[0]):
                    best = (gain, f, cut, left)
    if best is None:
        return leaf
    _, f, cut, left = best
    return f, cut, plain_tree(x[left], residual[left], s, depth - 1), plain_tree(x[~left], residual[~left], s, depth - 1)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("s", [bo.Setting(trees=6, depth=3, rate=0.3, l2=1.0), bo.Setting(trees=4, depth=2, rate=0.5, l2=0.0, l1=3.0, least=20.0)])
def test_equals_plain_boosting(s):
    x, y = sample()
    pred = np.full(len(y), y.mean())
    for _ in range(s.trees):
        tree = plain_tree(x, y - pred, s, s.depth)
        pred = pred + [plain_value(tree, r) for r in x]
    got = bo.predict(bo.grow(x, y, np.arange(len(y)), s), x)
    np.testing.assert_allclose(got, pred, atol=1e-9)
    assert np.var(y - got) < 0.7 * np.var(y)


def frame(spark, x, y):
    rows = [(i, bytes(r), [float(v), float(-v) if i % 7 else None], [1 if i % 5 else 2, 2 if i % 3 else 1]) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "number long, bins binary, targets array<double>, use array<tinyint>").repartition(3)


def test_lockstep_gives_the_same_trees(spark, monkeypatch):
    x, y = sample()
    settings = [bo.Setting(trees=4, depth=2, rate=0.3, rows=0.7, columns=0.6), bo.Setting(target=1, mark=1, trees=3, depth=3, rate=0.2, seed=5)]
    rows = frame(spark, x, y)
    in_tasks = bo.fit_trees(rows, settings)
    monkeypatch.setattr(bo, "TASK_ROWS", 50)
    monkeypatch.setattr(bo, "KEPT_TREES", 2)
    in_steps = bo.fit_trees(rows, settings)
    one, two = (bo.load_trees(f, [0, 1]) for f in (in_tasks, in_steps))
    for m in (0, 1):
        assert len(one[m]) == len(two[m]) == settings[m].trees + 1
        for a, b in zip(one[m], two[m]):
            assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist()
            np.testing.assert_allclose(a.value, b.value, atol=1e-9)
            np.testing.assert_allclose(a.cover, b.cover)
    # Scores of rows in parts equal those of the arrays.
    found = {(r.model, r.number): r.pred for r in bo.scores(rows, in_steps, settings, [0, 1], ["number"]).collect()}
    assert set(found) == {(0, i) for i in range(len(y)) if i % 5 == 0} | {(1, i) for i in range(len(y)) if i % 3}
    for m in (0, 1):
        own = sorted(i for k, i in found if k == m)
        np.testing.assert_allclose([found[m, i] for i in own], bo.predict(one[m], x[own]), atol=1e-9)


def test_rows_without_a_target_and_models_without_rows(spark):
    rows = spark.createDataFrame([(i, bytes([i % 2]), [float("nan") if i < 3 else float(i % 2)], [1, 2]) for i in range(10)], "number long, bins binary, targets array<double>, use array<tinyint>")
    settings = [bo.Setting(trees=1, depth=1, rate=1.0, l2=0.0), bo.Setting(mark=1)]
    fitted = bo.fit_trees(rows, settings)
    trees = bo.load_trees(fitted, [0, 1])
    assert trees[0][0].cover[0] == 7 and trees[1] == []
    assert {r.pred for r in bo.scores(rows, fitted, settings, [1], ["number"]).collect()} == {0.0}


def test_bins_count_the_cut_points_below(spark):
    df = spark.createDataFrame([(0.5, None), (1.0, 1.0), (1.5, float("nan")), (9.0, 2.5)], "p double, q double")
    cuts = [[1.0, 2.0], [0.0, 2.0]]
    got = [(r.p, list(r.bins)) for r in bo.binned(df, ["p", "q"], cuts).collect()]
    assert sorted(got) == [(0.5, [0, 0]), (1.0, [0, 1]), (1.5, [1, 0]), (9.0, [2, 2])]
    assert bo.cut_points(df, ["p"]) == [[0.5, 1.0, 1.5, 9.0]]


def test_shapley_values_by_subsets(spark):
    x, y = sample(80)
    trees = bo.grow(x, y, np.arange(len(y)), bo.Setting(trees=5, depth=3, rate=0.4, l2=0.5))

    def expected(tree, row, present, i=0):
        if tree.feature[i] < 0:
            return tree.value[i]
        f, (left, right) = tree.feature[i], (2 * i + 1, 2 * i + 2)
        if f in present:
            return expected(tree, row, present, left if row[f] <= tree.cut[i] else right)
        return sum(tree.cover[c] / tree.cover[i] * expected(tree, row, present, c) for c in (left, right))

    values, base = bo.shapley(trees, x)
    np.testing.assert_allclose(values.sum(1) + base, bo.predict(trees, x), atol=1e-9)
    for row, got in list(zip(x, values))[:12]:
        of = {p: sum(expected(t, row, set(p)) for t in trees) for n in range(5) for p in combinations(range(4), n)}
        for f in range(4):
            rest = [j for j in range(4) if j != f]
            want = sum(factorial(n) * factorial(3 - n) / factorial(4) * (of[tuple(sorted((*p, f)))] - of[p]) for n in range(4) for p in combinations(rest, n))
            assert got[f] == pytest.approx(want, abs=1e-9)
    rows = frame(spark, x, y)
    fitted = bo.fit_trees(rows, [bo.Setting(trees=5, depth=3)])
    long = bo.attributions(rows, fitted, [0], NAMES, ["number"])
    sums = long.groupBy("number").agg((F.sum("attribution") + F.max("base")).alias("pred")).collect()
    np.testing.assert_allclose([r.pred for r in sorted(sums, key=lambda r: r.number)], bo.predict(bo.load_trees(fitted, [0])[0], x), atol=1e-9)
    gains = bo.split_gains(fitted, NAMES).toPandas()
    assert gains["importance"].sum() == pytest.approx(1.0) and set(gains["feature"]) == set(NAMES)


def test_lockstep_writes_its_rows_once(spark, monkeypatch):
    monkeypatch.setattr(bo, "TASK_ROWS", 10)
    written, stored = [], bo.stored
    monkeypatch.setattr(bo, "stored", lambda df, label="stage": written.append(label) or stored(df, label))
    x, y = sample()
    fitted = bo.fit_trees(frame(spark, x, y), [bo.Setting(trees=2, depth=2, rate=0.3)])
    assert fitted.count() == 3 and written == ["training", "trees"]


def test_columns_become_matrices_without_objects():
    import pyarrow as pa

    lists = pa.array([[9.0, 9.0], [1.0, None], [3.0, 4.0]], pa.list_(pa.float64())).slice(1)
    np.testing.assert_array_equal(bo._matrix(lists), [[1.0, np.nan], [3.0, 4.0]])
    assert bo._matrix(pa.array([b"zz", b"ab", b"cd"]).slice(1)).tolist() == [[97, 98], [99, 100]]
    assert bo._matrix(pa.chunked_array([pa.array([b"ab"]), pa.array([b"cd"])])).tolist() == [[97, 98], [99, 100]]
    assert bo._bytes(np.array([[97, 98], [99, 100]], np.uint8)).to_pylist() == [b"ab", b"cd"]
    assert bo._lists(np.array([[1.0, 2.0], [3.0, 4.0]])).to_pylist() == [[1.0, 2.0], [3.0, 4.0]]
