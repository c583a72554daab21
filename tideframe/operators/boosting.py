"""Boosted trees in lockstep: many models grow together over rows that are binned once.

A row holds the bins of its features, its targets and, per model, whether it trains that model, is scored by it or
neither. At each level of each tree the tasks sum gradients per (model, node, feature, bin); the sums decide every split of
all models at once, so the number of jobs follows trees and depth, not models or rows. A model whose training and scored rows
stay below ``TASK_ROWS`` is grown in one task by the same steps, which saves a job per level.
Loss is the squared error; leaves carry an L1 and an L2 penalty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.scalars import is_finite
from tideframe.session import stored

TRAIN, SCORE = 1, 2
#: Rows of one model that a single task may hold; with more rows all models grow level by level.
TASK_ROWS = 100_000
#: Trees after which the predictions of all rows are written down.
KEPT_TREES = 25
BINS = 64
TREES = "model int, tree int, feature array<int>, cut array<int>, value array<double>, cover array<double>, gain array<double>"


@dataclass(frozen=True)
class Setting:
    """How one model grows: on target ``target`` of the rows that ``use[mark]`` names. ``rows`` and ``columns`` are the shares
    drawn for each tree, ``least`` the fewest rows of a leaf."""

    target: int = 0
    mark: int = 0
    trees: int = 150
    depth: int = 3
    rate: float = 0.03
    rows: float = 1.0
    columns: float = 1.0
    least: float = 1.0
    l2: float = 1.0
    l1: float = 0.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: the children of i are 2i + 1 (bin at most ``cut``) and 2i + 2; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n))

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node each row has reached."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(int(math.log2(len(self.value) + 1)) - 1):
            feature = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(feature, 0)] > self.cut[at]
            at = np.where(feature >= 0, 2 * at + 1 + right, at)
        return at


# ---- one step, on arrays ----------------------------------------------------


def drawn_rows(number: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Which rows a tree sees: a hash of the row's number, so that every task draws the same."""
    if share >= 1.0:
        return np.ones(len(number), bool)
    h = number.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xC2B2AE3D27D4EB4F) % 2**64)
    for shift in (31, 29):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def drawn_columns(n: int, share: float, seed: int, tree: int) -> np.ndarray:
    """Which features a tree may split on, at least one."""
    chosen = np.zeros(n, bool)
    chosen[np.random.default_rng([abs(seed), tree]).permutation(n)[: max(1, round(share * n))]] = True
    return chosen


def histogram(bins: np.ndarray, residual: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """(nodes, features, bins, 2): sums of residuals and numbers of rows."""
    width = bins.shape[1]
    cell = ((node[:, None] * width + np.arange(width)) * BINS + bins).ravel()
    shape = (nodes, width, BINS)
    sums = np.bincount(cell, np.repeat(residual, width), nodes * width * BINS).reshape(shape)
    return np.stack([sums, np.bincount(cell, minlength=nodes * width * BINS).reshape(shape)], axis=3)


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(sums: np.ndarray, columns: np.ndarray, s: Setting) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """(feature, cut, gain, sums of the left and of the right side) of one node; feature -1 where no split gains.

    Of equal gains the first feature and smallest cut count.
    """
    left = sums.cumsum(1)
    whole = left[0, -1]
    right = whole - left
    score = lambda x: _shrunk(x[..., 0], s.l1) ** 2 / (x[..., 1] + s.l2 + 1e-300)
    gain = (score(left) + score(right) - score(whole)) / 2
    gain[(left[..., 1] < max(s.least, 1)) | (right[..., 1] < max(s.least, 1)) | ~columns[:, None]] = -np.inf
    best = int(np.argmax(np.round(gain, 10)))
    feature, cut = divmod(best, sums.shape[1])
    if not gain[feature, cut] > 1e-10:
        return -1, 0, 0.0, whole, whole
    return feature, cut, float(gain[feature, cut]), left[feature, cut], right[feature, cut]


def apply_splits(tree: Tree, level: int, splits: dict[int, tuple], s: Setting) -> None:
    """Write the splits of one level and the values of the nodes below."""
    first = 2**level - 1
    for place, (feature, cut, gain, left, right) in splits.items():
        i = first + place
        if level == 0:
            whole = left + right if feature >= 0 else left
            tree.value[0], tree.cover[0] = s.rate * _shrunk(whole[0], s.l1) / (whole[1] + s.l2 + 1e-300), whole[1]
        if feature < 0:
            continue
        tree.feature[i], tree.cut[i], tree.gain[i] = feature, cut, gain
        for child, side in ((2 * i + 1, left), (2 * i + 2, right)):
            tree.value[child] = s.rate * _shrunk(side[0], s.l1) / (side[1] + s.l2 + 1e-300)
            tree.cover[child] = side[1]


def _level_rows(tree: Tree, level: int, bins: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a tree's sample that stand at a node of this level, and which."""
    at = tree.place(bins) - (2**level - 1)
    rows = np.flatnonzero(drawn & (at >= 0))
    return rows, at[rows]


def grow(bins: np.ndarray, y: np.ndarray, number: np.ndarray, s: Setting) -> list[Tree]:
    """A model from arrays; its first tree is the mean of the targets."""
    base = Tree.empty(0)
    base.value[0], base.cover[0] = (y.mean() if len(y) else 0.0), len(y)
    trees, pred = [base], np.full(len(y), base.value[0])
    for t in range(s.trees):
        tree, drawn, columns = Tree.empty(s.depth), drawn_rows(number, s.rows, s.seed, t), drawn_columns(bins.shape[1], s.columns, s.seed, t)
        for level in range(s.depth):
            rows, node = _level_rows(tree, level, bins, drawn)
            if not len(rows):
                break
            sums = histogram(bins[rows], y[rows] - pred[rows], node, 2**level)
            splits = {n: best_split(sums[n], columns, s) for n in np.unique(node).tolist()}
            apply_splits(tree, level, splits, s)
            if all(x[0] < 0 for x in splits.values()):
                break
        trees.append(tree)
        pred += tree.value[tree.place(bins)]
    return trees


def predict(trees: Sequence[Tree], bins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bins))
    for tree in trees:
        out += tree.value[tree.place(bins)]
    return out


# ---- bins ---------------------------------------------------------------------


def cut_points(df: DataFrame, names: Sequence[str]) -> list[list[float]]:
    """Up to ``BINS`` - 1 quantiles per feature, in one aggregate of mergeable sketches."""
    at = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    row = df.agg(*[F.percentile_approx(F.col(n).cast("double"), at, F.lit(10000)).alias(n) for n in names]).first()
    return [sorted(set(row[n] or [])) for n in names]


def binned(df: DataFrame, names: Sequence[str], cuts: Sequence[Sequence[float]]) -> DataFrame:
    """Adds ``bins``, one byte per feature: how many of its cut points lie below the value. A missing value is in bin 0."""
    edges = [np.asarray(c, float) for c in cuts]
    if any(len(e) >= BINS for e in edges):
        raise ValueError(f"at most {BINS - 1} cut points per feature")
    schema = T.StructType([*df.schema.fields, T.StructField("bins", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.where(np.isnan(x), 0, np.searchsorted(e, x, "left")) for n, e in zip(names, edges)
                       for x in [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False)]]
            bins = np.stack(columns, axis=1).astype(np.uint8) if columns else np.zeros((batch.num_rows, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, _bytes(bins)], names=[*batch.schema.names, "bins"])

    return df.mapInArrow(run, schema)


def marks(uses: Sequence[tuple[Column, Column]]) -> Column:
    """The column ``use`` from (trains it, is scored by it) conditions; a condition that is null does not hold."""
    return F.array(*[F.when(t, TRAIN).when(s, SCORE).otherwise(0).cast("tinyint") for t, s in uses])


# ---- fits ---------------------------------------------------------------------


def _matrix(column) -> np.ndarray:
    """Bytes of equal length, or lists of equal length, as a matrix, read from Arrow's buffers; nulls in lists are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    rows = len(column)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        wide = pa.types.is_large_binary(column.type)
        ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + rows + 1]
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and rows else np.zeros(0, np.uint8)
        return data.reshape(rows, len(data) // rows if rows else 0)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(rows, len(values) // rows if rows else 0)


def _bytes(matrix: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows, width = matrix.shape
    ends = np.arange(rows + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(matrix, np.uint8).tobytes())])


def _lists(matrix: np.ndarray) -> pa.Array:
    """Rows of numbers as a column of lists."""
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(width)), pa.array(matrix.ravel()))


def _as_rows(model: int, trees: Sequence[Tree]) -> list[tuple]:
    return [(model, i, *[x.tolist() for x in (t.feature, t.cut, t.value, t.cover, t.gain)]) for i, t in enumerate(trees)]


def _arrow(rows: list[tuple]) -> pa.Table:
    names = [c.strip().split(" ")[0] for c in TREES.split(",")]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 3]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def fit_trees(rows: DataFrame, settings: Sequence[Setting]) -> DataFrame:
    """``model, tree, feature, cut, value, cover, gain``: the trees of all models, one row each; tree 0 is the mean.

    ``rows`` holds ``bins``, ``targets`` (an array), ``use`` (array of marks) and ``number`` (a long that names the row in
    the draws). Rows whose target is null or not finite train no model. A model without training rows has no tree in one
    task and a mean of 0 in lockstep; both predict 0.
    """
    rows = stored(rows.select("bins", "targets", "use", "number").filter(F.array_contains("use", F.lit(TRAIN).cast("tinyint"))), "training")
    return stored(_fit_in_tasks(rows, settings), "trees") if rows.count() <= TASK_ROWS else _fit_in_lockstep(rows, settings)


def _of_models(settings: Sequence[Setting], models: Sequence[int]) -> Column:
    """One row per model with its target and mark; a list of the plan's own."""
    return F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(settings[m].target).alias("target"), F.lit(settings[m].mark).alias("mark")) for m in models])).alias("m")


def _fit_in_tasks(rows: DataFrame, settings: Sequence[Setting]) -> DataFrame:
    """One model per group; a group has ``TASK_ROWS`` rows at most."""
    dealt = rows.select("*", _of_models(settings, range(len(settings)))).filter(F.get("use", F.col("m.mark")) == TRAIN).select(
        F.col("m.model").alias("model"), "bins", "number", F.get("targets", F.col("m.target")).alias("y"))

    def run(group: pa.Table) -> pa.Table:
        model, number = group.column("model")[0].as_py(), group.column("number").to_numpy()
        y = group.column("y").to_numpy(zero_copy_only=False).astype(float)
        own = np.argsort(number, kind="stable")
        own = own[np.isfinite(y[own])]
        return _arrow(_as_rows(model, grow(_matrix(group.column("bins"))[own], y[own], number[own], settings[model])))

    # As many tasks as models: a fit costs far more than its bytes tell.
    return dealt.repartition(max(len(settings), rows.sparkSession.sparkContext.defaultParallelism), "model").groupBy("model").applyInArrow(run, TREES)


def _fit_in_lockstep(rows: DataFrame, settings: Sequence[Setting]) -> DataFrame:
    """All models grow level by level: one aggregate of histograms per level."""
    spark = rows.sparkSession
    own = [F.when((F.get("use", F.lit(s.mark)) == TRAIN) & is_finite(F.get("targets", F.lit(s.target))), F.get("targets", F.lit(s.target))) for s in settings]
    means = rows.agg(*[c for m, y in enumerate(own) for c in (F.avg(y).alias(f"m{m}"), F.count(y).alias(f"n{m}"))]).first()
    made: list[list[Tree]] = []
    for m in range(len(settings)):
        base = Tree.empty(0)
        base.value[0], base.cover[0] = means[f"m{m}"] or 0.0, means[f"n{m}"]
        made.append([base])
    # Until the first trees are written down a prediction is its model's mean, which needs no second copy of the rows.
    state = rows.withColumn("pred", F.array(*[F.lit(float(t[0].value[0])) for t in made]))
    recent: list[list[Tree]] = [[] for _ in settings]
    width = len(rows.select("bins").first()["bins"])
    for t in range(max(s.trees for s in settings)):
        live = [m for m, s in enumerate(settings) if t < s.trees]
        growing = {m: Tree.empty(settings[m].depth) for m in live}
        columns = {m: drawn_columns(width, settings[m].columns, settings[m].seed, t) for m in live}
        open_ = set(live)
        for level in range(max(settings[m].depth for m in live)):
            open_ = {m for m in open_ if level < settings[m].depth}
            if not open_:
                break
            found = _splits(state, settings, sorted(open_), growing, recent, columns, t, level, width)
            for m in list(open_):
                own = found.get(m, {})
                apply_splits(growing[m], level, own, settings[m])
                if all(x[0] < 0 for x in own.values()):
                    open_.discard(m)
        for m in live:
            made[m].append(growing[m])
            recent[m].append(growing[m])
        if t % KEPT_TREES == KEPT_TREES - 1:
            state, recent = stored(_advanced(state, recent), "boosting"), [[] for _ in settings]
    return stored(spark.createDataFrame([r for m, trees in enumerate(made) for r in _as_rows(m, trees)], TREES), "trees")


def _advanced(state: DataFrame, recent: Sequence[Sequence[Tree]]) -> DataFrame:
    """The rows with predictions that include the recent trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _matrix(batch.column("bins"))
            pred = _matrix(batch.column("pred")).astype(float)
            for m, trees in enumerate(recent):
                pred[:, m] += predict(trees, bins)
            at = batch.schema.get_field_index("pred")
            yield batch.set_column(at, "pred", _lists(pred))

    return state.mapInArrow(run, state.schema)


def _splits(state: DataFrame, settings, live, growing, recent, columns, t: int, level: int, width: int) -> dict[int, dict[int, tuple]]:
    """The best split of every node of one level of all live models, from one aggregate over the rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, use = _matrix(batch.column("bins")), _matrix(batch.column("use"))
            pred, targets, number = _matrix(batch.column("pred")), _matrix(batch.column("targets")), batch.column("number").to_numpy()
            for m in live:
                s = settings[m]
                own = np.flatnonzero(use[:, s.mark] == TRAIN)
                y = targets[own, s.target].astype(float)
                own, y = own[np.isfinite(y)], y[np.isfinite(y)]
                rows, node = _level_rows(growing[m], level, bins[own], drawn_rows(number[own], s.rows, s.seed, t))
                if len(rows):
                    at = own[rows]
                    sums = histogram(bins[at], y[rows] - pred[at, m] - predict(recent[m], bins[at]), node, 2**level)
                    total[m] = total[m] + sums if m in total else sums
        for m, sums in total.items():
            node, cell = np.nonzero(sums[..., 1].reshape(2**level, -1))
            held = sums.reshape(2**level, -1, 2)[node, cell]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(node), m, np.int32)), pa.array(node.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(held[:, 0]), pa.array(held[:, 1])],
                names=["model", "node", "cell", "g", "n"])

    def choose(group: pa.Table) -> pa.Table:
        m, node = group.column("model")[0].as_py(), group.column("node")[0].as_py()
        sums = np.zeros((width * BINS, 2))
        sums[group.column("cell").to_numpy()] = np.stack([group.column("g").to_numpy(), group.column("n").to_numpy()], axis=1)
        feature, cut, gain, left, right = best_split(sums.reshape(width, BINS, 2), columns[m], settings[m])
        return pa.table({"model": pa.array([m], pa.int32()), "node": pa.array([node], pa.int32()), "split": pa.array([[float(feature), float(cut), gain, *left.tolist(), *right.tolist()]])})

    cells = state.mapInArrow(partial, "model int, node int, cell int, g double, n double").groupBy("model", "node", "cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    out: dict[int, dict[int, tuple]] = {}
    # One row per open node of the models that the caller names.
    for r in cells.groupBy("model", "node").applyInArrow(choose, "model int, node int, split array<double>").collect():
        feature, cut, gain, *sums = r["split"]
        out.setdefault(r["model"], {})[r["node"]] = (int(feature), int(cut), gain, np.asarray(sums[:2]), np.asarray(sums[2:]))
    return out


def load_trees(fitted: DataFrame, models: Sequence[int]) -> dict[int, list[Tree]]:
    """The trees of a few models; their size follows the settings, not the data."""
    table = fitted.filter(F.col("model").isin(list(models))).orderBy("model", "tree").toArrow()
    model = table.column("model").to_numpy()
    return {m: _as_trees(table.filter(pa.array(model == m))) for m in models}


def scores(rows: DataFrame, fitted: DataFrame, settings: Sequence[Setting], models: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, ``model``, ``pred`` of each row for each of ``models`` that scores it. Rows meet the trees of their model
    in parts of ``TASK_ROWS``; the trees never pass through the driver."""
    chosen = rows.select(*keep, "bins", "number", _of_models(settings, models), "use").filter(F.get("use", F.col("m.mark")) == SCORE)
    parts = -(-rows.count() // TASK_ROWS) or 1
    dealt = chosen.select(F.col("m.model").alias("model"), F.pmod("number", F.lit(parts)).cast("int").alias("_part"), *keep, "bins")
    forest = fitted.filter(F.col("model").isin(list(models))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = T.StructType([*dealt.drop("_part", "bins").schema.fields, T.StructField("pred", T.DoubleType())])

    def run(own: pa.Table, trees: pa.Table) -> pa.Table:
        pred = predict(_as_trees(trees.sort_by("tree")), _matrix(own.column("bins"))) if own.num_rows else np.zeros(0)
        return own.drop_columns(["_part", "bins"]).append_column("pred", pa.array(pred, pa.float64()))

    return dealt.groupBy("model", "_part").cogroup(forest.groupBy("model", "_part")).applyInArrow(lambda a, b: run(a, b), schema)


def _as_trees(table: pa.Table) -> list[Tree]:
    columns = [table.column(c).to_pylist() for c in ("feature", "cut", "value", "cover", "gain")]
    return [Tree(np.asarray(f), np.asarray(c), *[np.asarray(x, float) for x in rest]) for f, c, *rest in zip(*columns)]


# ---- attribution ----------------------------------------------------------------


def paths(tree: Tree) -> list[tuple[float, list[tuple[int, float, list[tuple[int, bool]]]]]]:
    """Per leaf: its value and, per feature on the way, the share of training rows that go on and the tests passed."""
    out = []

    def walk(i: int, met: dict[int, tuple[float, list]]) -> None:
        if tree.feature[i] < 0:
            out.append((float(tree.value[i]), [(f, share, tests) for f, (share, tests) in met.items()]))
            return
        f = int(tree.feature[i])
        for child, right in ((2 * i + 1, False), (2 * i + 2, True)):
            share, tests = met.get(f, (1.0, []))
            walk(child, {**met, f: (share * float(tree.cover[child] / tree.cover[i]), [*tests, (int(tree.cut[i]), right)])})

    walk(0, {})
    return out


def shapley(trees: Sequence[Tree], bins: np.ndarray) -> tuple[np.ndarray, float]:
    """Exact Shapley values (rows by features) and the base, where an absent feature follows the shares of training rows.

    A leaf pays the product over its path's features of 1 or 0 (present: does the row pass?) or of the share that goes on
    (absent), so only the subsets of the few features on one path matter.
    """
    out, base = np.zeros(bins.shape), 0.0
    for tree in trees:
        for value, met in paths(tree):
            base += value * math.prod(share for _, share, _ in met)
            passed = [np.logical_and.reduce([(bins[:, f] > cut) == right for cut, right in tests]).astype(float) for f, _, tests in met]
            d = len(met)
            for i, (f, share, _) in enumerate(met):
                rest = [j for j in range(d) if j != i]
                weight = np.zeros(len(bins))
                for size in range(d):
                    factor = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                    for present in combinations(rest, size):
                        term = np.full(len(bins), factor * math.prod(met[j][1] for j in rest if j not in present))
                        for j in present:
                            term *= passed[j]
                        weight += term
                out[:, f] += value * weight * (passed[i] - share)
    return out, base


def attributions(rows: DataFrame, fitted: DataFrame, models: Sequence[int], names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long table: ``keep`` columns, ``model, feature, attribution, base``; a row's attributions sum to its prediction minus base."""
    forest = load_trees(fitted, models)
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("model", T.IntegerType()), T.StructField("feature", T.StringType()), T.StructField("attribution", T.DoubleType()), T.StructField("base", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                bins, n = _matrix(batch.column("bins")), batch.num_rows
                own = batch.select(list(keep)).take(pa.array(np.repeat(np.arange(n), len(names))))
                for m, trees in forest.items():
                    values, base = shapley(trees, bins)
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array(np.full(n * len(names), m, np.int32)), pa.array(list(names) * n), pa.array(values.ravel()), pa.array(np.full(n * len(names), base))],
                        names=[*keep, "model", "feature", "attribution", "base"])

    return rows.select(*keep, "bins").mapInArrow(run, schema)


def split_gains(fitted: DataFrame, names: Sequence[str]) -> DataFrame:
    """``model, feature, importance``: each feature's share of all gains of its model; a feature that is never split on has 0."""
    cells = fitted.select("model", F.explode(F.arrays_zip("feature", "gain")).alias("s")).filter("s.feature >= 0").groupBy("model", "s.feature").agg(F.sum("s.gain").alias("gain"))
    whole = fitted.select("model").distinct().select("model", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("feature", "name"))
    sums = cells.groupBy("model").agg(F.sum("gain").alias("all"))
    out = whole.join(cells, ["model", "feature"], "left").join(sums, "model", "left")
    return out.select("model", F.col("name").alias("feature"), F.coalesce(F.col("gain") / F.nullif("all", F.lit(0.0)), F.lit(0.0)).alias("importance"))

