"""Gradient-boosted trees pooled over the panel: walk-forward arm, search, importance, attribution.

All models of a job (folds, horizons, settings, seeds) are fitted together over rows that are binned once; roles are marks
of a row, not copies of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.operators import boosting as bo
from tideframe.operators.features import difference, forward_sum, forward_value, lagged, rolling, trim_edges
from tideframe.operators.intervals import conformal_quantiles
from tideframe.operators.profile import rank_in_band, seed_summary
from tideframe.operators.splits import fold_bounds, role_at, search_role_at
from tideframe.panel import PanelSpec, framed, series_length, with_position
from tideframe.session import stored

# The settings before any search.
CANONICAL = bo.Setting(trees=150, depth=3, rate=0.03, rows=0.8, columns=0.8, least=1.0, l2=1.0, l1=0.0)


def tabular_features(
    df: DataFrame, spec: PanelSpec, level: str, base: Sequence[str], lags: Sequence[int], horizons: Sequence[int], windows: Sequence[int] = (5, 20)
) -> tuple[DataFrame, list[str]]:
    """Causal lags, rolling deviation and momentum, cumulative forward targets and future levels.

    Warm-up rows and rows without a full target are trimmed. Returns the frame and the feature names.
    """
    target = f"d_{level}"
    d = framed(df, spec, difference(level, *base))
    changes = [f"d_{c}" for c in (level, *base)]
    items = [lagged(changes, lags)]
    names = [f"{c}_lag{k}" for c in changes for k in lags]
    for n in windows:
        items += [rolling(target, n, "sum", f"mom_{n}"), *[rolling(c, n, "std", f"vol_{c}_{n}") for c in changes]]
        names += [f"mom_{n}", *[f"vol_{c}_{n}" for c in changes]]
    items += [forward_sum(target, horizons), forward_value(level, horizons, "actual_h"), forward_value(spec.time, horizons, "target_date_h")]
    built = framed(d, spec, *items)
    kept = trim_edges(built, spec, max(*lags, *windows) + 1, max(horizons))
    return kept.na.drop("any", subset=names), names


def _numbered(spec: PanelSpec):
    return F.xxhash64(*spec.keys, spec.time).alias("number")


def walk_forward(
    data: DataFrame, names: Sequence[str], spec: PanelSpec, level: str, horizons: Sequence[int],
    min_train: int, n_folds: int, setting: bo.Setting,
) -> DataFrame:
    """Per fold and horizon: a point model on all embargoed training rows, a second model whose
    residuals on the held-out tail give the conformal band, level forecasts for the test block.

    Features are binned by quantiles of the rows before the first test block, which every fold knows. A series too short for
    the folds has one row per horizon with ``fit_ok = false`` and the reason; where too few rows calibrate a level, its band is null.
    """
    carried = [*spec.keys, spec.time, level, *[f"{s}{h}" for h in horizons for s in ("actual_h", "target_date_h")]]
    bounds = stored(fold_bounds(data, spec, min_train, n_folds, strict=False), "bounds")
    ends = bounds.filter("fold is not null").groupBy(*spec.keys).agg(*[F.max(F.when(F.col("fold") == k, F.col(c))).alias(f"{c}_{k}") for k in range(n_folds) for c in ("train_end", "test_end")])
    placed = stored(with_position(data, spec, "rn").join(ends, list(spec.keys)), "placed")
    role = lambda k, h: role_at(F.col("rn") - 1, F.col(f"train_end_{k}"), F.col(f"test_end_{k}"), F.lit(h))
    cells = [(k, h) for k in range(n_folds) for h in horizons]
    uses = [u for k, h in cells for u in (
        (role(k, h).isin("fit", "gap", "calibration"), role(k, h) == "test"), (role(k, h) == "fit", role(k, h) == "calibration"))]
    settings = [replace(setting, target=i % len(horizons), mark=2 * i + kind) for i in range(len(cells)) for kind in (0, 1)]
    cuts = bo.cut_points(placed.filter(F.col("rn") <= min_train), names)
    rows = bo.binned(placed, names, cuts).select(
        *carried, "bins", F.array(*[F.col(f"target_h{h}") for h in horizons]).alias("targets"), bo.marks(uses).alias("use"), _numbered(spec))
    rows = stored(rows, "binned")
    fitted = bo.fit_trees(rows, settings)
    found = bo.scores(rows, fitted, settings, range(len(settings)), [*carried, "targets"])
    cell = F.floor(F.col("model") / 2)
    at = (cell % len(horizons)).cast("int")
    of = lambda start: F.get(F.array(*[F.col(f"{start}{h}") for h in horizons]), at)
    found = found.withColumns({
        "fold": F.floor(cell / len(horizons)).cast("int"), "horizon": F.get(F.array(*[F.lit(h).cast("long") for h in horizons]), at), "held": F.col("model") % 2 == 1,
        "target_date": of("target_date_h"), "actual": of("actual_h"), "residual": F.get("targets", at) - F.col("pred")})
    found = stored(found, "scored")
    bands = conformal_quantiles(found.filter("held"), ["fold", "horizon"], "residual", {"q90": 0.90, "q95": 0.95}, strict=False)
    pred = F.col(level) + F.col("pred")
    made = found.filter("not held").join(bands, ["fold", "horizon"], "left").select(
        *spec.keys, F.lit("gbt").alias("model"), F.col(spec.time).alias("origin_date"), "horizon", "target_date", "actual", F.col(level).alias("naive"), pred.alias("pred"),
        (pred - F.col("q90")).alias("lo90"), (pred + F.col("q90")).alias("hi90"), (pred - F.col("q95")).alias("lo95"), (pred + F.col("q95")).alias("hi95"),
        "fold", pred.isNotNull().alias("fit_ok"), F.lit(None).cast("string").alias("reason"))
    short = bounds.filter("fold is null").withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons])))
    told = {**{c: F.col(c) for c in (*spec.keys, "horizon", "reason")}, "model": F.lit("gbt"), "fit_ok": F.lit(False)}
    return made.unionByName(short.select(*[told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in made.schema]))


def search(
    data: DataFrame, names: Sequence[str], spec: PanelSpec, horizons: Sequence[int], selection_end: int,
    configs: Sequence[bo.Setting], seeds: Sequence[int], canonical: bo.Setting,
) -> DataFrame:
    """Ranked configurations by RMSE relative to no change, averaged over horizons and seeds.

    Only rows before the first scored origin are used, split with embargoes. A configuration without randomness is fitted
    once. All fits of the search run as one job.
    """
    spark = data.sparkSession
    pool = series_length(with_position(data, spec, "rn").filter(F.col("rn") <= selection_end), spec, "_pool")
    roles = [search_role_at(F.col("rn") - 1, F.col("_pool"), F.lit(h)) for h in horizons]
    pool = stored(pool, "pool")
    rows = bo.binned(pool, names, bo.cut_points(pool, names)).select(
        "bins", F.array(*[F.col(f"target_h{h}") for h in horizons]).alias("targets"), bo.marks([(x == "inner_train", x == "inner_val") for x in roles]).alias("use"), _numbered(spec))
    rows = stored(rows, "binned")
    runs = [(i, seed, k) for i, c in enumerate(configs) for seed in (seeds[:1] if c.rows == c.columns == 1.0 else seeds) for k in range(len(horizons))]
    settings = [replace(configs[i], target=k, mark=k, seed=seed) for i, seed, k in runs]
    found = bo.scores(rows, bo.fit_trees(rows, settings), settings, range(len(settings)), ["targets"])
    named = F.get(F.array(*[F.struct(F.lit(i).alias("config"), F.lit(seed).alias("seed"), F.lit(k).alias("k")) for i, seed, k in runs]), F.col("model"))
    y = F.get("targets", F.col("run.k"))
    losses = found.withColumn("run", named).groupBy("run").agg(F.sqrt(F.avg(F.pow(y - F.col("pred"), 2))).alias("rmse"), F.sqrt(F.avg(y * y)).alias("naive_rmse"))
    relative = F.when(F.col("naive_rmse") > 0, F.col("rmse") / F.col("naive_rmse")).otherwise(1.0)
    per_seed = losses.select("run.*", relative.alias("_rel")).groupBy("config", "seed").agg(F.avg("_rel").alias("score"))
    table = spark.createDataFrame(
        [(i, c.trees, c.depth, c.rate, c == canonical) for i, c in enumerate(configs)], "config int, n_trees int, depth int, rate double, is_canonical boolean")
    return rank_in_band(seed_summary(per_seed, ["config"], "score").join(table, "config"), ["n_trees", "depth"])


def whole_sample(data: DataFrame, names: Sequence[str], spec: PanelSpec, horizons: Sequence[int], setting: bo.Setting) -> tuple[DataFrame, DataFrame]:
    """(rows, trees) of one model per horizon on all rows: a look back at what drives the forecasts, not a forecast."""
    data = stored(data, "whole")
    rows = bo.binned(data, names, bo.cut_points(data, names)).select(
        *spec.keys, spec.time, "bins", F.array(*[F.col(f"target_h{h}") for h in horizons]).alias("targets"), bo.marks([(F.lit(True), F.lit(False))]).alias("use"), _numbered(spec))
    rows = stored(rows, "binned")
    return rows, bo.fit_trees(rows, [replace(setting, target=i) for i in range(len(horizons))])


def _by_horizon(found: DataFrame, horizons: Sequence[int]) -> DataFrame:
    return found.withColumn("horizon", F.get(F.array(*[F.lit(h).cast("long") for h in horizons]), F.col("model"))).drop("model")


def attribution(rows: DataFrame, fitted: DataFrame, names: Sequence[str], spec: PanelSpec, horizons: Sequence[int]) -> DataFrame:
    """``keys, time, horizon, feature, attribution, base``: exact Shapley values of each row's forecast; they sum to it minus base."""
    return _by_horizon(bo.attributions(rows, fitted, range(len(horizons)), names, [*spec.keys, spec.time]), horizons)


def mean_attribution(attributed: DataFrame) -> DataFrame:
    """Mean absolute attribution per horizon and feature."""
    return attributed.groupBy("horizon", "feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))


def split_importance(fitted: DataFrame, names: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Importance by split gain, one row per horizon and feature."""
    return _by_horizon(bo.split_gains(fitted, names), horizons)


def permutation_importance(rows: DataFrame, fitted: DataFrame, names: Sequence[str], spec: PanelSpec, horizons: Sequence[int], seed: int = 7) -> DataFrame:
    """Rise of RMSE when one feature is shuffled within its series, all features and horizons in one pass over the rows."""
    order = Window.partitionBy(*spec.key_columns).orderBy(spec.time)
    mixed = Window.partitionBy(*spec.key_columns).orderBy(F.xxhash64(F.lit(seed), F.col(spec.time)), spec.time)
    base = rows.select(*spec.keys, "bins", "targets", F.row_number().over(order).alias("_a"), F.row_number().over(mixed).alias("_b"))
    other = base.select(*spec.keys, F.col("_b").alias("_a"), F.col("bins").alias("_other"))
    paired = base.join(other, [*spec.keys, "_a"]).select("bins", "_other", "targets")
    forest = bo.load_trees(fitted, range(len(horizons)))

    def run(batches):
        sums = np.zeros((len(horizons), len(names) + 1, 2))
        for batch in batches:
            own, theirs = (np.array([np.frombuffer(x, np.uint8) for x in batch.column(c).to_pylist()]) for c in ("bins", "_other"))
            y = np.asarray(batch.column("targets").to_pylist(), float)
            for f in range(-1, len(names)):
                tried = own.copy()
                if f >= 0:
                    tried[:, f] = theirs[:, f]
                for k, trees in forest.items():
                    missed = y[:, k] - bo.predict(trees, tried)
                    sums[k, f + 1] += (missed @ missed, len(y))
        model, feature = np.divmod(np.arange(len(horizons) * (len(names) + 1)), len(names) + 1)
        flat = sums.reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(feature.astype(np.int32) - 1), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["model", "_f", "sse", "n"])

    losses = paired.mapInArrow(run, "model int, _f int, sse double, n double").groupBy("model", "_f").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))
    whole = Window.partitionBy("model")
    out = losses.withColumn("base_rmse", F.max(F.when(F.col("_f") == -1, F.col("rmse"))).over(whole)).filter("_f >= 0")
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("_f")).alias("feature")
    return _by_horizon(out.select("model", label, "base_rmse", "rmse", (F.col("rmse") - F.col("base_rmse")).alias("importance")), horizons)


# ---- dataset of a sequence model -------------------------------------------


def sequence_dataset(
    df: DataFrame, spec: PanelSpec, level: str, features: Sequence[str], lookback: int, horizons: Sequence[int],
    min_train: int, n_folds: int, val_share: float = 0.15, val_floor: int = 50,
) -> DataFrame:
    """Windows, targets and roles per fold, scaled by statistics of the fold's training windows only.

    Roles are train, val (the tail of the training block) and test. The statistics run over
    all steps of the training windows of a series, as sums over rows that the windows share.
    """
    from tideframe.operators.features import sequence_window
    from tideframe.panel import series_length, with_position

    d = framed(df, spec, difference(level, *features)).na.drop("any")
    change = [f"d_{c}" for c in (level, *features)]
    rows = framed(d, spec, sequence_window(change, lookback), forward_sum(f"d_{level}", horizons), forward_value(level, horizons, "actual_h"))
    rows = rows.filter(F.col("window").isNotNull() & F.col(f"target_h{max(horizons)}").isNotNull())
    bounds = fold_bounds(rows, spec, min_train, n_folds)
    placed = with_position(rows, spec, "rn").withColumn("_i", F.col("rn") - 1).join(bounds, list(spec.keys)).filter(F.col("_i") < F.col("test_end"))
    held = F.greatest(F.floor(F.col("train_end") * val_share), F.lit(val_floor))
    role = F.when(F.col("_i") >= F.col("train_end"), "test").when(F.col("_i") >= F.col("train_end") - held, "val").otherwise("train")
    labelled = placed.withColumn("role", role)
    training = labelled.filter("role = 'train'")
    on = [*spec.keys, "fold"]
    targets = [f"target_h{h}" for h in horizons]
    y_stats = training.groupBy(*on).agg(*[f(t).alias(f"{s}_{t}") for t in targets for s, f in (("mean", F.avg), ("std", F.stddev_pop))])
    steps = training.select(*on, F.explode("window").alias("_row"))
    x_stats = steps.groupBy(*on).agg(
        F.array(*[F.avg(F.col("_row")[i]) for i in range(len(change))]).alias("_mean"),
        F.array(*[F.stddev_pop(F.col("_row")[i]) + 1e-8 for i in range(len(change))]).alias("_std"))
    scaled = F.transform("window", lambda row: F.zip_with(
        row, F.arrays_zip(F.col("_mean").alias("m"), F.col("_std").alias("s")), lambda x, st: (x - st["m"]) / st["s"]))
    out = labelled.join(y_stats, on).join(x_stats, on).withColumn("window", scaled)
    out = out.withColumns({f"scaled_{t}": (F.col(t) - F.col(f"mean_{t}")) / (F.col(f"std_{t}") + 1e-8) for t in targets})
    return out.select(*on, spec.time, "role", "window", *targets, *[f"scaled_{t}" for t in targets], *[f"actual_h{h}" for h in horizons])
