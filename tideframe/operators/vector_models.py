"""Vector autoregressions and error-correction models over moment matrices: walk-forward arms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.distributions import normal_quantile
from tideframe.operators.features import difference, forward_value, lag_block
from tideframe.operators.moments import expanding_solve, least_squares, vector
from tideframe.operators.splits import is_origin
from tideframe.panel import PanelSpec, Running, framed, running, series_length, with_position

Z90, Z95 = normal_quantile(0.95), normal_quantile(0.975)
FORECAST_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("origin_date", T.DateType()),
    T.StructField("horizon", T.LongType()), T.StructField("target_date", T.DateType()),
    *[T.StructField(c, T.DoubleType()) for c in ("actual", "naive", "pred", "lo90", "hi90", "lo95", "hi95")],
    T.StructField("fit_ok", T.BooleanType())])


def _forecast_rows(model: str, row: dict, horizons: Sequence[int], path=None, half=None) -> list[dict]:
    """Long rows of one origin; ``path`` holds level forecasts, ``half`` deviations, for steps 1, 2, ..."""
    out = []
    for h in horizons:
        pred = None if path is None else float(path[h - 1])
        sd = None if half is None or pred is None else float(half[h - 1])
        if sd is not None and not np.isfinite(sd):
            sd = 0.0
        band = {n: None if sd is None else pred + s * z * sd
                for n, s, z in (("lo90", -1, Z90), ("hi90", 1, Z90), ("lo95", -1, Z95), ("hi95", 1, Z95))}
        out.append({"model": model, "origin_date": row["date"], "horizon": h, "target_date": row[f"t{h}"], "actual": row[f"a{h}"],
                    "naive": row["naive"], "pred": pred, **band, "fit_ok": pred is not None})
    return out


def _origins(df: DataFrame, spec: PanelSpec, target: str, horizons: Sequence[int], min_train: int, step: int) -> DataFrame:
    """Row position, origin flag, naive level, future levels and target dates."""
    rows = series_length(with_position(df, spec, "rn"), spec, "n_rows")
    rows = framed(rows, spec, forward_value(target, horizons, "a"), forward_value(spec.time, horizons, "t"))
    return rows.withColumns({"is_origin": is_origin(min_train, step, max(horizons)), "naive": F.col(target)}).withColumnRenamed(spec.time, "date")


def responses(lags: list[np.ndarray], steps: int) -> np.ndarray:
    """Moving-average responses of a vector autoregression: identity first."""
    k = lags[0].shape[0] if lags else 0
    phi = [np.eye(k)]
    for j in range(1, steps):
        phi.append(sum((phi[j - i] @ a for i, a in enumerate(lags[:j], start=1)), np.zeros((k, k))))
    return np.stack(phi)


def level_deviation(lags: list[np.ndarray], sigma: np.ndarray, target: int, steps: int) -> np.ndarray:
    """Deviation of the level rebuilt from forecast differences, for steps 1, 2, ...

    The level error sums all step errors, so each shock enters with the running sum of
    responses; tiny negative variances from cancellation count as zero.
    """
    running_psi = np.cumsum(responses(lags, steps), axis=0) if lags else np.stack([np.eye(len(sigma))] * steps)
    per_step = np.einsum("hij,jk,hlk->hil", running_psi, sigma, running_psi)
    return np.sqrt(np.maximum(np.cumsum(per_step, axis=0)[:, target, target], 0.0))


def split_lags(coef: np.ndarray, k: int, p: int) -> list[np.ndarray]:
    """Lag matrices, nearest first, from stacked coefficients whose blocks run oldest first."""
    return [coef[(p - i) * k:(p - i + 1) * k].T for i in range(1, p + 1)]


def iterated_var(
    df: DataFrame, spec: PanelSpec, columns: Sequence[str], target: str, p: int, horizons: Sequence[int],
    min_train: int, step: int, exogenous: Sequence[str] = (), model: str = "var",
) -> DataFrame:
    """Walk-forward VAR(p) on differences, cumulated back to the level of ``target``.

    Order 0 is the drift forecast. Exogenous columns are differenced too and held at
    their expanding mean over the forecast path. Origins whose fit is singular give rows with ``fit_ok = false``.
    """
    k, e, at, top = len(columns), len(exogenous), list(columns).index(target), max(horizons)
    d = [f"d_{c}" for c in columns]
    dx = [f"d_{c}" for c in exogenous]
    rows = framed(df.select(*spec.keys, spec.time, *columns, *exogenous), spec, difference(*columns, *exogenous))
    if p:
        rows = framed(rows, spec, lag_block(d, p, "_past", shift=1), lag_block(d, p, "_now"))
    else:
        rows = rows.withColumns({c: F.array().cast("array<double>") for c in ("_past", "_now")})
    if dx:
        rows = running(rows, spec, *[Running("mean", c, f"_m_{c}") for c in dx])
    as_array = lambda cols: F.array(*[F.col(c).cast("double") for c in cols]) if cols else F.array().cast("array<double>")
    rows = rows.withColumns({
        "w": F.when(F.col("_past").isNotNull(), vector(F.array(F.lit(1.0)), as_array(dx), F.col("_past"), as_array(d))),
        "xmean": as_array([f"_m_{c}" for c in dx])})
    rows = _origins(rows, spec, target, horizons, min_train, step)

    def solve(g: np.ndarray, row: dict) -> list[dict]:
        m = 1 + e + k * p
        try:
            coef, rest = least_squares(g, m)
            if g[0, 0] <= m or row["_now"] is None:
                raise np.linalg.LinAlgError("too few rows")
        except np.linalg.LinAlgError:
            return _forecast_rows(model, row, horizons)
        lags = split_lags(coef[1 + e:], k, p)
        fixed = coef[0] + (np.asarray(row["xmean"], float) @ coef[1:1 + e] if e else 0.0)
        state = list(np.asarray(row["_now"], float).reshape(p, k))
        for _ in range(top):
            state.append(fixed + sum(a @ state[-i] for i, a in enumerate(lags, start=1)))
        path = row["naive"] + np.cumsum(np.stack(state[p:])[:, at])
        return _forecast_rows(model, row, horizons, path, level_deviation(lags, rest / (g[0, 0] - m), at, top))

    carried = ["date", "naive", "_now", "xmean", *[f"{c}{h}" for h in horizons for c in ("a", "t")]]
    return expanding_solve(rows, spec, "w", carried, solve, FORECAST_SCHEMA)


def direct_regression(
    df: DataFrame, spec: PanelSpec, columns: Sequence[str], target: str, p: int, horizons: Sequence[int],
    min_train: int, step: int, model: str = "direct",
) -> DataFrame:
    """Direct h-step regression of the level change on the same lag block, one fit per horizon.

    A training row is dated by its realised target, so no fit sees past its origin.
    """
    d = [f"d_{c}" for c in columns]
    base = framed(df.select(*spec.keys, spec.time, *columns), spec, difference(*columns))
    parts = []
    for h in horizons:
        rows = framed(base, spec, lag_block(d, p, "_then", shift=h), lag_block(d, p, "_now"), _change(target, h))
        w = F.when(F.col("_then").isNotNull(), vector(F.array(F.lit(1.0)), F.col("_then"), F.array("_gain")))
        rows = _origins(rows.withColumn("w", w), spec, target, horizons, min_train, step)

        def solve(g, row, h=h):
            m = g.shape[0] - 1
            try:
                coef, _ = least_squares(g, m)
                gain = float(np.concatenate([[1.0], row["_now"]]) @ coef[:, 0])
            except (np.linalg.LinAlgError, TypeError, ValueError):
                return _forecast_rows(model, row, [h])
            return _forecast_rows(model, row, [h], np.full(h, row["naive"] + gain))

        carried = ["date", "naive", "_now", f"a{h}", f"t{h}"]
        parts.append(expanding_solve(rows, spec, "w", carried, solve, FORECAST_SCHEMA))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _change(target: str, h: int):
    from tideframe.panel import Framed

    return Framed(h, 0, lambda w: {"_gain": F.col(target) - F.lag(target, h).over(w)})


def feature_set_comparison(
    df: DataFrame, spec: PanelSpec, base: Sequence[str], added: Sequence[str], target: str, p: int,
    horizons: Sequence[int], min_train: int, step: int,
) -> DataFrame:
    """The same arm twice, without and with the added columns, as two models of one long frame."""
    narrow = iterated_var(df, spec, base, target, p, horizons, min_train, step, model="var_narrow")
    wide = iterated_var(df, spec, [*base, *added], target, p, horizons, min_train, step, model="var_wide")
    return narrow.unionByName(wide)


# ---- ARMA by two least squares stages --------------------------------------


def _ar_residuals(df: DataFrame, spec: PanelSpec, value: str, order: int, fit_rows: int) -> DataFrame:
    """Add ``_e``: residuals of an AR fitted on the first ``fit_rows`` rows of each series only.

    Later residuals use those coefficients, so no residual knows a value after it.
    """
    from tideframe.operators.moments import gramian, square
    import pandas as pd

    keys = list(spec.keys)
    rows = framed(with_position(df, spec, "rn"), spec, lag_block([value], order, "_past", shift=1))
    w = F.when(F.col("_past").isNotNull(), vector(F.array(F.lit(1.0)), F.col("_past"), F.array(F.col(value))))
    early = gramian(rows.filter(F.col("rn") <= fit_rows).withColumn("w", w), keys, "w")
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_coef", T.ArrayType(T.DoubleType()))])

    def fit(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    coef = least_squares(square(row["g"]), order + 1)[0][:, 0].tolist()
                except np.linalg.LinAlgError:
                    coef = None
                out.append((*[row[k] for k in keys], coef))
            yield pd.DataFrame(out, columns=[*keys, "_coef"])

    with_fit = rows.join(early.mapInPandas(fit, schema), keys, "left")
    known = F.concat(F.array(F.lit(1.0)), F.col("_past"))
    fitted = F.aggregate(F.zip_with(known, F.col("_coef"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return with_fit.withColumn("_e", F.col(value) - fitted).drop("_past", "_coef", "rn")


def _arma_rows(df: DataFrame, spec: PanelSpec, level: str, widest: int, ar_order: int, fit_rows: int) -> DataFrame:
    base = framed(df.select(*spec.keys, spec.time, level), spec, difference(level, prefix="_d_"))
    base = _ar_residuals(base.withColumnRenamed(f"_d_{level}", "_d"), spec, "_d", ar_order, fit_rows)
    rows = framed(base, spec, lag_block(["_d"], widest, "_dp", 1), lag_block(["_e"], widest, "_ep", 1), lag_block(["_d"], widest, "_dn"), lag_block(["_e"], widest, "_en"))
    ready = F.col("_dp").isNotNull() & F.col("_ep").isNotNull()
    return rows.withColumn("w", F.when(ready, vector(F.array(F.lit(1.0)), F.col("_dp"), F.col("_ep"), F.array("_d"))))


def _pick(p: int, q: int, widest: int) -> list[int]:
    """Positions of constant, p lags, q residual lags and the response in the widest vector."""
    return [0, *range(1 + widest - p, 1 + widest), *range(1 + 2 * widest - q, 1 + 2 * widest), 1 + 2 * widest]


def arma_orders(df: DataFrame, spec: PanelSpec, level: str, widest: int = 5, ar_order: int = 10, fit_rows: int = 100) -> DataFrame:
    """AIC and BIC of ARMA(p, q) on differences for p, q in 0..widest, by Hannan-Rissanen least squares.

    An order without a fit has ``fit_ok = false`` and a reason; a series without any row to fit has one such row of order null.
    """
    from tideframe.operators.moments import every_series, gramian, square, typed

    keys = list(spec.keys)
    moments = every_series(df, keys, g=gramian(_arma_rows(df, spec, level, widest, ar_order, fit_rows), keys, "w"))
    schema = T.StructType([
        *[df.schema[k] for k in keys], T.StructField("p", T.LongType()), T.StructField("q", T.LongType()), T.StructField("aic", T.DoubleType()),
        T.StructField("bic", T.DoubleType()), T.StructField("best_aic", T.BooleanType()), T.StructField("best_bic", T.BooleanType()),
        T.StructField("fit_ok", T.BooleanType()), T.StructField("reason", T.StringType())])

    def score(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                key = [row[k] for k in keys]
                if row["g"] is None:
                    out.append((*key, *[None] * 4, False, False, False, "too few complete rows"))
                    continue
                g = square(row["g"])
                n, scores = g[0, 0], []
                for p in range(widest + 1):
                    for q in range(widest + 1):
                        at = _pick(p, q, widest)
                        try:
                            if n <= 1 + p + q:
                                raise np.linalg.LinAlgError("too few complete rows")
                            rest = least_squares(g[np.ix_(at, at)], 1 + p + q)[1][0, 0]
                        except np.linalg.LinAlgError as e:
                            out.append((*key, p, q, None, None, False, False, False, str(e)))
                            continue
                        fit = n * np.log(max(rest, 1e-300) / n)
                        scores.append((p, q, fit + 2 * (1 + p + q), fit + np.log(n) * (1 + p + q)))
                a, b = (min(scores, key=lambda s, i=i: (s[i], s[0] + s[1]))[:2] if scores else None for i in (2, 3))
                out += [(*key, *s, s[:2] == a, s[:2] == b, True, None) for s in scores]
            yield typed(out, schema)

    return moments.mapInPandas(score, schema)


def arma_forecasts(
    df: DataFrame, spec: PanelSpec, level: str, orders: DataFrame, horizons: Sequence[int], min_train: int, step: int,
    widest: int = 5, ar_order: int = 10, model: str = "arma",
) -> DataFrame:
    """Walk-forward ARMA on differences with the order of each series; ``orders`` holds the keys, ``p`` and ``q``.

    A fit that is singular or not stationary has ``fit_ok = false`` and, where a
    smaller order works, that order's forecast.
    """
    rows = _arma_rows(df, spec, level, widest, ar_order, min_train)
    rows = _origins(rows, spec, level, horizons, min_train, step)
    warm = F.col("rn") >= min_train + ar_order + 2 * widest
    rows = rows.withColumn("is_origin", F.col("is_origin") & warm)
    rows = rows.join(orders.select(*spec.keys, "p", "q"), list(spec.keys))
    top = max(horizons)

    def stable(ar: np.ndarray) -> bool:
        if len(ar) == 0:
            return True
        companion = np.zeros((len(ar), len(ar)))
        companion[0] = ar
        companion[1:, :-1] = np.eye(len(ar) - 1)
        return bool(np.max(np.abs(np.linalg.eigvals(companion))) < 1)

    def solve(g: np.ndarray, row: dict) -> list[dict]:
        p0, q0 = int(row["p"]), int(row["q"])
        tries = [(p0, q0)] + [(p, q) for p in range(p0, -1, -1) for q in range(q0, -1, -1) if (p, q) != (p0, q0)]
        for p, q in tries:
            at = _pick(p, q, widest)
            try:
                coef = least_squares(g[np.ix_(at, at)], 1 + p + q)[0][:, 0]
            except np.linalg.LinAlgError:
                continue
            ar, ma = coef[1:1 + p][::-1], coef[1 + p:][::-1]
            if row["_dn"] is None or row["_en"] is None or not stable(ar):
                continue
            d, e = list(row["_dn"]), list(row["_en"])
            for _ in range(top):
                d.append(coef[0] + sum(a * d[-i] for i, a in enumerate(ar, 1)) + sum(b * e[-i] for i, b in enumerate(ma, 1)))
                e.append(0.0)
            made = _forecast_rows(model, row, horizons, row["naive"] + np.cumsum(d[widest:]))
            return [{**m, "fit_ok": (p, q) == (p0, q0)} for m in made]
        return _forecast_rows(model, row, horizons)

    carried = ["date", "naive", "_dn", "_en", "p", "q", *[f"{c}{h}" for h in horizons for c in ("a", "t")]]
    return expanding_solve(rows, spec, "w", carried, solve, FORECAST_SCHEMA)
