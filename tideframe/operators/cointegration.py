"""Cointegration: Johansen tests, error-correction fits, causality, impulse responses, variance shares."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.distributions import f_quantile, f_tail
from tideframe.operators.features import difference, lag_block
from tideframe.operators.moments import every_series, expanding_solve, gramian, least_squares, require_rank, square, typed, vector
from tideframe.operators.vector_models import FORECAST_SCHEMA, _forecast_rows, _origins, responses
from tideframe.panel import UNBOUNDED, PanelSpec, framed, with_position

# Critical values at 90, 95 and 99 % for 1 to 6 remaining common trends,
# by deterministic order (-1 none, 0 constant, 1 constant and trend).
TRACE = {
    -1: ((2.9762, 4.1296, 6.9406), (10.4741, 12.3212, 16.364), (21.7781, 24.2761, 29.5147),
         (37.0339, 40.1749, 46.5716), (56.2839, 60.0627, 67.6367), (79.5329, 83.9383, 92.7136)),
    0: ((2.7055, 3.8415, 6.6349), (13.4294, 15.4943, 19.9349), (27.0669, 29.7961, 35.4628),
        (44.4929, 47.8545, 54.6815), (65.8202, 69.8189, 77.8202), (91.109, 95.7542, 104.9637)),
    1: ((2.7055, 3.8415, 6.6349), (16.1619, 18.3985, 23.1485), (32.0645, 35.0116, 41.0815),
        (51.6492, 55.2459, 62.5202), (75.1027, 79.3422, 87.7748), (102.4674, 107.3429, 116.9829)),
}
MAX_EIGENVALUE = {
    -1: ((2.9762, 4.1296, 6.9406), (9.4748, 11.2246, 15.0923), (15.7175, 17.7961, 22.2519),
         (21.837, 24.1592, 29.0609), (27.916, 30.4428, 35.7359), (33.9271, 36.6301, 42.2333)),
    0: ((2.7055, 3.8415, 6.6349), (12.2971, 14.2639, 18.52), (18.8928, 21.1314, 25.865),
        (25.1236, 27.5858, 32.7172), (31.2379, 33.8777, 39.3693), (37.2786, 40.0763, 45.8662)),
    1: ((2.7055, 3.8415, 6.6349), (15.0006, 17.1481, 21.7465), (21.8731, 24.2522, 29.2631),
        (28.2398, 30.8151, 36.193), (34.4202, 37.1646, 42.8612), (40.5244, 43.4183, 49.4095)),
}


#: Every table of fits ends with these; a series without a fit has one row with nulls and the reason.
FIT_FIELDS = [T.StructField("fit_ok", T.BooleanType()), T.StructField("reason", T.StringType())]
TOO_SHORT = "too few complete rows"


class Layout:
    """Positions inside the moment vector [1, t, lagged differences, lagged level, difference]."""

    def __init__(self, columns: Sequence[str], p: int):
        k = len(columns)
        self.columns, self.k, self.p = list(columns), k, p
        self.one, self.t = 0, 1
        self.past = list(range(2, 2 + k * p))
        self.level = list(range(2 + k * p, 2 + k * p + k))
        self.change = list(range(2 + k * p + k, 2 + k * p + 2 * k))
        #: What stands at each position; lag blocks run oldest first.
        self.names = ["constant", "trend", *[f"change of {c} at lag {p - b}" for b in range(p) for c in columns], *[f"level of {c}" for c in columns], *[f"change of {c}" for c in columns]]


def _rows(df: DataFrame, spec: PanelSpec, columns: Sequence[str], p: int) -> DataFrame:
    d = [f"d_{c}" for c in columns]
    arr = lambda cols: F.array(*[F.col(c).cast("double") for c in cols])
    rows = with_position(df.select(*spec.keys, spec.time, *columns).na.drop("any"), spec, "_t")
    rows = framed(rows, spec, difference(*columns), lag_block(columns, 1, "_y1", shift=1))
    if p:
        rows = framed(rows, spec, lag_block(d, p, "_past", shift=1), lag_block(d, p, "_now"))
    else:
        empty = F.array().cast("array<double>")
        rows = rows.withColumns({"_past": empty, "_now": empty})
    ready = F.col("_past").isNotNull() & F.col("_y1").isNotNull()
    w = vector(F.array(F.lit(1.0), F.col("_t").cast("double")), F.col("_past"), F.col("_y1"), arr(d))
    return rows.withColumns({"w": F.when(ready, w), "_y": arr(columns)})


def _partialled(g: np.ndarray, out: list[int], keep: list[int], names: Sequence[str]) -> np.ndarray:
    """Moments of ``keep`` after regressing them on ``out``."""
    if not out:
        return g[np.ix_(keep, keep)]
    zz = g[np.ix_(out, out)]
    require_rank(zz, "collinear lags", [names[i] for i in out])
    scale = np.sqrt(np.diag(zz))
    zy = g[np.ix_(out, keep)] / scale[:, None]
    return g[np.ix_(keep, keep)] - zy.T @ np.linalg.solve(zz / np.outer(scale, scale), zy)


def _reduced_rank(s: np.ndarray, k: int, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Squared canonical correlations and vectors from moments of [change, level]."""
    s00, s01, s11 = s[:k, :k], s[:k, k:], s[k:, k:]
    scale = np.sqrt(np.diag(s11))
    require_rank(s00, "collinear changes", names[:k])
    require_rank(s11, "collinear levels", names[k:])
    low = np.linalg.cholesky(s11 / np.outer(scale, scale))
    half = np.linalg.solve(low, (s01 / scale).T)
    lam, vec = np.linalg.eigh(half @ np.linalg.solve(s00, half.T))
    order = np.argsort(lam)[::-1]
    return np.clip(lam[order], 0, 1 - 1e-15), np.linalg.solve(low.T, vec[:, order]) / scale[:, None]


def _eigenvalues(g: np.ndarray, at: Layout, det: int, slope: np.ndarray) -> tuple[np.ndarray, float]:
    if det == 1:
        shift = np.eye(g.shape[0])
        for i, b in zip(at.level, slope):
            shift[i, at.t] = -b
        g = shift @ g @ shift.T
    fixed = [at.one] if det >= 0 else []
    keep = [*at.change, *at.level]
    lam, _ = _reduced_rank(_partialled(g, [*fixed, *at.past], keep, at.names) / g[0, 0], at.k, [at.names[i] for i in keep])
    return lam[: at.k], g[0, 0]


def johansen(df: DataFrame, spec: PanelSpec, columns: Sequence[str], k_ar_diff: int) -> DataFrame:
    """Trace and maximum-eigenvalue tests per series for three deterministic specifications.

    The trace statistic of r is the sum of the maximum-eigenvalue statistics from r on.
    Ranks follow sequential testing at 95 %. A specification that cannot be fitted has one row with ``fit_ok = false``.
    """
    keys, k, at = list(spec.keys), len(columns), Layout(columns, k_ar_diff)
    if k > 6:
        raise ValueError("critical values cover up to six variables")
    rows = _rows(df, spec, columns, k_ar_diff)
    trend = rows.withColumn("v", F.concat(F.array(F.lit(1.0), F.col("_t").cast("double")), F.col("_y")))
    both = every_series(df, keys, g=gramian(rows, keys, "w"), h=gramian(trend, keys, "v"))
    schema = T.StructType([
        *[df.schema[c] for c in keys], T.StructField("det_order", T.LongType()), T.StructField("r_null", T.LongType()),
        T.StructField("eigenvalue", T.DoubleType()), T.StructField("trace_stat", T.DoubleType()), T.StructField("trace_cv_95", T.DoubleType()),
        T.StructField("trace_reject_95", T.BooleanType()), T.StructField("max_eig_stat", T.DoubleType()), T.StructField("max_eig_cv_95", T.DoubleType()),
        T.StructField("max_eig_reject_95", T.BooleanType()), T.StructField("trace_rank", T.LongType()), T.StructField("max_eig_rank", T.LongType()), *FIT_FIELDS])

    def rank(rejects: list[bool]) -> int:
        return rejects.index(False) if False in rejects else len(rejects)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                for det in (-1, 0, 1):
                    try:
                        if row["g"] is None:
                            raise np.linalg.LinAlgError(TOO_SHORT)
                        slope = least_squares(square(row["h"]), 2)[0][1]
                        lam, n = _eigenvalues(square(row["g"]), at, det, slope)
                    except np.linalg.LinAlgError as e:
                        out.append((*[row[c] for c in keys], det, *[None] * 10, False, str(e)))
                        continue
                    top = -n * np.log1p(-lam)
                    trace = np.cumsum(top[::-1])[::-1]
                    cvt = [TRACE[det][k - r - 1][1] for r in range(k)]
                    cvm = [MAX_EIGENVALUE[det][k - r - 1][1] for r in range(k)]
                    rt, rm = [bool(a > b) for a, b in zip(trace, cvt)], [bool(a > b) for a, b in zip(top, cvm)]
                    out += [(*[row[c] for c in keys], det, r, float(lam[r]), float(trace[r]), cvt[r], rt[r], float(top[r]), cvm[r], rm[r], rank(rt), rank(rm), True, None) for r in range(k)]
            yield typed(out, schema)

    return both.mapInPandas(solve, schema)


def primary_rank(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cointegration rank per series: trace test with restricted constant; null where it could not be fitted."""
    return tests.filter("det_order = 0").groupBy(*keys).agg(F.max("trace_rank").alias("rank"))


def _fit(g: np.ndarray, at: Layout, r: int) -> dict:
    """Error-correction fit with a constant inside the cointegration relation."""
    k, n = at.k, g[0, 0]
    level = [*at.level, at.one]
    s = _partialled(g, at.past, [*at.change, *level], at.names) / n
    _, vec = _reduced_rank(s, k, [at.names[i] for i in (*at.change, *level)])
    beta = vec[:, :r]
    beta = beta @ np.linalg.inv(beta[:r])
    s01, s11 = s[:k, k:], s[k:, k:]
    alpha = s01 @ beta @ np.linalg.inv(beta.T @ s11 @ beta)
    sigma = s[:k, :k] - alpha @ beta.T @ s01.T
    gamma = np.zeros((k, k * at.p))
    if at.p:
        zz = g[np.ix_(at.past, at.past)]
        cross = g[np.ix_(at.change, at.past)] - alpha @ beta.T @ g[np.ix_(level, at.past)]
        gamma = np.linalg.solve(zz, cross.T).T
    pi = alpha @ beta[:k].T
    # Lag blocks run oldest first; lag i sits in block p - i.
    lag = [gamma[:, (at.p - i) * k:(at.p - i + 1) * k] for i in range(1, at.p + 1)]
    padded = [np.zeros((k, k)), *lag, np.zeros((k, k))]
    var = [padded[i] - padded[i - 1] for i in range(1, at.p + 2)]
    var[0] = np.eye(k) + pi + (lag[0] if lag else 0)
    return {"alpha": alpha, "beta": beta, "gamma": lag, "sigma": sigma, "var": var, "pi": pi, "constant": alpha @ beta[k]}


def _ranked_moments(df: DataFrame, spec: PanelSpec, columns: Sequence[str], k_ar_diff: int, ranks: DataFrame) -> DataFrame:
    """Moments of the series with a rank above 0 and of those whose rank is null because no test could be fitted."""
    keys = list(spec.keys)
    main = every_series(df, keys, g=gramian(_rows(df, spec, columns, k_ar_diff), keys, "w"))
    return main.join(ranks.filter("rank > 0 or rank is null").select(*keys, "rank"), keys)


def _ranked_fit(row: dict, at: Layout) -> dict:
    if row["g"] is None:
        raise np.linalg.LinAlgError(TOO_SHORT)
    if pd.isna(row["rank"]):
        raise np.linalg.LinAlgError("no cointegration rank")
    return _fit(square(row["g"]), at, min(int(row["rank"]), at.k))


def error_correction(df: DataFrame, spec: PanelSpec, columns: Sequence[str], k_ar_diff: int, ranks: DataFrame) -> DataFrame:
    """Cointegrating vectors and adjustment per series in long form; rank 0 gives no rows, a failed fit or null rank one."""
    keys, at = list(spec.keys), Layout(columns, k_ar_diff)
    main = _ranked_moments(df, spec, columns, k_ar_diff, ranks)
    schema = T.StructType([
        *[df.schema[c] for c in keys], T.StructField("relation", T.LongType()), T.StructField("variable", T.StringType()),
        T.StructField("beta", T.DoubleType()), T.StructField("alpha", T.DoubleType()), *FIT_FIELDS])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    fit = _ranked_fit(row, at)
                except np.linalg.LinAlgError as e:
                    out.append((*[row[c] for c in keys], *[None] * 4, False, str(e)))
                    continue
                for j in range(fit["beta"].shape[1]):
                    for i, name in enumerate([*columns, "constant"]):
                        a = float(fit["alpha"][i, j]) if i < at.k else None
                        out.append((*[row[c] for c in keys], j, name, float(fit["beta"][i, j]), a, True, None))
            yield typed(out, schema)

    return main.mapInPandas(solve, schema)


def vecm_forecasts(
    df: DataFrame, spec: PanelSpec, columns: Sequence[str], target: str, k_ar_diff: int, ranks: DataFrame,
    horizons: Sequence[int], min_train: int, step: int, model: str = "vecm",
) -> DataFrame:
    """Walk-forward error-correction forecasts in levels with 90 and 95 % bands.

    A series without a rank, or of rank 0, has one row per horizon with nulls and the reason; so has an origin whose fit fails. A
    band that is not finite shrinks to the point forecast.
    """
    k, at, where, top = len(columns), Layout(columns, k_ar_diff), list(columns).index(target), max(horizons)
    rows = _origins(_rows(df, spec, columns, k_ar_diff), spec, target, horizons, min_train, step)
    rows = rows.join(ranks.filter("rank > 0").select(*spec.keys, "rank"), list(spec.keys))

    def solve(g: np.ndarray, row: dict) -> list[dict]:
        try:
            fit = _fit(g, at, min(int(row["rank"]), k))
        except np.linalg.LinAlgError as e:
            return [{**r, "reason": str(e)} for r in _forecast_rows(model, row, horizons)]
        y = np.asarray(row["_y"], float)
        steps = list(np.asarray(row["_now"], float).reshape(at.p, k)) if at.p else []
        path = []
        for _ in range(top):
            change = fit["pi"] @ y + fit["constant"]
            for i, gam in enumerate(fit["gamma"], start=1):
                change = change + gam @ steps[-i]
            steps.append(change)
            y = y + change
            path.append(y[where])
        phi = responses(fit["var"], top)
        mse = np.cumsum(np.einsum("hij,jk,hlk->hil", phi, fit["sigma"], phi), axis=0)[:, where, where]
        with np.errstate(invalid="ignore"):
            return [{**r, "reason": None} for r in _forecast_rows(model, row, horizons, path, np.sqrt(mse))]

    carried = ["date", "naive", "_y", "_now", "rank", *[f"{c}{h}" for h in horizons for c in ("a", "t")]]
    schema = T.StructType([*FORECAST_SCHEMA.fields, T.StructField("reason", T.StringType())])
    made = expanding_solve(rows, spec, "w", carried, solve, schema)
    none = df.select(*spec.keys).distinct().join(ranks.select(*spec.keys, "rank"), list(spec.keys), "left").filter("rank is null or rank = 0")
    none = none.withColumn("horizon", F.explode(F.array(*[F.lit(h).cast("long") for h in horizons])))
    told = {"model": F.lit(model), "horizon": F.col("horizon"), "fit_ok": F.lit(False),
            "reason": F.when(F.col("rank") == 0, "rank 0: no cointegration").otherwise("no cointegration rank")}
    return made.unionByName(none.select(*spec.keys, *[told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]))


def granger(df: DataFrame, spec: PanelSpec, columns: Sequence[str], k_ar_diff: int, alpha: float = 0.05) -> DataFrame:
    """F test for every ordered pair: do the lags of ``causing`` help ``caused``?

    Levels enter with one lag more than the model has and the extra lag is not tested,
    so the statistic is valid for integrated series. A series without a fit has one row with ``fit_ok = false``.
    """
    keys, k, q = list(spec.keys), len(columns), k_ar_diff + 2
    names = ["constant", *[f"level of {c} at lag {q - b}" for b in range(q) for c in columns]]
    rows = framed(df.select(*spec.keys, spec.time, *columns).na.drop("any"), spec, lag_block(columns, q, "_past", shift=1))
    w = F.when(F.col("_past").isNotNull(), vector(F.array(F.lit(1.0)), F.col("_past"), F.array(*[F.col(c).cast("double") for c in columns])))
    moments = every_series(df, keys, g=gramian(rows.withColumn("w", w), keys, "w"))
    schema = T.StructType([
        *[df.schema[c] for c in keys], T.StructField("causing", T.StringType()), T.StructField("caused", T.StringType()),
        T.StructField("test_statistic", T.DoubleType()), T.StructField("crit_value", T.DoubleType()), T.StructField("df_num", T.LongType()), T.StructField("df_denom", T.LongType()),
        T.StructField("p_value", T.DoubleType()), T.StructField("reject_h0", T.BooleanType()), T.StructField("verdict", T.StringType()), *FIT_FIELDS])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                m = 1 + k * q
                try:
                    if row["g"] is None or row["g"][0] <= m:
                        raise np.linalg.LinAlgError(TOO_SHORT)
                    g = square(row["g"])
                    n = g[0, 0]
                    coef, rest = least_squares(g, m, names)
                except np.linalg.LinAlgError as e:
                    out.append((*[row[c] for c in keys], *[None] * 9, False, str(e)))
                    continue
                scale = np.sqrt(np.diag(g[:m, :m]))
                inverse = np.linalg.inv(g[:m, :m] / np.outer(scale, scale)) / np.outer(scale, scale)
                sigma = rest / (n - m)
                for i, caused in enumerate(columns):
                    for j, causing in enumerate(columns):
                        if i == j:
                            continue
                        lags = [1 + b * k + j for b in range(1, q)]
                        b = coef[lags, i]
                        wald = float(b @ np.linalg.solve(sigma[i, i] * inverse[np.ix_(lags, lags)], b)) / len(lags)
                        df2 = int(round(k * n - k * m))
                        p = float(f_tail(wald, len(lags), df2))
                        text = f"lags of {causing} {'help' if p < alpha else 'do not help'} to forecast {caused}: p = {p:.4f} at level {alpha}"
                        out.append((*[row[c] for c in keys], causing, caused, wald, f_quantile(1 - alpha, len(lags), df2), len(lags), df2, p, p < alpha, text, True, None))
            yield typed(out, schema)

    return moments.mapInPandas(solve, schema)


def impulse_responses(
    df: DataFrame, spec: PanelSpec, columns: Sequence[str], k_ar_diff: int, ranks: DataFrame, periods: int = 20
) -> DataFrame:
    """Orthogonalised responses to one-deviation shocks, Cholesky in the given order, with running sums.

    Rank 0 gives no rows, a failed fit or null rank one with ``fit_ok = false``.
    """
    keys, at = list(spec.keys), Layout(columns, k_ar_diff)
    main = _ranked_moments(df, spec, columns, k_ar_diff, ranks)
    schema = T.StructType([
        *[df.schema[c] for c in keys], T.StructField("horizon", T.LongType()), T.StructField("shock", T.StringType()),
        T.StructField("response_variable", T.StringType()), T.StructField("response", T.DoubleType()), *FIT_FIELDS])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    fit = _ranked_fit(row, at)
                    low = np.linalg.cholesky(fit["sigma"])
                except np.linalg.LinAlgError as e:
                    out.append((*[row[c] for c in keys], *[None] * 4, False, str(e)))
                    continue
                orth = responses(fit["var"], periods + 1) @ low
                out += [(*[row[c] for c in keys], h, s, v, float(orth[h, i, j]), True, None)
                        for h in range(periods + 1) for i, v in enumerate(columns) for j, s in enumerate(columns)]
            yield typed(out, schema)

    return with_running_response(main.mapInPandas(solve, schema), keys)


def with_running_response(irf: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "shock", "response_variable").orderBy("horizon").rowsBetween(UNBOUNDED, 0)
    return irf.withColumn("cumulative_response", F.sum("response").over(w))


def _fit_columns(df: DataFrame) -> list[str]:
    return [f.name for f in FIT_FIELDS if f.name in df.columns]


def variance_shares(irf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each shock in the forecast error variance; shares of one response and horizon sum to one."""
    run = Window.partitionBy(*keys, "shock", "response_variable").orderBy("horizon").rowsBetween(UNBOUNDED, 0)
    whole = Window.partitionBy(*keys, "response_variable", "horizon")
    squared = irf.withColumn("_c", F.sum(F.col("response") * F.col("response")).over(run))
    share = (F.col("_c") / F.nullif(F.sum("_c").over(whole), F.lit(0.0))).alias("proportion")
    return squared.select(*keys, "horizon", "response_variable", "shock", share, *_fit_columns(irf))


def response_summary(irf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Peak response, its horizon, the final response and whether it dies out."""
    size = F.struct(F.round(F.abs("response"), 12), -F.col("horizon"))
    out = irf.groupBy(*keys, "shock", "response_variable", *_fit_columns(irf)).agg(
        F.max_by("response", size).alias("peak"), F.max_by("horizon", size).alias("peak_horizon"),
        F.max_by("response", "horizon").alias("final"))
    fades = (F.abs("peak") < 1e-9) | (F.abs("final") < 0.25 * F.abs("peak"))
    return out.withColumns({
        "direction": F.when(F.col("peak") > 0, "rises").when(F.col("peak").isNotNull(), "falls"),
        "persistence": F.when(fades, "fades out").when(F.col("peak").isNotNull(), "stays away")})


def top_contributors(shares: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """The largest shock per response at one horizon and the response's own share."""
    own = F.max(F.when(F.col("shock") == F.col("response_variable"), F.col("proportion")))
    at = (F.col("horizon") == horizon) | F.col("horizon").isNull()
    return shares.filter(at).groupBy(*keys, "response_variable", *_fit_columns(shares)).agg(
        F.max_by("shock", F.struct(F.round("proportion", 12), "shock")).alias("top_shock"), F.max("proportion").alias("top_share"), own.alias("own_share"))
