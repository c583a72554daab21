"""Series diagnostics from moment matrices: collinearity, unit roots, lag order."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log, pi
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.operators.features import lag_block
from tideframe.functions.scalars import is_finite
from tideframe.operators.moments import every_series, gramian, least_squares, require_rank, square, typed, vector
from tideframe.panel import Framed, PanelSpec, framed, null_safe_join, series_length, with_position
from tideframe.session import stored

# MacKinnon's response surface for the unit-root test with a constant.
MACKINNON = {
    "tau_max": 2.74, "tau_min": -18.83, "tau_star": -1.61,
    "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368),
}


def correlations(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All pairwise correlations on complete rows, one pass, long form."""
    complete = df.na.drop("any", subset=list(columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = complete.groupBy(*groups).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("_c")
    return wide.select(*groups, cells).select(*groups, F.col("_c.a").alias("column_a"), F.col("_c.b").alias("column_b"), F.col("_c.corr").alias("corr"))


def variance_inflation(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """VIF with intercept per group and column; exact dependence gives infinity.

    Sums run in the JVM with a map-side combine; only the correlation matrix of each
    group reaches the solver. Too few rows or a constant column fail the job.
    """
    groups, cols = list(groups), list(columns)
    complete = df.na.drop("any", subset=cols)
    # Covariances are centred while they are summed, so large means do not cost digits.
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    cov = [F.covar_pop(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")) for i, j in pairs]
    flat = complete.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.array(*cov).alias("cov"),
        F.array(*[(F.min(c) == F.max(c)) for c in cols]).alias("constant"))
    schema = T.StructType([*[df.schema[g] for g in groups], T.StructField("feature", T.StringType()), T.StructField("vif", T.DoubleType())])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if row["n"] <= len(cols):
                    raise ValueError(f"{row['n']} rows are too few for {len(cols)} columns")
                fixed = [c for c, k in zip(cols, row["constant"]) if k]
                if fixed:
                    raise ValueError(f"constant columns {fixed}")
                s = np.zeros((len(cols), len(cols)))
                for (i, j), value in zip(pairs, row["cov"]):
                    s[i, j] = s[j, i] = value
                d = np.sqrt(np.diag(s))
                r = s / np.outer(d, d)
                full = np.linalg.matrix_rank(r, tol=1e-10)
                for i, c in enumerate(cols):
                    rest = np.delete(np.delete(r, i, 0), i, 1)
                    dependent = np.linalg.matrix_rank(rest, tol=1e-10) == full
                    others = np.linalg.pinv(rest, rcond=1e-10)
                    unexplained = 1 - np.delete(r[i], i) @ others @ np.delete(r[i], i)
                    out.append((*[row[g] for g in groups], c, np.inf if dependent else 1 / unexplained))
            yield pd.DataFrame(out, columns=[*groups, "feature", "vif"])

    return flat.mapInPandas(solve, schema)


def unit_root_p(tau: float) -> float:
    """Approximate p-value of the unit-root statistic (constant, one series)."""
    if tau > MACKINNON["tau_max"]:
        return 1.0
    if tau < MACKINNON["tau_min"]:
        return 0.0
    coefs = MACKINNON["small"] if tau <= MACKINNON["tau_star"] else MACKINNON["large"]
    return NormalDist().cdf(sum(c * tau**i for i, c in enumerate(coefs)))


def max_lag(n: int) -> int:
    return max(min(n // 2 - 2, int(ceil(12 * (n / 100) ** 0.25))), 0)


class _LagSums:
    """Moments of [1, y-1, k lagged differences, difference] over any range of rows of one series.

    ``c[h]`` sums the products of differences h rows apart and ``p[j]`` those of the level before a row with the difference j rows
    earlier, over all rows; what a range leaves out lies within a few lags of the ends, whose levels ``y`` (by position) has.
    """

    def __init__(self, n: int, c: Sequence[float], p: Sequence[float], level: float, squared: float, y: dict[int, float]):
        self.n, self.c, self.p, self.level, self.squared, self.y = n, c, p, level, squared, y

    def d(self, t: int) -> float:
        return self.y[t] - self.y[t - 1]

    def moments(self, start: int, k: int) -> np.ndarray:
        """Rows ``start`` to n. Order of columns: constant, level, lags 1 to k, the difference itself."""
        g, n, y, d = np.zeros((k + 3, k + 3)), self.n, self.y, self.d
        place = {0: k + 2, **{j: j + 1 for j in range(1, k + 1)}}
        g[0, 0] = n - start + 1
        g[0, 1] = self.level - sum(y[t - 1] for t in range(2, start))
        g[1, 1] = self.squared - sum(y[t - 1] ** 2 for t in range(2, start))
        for j in range(k + 1):
            g[0, place[j]] = y[n - j] - y[start - j - 1]
            g[1, place[j]] = self.p[j] - sum(y[t - 1] * d(t - j) for t in range(j + 2, start))
        for i in range(k + 1):
            for j in range(i, k + 1):
                h = j - i
                value = self.c[h] - sum(d(s) * d(s - h) for s in range(2 + h, start - i)) - sum(d(s) * d(s - h) for s in range(n - i + 1, n + 1))
                a, b = sorted((place[i], place[j]))
                g[a, b] = value
        return np.triu(g) + np.triu(g, 1).T


def _adf(sums: _LagSums, top: int) -> dict:
    """Statistic with the lag order of the smallest AIC on the rows that every order can use.

    A shorter order is a leading block, so the squared residuals of all of them are read from one factor.
    """
    g = sums.moments(top + 2, top)
    require_rank(g[:-1, :-1], "collinear lags")
    scale = np.sqrt(np.diag(g))
    low = np.linalg.cholesky(g / np.outer(scale, scale))
    rest = (1.0 - np.concatenate([[0.0], np.cumsum(low[-1, :-1] ** 2)])) * g[-1, -1]
    t = g[0, 0]
    best = min((t * (log(2 * pi) + log(rest[2 + k] / t) + 1) + 2 * (2 + k), k) for k in range(top + 1))[1]
    own, m = sums.moments(best + 2, best), 2 + best
    coef, left = least_squares(own, m)
    n = own[0, 0]
    tau = coef[1, 0] / np.sqrt(np.linalg.inv(own[:m, :m])[1, 1] * left[0, 0] / (n - m))
    return {"stat": float(tau), "p_value": unit_root_p(float(tau)), "used_lag": best, "n_obs": int(round(n))}


def unit_root_tests(df: DataFrame, spec: PanelSpec, value: str) -> DataFrame:
    """ADF test with constant and AIC lag choice per series; series too short, or without variance, report nulls.

    One pass sums products of differences up to the longest lag; no row carries its lags. Each series then solves its nested
    regressions from these sums and the levels near its ends. Values that are null or not finite are left out.
    """
    keys = list(spec.keys)
    sound = df.filter(is_finite(F.col(value).cast("double"))).select(*spec.keys, *spec.order, F.col(value).cast("double").alias("_y"))
    rows = stored(series_length(with_position(sound, spec, "rn"), spec, "n_rows"), "levels")
    # The longest series sets how far rows look back: one number, from row counts.
    top = max_lag(rows.agg(F.max("n_rows")).first()[0] or 0)
    lagged = framed(rows, spec, Framed(1, 0, lambda w: {"_y1": F.lag("_y").over(w), "_d0": F.col("_y") - F.lag("_y").over(w)}))
    lagged = framed(lagged, spec, Framed(top, 0, lambda w: {f"_d{h}": F.lag("_d0", h).over(w) for h in range(1, top + 1)}))
    sums = lagged.groupBy(*keys).agg(
        F.max("n_rows").alias("n"), F.array(*[F.sum(F.col("_d0") * F.col(f"_d{h}")) for h in range(top + 1)]).alias("c"),
        F.array(*[F.sum(F.col("_y1") * F.col(f"_d{h}")) for h in range(top + 1)]).alias("p"), F.sum("_y1").alias("level"), F.sum(F.col("_y1") * F.col("_y1")).alias("squared"))
    near = (F.col("rn") <= 2 * top + 4) | (F.col("rn") > F.col("n_rows") - 2 * top - 4)
    ends = rows.filter(near).groupBy(*keys).agg(F.collect_list(F.struct("rn", "_y")).alias("ends"))
    small = null_safe_join(sums, ends, keys)
    schema = T.StructType([
        *[df.schema[k] for k in keys], T.StructField("stat", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
        T.StructField("used_lag", T.LongType()), T.StructField("n_obs", T.LongType()), T.StructField("fit_ok", T.BooleanType())])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                key, n = [row[k] for k in keys], int(row["n"])
                try:
                    held = _LagSums(n, row["c"], row["p"], row["level"], row["squared"], {int(e["rn"]): e["_y"] for e in row["ends"]})
                    res = _adf(held, max_lag(n))
                    out.append((*key, res["stat"], res["p_value"], res["used_lag"], res["n_obs"], True))
                except (np.linalg.LinAlgError, ValueError, TypeError, ZeroDivisionError, KeyError):
                    out.append((*key, None, None, None, None, False))
            yield pd.DataFrame(out, columns=schema.fieldNames()).astype({"used_lag": "Int64", "n_obs": "Int64"})

    return small.mapInPandas(solve, schema)


def integration_report(df: DataFrame, spec: PanelSpec, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Unit-root p of level and first difference per series and variable; I(1) needs p_level >= alpha > p_diff."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_c")
    long = df.select(*spec.keys, spec.time, cells).select(*spec.keys, spec.time, F.col("_c.variable").alias("variable"), F.col("_c.value").alias("value"))
    inner = spec.with_keys("variable")
    from tideframe.operators.features import difference

    both = framed(long, inner, difference("value"))
    forms = F.explode(F.array(
        F.struct(F.lit("level").alias("form"), F.col("value").alias("x")), F.struct(F.lit("diff").alias("form"), F.col("d_value").alias("x")))).alias("_f")
    stacked = both.select(*inner.keys, inner.time, forms).select(*inner.keys, inner.time, F.col("_f.form").alias("form"), F.col("_f.x").alias("x"))
    tests = unit_root_tests(stacked, inner.with_keys("form"), "x")
    p = lambda form: F.max(F.when(F.col("form") == form, F.col("p_value")))
    out = tests.groupBy(*inner.keys).agg(p("level").alias("p_level"), p("diff").alias("p_diff"))
    return out.withColumn("is_i1", F.coalesce((F.col("p_level") >= alpha) & (F.col("p_diff") < alpha), F.lit(False)))


def require_i1(report: DataFrame) -> DataFrame:
    """The report, refusing it when one variable is not I(1); evaluated with the rows that follow."""
    ok = F.when(F.col("is_i1"), F.col("is_i1")).otherwise(F.raise_error(F.concat(F.lit("not integrated of order one: "), F.col("variable"))))
    return report.withColumn("is_i1", ok.cast("boolean"))


def lag_order(df: DataFrame, spec: PanelSpec, columns: Sequence[str], max_order: int = 15, exogenous: Sequence[str] = ()) -> DataFrame:
    """AIC, BIC, HQIC and FPE of a vector autoregression for orders 0..max per series, on one common sample.

    Exogenous columns enter every candidate. One row per order, with a flag per criterion at its minimum.
    An order without a fit has ``fit_ok = false`` and a reason; a series without any row to fit has one such row of order null.
    """
    keys, k, e = list(spec.keys), len(columns), len(exogenous)
    rows = framed(df, spec, lag_block(columns, max_order, "_past", shift=1))
    now = F.array(*[F.col(c).cast("double") for c in columns])
    outside = F.array(*[F.col(c).cast("double") for c in exogenous]) if exogenous else F.array().cast("array<double>")
    w = vector(F.array(F.lit(1.0)), outside, F.col("_past"), now)
    moments = every_series(df, keys, g=gramian(rows.filter(F.col("_past").isNotNull()).withColumn("w", w), keys, "w"))
    names = ["aic", "bic", "hqic", "fpe"]
    schema = T.StructType([
        *[df.schema[x] for x in keys], T.StructField("order", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names],
        *[T.StructField(f"best_{n}", T.BooleanType()) for n in names], T.StructField("fit_ok", T.BooleanType()), T.StructField("reason", T.StringType())])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                key = [row[x] for x in keys]
                if row["g"] is None:
                    out.append((*key, *[None] * 5, *[False] * 5, "too few complete rows"))
                    continue
                g = square(row["g"])
                n, fixed = g[0, 0], 1 + e
                scores = []
                for p in range(max_order + 1):
                    lags = range(fixed + (max_order - p) * k, fixed + max_order * k)
                    at = [*range(fixed), *lags, *range(g.shape[0] - k, g.shape[0])]
                    m = fixed + p * k
                    try:
                        if n < m + k:
                            raise np.linalg.LinAlgError("too few complete rows")
                        _, rest = least_squares(g[np.ix_(at, at)], m)
                        ld = np.linalg.slogdet(rest / n)[1]
                        if not np.isfinite(ld):
                            raise np.linalg.LinAlgError("no residual variance")
                    except np.linalg.LinAlgError as error:
                        out.append((*key, p, *[None] * 4, *[False] * 5, str(error)))
                        continue
                    free = k * m
                    scores.append((p, ld + 2 * free / n, ld + log(n) * free / n, ld + 2 * log(log(n)) * free / n,
                                   ((n + m) / (n - m)) ** k * np.exp(ld) if n > m else np.inf))
                best = [min(scores, key=lambda s, i=i: s[i])[0] for i in range(1, 5)] if scores else []
                for s in scores:
                    out.append((*key, *s, *[s[0] == b for b in best], True, None))
            yield typed(out, schema)

    return moments.mapInPandas(solve, schema)
