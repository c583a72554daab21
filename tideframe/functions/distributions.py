"""Tail probabilities. The normal tail is a column expression; t and F use a small vectorised helper."""

from __future__ import annotations

from math import lgamma
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Chebyshev coefficients of the complementary error function
# (Press et al., Numerical Recipes), relative error below 1.2e-7.
ERFC = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def normal_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    upper = 0.5 * t * F.exp(poly - x * x)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def normal_tail_sql(z: str) -> str:
    """The same expression as SQL text, for oracles."""
    x = f"(abs({z})/sqrt(2.0))"
    t = f"(1/(1+0.5*{x}))"
    poly = repr(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r}+{t}*{poly})"
    upper = f"(0.5*{t}*exp({poly}-{x}*{x}))"
    return f"(CASE WHEN {z}>=0 THEN {upper} ELSE 1-{upper} END)"


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by Lentz's continued fraction, element by element."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    log_beta = np.array([lgamma(u + v) - lgamma(u) - lgamma(v) for u, v in zip(p.ravel(), q.ravel())])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_beta.reshape(p.shape) + p * np.log(y) + q * np.log1p(-y)) / p
    c = np.ones_like(y)
    d = 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        for term in (
            m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    value = np.where(y <= 0, 0.0, front * h)
    return np.where(flip, 1 - value, value)


@F.pandas_udf(DoubleType())
def student_two_sided(stat: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| > |stat|); null in, null out."""
    t2, nu = stat.to_numpy(float) ** 2, df.to_numpy(float)
    return pd.Series(beta_tail(nu / 2, np.full_like(nu, 0.5), nu / (nu + t2))).where(stat.notna().to_numpy())


def f_tail(stat, df1, df2):
    """P(F > stat), used inside grouped solvers."""
    stat, df1, df2 = (np.asarray(v, float) for v in (stat, df1, df2))
    return beta_tail(df2 / 2, df1 / 2, df2 / (df2 + df1 * stat))


def f_quantile(p: float, df1: float, df2: float) -> float:
    """The value that F stays below with probability p, by bisection on its tail."""
    low, high = 0.0, 1.0
    while f_tail(high, df1, df2) > 1 - p:
        low, high = high, 2 * high
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if f_tail(middle, df1, df2) > 1 - p else (low, middle)
    return (low + high) / 2
