"""Distribution functions on numpy, also as pandas UDFs: t, F, normal (with log tail), hypergeometric.

Written from the standard formulas: the incomplete beta by its continued fraction (modified Lentz), the normal tail by
erfc, far out by its asymptotic series, the hypergeometric tail by log-gamma sums.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
        tiny = 1e-300
        c = np.ones_like(xx)
        d = 1 - (aa + bb) * xx / (aa + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)), -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out = front * h
    out = np.where(flip, 1 - out, out)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|) with df degrees of freedom; NaN where an argument is NaN or df is not positive."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    ok = np.isfinite(t) & (df > 0)
    d, x = np.where(ok, df, 1.0), np.where(ok, t, 0.0)
    return np.where(ok, betainc(d / 2, 0.5, d / (d + x * x)), np.where(np.isinf(t) & (df > 0), 0.0, np.nan))


def f_upper(f, d1, d2) -> np.ndarray:
    f = np.asarray(f, float)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection."""
    if df <= 0 or not 0 < p < 1:
        return math.nan
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        tail = float(t_two_sided(mid, df)) / 2
        if (1 - tail if mid > 0 else tail) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def normal_two_sided(z) -> np.ndarray:
    z = np.asarray(z, float)
    return np.where(np.isnan(z), np.nan, _erfc(np.abs(np.where(np.isnan(z), 0, z)) / math.sqrt(2)))


def normal_log_upper(z) -> np.ndarray:
    """ln P(Z >= z), exact in the far tail where the probability itself underflows."""
    z = np.asarray(z, float)
    near = np.minimum(z, 30.0)
    with np.errstate(divide="ignore"):
        direct = np.log(0.5 * _erfc(near / math.sqrt(2)))
    far = np.maximum(z, 30.0)
    s = 1 / far**2
    tail = -far * far / 2 - np.log(far) - 0.5 * math.log(2 * math.pi) + np.log1p(-s * (1 - 3 * s * (1 - 5 * s)))
    return np.where(z > 30, tail, direct)


def neg_log10_p(beta, se) -> np.ndarray:
    """-log10 of the two-sided normal P of beta / se, without underflow."""
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(np.asarray(beta, float) / np.asarray(se, float))
    return -(normal_log_upper(z) + math.log(2)) / math.log(10)


def hypergeom_upper(k, universe, marked, drawn) -> np.ndarray:
    """P(X >= k) when `drawn` of `universe` items are drawn and `marked` of them are marked."""

    def one(k, n, m, d) -> float:
        if any(v is None or v != v for v in (k, n, m, d)):
            return math.nan
        k, n, m, d = int(k), int(n), int(m), int(d)
        low, high = max(k, d - (n - m), 0), min(m, d)
        if low > high:
            return 0.0
        if low <= max(0, d - (n - m)):
            return 1.0
        choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        base = choose(n, d)
        return min(1.0, math.fsum(math.exp(choose(m, i) + choose(n - m, d - i) - base) for i in range(low, high + 1)))

    return np.vectorize(one, otypes=[float])(k, universe, marked, drawn)


def _floats(c: pd.Series) -> np.ndarray:
    return pd.to_numeric(c).to_numpy(dtype=float, na_value=np.nan)


def t_p_value(t, df):
    """Two-sided t P value as a column; null in, null out."""

    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(_floats(a), _floats(b)))

    return F.pandas_udf(over, T.DoubleType())(t, df)


def z_p_value(z):
    """Two-sided normal P value as a column."""

    def over(a: pd.Series) -> pd.Series:
        return pd.Series(normal_two_sided(_floats(a)))

    return F.pandas_udf(over, T.DoubleType())(z)


def nlp_value(beta, se):
    """-log10 P from an estimate and its standard error as a column."""

    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(neg_log10_p(_floats(a), _floats(b)))

    return F.pandas_udf(over, T.DoubleType())(beta, se)


def hypergeom_p_value(k, universe, marked, drawn):
    """Upper hypergeometric tail as a column."""

    def over(a: pd.Series, b: pd.Series, c: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series(hypergeom_upper(_floats(a), _floats(b), _floats(c), _floats(e)))

    return F.pandas_udf(over, T.DoubleType())(k, universe, marked, drawn)
