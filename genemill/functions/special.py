"""Tail probabilities that Spark SQL lacks, as Arrow UDFs on NumPy.

They run on tables that are already aggregated (one row per gene, test or
gene set), so Python sees few rows whatever the size of the matrix.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300
_EPS = 1e-15


def _beta_fraction(a, b, x):
    """Lentz evaluation of the continued fraction of the incomplete beta."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 20000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + coef / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < _EPS * 4):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b); NaN where the input is not valid."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        am, bm, xm = a[mid], b[mid], x[mid]
        swap = xm > (am + 1.0) / (am + bm + 2.0)
        p, q = np.where(swap, bm, am), np.where(swap, am, bm)
        z = np.where(swap, 1.0 - xm, xm)
        log_front = (
            _lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)
        )
        val = np.exp(log_front) * _beta_fraction(p, q, z) / p
        out[mid] = np.where(swap, 1.0 - val, val)
    return out


def gammaincc(a, x):
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    out[ok & np.isinf(x)] = 0.0
    mid = ok & (x > 0) & np.isfinite(x)
    series = mid & (x < a + 1.0)
    if series.any():
        s, z = a[series], x[series]
        term = 1.0 / s
        total = term.copy()
        for k in range(1, 100000):
            term = term * z / (s + k)
            total = total + term
            if np.all(term < total * _EPS):
                break
        out[series] = 1.0 - total * np.exp(-z + s * np.log(z) - _lgamma(s))
    tail = mid & (x >= a + 1.0)
    if tail.any():
        s, z = a[tail], x[tail]
        b = z + 1.0 - s
        c = np.full_like(z, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for k in range(1, 100000):
            an = -k * (k - s)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
            if np.all(np.abs(step - 1.0) < _EPS * 4):
                break
        out[tail] = h * np.exp(-z + s * np.log(z) - _lgamma(s))
    return out


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(invalid="ignore", over="ignore"):
        x = df / (df + t * t)
    return betainc(df / 2.0, 0.5, x)


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    with np.errstate(invalid="ignore", over="ignore"):
        x = d2 / (d2 + d1 * f)
    return betainc(d2 / 2.0, d1 / 2.0, x)


def chi2_upper(x, df):
    return gammaincc(np.asarray(df, dtype=float) / 2.0, np.asarray(x, dtype=float) / 2.0)


def normal_upper(z):
    return 0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2.0))


def normal_quantile(p):
    nd = NormalDist()
    return np.array(
        [
            -math.inf if v <= 0 else math.inf if v >= 1 else nd.inv_cdf(v)
            if v == v
            else math.nan
            for v in np.asarray(p, dtype=float)
        ]
    )


def hypergeom_upper(k, total, marked, drawn):
    """P(X >= k) for X marked items among `drawn` out of `total`."""
    out = []
    for ki, n_all, n_mark, n_draw in zip(k, total, marked, drawn):
        lo = max(0, int(n_draw + n_mark - n_all))
        hi = int(min(n_mark, n_draw))
        ki = max(int(ki), lo)
        if ki > hi:
            out.append(0.0)
            continue
        if ki == lo:
            out.append(1.0)
            continue
        j = np.arange(ki, hi + 1, dtype=float)

        def log_choose(n, r):
            return _lgamma(n + 1.0) - _lgamma(r + 1.0) - _lgamma(n - r + 1.0)

        logs = (
            log_choose(float(n_mark), j)
            + log_choose(float(n_all - n_mark), n_draw - j)
            - log_choose(float(n_all), float(n_draw))
        )
        top = logs.max()
        out.append(float(min(1.0, math.exp(top) * np.exp(logs - top).sum())))
    return np.array(out)


def mann_whitney_exact(u, n1, n2):
    """Two-sided exact p of the U statistic (no ties), by counting arrangements."""
    cache: dict[tuple[int, int], np.ndarray] = {}

    def counts(a: int, b: int) -> np.ndarray:
        if (a, b) not in cache:
            # number of ways to reach each U: product of (1 - q^(b+i)) / (1 - q^i)
            poly = np.zeros(a * b + 1)
            poly[0] = 1.0
            for i in range(1, a + 1):
                step = b + i
                if step <= a * b:
                    poly[step:] = poly[step:] - poly[: len(poly) - step]
                for j in range(i, len(poly)):
                    poly[j] += poly[j - i]
            cache[(a, b)] = poly
        return cache[(a, b)]

    out = []
    for ui, a, b in zip(u, n1, n2):
        if not (ui == ui):
            out.append(math.nan)
            continue
        a, b = int(a), int(b)
        c = counts(min(a, b), max(a, b))
        big = max(ui, a * b - ui)
        tail = c[int(math.ceil(big)) :].sum() / c.sum()
        out.append(float(min(1.0, 2.0 * tail)))
    return np.array(out)


@F.pandas_udf(DoubleType())
def t_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student t p-value."""
    return pd.Series(t_two_sided(t, df))


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    return pd.Series(f_upper(f, d1, d2))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution."""
    return pd.Series(chi2_upper(x, df))


@F.pandas_udf(DoubleType())
def norm_sf2(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value of |z|."""
    return pd.Series(2.0 * normal_upper(np.abs(z.to_numpy(dtype=float)))).clip(upper=1.0)


@F.pandas_udf(DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    """Inverse of the standard normal distribution."""
    return pd.Series(normal_quantile(p))


@F.pandas_udf(DoubleType())
def hypergeom_sf(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    """P(X >= k) of the hypergeometric distribution."""
    return pd.Series(hypergeom_upper(k, total, marked, drawn))


@F.pandas_udf(DoubleType())
def mwu_exact(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Two-sided exact Mann-Whitney p-value, for small groups without ties."""
    return pd.Series(mann_whitney_exact(u, n1, n2))
