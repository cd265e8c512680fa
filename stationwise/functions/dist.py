"""Distribution functions for result tables, as vectorised UDFs.

Only rows of finished tests (one per station and test) pass through here; the
data-sized work stays in built-in expressions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ERFC = np.vectorize(math.erfc, otypes=[float])
_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a, b, x):
    """Regularised incomplete beta by the continued fraction, on arrays."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    if not ok.any():
        return out
    a, b, x = a[ok], b[ok], x[ok]
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_LGAMMA(p + q) - _LGAMMA(p) - _LGAMMA(q) + p * np.log(z) + q * np.log1p(-z))
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for num in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-16):
            break
    part = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h / p))
    out[ok] = np.where(flip, 1 - part, part)
    return out


def gamma_sf(a, x):
    """Upper regularised incomplete gamma on arrays: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    if not ok.any():
        return out
    a, x = a[ok], x[ok]
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(-x + a * np.log(x) - _LGAMMA(a))
    term = 1 / a
    total = term.copy()
    for i in range(1, 1000):
        term = term * x / (a + i)
        total = total + term
    tiny = 1e-300
    b = x + 1 - a
    c = np.full_like(x, 1 / tiny)
    d = 1 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    for i in range(1, 1000):
        num = -i * (i - a)
        b = b + 2
        d = num * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + num / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
    out[ok] = np.where(x == 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h))
    return out


def t_sf_np(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return np.where(np.isnan(t), np.nan, np.where(t >= 0, tail, 1 - tail))


def norm_sf_np(z):
    return 0.5 * _ERFC(np.asarray(z, dtype=float) / math.sqrt(2))


def _bisect(cdf, p, low, high):
    low, high = np.full_like(p, low), np.full_like(p, high)
    for _ in range(200):
        mid = (low + high) / 2
        below = cdf(mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where(np.isnan(p), np.nan, (low + high) / 2)


def norm_ppf_np(p):
    return _bisect(lambda z: 1 - norm_sf_np(z) if np.ndim(z) else z, np.asarray(p, dtype=float), -40.0, 40.0)


def t_ppf_np(p, df):
    df = np.asarray(df, dtype=float)
    return _bisect(lambda t: 1 - t_sf_np(t, df), np.asarray(p, dtype=float), -1e4, 1e4)


def _series(values) -> pd.Series:
    return pd.Series(values).where(~np.isnan(values), None).astype("float64")


@F.pandas_udf(T.DoubleType())
def _t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_sf_np(t, df))


@F.pandas_udf(T.DoubleType())
def _f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    f, d1, d2 = (s.to_numpy(dtype=float) for s in (f, d1, d2))
    return _series(beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))))


@F.pandas_udf(T.DoubleType())
def _chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _series(gamma_sf(df.to_numpy(dtype=float) / 2, np.maximum(x.to_numpy(dtype=float), 0) / 2))


@F.pandas_udf(T.DoubleType())
def _norm_sf(z: pd.Series) -> pd.Series:
    return _series(norm_sf_np(z.to_numpy(dtype=float)))


@F.pandas_udf(T.DoubleType())
def _norm_ppf(p: pd.Series) -> pd.Series:
    return _series(norm_ppf_np(p.to_numpy(dtype=float)))


@F.pandas_udf(T.DoubleType())
def _t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_ppf_np(p.to_numpy(dtype=float), df.to_numpy(dtype=float)))


def _d(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def t_two_sided(t: Column, df) -> Column:
    return F.least(F.lit(1.0), 2 * _t_sf(F.abs(_d(t)), _d(df)))


def norm_two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _norm_sf(F.abs(_d(z))))


def f_sf(f: Column, d1, d2) -> Column:
    return _f_sf(_d(f), _d(d1), _d(d2))


def chi2_sf(x: Column, df) -> Column:
    return _chi2_sf(_d(x), _d(df))


def norm_ppf(p: Column) -> Column:
    return _norm_ppf(_d(p))


def t_ppf(p, df) -> Column:
    return _t_ppf(_d(p), _d(df))
