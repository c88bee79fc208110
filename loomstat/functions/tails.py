"""Upper tails of the F, t, chi-squared and normal distributions as Arrow UDFs.

They are meant for rows that aggregates have left - one per feature or pair - so Python never sees
the samples. NULL, NaN and impossible degrees of freedom give NULL; an infinite statistic gives 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    keep = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c = np.ones_like(x)
    d = 1 / keep(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 3000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / keep(1 + numerator * d)
            c = keep(1 + numerator / c)
            step = c * d
            h = h * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    return h


def betainc(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function for 0 <= x <= 1."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    inner = np.clip(x, 1e-320, 1 - 1e-16)
    swap = inner > (a + 1) / (a + b + 2)
    y, p, q = np.where(swap, 1 - inner, inner), np.where(swap, b, a), np.where(swap, a, b)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y))
    low = front * _beta_fraction(y, p, q) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1 - low, low)))


def gammaincc(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularized incomplete gamma function."""
    s, x = (np.asarray(v, float) for v in np.broadcast_arrays(s, x))
    y = np.maximum(x, 1e-300)
    front = np.exp(s * np.log(y) - y - _lgamma(s))
    term = 1 / s
    series, k = term.copy(), s.copy()
    small = y < s + 1
    for _ in range(3000):
        k = k + 1
        term = np.where(small, term * y / k, 0.0)
        series = series + term
        if (term <= series * 1e-17).all():
            break
    b = y + 1 - s
    c, d = np.full_like(y, 1 / _TINY), 1 / np.where(b == 0, _TINY, b)
    h = d.copy()
    for i in range(1, 3000):
        n = -i * (i - s)
        b = b + 2
        d = 1 / np.where(np.abs(n * d + b) < _TINY, _TINY, n * d + b)
        c = np.where(np.abs(b + n / c) < _TINY, _TINY, b + n / c)
        h = h * c * d
        if (small | (np.abs(c * d - 1) < 1e-15)).all():
            break
    return np.where(x <= 0, 1.0, np.where(small, 1 - front * series, front * h))


def f_tail(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f = np.maximum(f, 0)
    share = np.where(np.isinf(f), 0.0, d2 / (d2 + d1 * np.where(np.isinf(f), 1.0, f)))
    return betainc(share, d2 / 2, d1 / 2)


def t_tails(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Both tails."""
    return f_tail(np.asarray(t, float) ** 2, np.ones_like(np.asarray(df, float)), np.asarray(df, float))


def normal_tails(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2))


def t_quantile(p: float, df: float) -> float:
    """The t below which a share ``p`` > 0.5 lies, by bisection."""
    low, high = 0.0, 1e4
    for _ in range(64):
        mid = (low + high) / 2
        low, high = (mid, high) if float(t_tails(np.array([mid]), np.array([df]))[0]) / 2 > 1 - p else (low, mid)
    return (low + high) / 2


def _over(values: tuple[pd.Series, ...], positive: int, run) -> pd.Series:
    """``run`` where nothing is missing and the last ``positive`` arguments are above zero."""
    x = [v.to_numpy(dtype=float, na_value=np.nan) for v in values]
    ok = ~np.logical_or.reduce([np.isnan(v) for v in x])
    for v in x[len(x) - positive :]:
        ok &= v > 0
    out = np.full(len(ok), np.nan)
    if ok.any():
        out[ok] = run(*[v[ok] for v in x])
    return pd.Series([None if v != v else v for v in out], dtype="Float64")


@F.pandas_udf(DoubleType())
def _f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _over((f, d1, d2), 2, f_tail)


@F.pandas_udf(DoubleType())
def _t_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
    return _over((t, df), 1, t_tails)


@F.pandas_udf(DoubleType())
def _chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _over((x, df), 1, lambda v, d: np.where(np.isinf(v), 0.0, gammaincc(d / 2, np.where(np.isinf(v), 1.0, v) / 2)))


@F.pandas_udf(DoubleType())
def _norm_sf2(z: pd.Series) -> pd.Series:
    return _over((z,), 0, normal_tails)


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def f_sf(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    return _f_sf(_double(f), _double(d1), _double(d2))


def t_sf2(t: Column | str, df: Column | str) -> Column:
    return _t_sf2(_double(t), _double(df))


def chi2_sf(x: Column | str, df: Column | str) -> Column:
    return _chi2_sf(_double(x), _double(df))


def norm_sf2(z: Column | str) -> Column:
    return _norm_sf2(_double(z))
