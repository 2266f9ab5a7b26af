"""Tails of the usual distributions, vectorised over NumPy and as Arrow-batched pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after raising the argument above 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift - np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    s = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + s


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(np.maximum(z, tiny)) + q * np.log1p(-np.minimum(z, 1 - 1e-16))) / p
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h *= d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        got = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - got, got)


def gamma_q(a, x) -> np.ndarray:
    """Upper regularised incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0))
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - log_gamma(a))
        term = total = 1 / a
        for n in range(1, 2000):
            term = term * x / (a + n)
            total = total + term
            if not (np.abs(term / total) >= 1e-16).any():
                break
        low = 1 - front * total
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h *= d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        high = front * h
    return np.where(x <= 0, 1.0, np.where(x < a + 1, low, high))


def t_sf2(t, df) -> np.ndarray:
    """P(|T| >= |t|)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def chi2_sf(x, df) -> np.ndarray:
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def normal_sf2(z) -> np.ndarray:
    """P(|Z| >= |z|)."""
    z = np.asarray(z, float)
    return gamma_q(np.full_like(z, 0.5), z * z / 2)


def t_quantile(p: float, df: float) -> float:
    """By bisection on the tail."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf2(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def ks_sf(d, n_a, n_b) -> np.ndarray:
    """Asymptotic two-sample Kolmogorov-Smirnov tail."""
    n = np.asarray(n_a, float) * np.asarray(n_b, float) / (np.asarray(n_a, float) + np.asarray(n_b, float))
    x = np.asarray(d, float) * np.sqrt(n)
    k = np.arange(1, 101).reshape(-1, *([1] * np.ndim(x)))
    return np.where(x < 0.2, 1.0, np.clip(2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)).sum(0), 0, 1))


def mann_whitney_exact(u: float, n_a: int, n_b: int) -> float:
    """Two-sided exact p without ties: the counts of each U by adding one observation at a time."""
    counts = np.zeros((n_a + 1, n_a * n_b + 1))
    counts[0, 0] = 1.0
    for j in range(1, n_a + n_b + 1):  # rank j is or isn't of the first sample
        for i in range(min(j, n_a), 0, -1):
            shift = j - i
            if shift <= n_b:
                counts[i, shift:] += counts[i - 1, : counts.shape[1] - shift]
    own = counts[n_a] / counts[n_a].sum()
    low = min(u, n_a * n_b - u)
    return min(1.0, 2 * own[: math.floor(low) + 1].sum())


def wilcoxon_exact(w: float, n: int) -> float:
    """Two-sided exact p of the signed-rank sum without ties or zeros."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for r in range(1, n + 1):
        counts[r:] += counts[:-r].copy()
    own = counts / counts.sum()
    low = min(w, n * (n + 1) / 2 - w)
    return min(1.0, 2 * own[: math.floor(low) + 1].sum())


def _guarded(f, *xs: pd.Series) -> pd.Series:
    xs = [x.astype(float) for x in xs]
    ok = np.logical_and.reduce([np.isfinite(x.to_numpy()) for x in xs])
    out = np.full(len(ok), np.nan)
    if ok.any():
        out[ok] = f(*[x.to_numpy()[ok] for x in xs])
    return pd.Series(out)


def _udf(f, n: int):
    def one(a: pd.Series) -> pd.Series:
        return _guarded(f, a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return _guarded(f, a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _guarded(f, a, b, c)

    def apply(*cs) -> Column:
        got = F.pandas_udf((one, two, three)[n - 1], "double")(*[F.col(c) if isinstance(c, str) else c for c in cs])
        return F.when(~F.isnan(got), got)

    return apply


t_two_sided = _udf(t_sf2, 2)
chi2_tail = _udf(chi2_sf, 2)
f_tail = _udf(f_sf, 3)
normal_two_sided = _udf(normal_sf2, 1)
ks_tail = _udf(ks_sf, 3)
