"""Special functions in numpy and the standard library."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()
EULER = 0.5772156649015329


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    if p <= 0:
        return -math.inf
    return math.inf if p >= 1 else NORMAL.inv_cdf(p)


def digamma(x):
    """Recurrence up to 10, then the asymptotic series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        shift = np.where(low, shift - 1 / np.where(low, y, 1), shift)
        y = np.where(low, y + 1, y)
    f = 1 / (y * y)
    series = f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f * (1 / 132)))))
    out = shift + np.log(y) - 0.5 / y - series
    return out if out.ndim else float(out)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1) if f != 1.0 else front


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    half = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return half if t > 0 else 1 - half


def erfi(x: float) -> float:
    """Series for moderate arguments, asymptotic expansion beyond."""
    a = abs(x)
    if a < 5:
        total, term, n = a, a, 0
        while abs(term) > 1e-18 * abs(total):
            n += 1
            term *= a * a / n
            total += term / (2 * n + 1)
        return math.copysign(2 / math.sqrt(math.pi) * total, x)
    if a > 26:
        return math.copysign(math.inf, x)
    term, total, n = 1.0, 1.0, 0
    while n < 60:
        n += 1
        nxt = term * (2 * n - 1) / (2 * a * a)
        if nxt > term:
            break
        term = nxt
        total += term
    return math.copysign(math.exp(a * a) / (math.sqrt(math.pi) * a) * total, x)


def binom_cdf(k: int, n: int, p: float) -> float:
    return sum(binom_pmf(i, n, p) for i in range(k + 1))


def binom_pmf(k: int, n: int, p: float) -> float:
    if p in (0.0, 1.0):
        return float(k == (n if p else 0))
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


# Published response surface of the Dickey-Fuller distribution with a constant
# (tau max, tau min, tau star, small-p and large-p polynomials).
DF_MAX, DF_MIN, DF_STAR = 2.74, -18.83, -1.61
DF_SMALL = (2.1659, 1.4412, 0.038269)
DF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_pvalue(tau: float) -> float:
    """p-value of an augmented Dickey-Fuller statistic with a constant."""
    if not math.isfinite(tau):
        return math.nan
    if tau > DF_MAX:
        return 1.0
    if tau < DF_MIN:
        return 0.0
    poly = DF_SMALL if tau <= DF_STAR else DF_LARGE
    return norm_cdf(sum(c * tau**k for k, c in enumerate(poly)))


def ols_t(y: np.ndarray, x: np.ndarray, k: int = 0) -> float:
    """t statistic of coefficient k; nan where the fit is singular or has no residual freedom."""
    n, m = x.shape
    if n <= m:
        return math.nan
    try:
        inv = np.linalg.inv(x.T @ x)
    except np.linalg.LinAlgError:
        return math.nan
    beta = inv @ (x.T @ y)
    resid = y - x @ beta
    var = resid @ resid / (n - m) * inv[k, k]
    return float(beta[k] / math.sqrt(var)) if var > 0 else math.nan


def adf_statistic(y: np.ndarray, lags: int = 1) -> float:
    """Dickey-Fuller t statistic with a constant and so many lagged differences."""
    d = np.diff(y)
    n = len(d) - lags
    if n < 4:
        return math.nan
    cols = [y[lags:-1], np.ones(n)] + [d[lags - k : len(d) - k] for k in range(1, lags + 1)]
    return ols_t(d[lags:], np.column_stack(cols))


def sums_below(y: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """For each place, the sums of terms (rows of an array) over the places before it whose y is smaller.

    Merge counting in n log n steps of arrays: blocks are merged level by level, and in order of y running
    sums of a pair's left block give each value of its right one what lies below it.
    """
    n = len(y)
    _, rank = np.unique(y, return_inverse=True)
    below = np.zeros((len(terms), n))
    width = 1
    while width < n:
        place = np.arange(n)
        left = (place // width) % 2 == 0
        # by pair of blocks, then y; of equal ones those of the right block first, so that they don't count
        at = np.argsort((place // (2 * width) * n + rank) * 2 + left, kind="stable")
        left = left[at]
        run = np.cumsum(np.where(left, terms[:, at], 0.0), axis=1)
        begins = at // (2 * width) * (2 * width)
        base = np.where(begins > 0, run[:, np.maximum(begins - 1, 0)], 0.0)
        below[:, at[~left]] += (run - base)[:, ~left]
        width *= 2
    return below
