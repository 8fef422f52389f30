"""Special functions: native column expressions where Spark can express them, numpy helpers for Arrow functions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 2.2250738585072014e-308


def ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, brought back by eight factors; 13 digits or more."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    product = F.lit(1.0)
    for k in range(1, 9):
        product = product * (n.cast("double") + k)
    return series - F.log(product)


def clamp_probability(p: Column) -> Column:
    """p kept within (smallest double, 1]."""
    return F.least(F.greatest(p, F.lit(TINY)), F.lit(1.0))


def normal_cdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return 0.5 * math.erfc(-(x - mean) / (sd * math.sqrt(2)))


def normal_quantile(p: float) -> float:
    """The value below which a standard normal falls with probability p, by bisection."""
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if normal_cdf(middle) < p else (low, middle)
    return high


@lru_cache(maxsize=4)
def ln_factorials(n: int) -> np.ndarray:
    """ln 0! .. ln n!."""
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function of positive numbers, by Stirling's series at x + 8."""
    x = np.asarray(x, float)
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - np.log(np.prod([x + k for k in range(8)], axis=0))


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function of whole arrays: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    lead = np.exp(-x + a * np.log(np.maximum(x, TINY)) - ln_gamma(a))
    low = (x > 0) & (x < a + 1)
    if low.any():
        k, v = a[low].copy(), x[low]
        term = 1 / k
        total = term.copy()
        while (np.abs(term) > np.abs(total) * 1e-16).any():
            k = k + 1
            term = term * v / k
            total += term
        out[low] = np.maximum(0.0, 1 - total * lead[low])
    high = x >= a + 1
    if high.any():
        p, b = a[high], x[high] + 1 - a[high]
        c, d = np.full(p.shape, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - p)
            b = b + 2
            d = 1 / _off_zero(an * d + b)
            c = _off_zero(b + an / c)
            h *= d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = h * lead[high]
    return out


def _off_zero(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, 1e-300, x)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of whole arrays by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, v = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inner = (v > 0) & (v < 1)
    v = np.where(inner, v, 0.5)
    lead = np.exp(ln_gamma(p + q) - ln_gamma(p) - ln_gamma(q) + p * np.log(v) + q * np.log1p(-v)) / p
    c, d = np.ones(p.shape), 1 / _off_zero(1 - (p + q) * v / (p + 1))
    h = d.copy()
    for m in range(1, 10_000):
        step = np.ones(p.shape)
        for num in (m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / _off_zero(1 + num * d)
            c = _off_zero(1 + num / c)
            step = d * c
            h = h * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    part = lead * h
    part = np.where(swap, 1 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(inner, part, np.where(swap, 1.0, 0.0))))


def chi2_sf(x, df):
    return gamma_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def f_sf(x, d1, d2):
    x, d1, d2 = (np.asarray(v, float) for v in (x, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_sf(t: float, df: float) -> float:
    p = 0.5 * float(beta_inc(df / 2, 0.5, df / (df + t * t)))
    return p if t >= 0 else 1 - p


def one_sample_t(values: np.ndarray, mean: float, tail: str = "two") -> float:
    """p-value of a one-sample t-test; without spread it is 1 where the means agree in the tail's sense, else the
    smallest positive number."""
    n, m, sd = len(values), float(np.mean(values)), float(np.std(values, ddof=1)) if len(values) > 1 else 0.0
    if sd == 0:
        same = m == mean or (tail == "lower" and m > mean) or (tail == "upper" and m < mean)
        return 1.0 if same else TINY
    t = (m - mean) / (sd / math.sqrt(n))
    return {"two": 2 * t_sf(abs(t), n - 1), "lower": t_sf(-t, n - 1), "upper": t_sf(t, n - 1)}[tail]


def hardy_weinberg_mid_p(n_aa: int, n_ab: int, n_bb: int) -> float:
    """Exact Hardy-Weinberg test, mid-p: probabilities of all heterozygote counts with the same allele counts, by their
    ratios from the middle."""
    n, rare = n_aa + n_ab + n_bb, 2 * min(n_aa, n_bb) + n_ab
    if n == 0 or rare == 0:
        return 1.0
    het = np.arange(rare % 2, min(rare, 2 * n - rare) + 1, 2)
    lg = np.vectorize(math.lgamma)
    hom = (rare - het) / 2
    logs = het * math.log(2) - lg(hom + 1) - lg(het + 1.0) - lg(n - het - hom + 1)
    p = np.exp(logs - logs.max())
    p /= p.sum()
    own = p[int((n_ab - het[0]) // 2)]
    return float(min(1.0, p[p < own * (1 - 1e-9)].sum() + 0.5 * p[np.abs(p - own) <= own * 1e-9].sum()))
