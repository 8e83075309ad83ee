"""Distribution functions that reports need, on the driver: a few numbers in, one out."""

from __future__ import annotations

import math
from statistics import NormalDist


def two_sided_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def binomial_two_sided(k: int, n: int) -> float:
    """Exact p-value of the smaller of two counts k of n under p = 1/2."""
    if n == 0:
        return 1.0
    return min(1.0, 2 * math.exp(_log_tail(min(k, n - k), n)))


def _log_tail(k: int, n: int) -> float:
    """log P(X <= k), the terms summed from the largest down."""
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    total, ratio, i = 1.0, 1.0, k
    while i > 0 and ratio > 1e-18:
        ratio *= i / (n - i + 1)
        total += ratio
        i -= 1
    return term + math.log(total)


def chi2_one(x: float) -> float:
    """Upper tail with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0) / 2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function's continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + up / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def pearson_p(r: float | None, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs."""
    if r is None or n < 3:
        return math.nan
    if abs(r) >= 1:
        return 0.0
    return beta((n - 2) / 2, 0.5, 1 - r * r)
