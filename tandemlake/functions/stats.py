"""Tail probabilities of test statistics, for results of a few rows."""

from __future__ import annotations

import math


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) of the chi-square distribution: the regularised upper incomplete gamma function of df / 2 at x / 2."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:  # the lower part as a series
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = z + 1 - a, 1e300  # the upper part as a continued fraction
    d = 1 / b
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def wilcoxon_pvalue(w: float, n: int) -> float:
    """Two-sided, by the normal approximation."""
    if n == 0:
        return 1.0
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return math.erfc(abs(z) / math.sqrt(2))
