"""Tail probabilities for the handful of test statistics of a deviance table."""

from __future__ import annotations

import math


def chi_square_tail(x: float, df: float) -> float:
    """Upper tail by the series or the continued fraction of the incomplete gamma."""
    if x <= 0:
        return 1.0
    a, y = df / 2.0, x / 2.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= y / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = y + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1.0)) or tiny)
    h = d
    for m in range(1, 10_000):
        step = h
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1.0 + num * d) or tiny)
            c = (1.0 + num / c) or tiny
            h *= c * d
        if abs(h / step - 1.0) < 1e-15:
            break
    return h


def f_tail(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution by the incomplete beta function."""
    if f <= 0:
        return 1.0
    x, a, b = df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
