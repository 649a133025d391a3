"""Tail probabilities for one-row test results (driver side; a handful of scalars per test)."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _simpson_tail(density, lower: float, upper: float, steps: int = 4000) -> float:
    h = (upper - lower) / steps
    total = density(lower) + density(upper)
    for i in range(1, steps):
        total += density(lower + i * h) * (4 if i % 2 else 2)
    return total * h / 3


def t_two_sided(t: float, df: float) -> float:
    """Two-sided Student p-value by integrating the density in the angle atan(t/sqrt(df))."""
    t = abs(t)
    if not math.isfinite(t):
        return 0.0
    logc = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    angle = math.atan2(t, math.sqrt(df))

    def density(a: float) -> float:
        c = math.cos(a)
        return math.exp(logc + (df - 1) * math.log(c)) if c > 0 else 0.0

    # The mass sits within a few 1/sqrt(df) of the angle for large df.
    upper = min(math.pi / 2, angle + 40 / math.sqrt(df))
    return min(1.0, 2 * _simpson_tail(density, angle, upper))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-square: series for the lower part, continued fraction for the upper part."""
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= y / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = y + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-14:
            break
    return min(1.0, front * h)
