"""Tail probabilities, from public closed forms (no statistics library is assumed)."""

from __future__ import annotations

import math

TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > TINY else TINY)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > TINY else TINY)
            c = 1.0 + top / c
            c = c if abs(c) > TINY else TINY
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p_value(r: float | None, n: float | None) -> float | None:
    """Two-sided p of Pearson's r under independence."""
    if r is None or n is None or r != r or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    freedom = n - 2.0
    return beta_cdf(1.0 - r * r, freedom / 2.0, 0.5)


def binomial_tails(hits: int, trials: int, p: float = 0.5) -> tuple[float, float]:
    """(P[X >= hits], P[X <= hits])."""
    upper = 1.0 if hits <= 0 else beta_cdf(p, hits, trials - hits + 1)
    lower = 1.0 if hits >= trials else 1.0 - beta_cdf(p, hits + 1, trials - hits)
    return upper, lower
