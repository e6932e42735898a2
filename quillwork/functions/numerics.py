"""Tail probabilities without a statistics library: driver-side scalars on small aggregates."""

from __future__ import annotations

import math

_TINY = 1e-300


def _fraction_beta(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the front."""
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or _TINY)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + top * d or _TINY)
            c = 1 + top / c or _TINY
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return total


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction_beta(a, b, x) / a
    return 1 - front * _fraction_beta(b, a, 1 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    """P(X > x) for chi-squared."""
    return gammaincc(df / 2, x / 2)


def norm_sf(z: float) -> float:
    """P(Z > z) for the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return betainc(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation by the t approximation; NaN below three points."""
    if n < 3:
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    return t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def hypergeom_sf(k: int, total: int, marked: int, drawn: int) -> float:
    """P(at least ``k`` of ``drawn`` are marked), ``marked`` of ``total`` being so."""

    def choose(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1) if 0 <= r <= n else -math.inf

    whole = choose(total, drawn)
    return min(1.0, math.fsum(math.exp(choose(marked, i) + choose(total - marked, drawn - i) - whole) for i in range(max(k, 0), min(marked, drawn) + 1) if drawn - i <= total - marked))


def holm(p_values: list[float]) -> list[float]:
    """Step-down adjusted p-values in the given order."""
    order = sorted(range(len(p_values)), key=p_values.__getitem__)
    out, worst = [0.0] * len(p_values), 0.0
    for i, k in enumerate(order):
        worst = max(worst, min(1.0, (len(p_values) - i) * p_values[k]))
        out[k] = worst
    return out
