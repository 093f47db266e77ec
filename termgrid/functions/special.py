"""Tails of the normal, chi-squared and Student distributions, and unit-root p-values, in plain Python."""

from __future__ import annotations

import math
from statistics import NormalDist

#: Response surfaces of unit-root tests with a constant (MacKinnon 1994, 2010), fixed values:
#: variables -> (switch, least, largest, coefficients below the switch, above it).
SURFACES = {
    1: (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-2.62, -18.86, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}


def unit_root_p(stat: float, variables: int = 1) -> float:
    switch, least, largest, low, high = SURFACES[variables]
    if stat > largest:
        return 1.0
    if stat < least:
        return 0.0
    return NormalDist().cdf(sum(c * stat**k for k, c in enumerate(low if stat <= switch else high)))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail, by the finite sums for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        term = total = math.exp(-h)
        for k in range(1, df // 2):
            term *= h / k
            total += term
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(h)), math.sqrt(2 * x / math.pi) * math.exp(-h)
    for k in range(3, df + 1, 2):
        total += term
        term *= x / k
    return min(1.0, total)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny, key=abs)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / max(1 + num * d, tiny, key=abs)
            c = max(1 + num / c, tiny, key=abs)
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def correlation_p(rho: float, n: int) -> float | None:
    """Two-sided p of a rank correlation over n pairs."""
    if n < 3 or rho is None:
        return None
    if abs(rho) >= 1:
        return 0.0
    return t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
