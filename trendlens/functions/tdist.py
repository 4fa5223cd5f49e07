"""Student-t tail probabilities and quantiles in plain numpy/math.

Used inside tasks that solve small coefficient tables; there is no SQL
function for the t distribution.  The regularised incomplete beta uses the
classic continued fraction evaluated with the modified Lentz method.
"""

from __future__ import annotations

import math

_EPS = 1e-15
_TINY = 1e-300
NORMAL_FROM = 1e7


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        de = d * c
        h *= de
        if abs(de - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
           + a * math.log(x) + b * math.log1p(-x))
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value P(|T| > |t|) for Student t with ``df`` degrees."""
    if t is None or math.isnan(t) or df is None or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    if df > NORMAL_FROM:
        # the incomplete beta cancels for large df; expand about the normal tail
        z = abs(t)
        pdf = math.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
        return min(1.0, math.erfc(z / math.sqrt(2.0)) + pdf * (z + z ** 3) / (2.0 * df))
    x = df / (df + t * t)
    return betainc(df / 2.0, 0.5, x)


def t_cdf(t: float, df: float) -> float:
    p2 = t_sf2(t, df)
    return 1.0 - p2 / 2.0 if t >= 0 else p2 / 2.0


def t_ppf(q: float, df: float) -> float:
    """Quantile of Student t (bisection on the cdf; small tables only)."""
    if df is None or df <= 0 or math.isnan(df):
        return float("nan")
    if q == 0.5:
        return 0.0
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > q:
        lo *= 2.0
    while t_cdf(hi, df) < q:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, df) < q:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-13 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)
