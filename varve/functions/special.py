"""Normal, chi-square and Student-t functions.

``norm_cdf`` and ``norm_pdf`` are Column expressions and stay inside generated code. The
chi-square and t quantiles are only ever needed on reduced tables or as driver scalars, so
they are vectorised NumPy helpers.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of W. J. Cody's rational approximations to erfc (Math. Comp. 1969).
ERFC_SMALL_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERFC_SMALL_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_MID_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
ERFC_MID_DEN = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
ERFC_FAR_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
ERFC_FAR_DEN = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)

# Coefficients of P. J. Acklam's rational approximation to the normal quantile.
PPF_NUM = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0)
PPF_DEN = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
PPF_TAIL_NUM = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0)
PPF_TAIL_DEN = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0, 1.0)
PPF_EDGE = 0.02425

SQRT2 = math.sqrt(2.0)
INV_SQRT_PI = 1.0 / math.sqrt(math.pi)
HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)


def _poly(coefs: tuple[float, ...], x: str) -> str:
    out = f"{coefs[0]!r}D"
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r}D)"
    return out


def norm_cdf(v: str) -> Column:
    """Normal CDF of a column, from erfc with a relative error near 4e-15 on [-8, 8].

    Takes the column's name and hands Spark one SQL text: the expression has hundreds of nodes, and
    a name keeps its argument from being repeated in each of them.
    """
    x = f"(-{v} / {SQRT2!r}D)"
    y = f"abs({x})"
    y2 = f"({x} * {x})"
    inv = f"(1D / {y2})"
    small = f"1D - {x} * {_poly(ERFC_SMALL_NUM, y2)} / {_poly(ERFC_SMALL_DEN, y2)}"
    mid = f"exp(-{y2}) * {_poly(ERFC_MID_NUM, y)} / {_poly(ERFC_MID_DEN, y)}"
    far = f"exp(-{y2}) / {y} * ({INV_SQRT_PI!r}D - {inv} * {_poly(ERFC_FAR_NUM, inv)} / {_poly(ERFC_FAR_DEN, inv)})"
    tail = f"CASE WHEN {y} <= 4D THEN {mid} ELSE {far} END"
    return F.expr(f"0.5D * CASE WHEN {y} <= 0.46875D THEN {small} WHEN {x} < 0D THEN 2D - ({tail}) ELSE {tail} END")


def norm_pdf(v: str) -> Column:
    return F.expr(f"exp(-0.5D * {v} * {v} - {HALF_LOG_2PI!r}D)")


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def norm_ppf_column(p: str) -> Column:
    """Normal quantile of a column, relative error near 1e-9."""
    t = f"sqrt(-2D * ln(least({p}, 1D - {p})))"
    outer = f"{_poly(PPF_TAIL_NUM, t)} / {_poly(PPF_TAIL_DEN, t)}"
    q = f"({p} - 0.5D)"
    r = f"({q} * {q})"
    inner = f"{_poly(PPF_NUM, r)} * {q} / {_poly(PPF_DEN, r)}"
    return F.expr(f"CASE WHEN {p} < {PPF_EDGE}D THEN {outer} WHEN {p} > {1.0 - PPF_EDGE}D THEN -({outer}) ELSE {inner} END")


def _gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    lg = np.vectorize(math.lgamma)(a)
    with np.errstate(all="ignore"):
        front = np.where(x > 0, np.exp(-x + a * np.log(np.where(x > 0, x, 1.0)) - lg), 0.0)
        term = 1.0 / a
        total = term.copy()
        denom = a.copy()
        for _ in range(20000):
            denom = denom + 1.0
            term = term * x / denom
            total = total + term
            if np.all((np.abs(term) <= np.abs(total) * 1e-16) | (x >= a + 1.0)):
                break
        low = total * front
        tiny = 1e-300
        b = x + 1.0 - a
        c = np.full_like(x, 1.0 / tiny)
        d = 1.0 / np.where(b == 0, tiny, b)
        h = d.copy()
        for i in range(1, 20000):
            an = -i * (i - a)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
            if np.all((np.abs(step - 1.0) <= 2.3e-16) | (x < a + 1.0)):
                break
        high = 1.0 - front * h
    return np.where(x <= 0, 0.0, np.where(x < a + 1.0, low, high))


def chi2_ppf(p: np.ndarray | float, df: np.ndarray | float) -> np.ndarray:
    """Chi-square quantile: Newton on the logarithm from Wilson and Hilferty's start, bisection where a step leaves its bracket.

    Values that have settled are set aside, so a value that is slow does not hold up the others.
    """
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    shape, p, a = df.shape, p.ravel(), df.ravel() / 2.0
    lo, hi = np.full(a.shape, -700.0), np.log(a + 50.0 + 20.0 * np.sqrt(a) * 10.0)
    lg = np.array([math.lgamma(v) for v in a])
    z = np.array([norm_ppf(v) if 0.0 < v < 1.0 else 0.0 for v in np.unique(p)])[np.unique(p, return_inverse=True)[1]] if a.size else p
    with np.errstate(all="ignore"):
        root = 1.0 - 1.0 / (9.0 * a) + z / (3.0 * np.sqrt(a))
        u = np.where((root > 0.1) & (a > 0.5), np.log(a) + 3.0 * np.log(np.maximum(root, 0.1)), (np.log(p) + lg + np.log(a)) / a)
    u = np.where((u > lo) & (u < hi), u, 0.5 * (lo + hi))
    out, live = u.copy(), np.arange(a.size)
    for _ in range(200):
        if not live.size:
            break
        x = np.exp(u)
        gap = _gamma_p(a, x) - p
        lo, hi = np.where(gap < 0, u, lo), np.where(gap < 0, hi, u)
        with np.errstate(all="ignore"):
            after = u - gap / np.exp(a * u - x - lg)
        after = np.where((after > lo) & (after < hi), after, 0.5 * (lo + hi))
        after = np.where(gap == 0, u, after)
        done = np.abs(after - u) <= 4e-16 * np.maximum(1.0, np.abs(u))
        out[live] = after
        keep = ~done
        live, p, a, lg, lo, hi, u = live[keep], p[keep], a[keep], lg[keep], lo[keep], hi[keep], after[keep]
    return (2.0 * np.exp(out)).reshape(shape)


def chi2_ppf_column(p: Column, df: Column) -> Column:
    """Chi-square quantile on a reduced table (one row per statistic), Arrow batches; null passes through."""

    @F.pandas_udf("double")
    def _ppf(prob: pd.Series, dof: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=dof.index, dtype=float)
        ok = dof.notna() & (dof > 0) & prob.notna()
        if ok.any():
            out[ok] = chi2_ppf(prob[ok].to_numpy(float), dof[ok].to_numpy(float))
        return out.astype("object").where(ok, None)

    return _ppf(p, df)


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _betainc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 5000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for num in (even, odd):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h


def t_ppf(p: float, df: float) -> float:
    """Student-t quantile by bisection on the incomplete beta form of the CDF."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    upper_tail = lambda t: 0.5 * _betainc(df / 2.0, 0.5, df / (df + t * t))
    lo, hi = 0.0, 1.0
    while upper_tail(hi) > 1.0 - p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if upper_tail(mid) > 1.0 - p else (lo, mid)
    return 0.5 * (lo + hi)
