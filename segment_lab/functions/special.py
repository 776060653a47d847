"""Distribution tails for the statistics operators (T3, T6), accurate for very large counts.

The incomplete beta function is its leading term times a continued fraction.
The leading term is a binomial probability, computed from Stirling errors and
deviances, so no two huge logarithms are ever subtracted.  These run on one
row per feature or test, inside a pandas UDF.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAX_STEPS = 2_000_000
#: From this many trials on, the middle of the binomial uses its Edgeworth series.
_LARGE_N = 1e8


def _stirling_error(n: float) -> float:
    """log(n!) minus Stirling's formula, for real n > 0."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    r = 1.0 / (n * n)
    return (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / n


def _deviance(x: float, mean: float, above: float) -> float:
    """x log(x / mean) + mean - x, with ``above`` = x - mean given on its own."""
    d = above / (x + mean)
    if abs(d) > 0.1:
        return x * math.log(x / mean) - above
    total, term, k = above * d, 2 * x * d, 1
    while True:
        term *= d * d
        k += 2
        new = total + term / k
        if new == total:
            return total
        total = new


def _leading(a: float, b: float, x: float, y: float) -> float:
    """x**a y**b / (a B(a, b)) with y = 1 - x given on its own."""
    n = a + b
    above = a * y - b * x
    log = (_stirling_error(n) - _stirling_error(a) - _stirling_error(b)
           - _deviance(a, n * x, above) - _deviance(b, n * y, -above))
    return math.exp(log) * math.sqrt(n / (2 * math.pi * a * b)) * b / n


def _fraction(a: float, b: float, x: float, y: float) -> float:
    """The continued fraction of the incomplete beta function, two of its steps taken as one.

    Written in lam = a y - b x, which is at least about zero where the
    fraction is used, the joined denominators are sums of positive terms, so
    nothing cancels when a is huge and x almost 1.
    """
    lam = a * y - b * x
    value = up = (1.0 + lam) / (a + 1.0)
    down = 0.0
    for k in range(1, _MAX_STEPS):
        m = a + 2 * k
        top = (a + k - 1) * (a + b + k - 1) * k * (b - k) * x * x / ((m - 2) * (m - 1) ** 2 * m)
        below = (a * (2 * k + 1) + 3 * k * k + 2 * k + (a + k) * (lam + k * y)) / (m * (m + 1)) + k * (b - k) * x / ((m - 1) * m)
        down = 1.0 / (below + top * down)
        up = below + top / up
        step = up * down
        value *= step
        if abs(step - 1.0) < 4e-16:
            return 1.0 / value
    raise ArithmeticError(f"the tail at a={a}, b={b}, x={x} did not converge")


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularized incomplete beta I_x(a, b); pass y = 1 - x where x is near 1."""
    if x is None or a is None or b is None or any(map(math.isnan, (a, b, x))):
        return float("nan")
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    if a * y > b * x:
        return _leading(a, b, x, y) * _fraction(a, b, x, y)
    return 1.0 - _leading(b, a, y, x) * _fraction(b, a, y, x)


def f_sf(f: float, d1: float, d2: float) -> float:
    """Survival function of the F distribution: P(F' > f)."""
    if f is None or d1 is None or d2 is None or any(map(math.isnan, (f, d1, d2))):
        return float("nan")
    if d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    if d1 == 2:
        return math.exp(-0.5 * d2 * math.log1p(2.0 * f / d2))
    whole = d2 + d1 * f
    return betainc(d2 / 2.0, d1 / 2.0, d2 / whole, d1 * f / whole)


def _half_binomial_middle(k: int, n: int) -> float:
    """P(X <= k) of Binomial(n, 1/2) near its middle: Edgeworth terms of the half-step corrected sum."""
    var = n / 4 - 1 / 12
    l4, l6 = (-n / 8 + 1 / 120) / var ** 2, (n / 4 - 1 / 252) / var ** 3
    z = (k + 0.5 - n / 2) / math.sqrt(var)
    h3 = z ** 3 - 3 * z
    h5 = z ** 5 - 10 * z ** 3 + 15 * z
    h7 = z ** 7 - 21 * z ** 5 + 105 * z ** 3 - 105 * z
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return 0.5 * math.erfc(-z / math.sqrt(2)) - density * (l4 / 24 * h3 + l6 / 720 * h5 + l4 * l4 / 1152 * h7)


def binom_cdf(k: int, n: int, p: float = 0.5) -> float:
    """P(X <= k) of a binomial distribution."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    if p == 0.5 and n >= _LARGE_N and abs(k + 0.5 - n / 2) < 4 * math.sqrt(n):
        return _half_binomial_middle(k, n)
    return betainc(float(n - k), k + 1.0, 1.0 - p, p)


@F.pandas_udf(T.DoubleType())
def f_pvalue_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    out = [f_sf(float(a), float(b), float(c))
           if not (pd.isna(a) or pd.isna(b) or pd.isna(c)) else np.nan
           for a, b, c in zip(f, d1, d2)]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def mcnemar_exact_udf(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact McNemar p-value: min(1, 2 * BinomCDF(min(b, c); b + c, 1/2))."""
    out = []
    for x, y in zip(b, c):
        if pd.isna(x) or pd.isna(y):
            out.append(np.nan)
            continue
        x, y = int(x), int(y)
        n = x + y
        out.append(1.0 if n == 0 else min(1.0, 2.0 * binom_cdf(min(x, y), n, 0.5)))
    return pd.Series(out, dtype="float64")
