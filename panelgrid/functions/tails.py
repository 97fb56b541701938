"""Tail probabilities and quantiles, for which Spark has no function: Arrow-batched UDFs over NumPy."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by modified Lentz steps."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            c = 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def normal_two_sided(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2))


def student_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


def student_upper(t: float, df: float) -> float:
    p = student_two_sided(t, df) / 2
    return p if t >= 0 else 1 - p


def student_inverse(p: float, df: float) -> float:
    """The p quantile of Student's t: Newton steps on the distribution, kept inside a bracket that halves where a step would leave it."""
    if not 0 < p < 1 or df <= 0:
        return math.copysign(math.inf, p - 0.5) if p in (0, 1) and df > 0 else math.nan
    if p == 0.5:
        return 0.0
    upper, low, high = min(p, 1 - p), 0.0, 1.0  # of the upper tail; the lower one is its mirror image
    while student_upper(high, df) > upper:
        low, high = high, 2 * high
    log_peak = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    t = (low + high) / 2
    for _ in range(200):
        miss = student_upper(t, df) - upper
        low, high = (t, high) if miss > 0 else (low, t)
        step = t + miss / math.exp(log_peak - (df + 1) / 2 * math.log1p(t * t / df))
        new = step if low < step < high else (low + high) / 2
        if abs(new - t) <= 1e-15 * max(1.0, abs(t)):
            t = new
            break
        t = new
    return math.copysign(t, p - 0.5)


def _or_none(f, *xs):
    return None if any(x is None or math.isnan(x) for x in xs) else f(*xs)


def _udf(f):
    """A column function of f over doubles: null where an argument is null."""

    def run(*columns: Column | str) -> Column:
        def batch(*xs: pd.Series) -> pd.Series:
            return pd.Series([_or_none(f, *x) for x in zip(*xs, strict=True)], dtype="float64")

        one = pandas_udf(lambda a: batch(a), "double") if len(columns) == 1 else pandas_udf(lambda a, b: batch(a, b), "double")  # noqa: PLW0108
        return one(*columns)

    return run


def _quantile(p: float) -> float:
    return NormalDist().inv_cdf(p) if 0 < p < 1 else math.copysign(math.inf, p - 0.5)


#: Two-sided p-values of a normal (t) and of Student's t (t, df); the normal's cdf and quantile; log gamma.
p_normal, p_student = _udf(normal_two_sided), _udf(student_two_sided)
normal_cdf, normal_quantile, log_gamma = _udf(NormalDist().cdf), _udf(_quantile), _udf(math.lgamma)
#: Quantile of Student's t (p, df).
student_quantile = _udf(student_inverse)
