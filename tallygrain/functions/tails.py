"""Tail probabilities of the t, normal and chi-square laws for frames with one row per test.

Spark SQL has no error, gamma or beta function. The functions run on the few rows that are left
after aggregation, as Arrow-batched UDFs.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


# Terms after which a continued fraction counts as not converging; it needs about the root of its largest parameter.
MOST_TERMS = 1_000_000
CLOSE = 4e-16


def _log_gamma_ratio(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)); for large ``a`` from the difference of two Stirling series, which keeps its digits."""
    if a < 1e4:
        return math.lgamma(a + b) - math.lgamma(a)

    def rest(z: float) -> float:
        return 1.0 / (12.0 * z) - 1.0 / (360.0 * z**3)

    return (a + b - 0.5) * math.log1p(b / a) + b * math.log(a) - b + rest(a + b) - rest(a)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, MOST_TERMS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) <= CLOSE:
            return value
    raise ArithmeticError(f"The incomplete beta function does not converge for a={a}, b={b}, x={x}")


def incomplete_beta(a: float, b: float, x: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function; ``rest`` is 1 - x where the caller knows it to more digits."""
    rest = 1.0 - x if rest is None else rest
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    log_x = math.log(x) if x < 0.5 else math.log1p(-rest)
    log_rest = math.log(rest) if rest < 0.5 else math.log1p(-x)
    log_front = _log_gamma_ratio(max(a, b), min(a, b)) - math.lgamma(min(a, b)) + a * log_x + b * log_rest
    # Next to 1 the first fraction is a difference of nearly equal numbers, so the second one is taken a little further.
    if x < (a + 1.0) / (a + b + 2.0) and not (a > 1e4 and (a + b) * rest < 20.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, rest) / b


def t_two_sided(statistic: float, df: float) -> float:
    """P(|T| >= |statistic|); keeps tiny values, since no ``1 - cdf`` is taken."""
    if math.isinf(statistic):
        return 0.0
    if math.isinf(df):
        return math.erfc(abs(statistic) / math.sqrt(2.0))
    square = statistic * statistic
    return incomplete_beta(df / 2.0, 0.5, df / (df + square), square / (df + square))


def t_quantile(probability: float, df: float) -> float:
    """Value whose lower tail has the given probability, by bisection."""
    if probability == 0.5:
        return 0.0
    if probability < 0.5:
        return -t_quantile(1.0 - probability, df)
    target = 2.0 * (1.0 - probability)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > target:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if t_two_sided(middle, df) > target:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def normal_quantile(probability: float) -> float:
    """Standard normal quantile, by bisection on the complementary error function."""
    if probability < 0.5:
        return -normal_quantile(1.0 - probability)
    low, high = 0.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if 0.5 * math.erfc(middle / math.sqrt(2.0)) > 1.0 - probability:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def normal_two_sided(z: float) -> float:
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def chi_square_upper(statistic: float, df: float) -> float:
    """P(X >= statistic): series below the mean, continued fraction above it."""
    a, x = df / 2.0, statistic / 2.0
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = value = 1.0 / a
        k = a
        while abs(term) > abs(value) * 1e-17:
            k += 1.0
            term *= x / k
            value += term
        return 1.0 - value * math.exp(log_front)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for i in range(1, MOST_TERMS):
        factor = -i * (i - a)
        b += 2.0
        d = factor * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + factor / c
        c = c if abs(c) > tiny else tiny
        value *= d * c
        if abs(d * c - 1.0) <= CLOSE:
            return math.exp(log_front) * value
    raise ArithmeticError(f"The chi-square tail does not converge for {statistic} at {df} degrees of freedom")


def _map(function, *series: pd.Series) -> pd.Series:
    return pd.Series(
        [None if any(pd.isna(v) for v in row) else function(*row) for row in zip(*series)],
        dtype="float64",
    )


@F.pandas_udf(DoubleType())
def t_p_value(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return _map(t_two_sided, statistic, df)


@F.pandas_udf(DoubleType())
def t_critical(probability: pd.Series, df: pd.Series) -> pd.Series:
    return _map(t_quantile, probability, df)


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return _map(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def chi_square_p_value(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return _map(chi_square_upper, statistic, df)
