"""Distribution functions and resampling for Arrow UDFs: they see a row per group, never the rows of a group but where stated."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By bisection on the CDF, to 1e-12."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5) if p in (0, 1) else math.nan
    low, high = -40.0, 40.0
    while high - low > 1e-12:
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def student_t_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def binomial_two_sided(b: int, n: int) -> float:
    """Exact two-sided p of b successes in n fair trials, 1 for none."""
    if n == 0:
        return 1.0
    k = min(b, n - b)
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
    return min(1.0, 2 * tail)


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """The exact interval of a proportion, by bisection on the beta distribution."""
    def solve(a: float, b: float, p: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if incomplete_beta(a, b, mid) < p else (low, mid)
        return (low + high) / 2

    tail = (1 - confidence) / 2
    return (0.0 if k == 0 else solve(k, n - k + 1, tail)), (1.0 if k == n else solve(k + 1, n - k, 1 - tail))


def _z(alpha: float, power: float, two_sided: bool) -> tuple[float, float]:
    return normal_quantile(1 - alpha / 2 if two_sided else 1 - alpha), normal_quantile(power)


def required_n(effect: Column, alpha: float = 0.05, power: float = 0.8, two_sided: bool = True, paired: bool = False) -> Column:
    """Sample size for each arm, or of pairs, that shows a standardised effect; infinite for none."""
    a, b = _z(alpha, power, two_sided)
    n = F.ceil((1 if paired else 2) * F.pow(F.try_divide(F.lit(a + b), effect), F.lit(2.0))).cast("double")
    return F.when(effect > 0, n).otherwise(float("inf"))


def paired_mde(pairs: Column, alpha: float = 0.05, power: float = 0.8, two_sided: bool = True) -> Column:
    """The least standardised effect that so many pairs show; infinite for none."""
    a, b = _z(alpha, power, two_sided)
    return F.when(pairs > 0, F.try_divide(F.lit(a + b), F.sqrt(pairs.cast("double")))).otherwise(float("inf"))


def mcnemar_n(p10: Column, p01: Column, alpha: float = 0.05, power: float = 0.8, two_sided: bool = True) -> Column:
    """Pairs that show a difference of discordant shares; infinite for equal ones, null for shares that are none."""
    a, b = _z(alpha, power, two_sided)
    gap, both = p10 - p01, p10 + p01
    n = F.pow(a * F.sqrt(both) + b * F.sqrt(F.greatest(F.lit(0.0), both - gap * gap)), F.lit(2.0))
    return F.when((p10 < 0) | (p01 < 0) | (both > 1), None).when(gap == 0, float("inf")).otherwise(F.ceil(F.try_divide(n, gap * gap)).cast("double"))


def mcnemar_power(p10: Column, p01: Column, pairs: Column, alpha: float = 0.05, two_sided: bool = True) -> Column:
    """Chance that so many pairs show the difference of discordant shares; alpha for none."""
    a, _ = _z(alpha, 0.5, two_sided)
    gap, both = p10 - p01, p10 + p01
    z = (F.sqrt(pairs.cast("double")) * F.abs(gap) - a * F.sqrt(both)) / F.sqrt(F.greatest(F.lit(1e-12), both - gap * gap))
    cdf = F.pandas_udf(lambda s: pd.Series([None if math.isnan(v) else normal_cdf(v) for v in s.astype(float)], dtype="float64"), DoubleType())
    return F.when((p10 < 0) | (p01 < 0) | (both > 1), None).when((gap == 0) | (pairs <= 0), F.lit(alpha)).otherwise(cdf(z))


def signed_rank_exact(doubled: list[int], deviation: float) -> float:
    """Exact two-sided p of a signed rank sum: the share of sign patterns whose doubled sum lies so far from its centre or farther."""
    ways = np.zeros(sum(doubled) + 1)
    ways[0] = 1
    for r in doubled:
        ways[r:] += ways[: len(ways) - r].copy()
    far = np.abs(np.arange(len(ways)) - sum(doubled) / 2) >= deviation - 1e-9
    return min(1.0, float(ways[far].sum() / ways.sum()))


def _signed_rank_p(ranks: pd.Series, deviation: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else signed_rank_exact([round(x) for x in r], d) for r, d in zip(ranks, deviation, strict=True)], dtype="float64")


def signed_rank_p_value(doubled: Column, deviation: Column) -> Column:
    """signed_rank_exact() of an array of doubled ranks; null where that is."""
    return F.pandas_udf(_signed_rank_p, DoubleType())(doubled, deviation)


def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    pairs = zip(t.astype(float), df.astype(float), strict=True)
    return pd.Series([None if math.isnan(x) or math.isnan(d) else 2 * (1 - student_t_cdf(abs(x), d)) for x, d in pairs], dtype="float64")


def _normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([None if math.isnan(x) else 2 * (1 - normal_cdf(abs(x))) for x in z.astype(float)], dtype="float64")


def _sign_p(b: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided(int(x), int(m)) for x, m in zip(b, n, strict=True)], dtype="float64")


def _rank_p(u: pd.Series, n: pd.Series, m: pd.Series, times: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else mann_whitney_exact(x, int(a), int(b), [int(v) for v in t]) for x, a, b, t in zip(u, n, m, times, strict=True)], dtype="float64")


def rank_p_value(u: Column, n: Column, m: Column, times: Column) -> Column:
    """Exact two-sided p of the rank sum statistic u of samples of n and m whose values, in order, occur so many times; null where times is."""
    return F.pandas_udf(_rank_p, DoubleType())(u, n, m, times)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided; null where t or df is."""
    return F.pandas_udf(_t_p, DoubleType())(t, df)


def normal_p_value(z: Column) -> Column:
    """Two-sided; null where z is."""
    return F.pandas_udf(_normal_p, DoubleType())(z)


def sign_p_value(b: Column, n: Column) -> Column:
    """Exact two-sided sign test of b in n."""
    return F.pandas_udf(_sign_p, DoubleType())(b, n)


def mann_whitney_exact(u: float, n: int, m: int, times: list[int] | None = None) -> float:
    """Exact two-sided p of U: the share of the ways to deal the pooled values to samples of n and m whose U lies as far from its centre or farther.

    `times` says how often each value occurs, in order; without it none occurs twice. Ways are counted by the
    number dealt to the second sample and its doubled U, value by value.
    """
    times = [1] * (n + m) if times is None else times
    if m > n:  # the smaller sample makes the smaller table
        u, n, m = n * m - u, m, n
    ways = np.zeros((m + 1, 2 * n * m + 1))
    ways[0, 0] = 1
    seen = 0
    for t in times:
        new = np.zeros_like(ways)
        for had in range(min(m, seen) + 1):
            row = ways[had]
            if not row.any():
                continue
            before = seen - had  # of the first sample, below this value
            for k in range(max(0, t - (n - before)), min(t, m - had) + 1):
                step = k * (2 * before + (t - k))
                new[had + k, step:] += math.comb(t, k) * row[: len(row) - step]
        ways, seen = new / new.sum(), seen + t
    far = np.abs(np.arange(2 * n * m + 1) - n * m) >= abs(2 * u - n * m) - 1e-9
    return min(1.0, float(ways[m][far].sum() / ways[m].sum()))
