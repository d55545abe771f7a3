"""Statistics in closed form, as aggregate expressions over a group: one pass, partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def pearson(a: Column, b: Column) -> Column:
    """Pearson's r over pairs without null; NaN below two pairs, 1 if both are constant, 0 if one is."""
    ok = a.isNotNull() & b.isNotNull()
    a, b = F.when(ok, _d(a)), F.when(ok, _d(b))
    va, vb, n = F.var_pop(a), F.var_pop(b), F.count(a)
    return (
        F.when(n < 2, float("nan")).when((va == 0) & (vb == 0), 1.0).when((va == 0) | (vb == 0), 0.0)
        .otherwise(F.covar_pop(a, b) / F.sqrt(va * vb))
    )


def cohens_d(a: Column, b: Column) -> Column:
    """(mean b - mean a) over the pooled sample deviation; null if either has under two values or nothing varies but means differ."""
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(F.try_divide((na - 1) * F.var_samp(_d(a)) + (nb - 1) * F.var_samp(_d(b)), _d(na + nb - 2)))
    gap = F.avg(b) - F.avg(a)
    return F.when((na < 2) | (nb < 2), F.lit(None)).when(pooled == 0, F.when(gap == 0, 0.0)).otherwise(F.try_divide(gap, pooled))


def paired_dz(delta: Column) -> Column:
    """Mean over sample deviation of paired deltas; null below two or without variation."""
    return F.when(F.count(delta) >= 2, F.try_divide(F.avg(delta), F.stddev_samp(_d(delta))))


def sample_sd(x: Column) -> Column:
    """Sample deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(_d(x)), F.when(F.count(x) == 1, 0.0))


def t_statistic(delta: Column) -> Column:
    return F.when(F.count(delta) >= 2, F.try_divide(F.avg(delta) * F.sqrt(_d(F.count(delta))), F.stddev_samp(_d(delta))))


def welch(a: Column, b: Column) -> dict[str, Column]:
    """Welch's t (b against a) and its degrees of freedom; null below two values each or without variation."""
    na, nb = _d(F.count(a)), _d(F.count(b))
    va, vb = F.try_divide(F.var_samp(_d(a)), na), F.try_divide(F.var_samp(_d(b)), nb)
    t = F.try_divide(F.avg(b) - F.avg(a), F.sqrt(va + vb))
    df = F.try_divide((va + vb) * (va + vb), va * va / (na - 1) + vb * vb / (nb - 1))
    ok = (F.count(a) >= 2) & (F.count(b) >= 2)
    return {"t": F.when(ok, t), "df": F.when(ok, df)}


def doubly_robust(reward: Column, ratio: Column, chosen: Column, target: Column, cap: float = float("inf")) -> dict[str, Column]:
    """Mean of target + weight (reward - chosen) with its error, all values clipped to 0..1; chosen and target are a model's values of
    the action taken and of the policy, and a row without both counts with weight x reward. One without the other is an error."""
    unit = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), _d(x))))
    ok = ratio.isNotNull() & reward.isNotNull()
    w, modelled = F.when(ok, F.least(_d(ratio), F.lit(cap))), chosen.isNotNull() & target.isNotNull()
    lone = F.when(chosen.isNull() != target.isNull(), F.raise_error(F.lit("chosen and target values go together")).cast("double"))
    part = F.coalesce(lone, F.when(modelled, unit(target) + w * (unit(reward) - unit(chosen))).otherwise(w * unit(reward)))
    return {
        "n": F.count(part), "value": F.avg(part), "error": F.sqrt(F.try_divide(F.coalesce(F.var_samp(part), F.lit(0.0)), _d(F.count(part)))),
        "modelled": F.count_if(ok & modelled), "fallback": F.count_if(ok & ~modelled), "ess": F.coalesce(F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)), F.lit(0.0)), "max_weight": F.max(w),
    }


def off_policy(reward: Column, ratio: Column, cap: float = 10.0) -> dict[str, Column]:
    """Inverse propensity and self-normalised estimates with capped weights and rewards clipped to 0..1; rows without either do not count."""
    ok = ratio.isNotNull() & reward.isNotNull()
    w, r = F.when(ok, F.least(ratio, F.lit(cap))), F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _d(reward))))
    n, wr = F.count(w), F.sum(w * r)
    return {
        "n": n,
        "ips": wr / n,
        "ips_se": F.sqrt(F.try_divide(F.var_samp(w * r), _d(n))),
        "snips": F.try_divide(wr, F.sum(w)),
        "ess": F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)),
        "max_weight": F.max(w),
    }
