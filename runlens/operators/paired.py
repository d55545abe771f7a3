"""Paired evidence: intervals of risk differences, the Poisson bootstrap, promotion and held-out decisions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import clopper_pearson, normal_quantile, sign_p_value
from ..functions.random import poisson_one, uniform
from ..functions.scores import ratio
from ..scratch import scratch, written
from .quantiles import exact_quantiles

#: Pairs from which the bootstrap may decide; below, the exact sign test does.
BOOTSTRAP_PAIRS = 20
#: Halvings of an interval of length 2 that bring a bound to the last bit of a double.
_HALVINGS = 60


def least_pairs(confidence: float = 0.95) -> int:
    """The fewest pairs of which a one-sided sign test can reject."""
    return math.ceil(math.log2(2 / (1 - confidence)))


def binary_scale(*values: Column) -> Column:
    """Aggregate: the one positive level if every value is 0 or that level; null if there are others, none, or values that are no finite numbers."""
    bad = F.lit(False)
    low, high = [], []
    for v in values:
        x = v.cast("double")
        bad = bad | F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0), F.lit(True))
        low.append(F.min(F.when(x > 0, x)))
        high.append(F.max(F.when(x > 0, x)))
    least, most = (low[0], high[0]) if len(values) == 1 else (F.least(*low), F.greatest(*high))
    return F.when(~F.bool_or(bad) & (least == most), least)


def _score(b: Column, c: Column, n: Column, delta: Column) -> Column:
    """The score statistic of a risk difference delta, its variance at the loss rate that is likeliest under delta."""
    linear = delta * (b + 3 * c + 2 * (n - b - c)) - (b + c)
    inner = linear * linear + 8 * n * c * delta * (1 - delta)
    loss = (F.sqrt(F.greatest(inner, F.lit(0.0))) - linear) / (4 * n)
    loss = F.least(F.greatest(loss, F.lit(0.0), -delta), F.greatest(F.lit(0.0), (1 - delta) / 2))
    variance, gap = n * (2 * loss + delta * (1 - delta)), b - c - n * delta
    edge = F.when(gap == 0, 0.0).otherwise(F.signum(gap) * float("inf"))
    return F.when(variance > 0, gap / F.sqrt(F.greatest(variance, F.lit(1e-300)))).otherwise(edge)


def score_interval(b: Column, c: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Tango's interval of the paired risk difference of b won and c lost of n pairs, by halving; -1 and 1 for no pairs. It holds at any margin."""
    z = normal_quantile(1 - (1 - confidence) / 2)
    b, c, n = (x.cast("double") for x in (b, c, n))
    middle = (b - c) / n

    def bound(start: Column, end: Column, level: float) -> Column:
        first = F.struct(start.alias("lo"), end.alias("hi"))

        def halve(at: Column, _: Column) -> Column:
            mid = (at["lo"] + at["hi"]) / 2
            above = _score(b, c, n, mid) > level
            return F.struct(F.when(above, mid).otherwise(at["lo"]).alias("lo"), F.when(above, at["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), first, halve, lambda at: (at["lo"] + at["hi"]) / 2)

    some = n > 0
    return F.when(some, bound(F.lit(-1.0), middle, z)).otherwise(-1.0), F.when(some, bound(middle, F.lit(1.0), -z)).otherwise(1.0)


def exact_interval(b: Column, c: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """The interval of the paired risk difference given the number of pairs that differ: excludes 0 just when the exact sign test rejects. 0 and 0 for none that differ."""

    def bounds(b: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(x), int(y), confidence) if y else (0.5, 0.5) for x, y in zip(b, m, strict=True)], columns=["low", "high"])

    found = F.pandas_udf(bounds, "low double, high double")(b.cast("long"), (b + c).cast("long"))
    scale = F.coalesce(ratio(b + c, n), F.lit(0.0))
    return F.greatest(F.lit(-1.0), (2 * found["low"] - 1) * scale), F.least(F.lit(1.0), (2 * found["high"] - 1) * scale)


def paired_risk(pairs: DataFrame, group: str, before: Column, after: Column, confidence: float = 0.95) -> DataFrame:
    """group, n, won, lost, scale, difference, statistic, p, exact_low, exact_high, score_low, score_high: of paired outcomes, positive being a success.

    scale is the positive level of outcomes with two values, else null. statistic is McNemar's with continuity, p the
    exact sign test's; intervals and difference are of success rates. Pairs with a null side do not count.
    """
    rows = pairs.select(group, before.cast("double").alias("_x"), after.cast("double").alias("_y")).where("_x is not null and _y is not null")
    x, y = F.col("_x"), F.col("_y")
    out = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((y > 0) & ~(x > 0)).alias("won"), F.count_if((x > 0) & ~(y > 0)).alias("lost"), binary_scale(x, y).alias("scale")
    )
    b, c, n = F.col("won"), F.col("lost"), F.col("n")
    gap = F.abs(b - c) - 1
    exact, score = exact_interval(b, c, n, confidence), score_interval(b, c, n, confidence)
    return out.withColumns({
        "difference": ratio(b - c, n), "statistic": F.coalesce(ratio(gap * gap, b + c), F.lit(0.0)), "p": sign_p_value("won", b + c),
        "exact_low": exact[0], "exact_high": exact[1], "score_low": score[0], "score_high": score[1],
    })


def poisson_bootstrap(rows: DataFrame, group: str | Sequence[str], key: Column, value: Column, resamples: int = 200, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """group, n, mean, low, high: percentile interval of the mean, every row counted a Poisson number of times in each resample.

    The number depends on the row's integer key and the resample alone, and a resample is a sum, so partial
    sums merge and no group meets in one task; rows with equal keys are counted alike. Resamples that drew
    nothing drop out. Values that are null do not count; bounds are the sorted means at floor(a B) and ceil((1 - a) B) - 1.
    """
    by = [group] if isinstance(group, str) else list(group)
    own = rows.select(*by, key.cast("long").alias("_key"), value.cast("double").alias("_v")).where("_v is not null")
    drawn = own.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = drawn.withColumn("_w", poisson_one(uniform(F.col("_key"), F.col("_b"), seed)))
    sums = drawn.groupBy(*by, "_b").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_n")).where("_n > 0")
    tail = (1 - confidence) / 2
    means = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.col("_s") / F.col("_n"))).alias("_m"))  # as many as resamples
    size = F.size("_m")
    low = F.floor(tail * size).cast("int")
    high = F.greatest(F.least(size - 1, (F.ceil((1 - tail) * size) - 1).cast("int")), low)
    plain = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    joined = plain.join(means, by, "left")
    one = F.col("n") == 1
    return joined.select(*by, "n", "mean", F.when(one, F.col("mean")).otherwise(F.get("_m", low)).alias("low"), F.when(one, F.col("mean")).otherwise(F.get("_m", high)).alias("high"))


def paired_bootstrap(pairs: DataFrame, group: str, key: Column, before: Column, after: Column, **options) -> DataFrame:
    """poisson_bootstrap() of the paired differences, and `tied`, the share of pairs without one."""
    d = (after - before).cast("double")
    out = poisson_bootstrap(pairs, group, key, d, **options)
    return out.join(pairs.groupBy(group).agg(F.avg((d == 0).cast("int")).alias("tied")), group)


def arm_bootstrap(rows: DataFrame, group: str, key: Column, arm: Column, value: Column, resamples: int = 200, confidence: float = 0.95, seed: int = 0, least: int = 6) -> DataFrame:
    """group, mean_a, mean_b, delta, low, high, verdict: two independent arms (arm true is the candidate's).

    ADVANCE if the interval of the difference of means lies above 0, REVERT below, KEEP around it with delta 0
    or more; INCONCLUSIVE with fewer than `least` rows, an empty arm, or an interval that is a point.
    """
    own = rows.select(F.col(group).alias("_g"), key.cast("long").alias("_key"), F.coalesce(arm, F.lit(False)).alias("_arm"), value.cast("double").alias("_v")).where("_v is not null")
    drawn = own.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("_w", poisson_one(uniform(F.col("_key"), F.col("_b"), seed)))
    side = lambda on, x: F.sum(F.when(on, x))
    b = F.col("_arm")
    sums = drawn.groupBy("_g", "_b").agg((ratio(side(b, F.col("_w") * F.col("_v")), side(b, F.col("_w"))) - ratio(side(~b, F.col("_w") * F.col("_v")), side(~b, F.col("_w")))).alias("_d"))
    tail = (1 - confidence) / 2
    ends = sums.where("_d is not null").groupBy("_g").agg(F.array_sort(F.collect_list("_d")).alias("_m"))
    plain = own.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(~b, F.col("_v"))).alias("mean_a"), F.avg(F.when(b, F.col("_v"))).alias("mean_b"))
    size = F.size("_m")
    bound = lambda at: F.get("_m", F.greatest(F.lit(0), F.least(size - 1, at.cast("int"))))
    out = plain.join(ends, "_g", "left").withColumns({"delta": F.col("mean_b") - F.col("mean_a"), "low": bound(F.floor(tail * size)), "high": bound(F.floor((1 - tail) * size) - 1)})
    open_ = (F.col("n") < least) | F.col("delta").isNull() | F.col("low").isNull()
    bare = open_ | (F.col("low") == F.col("high"))
    verdict = F.when(bare, "INCONCLUSIVE").when(F.col("low") > 0, "ADVANCE").when(F.col("high") < 0, "REVERT").when(F.col("delta") >= 0, "KEEP").otherwise("INCONCLUSIVE")
    infinite = float("inf")
    return out.select(F.col("_g").alias(group), "mean_a", "mean_b", "delta", F.when(open_, -infinite).otherwise(F.col("low")).alias("low"), F.when(open_, infinite).otherwise(F.col("high")).alias("high"), verdict.alias("verdict"))


def _one_sided(won: Column, of: Column) -> Column:
    """Chance of so many or more of `of` fair trials: the sign test against chance. Terms are added from the far end, each from the one before."""

    def p(w: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for k, n in zip(w, m, strict=True):
            k, n = int(k), int(n)
            out.append(min(1.0, sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k, n + 1))) if k else 1.0)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(p, "double")(won.cast("long"), of.cast("long"))


def decide(pairs: DataFrame, group: str, key: Column, before: Column, after: Column, threshold: float = 0.0, confidence: float = 0.95, min_pairs: int | None = None, resamples: int = 200, seed: int = 0) -> DataFrame:
    """group, n, scale, tied, statistic, method, delta, low, high, p, sufficient, indeterminate, vetoed, clears, promote.

    Outcomes of two values are decided by the score interval of their risk difference (in the outcomes' own units),
    and at a threshold of 0 or more only if the exact test rejects too; others by the bootstrap of the mean
    difference from BOOTSTRAP_PAIRS pairs on, below by the exact sign test of differences above the threshold.
    An interval that is a point says nothing. p is McNemar's or the sign test's, null where the bootstrap decides.
    """
    with scratch() as kept:
        least = max(min_pairs or 0, least_pairs(confidence))
        x, y = before.cast("double"), after.cast("double")
        pairs = written(pairs.select(group, key.cast("long").alias("_key"), x.alias("_x"), y.alias("_y")).where("_x is not null and _y is not null"), "pairs")
        d = F.col("_y") - F.col("_x")
        boot = paired_bootstrap(pairs, group, F.col("_key"), F.col("_x"), F.col("_y"), resamples=resamples, confidence=confidence, seed=seed)
        risk = paired_risk(pairs, group, F.col("_x"), F.col("_y"), confidence).select(group, "scale", "difference", "p", "score_low", "score_high")
        signs = pairs.groupBy(group).agg(F.count_if(d - threshold > 0).alias("_up"), F.count_if(d - threshold != 0).alias("_of"))
        out = boot.join(risk, group).join(signs, group)
        two, few = F.col("scale").isNotNull(), F.col("n") < BOOTSTRAP_PAIRS
        pick = lambda a, b: F.when(two, a).otherwise(b)
        scaled = lambda c: F.col(c) * F.col("scale")
        sign_p = _one_sided(F.col("_up"), F.col("_of"))
        # fixed values: the names of statistics and methods
        out = out.withColumns({
            "statistic": pick(F.lit("paired_risk_difference"), F.lit("mean_bootstrap")), "method": pick(F.lit("score-interval"), F.when(few, "exact-sign").otherwise("bootstrap-ci")),
            "delta": pick(scaled("difference"), F.col("mean")), "low": pick(scaled("score_low"), F.col("low")), "high": pick(scaled("score_high"), F.col("high")),
            "p": pick(F.col("p"), F.when(few, sign_p)), "sufficient": F.col("n") >= least,
        })
        out = out.withColumn("indeterminate", F.coalesce(F.col("low") == F.col("high"), F.lit(True)))
        by_sign = (F.col("delta") > threshold) & (F.col("p") <= (1 - confidence) / 2)
        guarded = F.col("sufficient") & ~F.col("indeterminate")
        clears = pick(F.col("low") > threshold, guarded & F.when(few, by_sign).otherwise(F.col("low") > threshold))
        vetoed = two & F.lit(threshold >= 0) & ~(F.col("p") < 1 - confidence)
        out = out.withColumns({"clears": F.coalesce(clears, F.lit(False)), "vetoed": F.coalesce(vetoed, F.lit(False))})
        columns = [group, "n", "scale", "tied", "statistic", "method", "delta", "low", "high", "p", "sufficient", "indeterminate", "vetoed", "clears"]
        kept.append(written(out.select(*columns, (guarded & F.col("clears") & ~F.col("vetoed")).alias("promote")), "decisions"))
    return kept[0]


def held_out_gate(
    pairs: DataFrame, group: str, split: str, key: Column, before: Column, after: Column, in_before: Column, in_after: Column, cost_before: Column, cost_after: Column,
    threshold: float = 0.0, overfit: float = 0.15, coverage: float = 1.0, min_pairs: int = 3, ceiling: float | None = None, **options,
) -> DataFrame:
    """group, n, search, holdout, gap, baseline_gap, coverage_search, coverage_holdout, cost, baseline_cost, delta, low, high, promote, code.

    Pairs are the full match of a baseline's (before) and a candidate's (after) honest runs on both splits, `search`
    and `holdout`; in_before and in_after tell which side has a run, its score may be missing. code is the first
    reason to refuse: missing_split_scores, incomplete_coverage, few_runs, indeterminate_delta, negative_delta,
    overfit_gap, missing_cost, cost_ceiling; null if the candidate is promoted. Costs are medians over the pairs
    that were scored on both sides, null if any of them has none.
    """
    with scratch() as kept:
        finite = lambda c: F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), c.cast("double"))
        rows = written(pairs.select(
            group, F.col(split).alias("_split"), key.cast("long").alias("_key"), finite(before).alias("_x"), finite(after).alias("_y"), F.coalesce(in_before, F.lit(False)).alias("_a"), F.coalesce(in_after, F.lit(False)).alias("_b"),
            cost_before.cast("double").alias("_ca"), cost_after.cast("double").alias("_cb"),
        ), "gate")
        both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
        on = lambda s: F.col("_split") == s
        mean = lambda c, s: F.avg(F.when(on(s) & both, F.col(c)))
        share = lambda s: F.coalesce(ratio(F.count_if(on(s) & both), F.count_if(on(s) & (F.col("_a") | F.col("_b")))), F.lit(0.0))
        decided = both & F.col("_split").isin("search", "holdout")
        out = rows.groupBy(group).agg(
            F.count_if(on("holdout") & both).alias("n"), mean("_y", "search").alias("search"), mean("_y", "holdout").alias("holdout"),
            (mean("_y", "search") - mean("_y", "holdout")).alias("gap"), (mean("_x", "search") - mean("_x", "holdout")).alias("baseline_gap"),
            share("search").alias("coverage_search"), share("holdout").alias("coverage_holdout"),
            *(F.count_if(decided & F.col(c).isNull()).alias(f"_no{c}") for c in ("_ca", "_cb")),
            F.least(*(F.count(F.when(on(s), F.col(c))) for s in ("search", "holdout") for c in ("_x", "_y"))).alias("_least"),
        )
        medians = [exact_quantiles(rows.where(decided), group, c, [0.5]).select(group, F.get("q", F.lit(0)).alias(f"_m{c}")) for c in ("_ca", "_cb")]
        for m in medians:
            out = out.join(m, group, "left")
        out = out.withColumns({"cost": F.when(F.col("_no_cb") == 0, F.col("_m_cb")), "baseline_cost": F.when(F.col("_no_ca") == 0, F.col("_m_ca"))})
        least = max(min_pairs, least_pairs(options.get("confidence", 0.95)))
        told = decide(rows.where(on("holdout")), group, F.col("_key"), F.col("_x"), F.col("_y"), threshold, min_pairs=least, **options)
        out = out.join(told.select(group, "delta", "low", "high", "indeterminate", "clears", "vetoed"), group, "left")
        short = (F.col("coverage_search") < coverage) | (F.col("coverage_holdout") < coverage)
        # fixed values: the codes of refusals
        code = (
            F.when(F.col("_least") == 0, "missing_split_scores").when(short, "incomplete_coverage").when(F.col("n") < least, "few_runs").when(F.col("indeterminate"), "indeterminate_delta")
            .when(~F.col("clears") | F.col("vetoed"), "negative_delta").when(F.col("gap") > F.col("baseline_gap") + overfit, "overfit_gap")
        )
        if ceiling is not None:
            code = code.when(F.col("cost").isNull(), "missing_cost").when(F.col("cost") > ceiling, "cost_ceiling")
        names = [group, "n", "search", "holdout", "gap", "baseline_gap", "coverage_search", "coverage_holdout", "cost", "baseline_cost", "delta", "low", "high"]
        kept.append(written(out.withColumn("code", code).select(*names, F.col("code").isNull().alias("promote"), "code"), "gates"))
    return kept[0]
