"""Views for judges, curricula, frontiers and releases."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import moments
from ..functions.distributions import incomplete_beta
from ..functions.random import uniform
from ..functions.scores import ratio
from .ordered import ks_distance
from .quantiles import exact_quantiles


def positional_bias(scores: DataFrame, item: str, position: Column, score: Column) -> DataFrame:
    """One row: items seen in both positions and the mean of first less second."""
    by = scores.groupBy(item).agg(F.avg(F.when(position == 1, score)).alias("a"), F.avg(F.when(position == 2, score)).alias("b"))
    return by.where("a is not null and b is not null").agg(F.count(F.lit(1)).alias("items"), F.avg(F.col("a") - F.col("b")).alias("bias"))


def verbosity_bias(samples: DataFrame, group: str, length: Column, score: Column) -> DataFrame:
    """group, n, r of length and score; NaN below three samples."""
    r = F.when(F.count(F.lit(1)) < 3, float("nan")).otherwise(moments.pearson(length, score))
    return samples.groupBy(group).agg(F.count(F.lit(1)).alias("n"), r.alias("r"))


def self_preference(samples: DataFrame, own: Column, score: Column) -> DataFrame:
    """One row: means of own and other families and their gap."""
    a, b = F.avg(F.when(own, score)), F.avg(F.when(~own, score))
    return samples.agg(a.alias("own"), b.alias("others"), (a - b).alias("gap"))


def curriculum(runs: DataFrame, cells: DataFrame, cell: Sequence[str], score: Column, budget: int, floor: int = 1, prior: float = 0.05) -> DataFrame:
    """cell, n, weight, share: how a budget of further runs is dealt to the candidate cells, observed or not.

    weight = sqrt(variance + prior) + 1/sqrt(max(1, n)), with the sample variance, or the prior alone below
    two observations. Each cell gets `floor` and its rounded share of the rest. Where the floors alone use
    up the budget, each gets an equal part of it, 1 at least.
    """
    by = runs.groupBy(*cell).agg(F.count(score).alias("n"), F.var_samp(score).alias("v"))
    rows = cells.select(*cell).join(by, list(cell), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    variance = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("v")) + prior
    rows = rows.withColumn("weight", F.sqrt(variance) + 1 / F.sqrt(F.greatest(F.col("n"), F.lit(1)).cast("double")))
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_cells"), F.sum("weight").alias("_total")))  # one row
    rest = budget - floor * F.col("_cells")
    share = floor + F.floor(F.try_divide(F.col("weight"), F.col("_total")) * rest + 0.5)
    tight = F.greatest(F.lit(1), F.floor(F.lit(float(budget)) / F.greatest(F.col("_cells"), F.lit(1))))
    return rows.join(total).select(*cell, "n", "weight", F.when(rest <= 0, tight).otherwise(share).cast("long").alias("share"))


def scalar_scores(points: DataFrame, objectives: dict[str, tuple[str, float]]) -> DataFrame:
    """points with `score`: min-max normalised objectives ({column: (min|max, weight)}), weighted; a null or constant one adds 0."""
    total, parts, bounds = sum(w for _, w in objectives.values()), [], []
    for i, (c, (way, weight)) in enumerate(objectives.items()):
        bounds += [F.min(c).alias(f"_low{i}"), F.max(c).alias(f"_high{i}")]
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        gap = F.col(c) - low if way == "max" else high - F.col(c)
        parts.append(weight * F.coalesce(F.try_divide(gap.cast("double"), high - low), F.lit(0.0)))
    ends = F.broadcast(points.agg(*bounds))  # one row
    return points.join(ends).select(*points.columns, (sum(parts, F.lit(0.0)) / total).alias("score"))


def self_consistency(answers: DataFrame, item: str, answer: str, order: str) -> DataFrame:
    """item, answer, votes, n: the most frequent answer, the first given of ties."""
    by = answers.groupBy(item, answer).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_o"))
    top = F.min(F.struct((-F.col("votes")).alias("v"), F.col("_o"), F.col(answer).alias("a")))
    return by.groupBy(item).agg(top.alias("t"), F.sum("votes").alias("n")).select(item, F.col("t.a").alias(answer), (-F.col("t.v")).alias("votes"), "n")


def argument_diff(calls: DataFrame, field: str, value: str, passed: Column) -> DataFrame:
    """field, value, passing, failing: only values seen on one side."""
    by = calls.groupBy(field, value).agg(F.count_if(passed).alias("passing"), F.count_if(~passed).alias("failing"))
    return by.where("passing = 0 or failing = 0")


def number_series(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """by, min, p50, p90 (nearest rank), max, sum, n."""
    ranked = lambda q: F.expr("percentile_disc({}) within group (order by _v)".format(q))
    v = rows.withColumn("_v", value.cast("double")).where("_v is not null")
    return v.groupBy(by).agg(F.min("_v").alias("min"), ranked(0.5).alias("p50"), ranked(0.9).alias("p90"), F.max("_v").alias("max"), F.sum("_v").alias("sum"), F.count("_v").alias("n"))


def headroom(rows: DataFrame, task: str, outcome: Column, keep: float = 0.0) -> DataFrame:
    """task, n, n_known, pass_rate, headroom: what a baseline leaves open; outcome is pass, fail or unknown.

    The rate is taken over known outcomes: up to `keep` the task has a gap, above it is saturated, and it
    is unknown (rate null) where no outcome is known. Any other outcome is an error.
    """
    said = F.when(outcome.isin("pass", "fail", "unknown"), outcome).otherwise(F.raise_error(F.concat(F.lit("no baseline outcome "), F.coalesce(outcome, F.lit("null")))))
    by = rows.select(task, said.alias("_o")).groupBy(task).agg(F.count("_o").alias("n"), F.count_if(F.col("_o") != "unknown").alias("n_known"), F.count_if(F.col("_o") == "pass").alias("_p"))
    rate = ratio(F.col("_p"), F.col("n_known"))
    kind = F.when(F.col("n_known") == 0, "unknown").when(rate <= keep, "gap").otherwise("saturated")
    return by.select(task, "n", "n_known", rate.alias("pass_rate"), kind.alias("headroom"))


def reward_hacking(runs: DataFrame, lane: str, order: Sequence[str], proxy: str, truth: str, second: str | None = None, checked: str | None = None, window: int | None = None) -> DataFrame:
    """lane, n, divergence, shift, disagreement, drift, verdict: signs that a proxy reward is gamed, each 0..1 or null without evidence.

    Only runs with a proxy count; the last min(50, n/2) of them (`window`) are held against those before.
    divergence: 5 (proxy gain less truth gain), two values a side and measure at least. shift: the
    two-sample distance of the proxy less 0.2, four values a side. disagreement: 0.5 less the correlation
    with an independent second reward, four pairs. drift: 5 (proxy gain less the gain of a deterministic
    reward between the halves of the runs that have it, four runs). The verdict is gaming from 0.6 on,
    suspect from 0.3, else clean; insufficient_evidence below four runs or without any sign.
    """
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    w, on = W.partitionBy(lane), W.partitionBy(lane).orderBy(*order)
    rows = runs.where(finite(proxy).isNotNull()).select(
        lane, finite(proxy).alias("p"), finite(truth).alias("t"), *(finite(c).alias(n) if c else F.lit(None).cast("double").alias(n) for c, n in ((second, "s"), (checked, "c"))),
        F.count(F.lit(1)).over(w).alias("n"), F.row_number().over(on).alias("_i"), *(F.col(c).alias(f"_o{j}") for j, c in enumerate(order)),
    )
    size = F.greatest(F.lit(1), F.lit(window) if window else F.least(F.lit(50), F.floor(F.col("n") / 2).cast("int")))
    rows = rows.withColumn("part", F.when(F.col("_i") > F.col("n") - size, "recent").otherwise("before"))
    half = F.row_number().over(W.partitionBy(lane, F.col("c").isNotNull()).orderBy("_i")) <= F.floor(F.count("c").over(w) / 2)
    rows = rows.withColumn("early", half)
    late = F.col("part") == "recent"
    side = lambda c, on: (F.avg(F.when(on, F.col(c))), F.count(F.when(on, F.col(c))))
    (p1, n1), (p0, n0), (t1, m1), (t0, m0) = side("p", late), side("p", ~late), side("t", late), side("t", ~late)
    (c1, k1), (c0, k0) = side("c", ~F.col("early")), side("c", F.col("early"))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    pairs = F.count(F.when(F.col("s").isNotNull(), F.col("p")))
    out = rows.groupBy(lane).agg(
        F.count(F.lit(1)).alias("n"), F.when(F.least(n1, n0, m1, m0) >= 2, unit(5 * ((p1 - p0) - (t1 - t0)))).alias("divergence"), (F.least(n1, n0) >= 4).alias("_ks"),
        F.when(pairs >= 4, unit(0.5 - F.greatest(F.lit(0.0), moments.pearson(F.col("p"), F.col("s"))))).alias("disagreement"),
        F.when(k1 + k0 >= 4, unit(5 * (F.coalesce(p1 - p0, F.lit(0.0)) - (c1 - c0)))).alias("drift"),
    )
    d = ks_distance(rows.select(lane, "part", "p"), lane, "part", "p").select(lane, "d")
    out = out.join(d, lane).withColumn("shift", F.when(F.col("_ks"), unit(F.col("d") - 0.2)))
    enough = F.col("n") >= 4
    signs = [F.when(enough, F.col(c)).alias(c) for c in ("divergence", "shift", "disagreement", "drift")]
    worst = F.greatest(*(F.when(enough, F.col(c)) for c in ("divergence", "shift", "disagreement", "drift")))
    verdict = F.when(worst.isNull(), "insufficient_evidence").when(worst >= 0.6, "gaming").when(worst >= 0.3, "suspect").otherwise("clean")
    return out.select(lane, "n", *signs, verdict.alias("verdict"))


def lift(pairs: DataFrame, by: str, before: Column, after: Column) -> DataFrame:
    """by, n, delta, dz, t, tied: paired differences; tied is the share below 1e-9."""
    d = after - before
    return pairs.groupBy(by).agg(
        F.count(d).alias("n"), F.avg(d).alias("delta"), moments.paired_dz(d).alias("dz"), moments.t_statistic(d).alias("t"), F.avg((F.abs(d) < 1e-9).cast("int")).alias("tied")
    )


def release_confidence(runs: DataFrame, passed: Column, gated: Column, cost: Column, wall: Column, limits: dict[str, float]) -> DataFrame:
    """One row: n, pass rate of ungated runs, mean cost (null unless complete), p95 wall, issues, verdict fail, warn or pass."""
    ok = ~F.coalesce(gated, F.lit(False))
    n, costs = F.count(F.lit(1)), F.count(cost)
    out = runs.agg(
        n.alias("n"), ratio(F.count_if(ok & passed), F.count_if(ok)).alias("pass_rate"), F.when(costs == n, F.avg(cost)).alias("mean_cost"), F.count_if(~ok).alias("gated")
    )
    out = out.join(exact_quantiles(runs.select(wall.alias("_w")), None, "_w", [0.95]).select(F.get("q", F.lit(0)).alias("p95_wall")), how="left")  # one row each
    issue = lambda when, name: F.when(F.coalesce(when, F.lit(True)), F.lit(name))
    critical = [issue(F.col("n") < limits["runs"], "too_few_runs"), issue(F.col("pass_rate") < limits["pass_rate"], "low_pass_rate")]
    other = [issue(F.col("mean_cost") > limits["cost"], "cost"), issue(F.col("p95_wall") > limits["wall"], "slow"), F.when(F.col("gated") > 0, F.lit("gated_runs"))]
    known = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    out = out.withColumns({"_c": known(critical), "_o": known(other)})
    verdict = F.when(F.size("_c") > 0, "fail").when(F.size("_o") > 0, "warn").otherwise("pass")
    return out.select("n", "pass_rate", "mean_cost", "p95_wall", "gated", F.array_join(F.concat("_c", "_o"), ",").alias("issues"), verdict.alias("verdict"))


def sentinel(history: DataFrame, judge: str, time: str, model: str, metric: str) -> DataFrame:
    """judge, n, first, last, trend, changes: how a judge's metric moved and how often its model changed."""
    before = F.lag(model).over(W.partitionBy(judge).orderBy(time))
    rows = history.select(judge, time, metric, (before.isNotNull() & (before != F.col(model))).alias("_c"))
    out = rows.groupBy(judge).agg(F.count(F.lit(1)).alias("n"), F.min_by(metric, time).alias("first"), F.max_by(metric, time).alias("last"), F.count_if("_c").alias("changes"))
    return out.withColumn("trend", F.col("last") - F.col("first"))


def beta_quantile(p: Column, a: Column, b: Column) -> Column:
    """The value below which a beta variable of (a, b) lies with chance p, by halving."""

    def solve(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for q, x, y in zip(p, a, b, strict=True):
            low, high = 0.0, 1.0
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if incomplete_beta(x, y, mid) < q else (low, mid)
            out.append((low + high) / 2)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(solve, "double")(p, a.cast("double"), b.cast("double"))


def thompson_curriculum(cells: DataFrame, observations: DataFrame, cell: Sequence[str], key: Column, passed: Column, budget: int, threshold: float = 0.5, prior: tuple[float, float] = (1.0, 1.0), seed: int = 0) -> DataFrame:
    """cell, n, sampled, weight, count: how many of `budget` runs each candidate cell gets, most where a draw of its pass rate lies near the threshold.

    The draw is the beta quantile, at passes and failures plus the prior, of a uniform number of the cell's integer
    key and the seed alone. weight falls with the squared distance over the posterior's deviation (0.05 at least);
    counts are rounded one by one. Cells without observations have the prior; observations of other cells do not count.
    """
    told = observations.where(passed.isNotNull()).groupBy(*cell).agg(F.count_if(passed).alias("_p"), F.count_if(~passed).alias("_f"))
    rows = cells.withColumn("_key", key.cast("long")).join(told, list(cell), "left")
    p, f = (F.coalesce(c, F.lit(0)) for c in ("_p", "_f"))
    rows = rows.select(*cell, "_key", (p + f).alias("n"), (p + prior[0]).alias("_a"), (f + prior[1]).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    rows = rows.withColumn("sampled", beta_quantile(uniform(F.col("_key"), F.lit(0), seed), a, b))
    far = (F.col("sampled") - threshold) / F.greatest(F.lit(0.05), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    rows = rows.withColumn("weight", F.exp(-far * far))
    total = rows.agg(F.sum("weight").alias("_total"))
    share = F.coalesce(F.try_divide(F.col("weight"), F.col("_total")), F.lit(0.0))
    return rows.crossJoin(F.broadcast(total)).select(*cell, "n", "sampled", "weight", F.floor(share * budget + 0.5).alias("count"))  # one row of totals
