"""Grouped reports over run records, spans and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import ratio, wilson


def leaderboard(runs: DataFrame, candidate: str, passed: Column, cost: Column, wall: Column | None = None) -> DataFrame:
    """Per candidate: n, pass rate with Wilson interval, mean cost (null unless all are known), rank.

    Rank goes by pass rate descending, then mean cost ascending with unknown last, then candidate; it is
    taken over the aggregated rows, one for each candidate.
    """
    known = F.count(cost) == F.count(F.lit(1))
    out = runs.groupBy(F.col(candidate).alias("candidate")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("passes"), F.when(known, F.avg(cost)).alias("mean_cost"),
        F.avg(F.lit(None).cast("double") if wall is None else wall).alias("mean_wall"),
    )
    low, high = wilson(F.col("passes"), F.col("n"))
    rate = ratio(F.col("passes"), F.col("n"))
    order = W.orderBy(F.desc("pass_rate"), F.asc_nulls_last("mean_cost"), "candidate")
    return out.withColumns({"pass_rate": rate, "ci_low": low, "ci_high": high}).withColumn("rank", F.row_number().over(order).cast("long"))


def axis_summary(cells: DataFrame, axes: Sequence[str], score: Column, passed: Column, cost: Column, failed: Column) -> DataFrame:
    """One grouping for each axis, not a cube: cells, pass rate, mean, p50, p90, cost. Failed cells score 0 and do not pass.

    A row without a value on an axis is left out of that axis alone.
    """
    rows = cells.select(
        F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes))).alias("x"),
        F.when(failed, 0.0).otherwise(score.cast("double")).alias("score"), (passed & ~failed).alias("passed"), cost.alias("cost"),
    ).where("x.value is not null")
    return rows.groupBy("x.axis", "x.value").agg(
        F.count(F.lit(1)).alias("cells"), ratio(F.count_if("passed"), F.count(F.lit(1))).alias("pass_rate"), F.avg("score").alias("mean"),
        F.percentile("score", 0.5).alias("p50"), F.percentile("score", 0.9).alias("p90"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"), F.count_if(F.col("cost").isNull()).alias("uncaptured"),
    )


def distribution(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """n, mean, p50, p95, population deviation, min and max of a measure."""
    v = value.cast("double")
    return rows.groupBy(by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.95).alias("p95"),
        F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def histogram(rows: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """bin, low, high, n: equal widths, the last bin closed, empty bins with 0; one bin for a constant series."""
    v = rows.select(value.cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    ends = ends.where("low is not null").withColumn("bins", F.when(F.col("low") == F.col("high"), 1).otherwise(bins))
    ends = ends.withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    at = F.when(F.col("width") == 0, 0).otherwise(F.least(F.col("bins") - 1, F.floor(F.try_divide(F.col("v") - F.col("low"), F.col("width"))).cast("int")))
    counts = v.join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends is one row
    grid = ends.select("low", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def cross_tab(rows: DataFrame, by: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Counts and sums by several keys; null measures add 0."""
    sums = [F.sum(F.coalesce(m, F.lit(0))).alias(n) for n, m in measures.items()]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def cost_provenance(rows: DataFrame, kind: Column, usd: Column) -> DataFrame:
    """n, dollars and share of rows by how a cost is known; an uncaptured cost is never 0 dollars but null."""
    out = rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(usd).alias("usd"))
    return out.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy())))


def usage_rollup(spans: DataFrame, run: str, measures: dict[str, Column]) -> DataFrame:
    """Sums by run and in all: (null, totals) is the last row of the rollup."""
    return spans.rollup(run).agg(F.count(F.lit(1)).alias("spans"), *(F.sum(F.coalesce(m, F.lit(0))).alias(n) for n, m in measures.items()))


def tool_use(calls: DataFrame, run: str, tool: str, order: Sequence[str], args: str, failed: Column, latency: Column) -> DataFrame:
    """Per run and tool: calls, errors, mean latency (unknown counts 0), duplicate and retry rate.

    A call repeats an earlier one if tool and arguments are equal; a failed call is retried if the run
    has a later call of the tool.
    """
    mine, same = W.partitionBy(run, tool).orderBy(*order), W.partitionBy(run, tool, args).orderBy(*order)
    rows = calls.select(
        run, tool, failed.alias("failed"), F.coalesce(latency, F.lit(0.0)).alias("latency"),
        (F.row_number().over(same) > 1).alias("again"), F.lead(F.lit(1)).over(mine).isNotNull().alias("later"),
    )
    n = F.count(F.lit(1))
    return rows.groupBy(run, tool).agg(
        n.alias("calls"), F.count_if("failed").alias("errors"), F.avg("latency").alias("mean_latency"),
        ratio(F.count_if("again"), n).alias("duplicate_rate"),
        F.coalesce(ratio(F.count_if(F.col("failed") & F.col("later")), F.count_if("failed")), F.lit(0.0)).alias("retry_rate"),
    )


def budget_breach(charges: DataFrame, dims: Sequence[str], consumed: Column, limit: Column) -> DataFrame:
    """Breaches and worst consumed/limit by each dimension on its own and in all; a limit of 0 is exceeded infinitely."""
    over = consumed > limit
    share = F.when(limit > 0, F.try_divide(consumed.cast("double"), limit)).when(over, float("inf"))
    rows = charges.withColumns({"_over": over, "_share": share})
    sets = rows.select("*", F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in dims), F.struct(F.lit("all").alias("dim"), F.lit("all").alias("key")))).alias("x"))
    return sets.groupBy("x.dim", "x.key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_over").alias("breaches"), F.max("_share").alias("worst"),
        ratio(F.count_if("_over"), F.count(F.lit(1))).alias("breach_rate"),
    )


def failure_shares(runs: DataFrame, failure: Column, score: Column) -> DataFrame:
    """Failed runs by class with their share of all runs; failed: a class is given or the score is under 0.5."""
    rows = runs.select(failure.alias("class"), (failure.isNotNull() | (score < 0.5)).alias("failed"))
    out = rows.groupBy(F.coalesce("class", F.lit("unknown")).alias("class")).agg(F.count_if("failed").alias("n"), F.count(F.lit(1)).alias("_all"))
    return out.withColumn("share", ratio(F.col("n"), F.sum("_all").over(W.partitionBy()))).where("n > 0").drop("_all")


def clusters(rows: DataFrame, keys: dict[str, Column], group: Column, example: str, least: int = 1, few: int = 5) -> DataFrame:
    """Rows by signature: count, distinct groups, share of rows, the first `few` examples in order, comma-joined.

    Examples are ranked before they are gathered, so a task keeps `few` of a signature.
    """
    named = rows.select(*(c.alias(k) for k, c in keys.items()), group.alias("_g"), F.col(example).alias("_x"))
    out = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_g").alias("groups"))
    out = out.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy()))).where(F.col("n") >= least)
    first = named.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_x"))).where(F.col("_r") <= few)
    first = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_x")).cast("array<string>"), ",").alias("examples"))
    return out.join(first, list(keys))


def error_prevalence(spans: DataFrame, trace: str, signature: Column) -> DataFrame:
    """Error clusters with their prevalence among traces that have an error."""
    rows = spans.select(F.col(trace).alias("trace"), signature.alias("signature"))
    total = rows.agg(F.countDistinct("trace").alias("traces"))
    out = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("trace").alias("in_traces"))
    return out.join(F.broadcast(total)).select("signature", "spans", "in_traces", ratio(F.col("in_traces"), F.col("traces")).alias("prevalence"))


def overview(spans: DataFrame, kind: str, trace: str, time: str, failed: Column) -> DataFrame:
    """One row: traces, spans, errors, kinds (sorted), time range."""
    return spans.agg(
        F.countDistinct(trace).alias("traces"), F.count(F.lit(1)).alias("spans"), F.count_if(failed).alias("errors"),
        F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"), F.min(time).alias("first"), F.max(time).alias("last"),
    )


def discrimination(scores: DataFrame, scenario: str, candidate: str, score: Column, ceiling: float = 0.999) -> DataFrame:
    """How far a scenario tells candidates apart: mean and population variance of their mean scores; saturated ties flagged."""
    by = scores.groupBy(scenario, candidate).agg(F.avg(score).alias("s"))
    out = by.groupBy(scenario).agg(F.count(F.lit(1)).alias("candidates"), F.avg("s").alias("mean"), F.var_pop("s").alias("variance"), F.min("s").alias("low"))
    return out.withColumn("saturated", (F.col("variance") == 0) & (F.col("low") >= ceiling)).drop("low")


def coverage(design: DataFrame, seen: DataFrame, keys: Sequence[str], score: Column) -> DataFrame:
    """Every designed cell with its observations; an uncovered one keeps a null score."""
    got = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("score"))
    return design.join(got, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def verdicts(scores: DataFrame, item: str, dimension: str, judge: str, score: Column) -> DataFrame:
    """Per item and dimension: mean over the judges that answered (scores held to 0..1), how many did not, widest gap."""
    s = F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score.cast("double"))))
    return scores.groupBy(item, dimension).agg(
        F.avg(s).alias("mean"), F.count(s).alias("answered"), F.count_if(score.isNull()).alias("silent"), (F.max(s) - F.min(s)).alias("disagreement")
    )


def pass_rates(rows: DataFrame, by: str, passed: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(passed), F.count(F.lit(1))).alias("pass_rate"))


def integrity(rows: DataFrame, tokens: Column, cost: Column) -> DataFrame:
    """One row: real, stub (no tokens) and uncosted rows, and a verdict."""
    n, stub = F.count(F.lit(1)), F.count_if(F.coalesce(tokens, F.lit(0)) == 0)
    verdict = F.when(n == 0, "empty").when(stub == 0, "real").when(stub == n, "stub").otherwise("mixed")
    return rows.agg(n.alias("n"), stub.alias("stubs"), (n - stub).alias("real"), F.count_if(cost.isNull()).alias("uncosted"), verdict.alias("verdict"))
