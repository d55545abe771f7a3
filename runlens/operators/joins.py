"""Pairing, diffs, temporal joins and self joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import ratio
from .texts import last_seen


def pair_arms(rows: DataFrame, arm: str, arms: tuple[str, str], key: Sequence[str], rep: Sequence[str], value: str) -> DataFrame:
    """key, rep, before, after, side: a full outer match of two arms on key and repetition.

    Repetitions are numbered within arm and key by the `rep` order; side tells both, before or after.
    """
    number = F.row_number().over(W.partitionBy(arm, *key).orderBy(*rep))
    own = rows.where(F.col(arm).isin(*arms)).select(*key, F.col(arm).alias("_arm"), F.col(value).alias("_v"), number.alias("rep"))
    before = own.where(F.col("_arm") == arms[0]).select(*key, "rep", F.col("_v").alias("before"))
    after = own.where(F.col("_arm") == arms[1]).select(*key, "rep", F.col("_v").alias("after"))
    side = F.when(F.col("before").isNull(), "after").when(F.col("after").isNull(), "before").otherwise("both")
    return before.join(after, [*key, "rep"], "full_outer").withColumn("side", side)


def generation_diff(before: DataFrame, after: DataFrame, key: Sequence[str], score: str) -> DataFrame:
    """key, before, after, change (added, removed, matched), delta (null if either side is missing)."""
    a = before.select(*key, F.col(score).alias("before"), F.lit(True).alias("_a"))
    b = after.select(*key, F.col(score).alias("after"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("matched")
    out = a.join(b, list(key), "full_outer")
    return out.select(*key, "before", "after", change.alias("change"), (F.col("after") - F.col("before")).alias("delta"))


def compare_candidates(runs: DataFrame, scenario: str, candidate: str, pair: tuple[str, str], score: Column, gated: Column | None = None) -> DataFrame:
    """One row: scenarios in common, wins, losses, ties and means of the best scores of two candidates; gated runs do not count."""
    ok = F.lit(True) if gated is None else ~F.coalesce(gated, F.lit(False))
    best = runs.where(ok & F.col(candidate).isin(*pair)).groupBy(scenario).agg(*(F.max(F.when(F.col(candidate) == c, score)).alias(n) for c, n in zip(pair, "ab", strict=True)))
    both = best.where("a is not null and b is not null")
    return both.agg(
        F.count(F.lit(1)).alias("scenarios"), F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") < F.col("a")).alias("losses"),
        F.count_if(F.col("b") == F.col("a")).alias("ties"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
    )


def latest_as_of(left: DataFrame, right: DataFrame, on: str, at: str, time: str, values: Sequence[str], lag: str | None = None) -> DataFrame:
    """left with the values of the latest right row of the same key not after `at` (and within `lag` of it); null without one.

    Both sides become one ordered stream by key and time, and the last value seen is carried on: one
    shuffle, no pairs.
    """
    names = left.columns
    l = left.select(F.col(on).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_s"), F.struct(*names).alias("_l"))
    r = right.select(F.col(on).alias("_k"), F.col(time).alias("_t"), F.lit(0).alias("_s"), F.struct(F.col(time).alias("_at"), *values).alias("_r"))
    last = F.last("_r", ignorenulls=True).over(W.partitionBy("_k").orderBy("_t", "_s").rowsBetween(W.unboundedPreceding, 0))
    out = l.unionByName(r, allowMissingColumns=True).withColumn("_last", last).where("_s = 1")
    near = F.lit(True) if lag is None else F.col("_last._at") >= F.col("_t") - F.expr(f"interval {lag}")
    return out.select("_l.*", *(F.when(near, F.col(f"_last.{v}")).alias(v) for v in values))


def rater_pairs(scores: DataFrame, item: str, judge: str, score: str, order: Sequence[str]) -> DataFrame:
    """item, judge_a, judge_b, a, b: each judge's last score of an item, every two judges in order of name."""
    last = scores.groupBy(item, judge).agg(F.max_by(score, F.struct(*order)).alias("s"))
    a = last.select(item, F.col(judge).alias("judge_a"), F.col("s").alias("a"))
    b = last.select(item, F.col(judge).alias("judge_b"), F.col("s").alias("b"))
    return a.join(b, item).where("judge_a < judge_b")


def preferences(runs: DataFrame, scenario: Sequence[str], candidate: str, score: Column, margin: float = 0.0) -> DataFrame:
    """scenario, chosen, rejected, gap: the best against the worst candidate's mean, if they differ by over the margin."""
    means = runs.groupBy(*scenario, candidate).agg(F.avg(score).alias("s"))
    c = F.col(candidate)
    ends = means.groupBy(*scenario).agg(
        F.min(F.struct((-F.col("s")).alias("k"), c.alias("c"))).alias("top"), F.min(F.struct(F.col("s").alias("k"), c.alias("c"))).alias("low")
    )
    out = ends.select(*scenario, F.col("top.c").alias("chosen"), F.col("low.c").alias("rejected"), (-F.col("top.k") - F.col("low.k")).alias("gap"))
    return out.where(F.col("gap") > margin)


def scenario_preferences(runs: DataFrame, scenario: Sequence[str], candidate: str, score: Column, margin: float = 0.0) -> DataFrame:
    """scenario, chosen, rejected, gap: of every two candidates with different means."""
    means = runs.groupBy(*scenario, F.col(candidate).alias("c")).agg(F.avg(score).alias("s"))
    a, b = (means.select(*scenario, F.col("c").alias(f"c{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    return a.join(b, list(scenario)).where(F.col("sa") - F.col("sb") > margin).select(
        *scenario, F.col("ca").alias("chosen"), F.col("cb").alias("rejected"), (F.col("sa") - F.col("sb")).alias("gap")
    )


def pairwise_wins(runs: DataFrame, match: str, candidate: str, score: Column, draw: float = 0.0) -> DataFrame:
    """a, b, wins_a, wins_b, draws over matches that both play; a before b by name."""
    best = runs.groupBy(match, F.col(candidate).alias("c")).agg(F.avg(score).alias("s"))
    a, b = (best.select(match, F.col("c").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    gap = F.col("sa") - F.col("sb")
    return a.join(b, match).where("a < b").groupBy("a", "b").agg(
        F.count_if(gap > draw).alias("wins_a"), F.count_if(gap < -draw).alias("wins_b"), F.count_if(F.abs(gap) <= draw).alias("draws")
    )


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, query: str, doc: str, rank: str, grade: str, cutoff: int = 10) -> DataFrame:
    """Per query of `relevant`: hit, recall, precision (hits/cutoff), MRR, nDCG with gain 2^grade-1; 1 where nothing is relevant."""
    top = ranked.where(F.col(rank) <= cutoff).select(query, doc, F.col(rank).alias("r"))
    rel = relevant.where(F.col(grade) > 0).select(query, doc, F.col(grade).cast("double").alias("g"))
    ideal_rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc("g"), doc))
    gain = F.pow(F.lit(2.0), F.col("g")) - 1
    ideal = rel.withColumn("i", ideal_rank).groupBy(query).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("i") <= cutoff, gain / F.log2(F.col("i") + 1.0))).alias("ideal")
    )
    hits = top.join(rel, [query, doc]).groupBy(query).agg(
        F.count(F.lit(1)).alias("hits"), F.min("r").alias("first"), F.sum(gain / F.log2(F.col("r") + 1.0)).alias("dcg")
    )
    n, h = F.coalesce("n", F.lit(0)), F.coalesce("hits", F.lit(0))
    return relevant.select(query).distinct().join(ideal, query, "left").join(hits, query, "left").select(
        query, (h > 0).cast("int").alias("hit"), F.when(n == 0, 1.0).otherwise(ratio(h, n)).alias("recall"), (h / float(cutoff)).alias("precision"),
        F.coalesce(ratio(F.lit(1), F.col("first")), F.lit(0.0)).alias("mrr"),
        F.when(F.coalesce("ideal", F.lit(0.0)) == 0, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"),
    )


def admission_funnel(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """stage, entered, dropped, left: each row leaves at the first stage whose condition does not hold (null does not)."""
    first = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), i) for i, ok in enumerate(stages.values())), F.lit(len(stages)))
    out = rows.groupBy(first.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("stage")) for i, s in enumerate(stages))))
    grid = rows.sparkSession.range(1).select(names.alias("x")).select("x.*")
    after = F.broadcast(out.select(F.col("i").alias("o"), "n"))  # a row for each stage
    sums = grid.join(after, F.col("o") >= F.col("i"), "left").groupBy("i", "stage").agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("entered"), F.coalesce(F.sum(F.when(F.col("o") == F.col("i"), F.col("n"))), F.lit(0).cast("long")).alias("dropped")
    )
    return sums.select("stage", "entered", "dropped", (F.col("entered") - F.col("dropped")).alias("left"))


def rate_at_least_once(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """One row: groups, groups with a hit, their share."""
    by = rows.groupBy(group).agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("any"))
    return by.agg(F.count(F.lit(1)).alias("groups"), F.count_if("any").alias("hits"), ratio(F.count_if("any"), F.count(F.lit(1))).alias("rate"))


def set_ratio(rows: DataFrame, item: str, a: Column, b: Column) -> DataFrame:
    """One row: sizes of two sets of ids, of what they share and all, and the share of both."""
    by = rows.groupBy(item).agg(F.bool_or(a).alias("a"), F.bool_or(b).alias("b"))
    both, any_of = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") | F.col("b"))
    return by.agg(F.count_if("a").alias("in_a"), F.count_if("b").alias("in_b"), both.alias("in_both"), any_of.alias("in_any"), ratio(both, any_of).alias("jaccard"))


def outcome_correlation(runs: DataFrame, outcomes: DataFrame, run: str, start: str, time: str, lag: str, x: Column, y: str) -> DataFrame:
    """run, x, y: the latest outcome captured within `lag` after the start of its run."""
    ends = runs.select(run, x.alias("x"), (F.col(start) + F.expr(f"interval {lag}")).alias("_end"))
    out = latest_as_of(ends, outcomes.select(run, F.col(time).alias("_t"), F.col(y).alias("y"), F.lit(True).alias("_any")), run, "_end", "_t", ["y", "_any"])
    return out.where("_any").select(run, "x", "y")


def latest_by_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key in the order given; partial maxima before the shuffle."""
    row = F.struct(*order, F.struct(*rows.columns).alias("_row"))
    return rows.groupBy(*key).agg(F.max(row).alias("_m")).select("_m._row.*")


def tool_waste(runs: DataFrame, calls: DataFrame, messages: DataFrame, run: str, call_time: str, message_time: str, failed: Column, result: str, text: str) -> DataFrame:
    """run, calls, wasted, waste_rate for every run, 0 for one without calls.

    A failed call is wasted, and so is one whose result (first 120 characters) stands in no later message of
    its run; an empty or null result has nothing to be found and is not. Results find their messages once for
    each result of a run (texts.last_seen).
    """
    mine = calls.select(run, F.col(call_time).alias("_at"), F.coalesce(failed, F.lit(False)).alias("_bad"), F.substring(F.col(result), 1, 120).alias("_said"))
    wanted = mine.where("not _bad and _said <> ''").select(run, "_said").distinct()
    seen = last_seen(messages, wanted, run, text, message_time, "_said").withColumnRenamed("last", "_last")
    lost = F.col("_bad") | ((F.coalesce("_said", F.lit("")) != "") & ~F.coalesce(F.col("_last") > F.col("_at"), F.lit(False)))
    by = mine.join(seen, [run, "_said"], "left").groupBy(run).agg(F.count(F.lit(1)).alias("calls"), F.count_if(lost).alias("wasted"))
    none = F.lit(0).cast("long")
    out = runs.select(run).distinct().join(by, run, "left").select(run, F.coalesce("calls", none).alias("calls"), F.coalesce("wasted", none).alias("wasted"))
    return out.withColumn("waste_rate", F.coalesce(ratio(F.col("wasted"), F.col("calls")), F.lit(0.0)))
