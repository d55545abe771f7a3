"""Ordered rows: streaks, sessions, drift, multiplicity, frontiers, intervals, temporal rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import ratio

_START = W.unboundedPreceding


def streaks(rows: DataFrame, lane: str, order: Sequence[str], hit: Column, least: int = 3) -> DataFrame:
    """lane, first, last, length of every run of at least `least` consecutive hits; first and last are `order[0]` values."""
    w = W.partitionBy(lane).orderBy(*order)
    broken = F.sum((~hit).cast("int")).over(w.rowsBetween(_START, 0))
    by = rows.select(lane, F.col(order[0]).alias("_t"), hit.alias("_hit"), broken.alias("_g")).where("_hit")
    out = by.groupBy(lane, "_g").agg(F.min("_t").alias("first"), F.max("_t").alias("last"), F.count(F.lit(1)).alias("length"))
    return out.where(F.col("length") >= least).drop("_g")


def stuck_loops(calls: DataFrame, lane: Sequence[str], start: Column, end: Column, order: str, signature: Sequence[str], window_ms: int = 60_000, least: int = 3, between: int = 0) -> DataFrame:
    """lane, signature, first, last, calls: the densest stretch of each episode of one call repeated; start, end, first and last in milliseconds.

    An episode of a lane (a run's execution track) ends where the next equal call starts over `window_ms`
    later, after more than `between` other calls, or before the last one has ended (or if it has no end).
    Of an episode the stretch of most calls within `window_ms` is told, the first of equal ones, if it has
    `least` calls. Calls without a start or a signature value (arguments not captured) make no loop.
    """
    mine, same = W.partitionBy(*lane).orderBy("_s", order), W.partitionBy(*lane, *signature).orderBy("_s", order)
    rows = calls.select(*lane, *signature, order, start.alias("_s"), end.alias("_e")).where("_s is not null").withColumn("_n", F.row_number().over(mine))
    for c in signature:
        rows = rows.where(F.col(c).isNotNull())
    late = F.col("_s") - F.lag("_s").over(same) > window_ms
    far = F.col("_n") - F.lag("_n").over(same) - 1 > between
    serial = F.coalesce(F.lag("_e").over(same) <= F.col("_s"), F.lit(False))
    rows = rows.withColumn("_new", F.coalesce(late | far | ~serial, F.lit(True)).cast("int")).withColumn("_ep", F.sum("_new").over(same.rowsBetween(_START, 0)))
    near = W.partitionBy(*lane, *signature, "_ep").orderBy("_s").rangeBetween(-window_ms, 0)
    ends = rows.select(*lane, *signature, "_ep", F.struct((-F.count(F.lit(1)).over(near)).alias("n"), F.col("_s").alias("last"), F.min("_s").over(near).alias("first")).alias("m"))
    best = ends.groupBy(*lane, *signature, "_ep").agg(F.min("m").alias("m")).where(F.col("m.n") <= -least)
    return best.select(*lane, *signature, F.col("m.first").alias("first"), F.col("m.last").alias("last"), (-F.col("m.n")).alias("calls"))


def recent_and_before(rows: DataFrame, lane: str, order: Sequence[str], recent: int, before: int) -> DataFrame:
    """rows with `part`: the lane's last `recent` rows are 'recent', the `before` rows ahead of them 'before'."""
    back = F.row_number().over(W.partitionBy(lane).orderBy(*(F.desc(c) for c in order)))
    part = F.when(F.col("_b") <= recent, "recent").otherwise("before")
    return rows.withColumn("_b", back).where(F.col("_b") <= recent + before).withColumn("part", part).drop("_b")


def ks_distance(rows: DataFrame, lane: str, part: str, value: str) -> DataFrame:
    """lane, n_recent, n_before, d: the textbook two-sample distance, both shares taken after all ties of a value."""
    by = rows.groupBy(lane, value).agg(F.count_if(F.col(part) == "recent").alias("r"), F.count_if(F.col(part) == "before").alias("b"))
    run, whole = W.partitionBy(lane).orderBy(value).rowsBetween(_START, 0), W.partitionBy(lane)
    gap = F.abs(ratio(F.sum("r").over(run), F.sum("r").over(whole)) - ratio(F.sum("b").over(run), F.sum("b").over(whole)))
    return by.select(lane, "r", "b", gap.alias("gap")).groupBy(lane).agg(F.sum("r").alias("n_recent"), F.sum("b").alias("n_before"), F.max("gap").alias("d"))


def chi_square_shift(rows: DataFrame, lane: str, part: str, category: str) -> DataFrame:
    """lane, chi2, cells: recent counts against those expected from before; cells with under 1 expected are left out."""
    by = rows.groupBy(lane, category).agg(F.count_if(F.col(part) == "recent").alias("r"), F.count_if(F.col(part) == "before").alias("b"))
    whole = W.partitionBy(lane)
    expected = ratio(F.col("b") * F.sum("r").over(whole), F.sum("b").over(whole))
    cells = by.withColumn("e", expected).where("e >= 1")
    return cells.groupBy(lane).agg(F.sum(F.pow(F.col("r") - F.col("e"), F.lit(2)) / F.col("e")).alias("chi2"), F.count(F.lit(1)).alias("cells"))


def series_convergence(rows: DataFrame, lane: str, order: Sequence[str], value: str, window: int = 5, stable: float = 0.05, drift: int = 3) -> DataFrame:
    """lane, n, mean, cv, tail_run, stable, state of each lane's series; null values are no measurements.

    mean and cv (population deviation over |mean|, over 1 for a mean of 0) are those of the last `window`
    values; tail_run counts the last steps that go one way, negative downwards. A full window with cv up to
    `stable` is stabilized, else `drift` steps make it drifting-up or drifting-down, else it is noisy. Below
    max(2, min(window, 3)) values the state is insufficient-data and the numbers are 0.
    """
    back = W.partitionBy(lane).orderBy("_b")
    known = rows.where(F.col(value).isNotNull()).select(lane, F.col(value).cast("double").alias("_v"), F.row_number().over(W.partitionBy(lane).orderBy(*(F.desc(c) for c in order))).alias("_b"))
    steps = known.withColumn("_d", F.signum(F.col("_v") - F.lead("_v").over(back))).withColumn("_way", F.first("_d").over(back))
    tail = F.when(F.col("_b") <= window, F.col("_v"))
    broken = F.coalesce((F.col("_d") != F.col("_way")) | (F.col("_d") == 0), F.lit(True))
    out = steps.groupBy(lane).agg(
        F.count(F.lit(1)).alias("n"), F.avg(tail).alias("mean"), F.stddev_pop(tail).alias("_sd"),
        F.min(F.when(broken, F.col("_b"))).alias("_end"), F.max(F.when(F.col("_b") == 1, F.col("_way"))).alias("_way"),
    )
    known, zero = F.col("n") >= max(2, min(window, 3)), F.lit(0.0)
    cv = F.col("_sd") / F.when(F.abs("mean") > 1e-9, F.abs("mean")).otherwise(1.0)
    run = ((F.col("_end") - 1) * F.coalesce("_way", zero)).cast("long")
    done = known & (F.col("n") >= window) & (cv <= stable)
    state = F.when(~known, "insufficient-data").when(done, "stabilized").when(run >= drift, "drifting-up").when(run <= -drift, "drifting-down").otherwise("noisy")
    return out.select(
        lane, "n", F.when(known, F.col("mean")).otherwise(zero).alias("mean"), F.when(known, cv).otherwise(zero).alias("cv"),
        F.when(known, run).otherwise(F.lit(0)).alias("tail_run"), done.alias("stable"), state.alias("state"),
    )


def adjusted_p(tests: DataFrame, family: str, p: str, key: str) -> DataFrame:
    """tests with Benjamini-Hochberg q, Holm and Bonferroni p-values within each family of tests.

    Equal p-values have equal results in any order of `key`: the last of them decides theirs by Benjamini and
    Hochberg, the first by Holm. So values are counted, and only the distinct ones of a family are put in order,
    once up and once down: a frame that ends at the family's end would be gone through anew for each row.
    """
    values = tests.groupBy(family, p).agg(F.count(F.lit(1)).alias("_n"))
    up, down = (W.partitionBy(family).orderBy(o).rowsBetween(_START, 0) for o in (F.asc(p), F.desc(p)))
    values = values.withColumns({"_m": F.sum("_n").over(W.partitionBy(family)), "_last": F.sum("_n").over(up)})
    values = values.select(
        F.col(family).alias("_family"), F.col(p).alias("_p"),
        F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_last")).over(down)).alias("bh"),
        F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_m") - F.col("_last") + F.col("_n"))).over(up)).alias("holm"),
        F.least(F.lit(1.0), F.col(p) * F.col("_m")).alias("bonferroni"),
    )
    return tests.join(values, F.col(family).eqNullSafe(F.col("_family")) & F.col(p).eqNullSafe(F.col("_p"))).drop("_family", "_p")


def average_ranks(rows: DataFrame, group: Sequence[str], value: str, name: str, times: str | None = None) -> DataFrame:
    """rows with average ranks, ties sharing theirs; `times` says how often a row counts. Counts per value make the ranks, so ties never meet in one task twice."""
    counts = rows.groupBy(*group, value).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy(value).rowsBetween(_START, 0)) - F.col("_n")
    ranks = counts.select(*group, value, (before + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranks, [*group, value])


def pareto_frontier(points: DataFrame, cost: str, quality: str) -> DataFrame:
    """Points that no other one beats: low cost, high quality, better in one at least. Equal points stay together.

    The best quality for each cost is aggregated first; the running maximum then sees one row a cost.
    """
    best = points.groupBy(cost).agg(F.max(quality).alias("_q"))
    ahead = F.max("_q").over(W.orderBy(cost).rowsBetween(_START, -1))
    front = best.withColumn("_ahead", ahead).where("_ahead is null or _q > _ahead").select(cost, F.col("_q").alias(quality))
    return points.join(front, [cost, quality], "left_semi")


def crowding(points: DataFrame, key: str, objectives: Sequence[str]) -> DataFrame:
    """points with the sum over objectives of the normalised gap between neighbours; infinite at a boundary."""
    out = points
    for i, o in enumerate(objectives):
        w = W.orderBy(o, key)
        span = F.max(o).over(W.partitionBy()) - F.min(o).over(W.partitionBy())
        gap = F.lead(o).over(w) - F.lag(o).over(w)
        out = out.withColumn(f"_g{i}", F.when(gap.isNull(), float("inf")).otherwise(F.coalesce(F.try_divide(gap, span), F.lit(0.0))))
    total = sum((F.col(f"_g{i}") for i in range(len(objectives))), F.lit(0.0))
    return out.withColumn("crowding", total).drop(*(f"_g{i}" for i in range(len(objectives))))


def max_concurrency(spans: DataFrame, lane: str, start: Column, end: Column) -> DataFrame:
    """lane, peak, busy seconds, wall seconds: a sweep over starts and ends, half-open; spans without an end do not count."""
    rows = spans.where(start.isNotNull() & end.isNotNull())
    edges = rows.select(lane, F.explode(F.array(F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))).alias("x")).groupBy(lane, "x.t").agg(F.sum("x.d").alias("d"))
    w = W.partitionBy(lane).orderBy("t")
    at = edges.select(lane, "t", F.sum("d").over(w.rowsBetween(_START, 0)).alias("open"), F.lead("t").over(w).alias("until"))
    secs = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    return at.groupBy(lane).agg(
        F.max("open").alias("peak"), F.coalesce(F.sum(F.when(F.col("open") > 0, secs(F.col("t"), F.col("until")))), F.lit(0.0)).alias("busy_s"),
        secs(F.min("t"), F.max("t")).alias("wall_s"),
    )


def pack_intervals(spans: DataFrame, lane: str, start: str, end: str, key: str) -> DataFrame:
    """spans with `island`: overlapping spans of a lane share one, touching ones do not."""
    w = W.partitionBy(lane).orderBy(start, key)
    reach = F.max(end).over(w.rowsBetween(_START, -1))
    new = F.coalesce(F.col(start) >= F.col("_reach"), F.lit(True)).cast("int")
    rows = spans.withColumn("_reach", reach).withColumn("_new", new)
    return rows.withColumn("island", F.sum("_new").over(w.rowsBetween(_START, 0))).drop("_reach", "_new")


def contract(spans: DataFrame, run: str, order: Sequence[str], rules: dict[str, tuple[str, Column, Column | None]]) -> DataFrame:
    """run, rule, ok: temporal rules over ordered spans.

    always(p), never(p), eventually(p); precedes(p, q): a p comes before the first q; never_unless(p, q):
    no p without a q before it. A guard on the same span does not count.
    """
    w = W.partitionBy(run).orderBy(*order).rowsBetween(_START, -1)
    checks = {}
    for name, (kind, p, q) in rules.items():
        p = F.coalesce(p, F.lit(False))
        if kind in ("always", "never", "eventually"):
            checks[name] = (p if kind != "never" else ~p, F.bool_or if kind == "eventually" else F.bool_and)
        elif kind in ("precedes", "never_unless"):
            guard, then = (p, q) if kind == "precedes" else (q, p)
            seen = F.coalesce(F.bool_or(F.coalesce(guard, F.lit(False))).over(w), F.lit(False))
            checks[name] = (~F.coalesce(then, F.lit(False)) | seen, F.bool_and)
        else:
            raise ValueError(f"no rule {kind}")
    rows = spans.select(run, *(c.alias(n) for n, (c, _) in checks.items()))
    by = rows.groupBy(run).agg(*(f(n).alias(n) for n, (_, f) in checks.items()))
    return by.unpivot(run, list(checks), "rule", "ok")


def first_divergence(a: DataFrame, b: DataFrame, pair: str, index: str, action: str) -> DataFrame:
    """pair, first: the first index where two trajectories differ or one has ended; null if they are equal."""
    x, y = (t.select(pair, index, F.col(action).alias(n)) for t, n in ((a, "x"), (b, "y")))
    both = x.join(y, [pair, index], "full_outer")
    return both.groupBy(pair).agg(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col(index))).alias("first"))


def step_rewards(steps: DataFrame, run: str, order: Sequence[str], reward: str, weight: str) -> DataFrame:
    """run, mean and sum (weighted), share under 0.5, worst drop between neighbours and its index (0 and null without one)."""
    w = W.partitionBy(run).orderBy(*order)
    rows = steps.select(run, F.col(reward).alias("r"), F.col(weight).alias("w"), (F.col(reward) - F.lag(reward).over(w)).alias("d"), (F.row_number().over(w) - 1).alias("i"))
    worst = F.min(F.when(F.col("d") < 0, F.struct("d", "i")))
    out = rows.groupBy(run).agg(
        F.coalesce(ratio(F.sum(F.col("r") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("mean"), F.sum(F.col("r") * F.col("w")).alias("sum"),
        ratio(F.count_if(F.col("r") < 0.5), F.count(F.lit(1))).alias("low_share"), worst.alias("_w"),
    )
    return out.select(run, "mean", "sum", "low_share", F.coalesce("_w.d", F.lit(0.0)).alias("worst_drop"), F.col("_w.i").alias("worst_at"))


def round_robin(rows: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows taken from the groups in turn, groups by name."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def best_by_scenario(runs: DataFrame, scenario: str, score: str, order: Column) -> DataFrame:
    """The run with the highest score of each scenario, the first in order of ties; partial maxima before the shuffle."""
    row = F.struct((-F.col(score)).alias("s"), order.alias("o"), F.struct(*runs.columns).alias("r"))
    return runs.where(F.col(score).isNotNull()).groupBy(scenario).agg(F.min(row).alias("m")).select("m.r.*")


def token_signals(turns: DataFrame, run: str, order: str, size: Column) -> DataFrame:
    """run, steps, growth (last over first size), rising (every step grows), halved (last is at most 0.6 of the first, 5 steps or more)."""
    w = W.partitionBy(run).orderBy(order)
    rows = turns.select(run, F.col(order).alias("_o"), size.alias("s"), (size > F.lag(size).over(w)).alias("_up"))
    out = rows.groupBy(run).agg(F.count(F.lit(1)).alias("steps"), F.min_by("s", "_o").alias("_f"), F.max_by("s", "_o").alias("_l"), F.coalesce(F.bool_and("_up"), F.lit(False)).alias("rising"))
    growth = ratio(F.col("_l"), F.col("_f"))
    return out.select(run, "steps", growth.alias("growth"), "rising", F.coalesce((F.col("steps") >= 5) & (growth <= 0.6), F.lit(False)).alias("halved"))
