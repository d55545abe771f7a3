"""Statistics over tables: agreement, effect sizes, tests, estimates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import moments
from ..functions.distributions import normal_p_value, rank_p_value, sign_p_value, signed_rank_p_value, t_p_value
from ..functions.scores import cliffs_band, ratio
from .ordered import average_ranks

#: Product of the arms' sizes up to which rank tests are exact.
EXACT_CELLS = 8192
#: Differences up to which the signed rank test is exact.
WILCOXON_EXACT = 20


def spearman(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, n, rho: Pearson's r of average ranks; NaN below two pairs, 1 if both are constant, 0 if one is.

    Pairs of values are counted first; ranks, their joins and the sums see a row for each distinct pair.
    """
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(group, a, b).agg(F.count(F.lit(1)).alias("_n"))
    ranked = average_ranks(average_ranks(pairs, [group], a, "_ra", "_n"), [group], b, "_rb", "_n")
    w, x, y = (F.col(c).cast("double") for c in ("_n", "_ra", "_rb"))
    n = F.sum(w)
    centre = (n + 1) / 2
    cov, va, vb = (F.sum(w * p) / n - centre * centre for p in (x * y, x * x, y * y))
    rho = F.when(n < 2, float("nan")).when((va <= 1e-12) & (vb <= 1e-12), 1.0).when((va <= 1e-12) | (vb <= 1e-12), 0.0).otherwise(cov / F.sqrt(va * vb))
    return ranked.groupBy(group).agg(F.sum("_n").alias("n"), rho.alias("rho"))


def wilcoxon(pairs: DataFrame, group: str, before: Column, after: Column) -> DataFrame:
    """group, n (pairs that differ), w (rank sum of the gains), p: exact up to WILCOXON_EXACT differences, else normal with ties corrected; 1 for none.

    Sizes of differences are counted first, so ties make no rows.
    """
    d = (after - before).cast("double")
    sizes = pairs.select(group, d.alias("_d")).where("_d <> 0").groupBy(group, F.abs("_d").alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") > 0).alias("_up"))
    ranked = average_ranks(sizes, [group], "_s", "_r", "_n")
    t = F.col("_n").cast("double")
    sums = ranked.groupBy(group).agg(F.sum("_n").alias("n"), F.sum(F.col("_up") * F.col("_r")).alias("w"), F.sum(t * t * t - t).alias("_ties"))
    few = ranked.join(sums.where(F.col("n") <= WILCOXON_EXACT).select(group), group, "left_semi")
    ranks = few.groupBy(group).agg(F.flatten(F.collect_list(F.array_repeat((2 * F.col("_r")).cast("int"), F.col("_n").cast("int")))).alias("_ranks"))
    n = F.col("n").cast("double")
    gap = F.abs(F.col("w") - n * (n + 1) / 4)
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    out = sums.join(ranks, group, "left").withColumns({"_dev": 2 * gap, "_z": F.try_divide(F.greatest(gap - 0.5, F.lit(0.0)), sd)})
    p = F.coalesce(signed_rank_p_value("_ranks", "_dev"), normal_p_value("_z"))
    groups = pairs.select(group).distinct()
    out = groups.join(out.select(group, "n", "w", p.alias("p")), group, "left")
    return out.select(group, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("p", F.lit(1.0)).alias("p"))


def rank_sums(rows: DataFrame, group: str, arm: str, arms: tuple[str, str], value: str) -> DataFrame:
    """group, n_a, n_b, u (of arm b over arm a), ties: sum of t^3 - t over tie groups. One row a value meets the window."""
    by = rows.where(F.col(arm).isin(*arms)).groupBy(group, value).agg(F.count_if(F.col(arm) == arms[0]).alias("a"), F.count_if(F.col(arm) == arms[1]).alias("b"))
    below = F.coalesce(F.sum("a").over(W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = by.select(group, "a", "b", (F.col("b") * (below + F.col("a") / 2)).alias("u"), (F.col("a") + F.col("b")).cast("double").alias("t"))
    return cells.groupBy(group).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum("u").alias("u"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))


def cliffs_delta(rows: DataFrame, group: str, arm: str, arms: tuple[str, str], value: str) -> DataFrame:
    """group, n_a, n_b, delta, band: (greater - less) / pairs of arm b against arm a, from rank sums."""
    sums = rank_sums(rows, group, arm, arms, value)
    pairs = F.col("n_a") * F.col("n_b")
    out = sums.select(group, "n_a", "n_b", (ratio(2 * F.col("u"), pairs) - 1).alias("delta"))
    return out.withColumn("band", cliffs_band(F.col("delta")))


def mann_whitney(rows: DataFrame, group: str, arm: str, arms: tuple[str, str], value: str) -> DataFrame:
    """group, n_a, n_b, u, z, p: two-sided; exact, ties included, up to n_a n_b = EXACT_CELLS, else the normal approximation, tie-corrected with continuity. 1 where an arm is empty."""
    sums = rank_sums(rows, group, arm, arms, value)
    a, b, n = F.col("n_a").cast("double"), F.col("n_b").cast("double"), (F.col("n_a") + F.col("n_b")).cast("double")
    var = a * b / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    gap = F.col("u") - a * b / 2
    z = F.try_divide(F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)), F.sqrt(var))
    few = (F.col("n_a") * F.col("n_b")).between(1, EXACT_CELLS)
    # how often each value occurs, in order: what the exact count needs of a small group
    by = rows.where(F.col(arm).isin(*arms)).groupBy(group, value).agg(F.count(F.lit(1)).alias("_t")).join(sums.where(few).select(group), group, "left_semi")
    times = by.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(value, "_t"))), lambda x: x["_t"]).alias("_times"))
    out = sums.select(group, "n_a", "n_b", "u", z.alias("z")).join(times, group, "left")
    p = F.coalesce(rank_p_value("u", "n_a", "n_b", "_times"), normal_p_value("z"), F.lit(1.0))
    return out.withColumn("p", p).drop("_times")


def welch_test(rows: DataFrame, group: str, a: Column, b: Column) -> DataFrame:
    """group, t, df, p and Cohen's d of measure b against measure a (each null where the other arm has the row)."""
    parts = moments.welch(a, b)
    out = rows.groupBy(group).agg(parts["t"].alias("t"), parts["df"].alias("df"), moments.cohens_d(a, b).alias("d"))
    return out.withColumn("p", t_p_value("t", "df"))


def mcnemar(pairs: DataFrame, group: str, before: Column, after: Column) -> DataFrame:
    """group, n, b (lost), c (won), p (exact), and the Wald risk difference with its interval within -1..1."""
    lost, won = F.count_if(before & ~after), F.count_if(~before & after)
    out = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n"), lost.alias("b"), won.alias("c"))
    n, gap = F.col("n").cast("double"), (F.col("c") - F.col("b")).cast("double")
    half = 1.959963984540054 * F.sqrt((F.col("b") + F.col("c") - gap * gap / n) / (n * n))
    out = out.withColumns({"difference": gap / n, "low": F.greatest(F.lit(-1.0), gap / n - half), "high": F.least(F.lit(1.0), gap / n + half)})
    return out.withColumn("p", sign_p_value("b", F.col("b") + F.col("c")))


def krippendorff(ratings: DataFrame, dim: str, item: str, value: Column) -> DataFrame:
    """dim, n, alpha with squared differences: pair sums are n sum(x^2) - sum(x)^2, so no pairs are made. 1 without variation."""
    x = value.cast("double")
    by = ratings.groupBy(dim, item).agg(F.count(x).alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).where("m >= 2")
    within = F.sum((F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1))
    n, s, q = F.sum("m"), F.sum("s"), F.sum("q")
    expected = F.try_divide(n * q - s * s, n * (n - 1))
    alpha = F.when(expected == 0, 1.0).otherwise(1 - F.try_divide(within / n, expected))
    return by.groupBy(dim).agg(n.alias("n"), alpha.alias("alpha"))


def weighted_kappa(pairs: DataFrame, group: str, a: Column, b: Column) -> DataFrame:
    """group, n, kappa with quadratic weights: 1 - E[(a-b)^2] / E of independent raters, from moments. 1 without variation."""
    a, b = F.floor(a + 0.5).cast("double"), F.floor(b + 0.5).cast("double")
    gap = F.avg(a) - F.avg(b)
    apart = F.var_pop(a) + F.var_pop(b) + gap * gap
    kappa = F.when(apart == 0, 1.0).otherwise(1 - F.try_divide(F.avg((a - b) * (a - b)), apart))
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n"), kappa.alias("kappa"))


def icc21(ratings: DataFrame, dim: str, item: str, rater: str, value: Column) -> DataFrame:
    """dim, items, raters, icc: two-way random effects, single rater, from the sums of squares of a complete design."""
    x = value.cast("double")
    base = ratings.select(dim, item, rater, x.alias("x"))
    total = base.groupBy(dim).agg(F.sum("x").alias("t"), F.sum(F.col("x") * F.col("x")).alias("q"))
    rows = base.groupBy(dim, item).agg(F.sum("x").alias("s")).groupBy(dim).agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("s") * F.col("s")).alias("rq"))
    cols = base.groupBy(dim, rater).agg(F.sum("x").alias("s")).groupBy(dim).agg(F.count(F.lit(1)).alias("raters"), F.sum(F.col("s") * F.col("s")).alias("cq"))
    out = total.join(rows, dim).join(cols, dim)
    n, k = F.col("items").cast("double"), F.col("raters").cast("double")
    c = F.col("t") * F.col("t") / (n * k)
    r, j = F.col("rq") / k - c, F.col("cq") / n - c
    out = out.withColumns({"msr": r / (n - 1), "msc": j / (k - 1), "mse": (F.col("q") - c - r - j) / ((n - 1) * (k - 1))})
    bottom = F.col("msr") + (k - 1) * F.col("mse") + k * (F.col("msc") - F.col("mse")) / n
    return out.select(dim, "items", "raters", F.try_divide(F.col("msr") - F.col("mse"), bottom).alias("icc"))


def js_divergence(rows: DataFrame, group: str, side: Column, sides: tuple[str, str], category: Column) -> DataFrame:
    """group, jsd: base-2 divergence of two histograms within 0..1; null is a category of its own."""
    by = rows.select(group, category.alias("c"), side.alias("s")).groupBy(group, "c").agg(F.count_if(F.col("s") == sides[0]).alias("a"), F.count_if(F.col("s") == sides[1]).alias("b"))
    whole = W.partitionBy(group)
    cells = by.select(group, ratio(F.col("a"), F.sum("a").over(whole)).alias("p"), ratio(F.col("b"), F.sum("b").over(whole)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return cells.groupBy(group).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(part(F.col("p")) + part(F.col("q"))) / 2)).alias("jsd"))


def bradley_terry(wins: DataFrame, smoothing: float = 0.1, tolerance: float = 1e-6, rounds: int = 256) -> DataFrame:
    """(a, b, wins_a, wins_b, draws) -> candidate, strength (geometric mean 1): minorise-maximise on the candidates' matrix.

    The matrix has a cell for each pair of candidates, which are few; matches were summed before.
    """
    cells = wins.collect()
    names = sorted({r[k] for r in cells for k in ("a", "b")})
    at = {x: i for i, x in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for r in cells:
        i, j = at[r["a"]], at[r["b"]]
        w[i, j] += r["wins_a"] + r["draws"] / 2 + smoothing
        w[j, i] += r["wins_b"] + r["draws"] / 2 + smoothing
    n, p = w + w.T, np.ones(len(names))
    for _ in range(rounds):
        new = w.sum(1) / np.where(n > 0, n / (p[:, None] + p[None, :]), 0).sum(1)
        new /= np.exp(np.log(new).mean())
        if np.abs(new - p).max() < tolerance:
            p = new
            break
        p = new
    return wins.sparkSession.createDataFrame([(x, float(s)) for x, s in zip(names, p, strict=True)], "candidate string, strength double")


class Wealth:
    """An e-process on outcomes within 0..1 against a mean of at most `null`: bets from the past only, decided once wealth reaches 1/alpha.

    A bet is the past edge over its variance plus squared edge, within 0..most; mean and variance are
    shrunk towards 1/2 and 1/4 by one observation. Wealth grows by the factor 1 + bet (x - null).
    """

    def __init__(self, null: float = 0.5, alpha: float = 0.05, most: float = 0.5) -> None:
        if not (0 < null < 1 and 0 < alpha < 1 and 0 < most < 1 / null):
            raise ValueError("null and alpha lie within 0..1, the greatest bet within 0..1/null")
        self.null, self.alpha, self.most = null, alpha, most
        self.wealth, self.n, self.total, self.squares, self.decided = 1.0, 0, 0.0, 0.0, None

    def add(self, x: float) -> float:
        if not 0 <= x <= 1:
            raise ValueError(f"outcome {x} is not within 0..1")
        seen = self.n + 1
        edge = (self.total + 0.5) / seen - self.null
        spread = (self.squares + 0.25) / seen
        self.wealth *= 1 + max(0.0, min(self.most, edge / (spread + edge * edge))) * (x - self.null)
        self.n, self.total = seen, self.total + x
        self.squares += (x - (self.total + 0.5) / (seen + 1)) ** 2
        if self.decided is None and self.wealth >= 1 / self.alpha:
            self.decided = self.n
        return self.wealth


def eprocess(rows: DataFrame, lane: str, order: Sequence[str], x: Column, null: float = 0.5) -> DataFrame:
    """lane, n, wealth, decided_at: the e-process over each lane's ordered outcomes, batch by batch in bounded memory."""
    kind = rows.schema[lane].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, ended = None, Wealth(null), []
        for pdf in batches:
            for key, value in zip(pdf["_lane"], pdf["_x"], strict=True):
                if key != now:
                    if now is not None:
                        ended.append((now, state.n, state.wealth, state.decided))
                    now, state = key, Wealth(null)
                state.add(value)
            if ended:
                yield pd.DataFrame(ended, columns=[lane, "n", "wealth", "decided_at"]).astype({"decided_at": "Int64"})
                ended = []
        if now is not None:
            yield pd.DataFrame([(now, state.n, state.wealth, state.decided)], columns=[lane, "n", "wealth", "decided_at"]).astype({"decided_at": "Int64"})

    named = rows.select(F.col(lane).alias("_lane"), x.cast("double").alias("_x"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    dealt = named.repartition("_lane").sortWithinPartitions("_lane", *(f"_o{i}" for i in range(len(order)))).select("_lane", "_x")
    return dealt.mapInPandas(run, f"{lane} {kind}, n long, wealth double, decided_at long")


class Gate:
    """A paired test that may stop at any time: `promote` once the wealth of n >= least pairs reaches 1 / alpha, `undecided-at-maxN` if `most` pairs end without.

    A decision stays, and what comes after it is not looked at. deltas lie within the scale; the null is a gain of
    min_effect at most.
    """

    def __init__(self, most: int, least: int = 5, scale: float = 1.0, alpha: float = 0.05, min_effect: float = 0.0, decrease: bool = False) -> None:
        if not 1 <= least <= most or not 0 <= min_effect < scale:
            raise ValueError("1 <= least <= most and 0 <= min_effect < scale")
        self.process, self.most, self.least, self.scale, self.sign = Wealth(0.5 + min_effect / (2 * scale), alpha), most, least, scale, -1 if decrease else 1
        self.decision = "continue"

    def add(self, delta: float) -> None:
        if self.decision != "continue":
            return
        if not abs(delta) <= self.scale:
            raise ValueError(f"delta {delta} is not within {self.scale} of 0")
        self.process.add((self.sign * delta / self.scale + 1) / 2)
        if self.process.n >= self.least and self.process.wealth >= 1 / self.process.alpha:
            self.decision = "promote"
        elif self.process.n >= self.most:
            self.decision = "undecided-at-maxN"


def sequential_gate(pairs: DataFrame, lane: str, order: Sequence[str], delta: Column, most: int, **options) -> DataFrame:
    """lane, n, wealth, decision: Gate over each lane's ordered differences, batch by batch in bounded memory. A null difference does not count."""
    kind, names = pairs.schema[lane].dataType.simpleString(), [lane, "n", "wealth", "decision"]
    Gate(most, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, gate, ended = None, None, []
        for pdf in batches:
            for key, value in zip(pdf["_lane"], pdf["_x"], strict=True):
                if gate is None or key != now:
                    if gate is not None:
                        ended.append((now, gate.process.n, gate.process.wealth, gate.decision))
                    now, gate = key, Gate(most, **options)
                gate.add(value)
            yield pd.DataFrame(ended, columns=names)
            ended = []
        if gate is not None:
            yield pd.DataFrame([(now, gate.process.n, gate.process.wealth, gate.decision)], columns=names)

    named = pairs.select(F.col(lane).alias("_lane"), delta.cast("double").alias("_x"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order))).where("_x is not null and _lane is not null")
    # a gate looks at `most` pairs at the most, so no more of a lane need to be sorted
    first = F.row_number().over(W.partitionBy("_lane").orderBy(*(f"_o{i}" for i in range(len(order)))))
    dealt = named.withColumn("_i", first).where(F.col("_i") <= most).repartition("_lane").sortWithinPartitions("_lane", "_i").select("_lane", "_x")
    return dealt.mapInPandas(run, f"{lane} {kind}, n long, wealth double, decision string")


def elo(matches: DataFrame, pool: str, order: Sequence[str], a: str, b: str, result: Column, k: float = 32.0) -> DataFrame:
    """pool, player, rating: sequential Elo from 1000 within each pool of matches; result is 1, 0.5 or 0 for player a.

    Pools pass one after the other through the tasks, in order, so a task holds one pool's players and no
    pool costs a group of its own.
    """
    kind = matches.schema[pool].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rating, begun = None, {}, False
        for batch in batches:
            done: list[tuple] = []
            for key, x, y, s in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != at or not begun:
                    done += [(at, name, r) for name, r in rating.items()]
                    at, rating, begun = key, {}, True
                rx, ry = rating.get(x, 1000.0), rating.get(y, 1000.0)
                step = k * (s - 1 / (1 + 10 ** ((ry - rx) / 400)))
                rating[x], rating[y] = rx + step, ry - step
            of = batch.schema.field(0).type
            yield told(done, of)
        if rating:
            yield told([(at, name, r) for name, r in rating.items()], of)

    def told(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        pools, players, ratings = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(pools, of), pa.array(players, pa.string()), pa.array(ratings, pa.float64())], [pool, "player", "rating"])

    known = F.coalesce(result.cast("double"), F.lit(float("nan")))
    orders = [f"_o{i}" for i in range(len(order))]
    named = matches.select(pool, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b"), known.alias("_s"), *(F.col(c).alias(o) for c, o in zip(order, orders, strict=True)))
    # a number of partitions, else adaptive plans make one task of what takes few bytes and much time
    tasks = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.repartition(tasks, pool).sortWithinPartitions(pool, *(F.asc_nulls_last(o) for o in orders))
    return dealt.select(pool, "_a", "_b", "_s").mapInArrow(run, f"{pool} {kind}, player string, rating double")
