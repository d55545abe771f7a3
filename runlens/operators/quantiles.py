"""Exact interpolated quantiles without a group in one task, buckets by them, and how far two populations differ in them.

A mergeable sketch of each group tells, for every order statistic wanted, two values that it lies between
for all but certain. One more pass counts what lies below and, by value, what lies between; only the values
between, a small share that the sketch's error decides, are put in order. Where the count shows that a bracket
missed, it is widened to everything. Sketches are drawn anew each time they are made, so brackets are written
tables: all that follows sees the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import ratio
from ..scratch import small, written

#: Items of a sketch's levels, and the rank error (as a share) that brackets allow for: five times the sketch's typical one.
SKETCH = 2048
ERROR = 0.005
#: Values of a group up to which all are put in order.
FEW = 10_000


def exact_quantiles(rows: DataFrame, group: str | None, value: str, shares: Sequence[float], counted: DataFrame | None = None) -> DataFrame:
    """group (if any), n, q: array of the linearly interpolated quantiles at these shares, as percentile() gives them. Null and NaN values do not count.

    `counted`, if at hand, holds the same rows counted by value: group, value, n.
    """
    own = rows.select((F.lit(0) if group is None else F.col(group)).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    told = own.groupBy("_g").agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_k"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    few = F.col("_n") <= FEW

    def wish(i: int, share: float) -> Column:
        low, high = (F.kll_sketch_get_quantile_double("_k", F.lit(min(1.0, max(0.0, share + side * ERROR)))) for side in (-1, 1))
        low, high = F.when(few | F.lit(share <= ERROR), F.col("_lo")).otherwise(low), F.when(few | F.lit(share >= 1 - ERROR), F.col("_hi")).otherwise(high)
        return F.struct(F.lit(i).alias("i"), (F.lit(float(share)) * (F.col("_n") - 1)).alias("pos"), low.alias("lo"), high.alias("hi"))

    wanted = told.select("_g", "_n", "_lo", "_hi", F.explode(F.array(*(wish(i, s) for i, s in enumerate(shares)))).alias("w")).select("_g", "_n", "_lo", "_hi", "w.*")
    wanted = written(wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("r")), "brackets")
    by_value = own.withColumn("_w", F.lit(1)) if counted is None else counted.select((F.lit(0) if group is None else F.col(group)).alias("_g"), F.col(value).cast("double").alias("_v"), F.col("n").alias("_w")).where("_v is not null and not isnan(_v)")
    found = written(_between(by_value, wanted), "ranks")
    missed = written(wanted.join(found, ["_g", "r"], "left_anti").withColumns({"lo": F.col("_lo"), "hi": F.col("_hi")}), "missed")
    if not missed.isEmpty():
        found = found.unionByName(written(_between(by_value, missed), "ranks"))
    both = wanted.join(found, ["_g", "r"]).groupBy("_g", "_n", "i", "pos").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    q = F.col("a") + (F.col("pos") - F.floor("pos")) * (F.col("b") - F.col("a"))
    out = both.groupBy("_g", "_n").agg(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))).alias("q"))
    names = [] if group is None else [F.col("_g").alias(group)]
    return out.select(*names, F.col("_n").alias("n"), F.col("q.q").alias("q"))


def _between(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_g, _v, _w times), wanted (_g, r, lo, hi) -> _g, r, v: the values of these ranks (from 0), where they lie between lo and hi."""
    cut = small(written(wanted.groupBy("_g", "r").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "cuts"))
    # rows below a bracket are counted, rows inside by value; the rest of the rows makes none
    met = own.join(cut, "_g").where(F.col("_v") <= F.col("hi"))
    counts = met.groupBy("_g", "r", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("v")).agg(F.sum("_w").alias("n"))
    order = W.partitionBy("_g", "r").orderBy(F.col("v").asc_nulls_first())
    upto = counts.withColumn("upto", F.sum("n").over(order))
    return upto.where(F.col("v").isNotNull() & (F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n"))).select("_g", "r", "v")


def quantile_edges(rows: DataFrame, value: str, buckets: int = 5) -> DataFrame:
    """i, edge: distinct linear quantiles."""
    edges = exact_quantiles(rows, None, value, [i / buckets for i in range(1, buckets)])
    return edges.select(F.posexplode(F.array_distinct("q")).alias("i", "edge"))


def bucket_label(value: Column, edges: Column) -> Column:
    """[low,high) of the half-open bucket of a value between ascending edges, -inf and +inf at the ends; whole numbers without a fraction."""
    i = F.size(F.filter(edges, lambda e: value >= e))
    said = lambda at: F.regexp_replace(F.get(edges, at).cast("string"), r"\.0$", "")
    low, high = F.when(i == 0, "-inf").otherwise(said(i - 1)), F.when(i == F.size(edges), "+inf").otherwise(said(i))
    return F.when(value.isNotNull(), F.concat(F.lit("["), low, F.lit(","), high, F.lit(")")))


#: The category of missing values.
ABSENT = "(absent)"


def fidelity(rows: DataFrame, simulated: Column, numbers: Sequence[str], names: Sequence[str], buckets: int = 5, least: int = 20) -> DataFrame:
    """feature, n_sim, n_prod, divergence, top: how far simulated rows differ from the others, by feature; all features stay.

    Numbers are cut at the quantiles of both sides together, missing values are a category of their own.
    divergence is Jensen and Shannon's in bits, null where a side has fewer than `least` values; top holds the five
    categories (value, p_sim, p_prod) whose shares differ most. A row for each feature that any row has.
    """
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    sim = F.coalesce(simulated, F.lit(False)).alias("sim")
    long = rows.select(sim, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), finite(c).alias("x"), F.lit(None).cast("string").alias("name")) for c in numbers), *(F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("x"), F.col(c).cast("string").alias("name")) for c in names))).alias("f"))
    # values are counted before anything else sees them
    counts = written(long.select("sim", "f.*").groupBy("feature", "sim", "x", "name").agg(F.count(F.lit(1)).alias("n")), "counts")
    edges = exact_quantiles(long.select("f.feature", "f.x"), "feature", "x", [i / buckets for i in range(1, buckets)], counts).select("feature", F.array_distinct("q").alias("edges"))
    label = F.coalesce(bucket_label(F.col("x"), F.col("edges")), F.col("name"), F.lit(ABSENT))
    side = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0))
    cells = counts.join(edges, "feature", "left").groupBy("feature", label.alias("value")).agg(side(F.col("sim")).alias("s"), side(~F.col("sim")).alias("p"))
    w = W.partitionBy("feature")
    cells = cells.withColumns({"p_sim": ratio(F.col("s"), F.sum("s").over(w)), "p_prod": ratio(F.col("p"), F.sum("p").over(w))})
    part = lambda a, b: F.when(F.col(a) > 0, F.col(a) * F.log2(2 * F.col(a) / (F.col(a) + F.col(b)))).otherwise(0.0) / 2
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.round(F.abs(F.col("p_sim") - F.col("p_prod")), 12)).alias("o"), "value", "p_sim", "p_prod"))), 1, 5)
    seen = lambda c: F.sum(F.when(F.col("value") == ABSENT, 0).otherwise(F.col(c)))
    out = cells.groupBy("feature").agg(seen("s").alias("n_sim"), seen("p").alias("n_prod"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(part("p_sim", "p_prod") + part("p_prod", "p_sim")))).alias("d"), top.alias("t"))
    divergence = F.when((F.col("n_sim") >= least) & (F.col("n_prod") >= least), F.col("d"))
    return out.select("feature", "n_sim", "n_prod", divergence.alias("divergence"), F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["p_sim"].alias("p_sim"), x["p_prod"].alias("p_prod"))).alias("top"))


def fidelity_verdict(features: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: fidelity (1 less the mean divergence of the features that have one; NaN for none), insufficient (the others, in order), verdict."""
    score = 1 - F.avg("divergence")
    verdict = F.when(score.isNull(), "insufficient-data").when(score >= least, "representative").otherwise("skewed")
    return features.agg(F.coalesce(score, F.lit(float("nan"))).alias("fidelity"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("divergence").isNull(), F.col("feature")))), ",").alias("insufficient"), verdict.alias("verdict"))


def easy_mode(rows: DataFrame, simulated: Column, score: Column, threshold: float = 0.5, tolerance: float = 0.1) -> DataFrame:
    """One row: pass_sim, pass_prod, gap, inflated (by more than the tolerance): is the simulator easier than production? A run without a score is an error, and so is a side without runs."""
    s = score.cast("double")
    known = F.when(s.isNull() | F.isnan(s), F.raise_error(F.lit("a run has no score")).cast("double")).otherwise(s)
    passed = lambda on: F.avg(F.when(on, (known >= threshold).cast("int")))
    sim = F.coalesce(simulated, F.lit(False))
    out = rows.agg(passed(sim).alias("pass_sim"), passed(~sim).alias("pass_prod"))
    side = lambda c: F.coalesce(c, F.raise_error(F.lit("a side has no runs")).cast("double")).alias(c)
    out = out.select(side("pass_sim"), side("pass_prod"))
    gap = F.col("pass_sim") - F.col("pass_prod")
    return out.withColumns({"gap": gap, "inflated": gap > tolerance})
