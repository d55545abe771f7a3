"""Connected components of an edge table by alternating star contractions, DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _unsettled(edges: DataFrame) -> int:
    """Nodes that keep edges (u, v) from being stars around the v: with two larger ends, or between others."""
    up = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.col("v").alias("to"))
    down = edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(None).cast("long").alias("to"))
    ends = up.unionByName(down).groupBy("n").agg(F.min("up").alias("x"), F.max("up").alias("y"), F.min("to").alias("low"), F.max("to").alias("high"))
    return ends.where("x <> y or low <> high").count()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component), component being the smallest node reachable.

    Nodes without an edge to another node are absent. Each round hangs every node's larger
    neighbours on its smallest one, then its smaller neighbours likewise; the graph becomes a
    forest of stars in O(log^2 n) rounds. Minima are pre-aggregated before the shuffle and the
    joins that follow can be split by AQE, so a hub does not gather its edges in one task.
    """
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while _unsettled(edges):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(edges)
        drop(large)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def mixed_buckets(members: DataFrame, bucket: str, block: int) -> DataFrame:
    """(bucket, g, ...) -> bucket, main, n_main, n_rest: of buckets with members of several components, the largest one, its blocks and those of all others."""
    by = members.groupBy(bucket, "g").agg(F.count(F.lit(1)).alias("n"))
    sizes = by.groupBy(bucket).agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("g", F.struct("n", "g")).alias("main")).where("size > most")
    blocks = [F.ceil(n / block).cast("int").alias(name) for n, name in ((F.col("most"), "n_main"), (F.col("size") - F.col("most"), "n_rest"))]
    return sizes.select(bucket, "main", *blocks)


def cells(by: Column, in_main: Column, n_main: Column, n_rest: Column) -> tuple[Column, Column]:
    """A member's block, and the pairs of blocks (i, j) with i <= j that it belongs to: all but those of the largest component with itself.

    The blocks of the largest component follow those of the others, so the pairs number
    rest * (rest / 2 + main): a component that fills a bucket costs no pairs of its own.
    """
    part = F.when(in_main, n_rest + F.pmod(F.xxhash64(by), n_main)).otherwise(F.pmod(F.xxhash64(by), n_rest)).cast("int")
    others = F.when(in_main, F.sequence(F.lit(0), n_rest - 1)).otherwise(F.sequence(F.lit(0), n_rest + n_main - 1))
    return part, F.transform(others, lambda o: F.struct(F.least(part, o).alias("i"), F.greatest(part, o).alias("j")))


def settled(of: DataFrame, pairs: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """of (node, component) with the components joined that a similar pair connects; pairs (a, b, ga, gb, d) are not verified yet.

    ga and gb are the components of a and b, or the nodes themselves if they are in none; `verify` returns
    the similar ones among the pairs it is given. Of each two components the pair of least d is verified
    first, then every pair that still lies in two components: what is left unverified could join nothing.
    """
    pairs = written(pairs, "apart")
    if pairs.isEmpty():
        drop(pairs)
        return of
    best = F.min_by(F.struct("a", "b", "ga", "gb"), F.struct("d", "a", "b")).alias("p")
    first = written(pairs.groupBy(F.least("ga", "gb"), F.greatest("ga", "gb")).agg(best).select("p.*"), "first")
    ends = [F.col("ga").alias("a"), F.col("gb").alias("b")]
    if pairs.count() <= 2 * first.count():  # hardly any to be spared by an order
        found = written(verify(pairs.select("a", "b", "ga", "gb")).select(*ends), "found")
    else:
        found = written(verify(first).select(*ends), "found")
        joined = written(connected_components(found), "joined")
        rest = pairs.select("a", "b", "ga", "gb").join(first.select("a", "b"), ["a", "b"], "left_anti")
        for c in ("ga", "gb"):
            to = joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_to"))
            rest = rest.join(to, c, "left").withColumn(f"{c}_to", F.coalesce(f"{c}_to", c))
        more = written(verify(rest.where("ga_to <> gb_to").select("a", "b", "ga", "gb")).select(*ends), "found")
        found = found.unionByName(more)
    joined = written(connected_components(found), "joined")
    of = written(of, "of")
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = of.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(joined.join(of, "node", "left_anti").select("node", "component"))
