"""Near-duplicate embeddings by a forest of random-projection trees with overlapping splits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

TREES = 5
#: Vectors aimed at in a leaf; it sets the depth of the trees.
LEAF = 384
#: Vectors that one task compares with each other, or with as many others.
BLOCK = 1024
#: Half the width of the band around a split whose vectors go both ways, for unit vectors of 64 dimensions; projections shrink with the root of the dimension.
SPILL = 0.02
#: The splits are fitted on at most so many vectors, chosen by hash of the id; every vector is indexed.
SAMPLE = 16_384
#: Levels whose nodes have medians of their own; deeper ones share their level's median.
OWN_MEDIANS = 12
#: A node stays whole if over this share of its sample would go both ways.
TIGHT = 0.5


def spill(dim: int) -> float:
    return SPILL * math.sqrt(64 / dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by their largest component first."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Tree:
    directions: np.ndarray  # one for each level
    level_medians: np.ndarray
    medians: np.ndarray  # by node, numbered as in a heap; NaN: the node stays whole

    @classmethod
    def fit(cls, x: np.ndarray, depth: int, seed: int) -> Tree:
        rng = np.random.default_rng([seed, x.shape[1]])
        directions = rng.standard_normal((max(depth, 1), x.shape[1]))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        own = min(depth, OWN_MEDIANS)
        medians, node = np.full(1 << own, np.nan), np.ones(len(x), np.int64)
        shown = x @ directions.T
        level_medians = np.median(shown, axis=0)
        for level in range(own):
            order = np.argsort(node, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                n, p = int(node[rows[0]]), shown[rows, level]
                split = float(np.median(p)) if len(rows) >= 16 else float(level_medians[level])
                whole = len(rows) >= 16 and (np.abs(p - split) < spill(x.shape[1])).mean() > TIGHT
                if n >= 1 << level and not whole:
                    medians[n] = split
                    node[rows] = 2 * n + (p >= split)
            empty = np.arange(1 << level, 2 << level)
            seen = np.isin(empty, node) | np.isin(2 * empty, node) | np.isin(2 * empty + 1, node)
            medians[empty[~seen]] = level_medians[level]
        return cls(directions, level_medians, medians)

    def leaves(self, x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row falls into."""
        shown = x @ self.directions.T
        rows, nodes = np.arange(len(x)), np.ones(len(x), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(depth):
            split = self.medians[nodes] if level < OWN_MEDIANS else np.full(len(rows), self.level_medians[level])
            whole = np.isnan(split)
            done.append((rows[whole], nodes[whole]))
            rows, nodes, split = rows[~whole], nodes[~whole], split[~whole]
            p = shown[rows, level] - split
            left, right = p < spill(x.shape[1]), p >= -spill(x.shape[1])
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
        done.append((rows, nodes))
        return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.empty((0, 1))


def _valid(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & ok & F.exists(v, lambda x: x != 0)


def _groups(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Each row's members: ids, unit vectors, numbers of copies, parts; and whether only pairs across parts count."""
    for members, cross in zip(b.column(0), b.column(1), strict=True):
        own = members.values
        yield np.asarray(own.field(0)), unit(_matrix(own.field(1))), np.asarray(own.field(2)), np.asarray(own.field(3)), cross.as_py()


def _dealt(rows: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """(key, vec_id, embedding, copies) -> members, cross: groups of a key, the large ones as all pairs of hashed blocks."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    return (
        rows.join(sizes.where("n > 1"), key)
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .groupBy(*key, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        .agg(F.collect_list(F.struct("vec_id", "embedding", "copies", "part")).alias("members"))
        .where(F.size("members") > 1)
        .select("members", (F.col("i") != F.col("j")).alias("cross"))
    )


def _near(x: np.ndarray, part: np.ndarray, cross: bool, least: float) -> np.ndarray:
    near = x @ x.T >= least
    if cross:
        near &= part[:, None] != part[None, :]
    np.fill_diagonal(near, False)
    return near


def _spanning(least: float):
    """Edges that span the components of each group's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for ids, x, _, part, cross in _groups(b):
                near, label = _near(x, part, cross, least), ids.copy()
                i, j = np.nonzero(near)
                while True:
                    low = label.copy()
                    np.minimum.at(low, i, label[j])
                    if (low == label).all():
                        break
                    label = low
                a.append(ids[label != ids])
                c.append(label[label != ids])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, c)], ["a", "b"])

    return run


def _counting(least: float):
    """How many links to other vectors each one has within each group; a vector that stands for copies counts as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for ids, x, copies, part, cross in _groups(b):
                n = _near(x, part, cross, least) @ copies
                a.append(ids[n > 0])
                c.append(n[n > 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, c)], ["vec_id", "links"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, embedding, ...) -> vec_id, n_links, component_id, kept, one row for each input row.

    Equal vectors are one node that knows its number of copies, so a large group of them is compared once.
    Candidates come from the leaves of the forest; a pair is linked if its cosine in double precision is
    at least `least`. Leaves only have to connect what belongs together: links are counted afterwards
    among the members of a component, in blocks, so that no pair is written down and none is counted
    twice. Vectors that are null, empty or zero, hold null or non-finite components or have no vec_id
    link with nothing, nor do vectors of different lengths; component_id is then vec_id. Equal rows count
    once. Rows with one vec_id but different vectors each show the smallest of their components and the
    sum of their links.
    """
    equal = [F.xxhash64("embedding").alias("h"), F.hash("embedding").alias("h2"), F.size("embedding").alias("dim")]
    ok = F.col("vec_id").isNotNull() & _valid(F.col("embedding"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(ok).select("vec_id", "embedding", *equal)
    own_ids = written(rows.groupBy("h", "h2", "dim", "vec_id").agg(F.first("embedding").alias("embedding")), "ids")
    nodes = own_ids.groupBy("h", "h2", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    good = written(nodes.select("h", "h2", F.col("rep").alias("vec_id"), "embedding", "dim", "copies"), "vectors")
    n = good.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
    some = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    by_dim: dict[int, list] = {}
    for r in some:
        by_dim.setdefault(len(r[0]), []).append(r[0])
    forest = {d: [Tree.fit(unit(np.array(x)), depth, seed) for seed in range(TREES)] for d, x in by_dim.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in np.unique(np.asarray(b.column(2))).tolist():
                own = b.filter(pa.array(np.asarray(b.column(2)) == dim))
                x = unit(_matrix(own.column(1)))
                trees = shared.value.get(dim)  # a length that the sample lacks is rare: one leaf
                for t, tree in enumerate(trees or [None]):
                    at, leaf = tree.leaves(x, depth) if tree else (np.arange(len(x)), np.ones(len(x), np.int64))
                    for s in range(0, len(at), 8192):
                        k, out = at[s : s + 8192], own.take(pa.array(at[s : s + 8192]))
                        yield pa.RecordBatch.from_arrays(
                            [out.column(0), out.column(1), pa.array(np.full(len(k), dim), pa.int32()), out.column(3), pa.array(np.full(len(k), t), pa.int32()), pa.array(leaf[s : s + 8192])],
                            ["vec_id", "embedding", "dim", "copies", "tree", "leaf"],
                        )

    kind = good.schema["embedding"].dataType.simpleString()
    indexed = good.select("vec_id", "embedding", "dim", "copies")
    routed = written(indexed.mapInArrow(route, f"vec_id long, embedding {kind}, dim int, copies long, tree int, leaf long"), "leaves")
    key = ["dim", "tree", "leaf"]
    sizes = routed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    edges = _dealt(routed, sizes, key).mapInArrow(_spanning(least), "a long, b long")
    component = connected_components(edges).select(F.col("node").alias("vec_id"), "component")
    component = written(component, "components")
    member = written(indexed.join(component, "vec_id"), "members")
    sizes = member.groupBy("component", "dim").agg(F.count(F.lit(1)).alias("n"))
    links = _dealt(member, sizes, ["component", "dim"]).mapInArrow(_counting(least), "vec_id long, links long")
    links = links.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    nodes = good.join(component, "vec_id", "left").join(links, "vec_id", "left")
    nodes = nodes.select("h", "h2", "dim", F.coalesce("component", "vec_id").alias("component"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = own_ids.select("h", "h2", "dim", "vec_id").join(nodes, ["h", "h2", "dim"])
    several = found.groupBy("vec_id").agg(F.min("component").alias("component"), F.sum("n_links").cast("long").alias("n_links"))
    own = F.coalesce("component", "vec_id")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(several, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"),
        F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
