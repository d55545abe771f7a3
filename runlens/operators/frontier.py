"""Frontiers over any number of objectives, without a window or task that holds all points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch, written

#: Points of a block that one task holds against another block; cells that the merge cuts the space into at most.
BLOCK = 4096
CELLS = 256


def local_skyline(x: np.ndarray) -> np.ndarray:
    """Places of the rows that no other row dominates (lower is better, equal rows stay), smallest sums first."""
    order = np.argsort(x.sum(axis=1), kind="stable")
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), 256):
        part = order[at : at + 256]
        part = part[~dominated(x[part], x[kept])]
        kept = np.concatenate([kept, part[~dominated(x[part], x[part])]])
    return kept


def dominated(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of x some row of `by` dominates: nowhere worse, somewhere better."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(by), 256):
        some = by[at : at + 256]
        out |= ((some[None] <= x[:, None]).all(axis=2) & (some[None] < x[:, None]).any(axis=2)).any(axis=1)
    return out


def _vectors(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in names], axis=1)


def skyline(points: DataFrame, objectives: dict[str, str]) -> DataFrame:
    """The points that no other dominates; objectives give each column's direction, `max` or `min`. Equal points stay together.

    Points with a missing or infinite objective are left out. Every batch drops what it dominates itself; what is
    left is cut into cells along each objective, cells that another one dominates go whole, and blocks of the others
    are held against the blocks of cells that may dominate them.
    """
    if not objectives or set(objectives.values()) - {"max", "min"}:
        raise ValueError("objectives: at least one, each max or min")
    names = [f"_o{i}" for i in range(len(objectives))]
    x = [F.col(c).cast("double") * (1 if way == "min" else -1) for c, way in objectives.items()]
    finite = reduce(and_, (v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) for v in x))
    with scratch() as kept:
        rows = written(points.where(finite).withColumn("_id", F.monotonically_increasing_id()).withColumns(dict(zip(names, x, strict=True))), "points")
        some = written(_local(rows.select("_id", *names), names), "local")
        gone = _merged(some, names)
        stays = some.select("_id").join(gone, "_id", "left_anti")
        kept.append(written(rows.join(stays, "_id", "left_semi").select(*points.columns), "frontier"))
    return kept[0]


def _local(rows: DataFrame, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(local_skyline(_vectors(b, names))))

    return rows.mapInArrow(run, rows.schema)


def _counting(name: str):
    return lambda n, edge: n + (edge <= F.col(name)).cast("int")


def _merged(some: DataFrame, names: list[str]) -> DataFrame:
    """(_id, objectives) -> _id of those that another one dominates."""
    cut = max(1, round(CELLS ** (1 / len(names)))) - 1 or 1
    used = names[:8]  # of more objectives the others do not cut
    shares = [(i + 1) / (cut + 1) for i in range(cut)]
    edges = some.agg(*(F.percentile_approx(c, F.array(*map(F.lit, shares))).alias(f"_e{c}") for c in used))  # one row of cell edges
    cell = [F.aggregate(f"_e{c}", F.lit(0), _counting(c)).alias(f"_c{c}") for c in used]
    placed = written(some.crossJoin(F.broadcast(edges)).select("_id", *names, *cell).withColumn("cell", F.concat_ws("-", *(f"_c{c}" for c in used))), "placed")
    cells = placed.groupBy("cell", *(f"_c{c}" for c in used)).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # CELLS rows, or 2^8
    a, b = (cells.select(*(F.col(c).alias(f"{side}{c}") for c in cells.columns)) for side in "ab")
    below = reduce(and_, (F.col(f"a_c{c}") <= F.col(f"b_c{c}") for c in used))
    whole = reduce(and_, (F.col(f"a_c{c}") < F.col(f"b_c{c}") for c in used))
    pairs = written(a.join(F.broadcast(b), below).select("acell", "bcell", "ablocks", "bblocks", (whole if len(used) == len(names) else F.lit(False)).alias("whole")), "cells")
    lost = pairs.where("whole").select(F.col("bcell").alias("cell")).distinct()
    left = pairs.join(lost, F.col("bcell") == F.col("cell"), "left_anti").join(lost, F.col("acell") == F.col("cell"), "left_anti")
    block = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    upper = placed.join(left, F.col("cell") == F.col("bcell")).select("_id", *names, "acell", "bcell", block("bblocks").alias("j"), F.explode(F.sequence(F.lit(0), F.col("ablocks") - 1)).alias("i"))
    lower = placed.join(left, F.col("cell") == F.col("acell")).select(*names, "acell", "bcell", F.explode(F.sequence(F.lit(0), F.col("bblocks") - 1)).alias("j"), block("ablocks").alias("i"))

    lower = lower.select(*(F.col(c).alias(f"low{c}") for c in lower.columns))  # names of its own, as both sides come from one table

    def beaten(up: pa.Table, low: pa.Table) -> pa.Table:
        hit = dominated(_vectors(up, names), _vectors(low, [f"low{c}" for c in names])) if len(up) and len(low) else np.zeros(len(up), bool)
        return up.select(["_id"]).filter(pa.array(hit))

    keys = ["acell", "bcell", "i", "j"]
    found = upper.groupBy(*keys).cogroup(lower.groupBy(*(f"low{k}" for k in keys))).applyInArrow(beaten, "_id long")
    return found.unionByName(placed.join(lost, "cell", "left_semi").select("_id")).distinct()
