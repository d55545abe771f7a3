"""Trees by list ranking: depth without limit, orphans, cycles, sums, and the issues of supervised runs."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import trees


def frame(spark, rows):
    return spark.createDataFrame(rows, "run string, s long, p long, o long, w int")


def walk(rows):
    """By recursion over dicts: (run, span) -> (reach, depth, index, below)."""
    out = {}
    for run in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == run]
        parent, weight = {r[1]: r[2] for r in own}, {r[1]: r[4] for r in own}
        kids = {}
        for r in sorted(own, key=lambda r: (r[3], r[1])):
            kids.setdefault(r[2], []).append(r[1])
        ring = set()
        for s in parent:
            at, seen = s, []
            while at in parent and at not in seen:
                seen.append(at)
                at = parent[at]
            if at == s and parent[s] is not None:
                ring.add(s)
        index = 0
        stack = [(s, 0) for s in reversed(kids.get(None, []))]
        placed = {}
        while stack:
            s, depth = stack.pop()
            placed[s] = depth, index
            index += 1
            stack += [(c, depth + 1) for c in reversed(kids.get(s, []))]

        def below(s):
            total, todo = 0, [c for c in kids.get(s, []) if c not in ring]
            while todo:
                c = todo.pop()
                total += weight[c]
                todo += [x for x in kids.get(c, []) if x not in ring]
            return total

        for s in parent:
            at, seen = s, set()
            while at in parent and at not in seen and at not in ring:
                seen.add(at)
                at = parent[at]
            reach = "cycle" if s in ring else "root" if s in placed else "under_cycle" if at in ring else "orphan"
            out[run, s] = (reach, *placed.get(s, (None, None)), below(s))
    return out


def test_forests_with_orphans_and_cycles(spark):
    rng = random.Random(1)
    rows = []
    for run, n in (("a", 1), ("b", 2), ("c", 60), ("d", 60), ("e", 7)):
        ids = list(range(n))
        rng.shuffle(ids)
        rows += [(run, s, None if rng.random() < 0.08 else rng.randrange(n + n // 8), rng.randrange(5), rng.randrange(4)) for s in ids]
    rows += [("self", 1, 1, 0, 2), ("self", 2, 1, 0, 3), ("roots", 1, None, 2, 1), ("roots", 2, None, 1, 1), ("roots", 3, 2, 1, 1)]
    got = {(r.run, r.s): (r.reach, r.depth, r["index"], r.below) for r in trees.tour(frame(spark, rows), "run", "s", "p", ["o"], F.col("w")).collect()}
    want = walk(rows)
    assert got == want and {x[0] for x in want.values()} == {"root", "orphan", "cycle", "under_cycle"}


def test_a_chain_of_ten_thousand_and_a_star(spark):
    chain = [("chain", i, i - 1 if i else None, 0, int(i % 2)) for i in range(10_000)]
    star = [("star", i, 0 if i else None, -i, 1) for i in range(5_000)]
    got = {(r.run, r.s): r for r in trees.tour(frame(spark, chain + star), "run", "s", "p", ["o"], F.col("w")).collect()}
    assert [(got["chain", i].depth, got["chain", i]["index"]) for i in (0, 1, 9_999)] == [(0, 0), (1, 1), (9_999, 9_999)]
    assert got["chain", 4_000].below == sum(i % 2 for i in range(4_001, 10_000))
    assert got["star", 0].below == 4_999 and got["star", 4_999]["index"] == 1 and got["star", 1]["index"] == 4_999


def test_nothing_to_walk(spark):
    none = frame(spark, []).where("false")
    assert trees.tour(none, "run", "s", "p", ["o"]).count() == 0
    assert trees.trajectory(frame(spark, [("r", None, 1, 0, 0), (None, 1, None, 0, 0)]), "run", "s", "p", ["o"]).count() == 0


def test_a_failure_comes_up_from_below(spark):
    rows = [("r", 1, None, 0, 1), ("r", 2, 1, 0, 0), ("r", 3, 2, 0, 1), ("r", 4, 3, 0, 0), ("x", 1, 2, 0, 1), ("x", 2, 1, 0, 0), ("o", 5, 99, 0, 1), ("o", 6, 5, 0, 1)]
    df = frame(spark, rows)
    got = {(r.run, r.s): r.propagated for r in trees.propagated_errors(df, "run", "s", "p", df.w == 1).collect()}
    assert got == {("r", 1): True, ("r", 3): False, ("x", 1): True, ("o", 5): True, ("o", 6): False}


def test_issues_of_a_tree(spark):
    schema = "run string, id string, parent string, role string, claimed_run string, start long, close long, completed boolean, terminal boolean"
    rows = [
        ("a", "root", None, "supervisor", "a", 0, 90, True, True), ("a", "w", "root", "worker", "a", 5, 80, True, True), ("a", "v", "w", "worker", "a", 6, None, None, False),
        ("b", "root", "x", "worker", "b", 0, 9, False, True), ("b", "x", "root", None, "c", 10, 4, None, True), ("b", "y", None, None, None, None, None, None, None), ("b", "z", "gone", None, None, None, None, None, None),
        ("c", "twice", None, None, None, 1, 2, None, None), ("c", "twice", "twice", None, None, 1, 2, None, None), ("c", None, None, None, None, None, None, None, None), ("c", "p", "gone", None, None, None, None, None, None),
        ("d", "s", "s", None, None, None, None, None, None), ("d", "m", "n", None, None, 3, None, None, None), ("d", "n", "m", None, None, 2, None, None, None), ("d", "under", "m", None, None, None, None, None, None),
    ]
    roots = spark.createDataFrame([("a", "root"), ("b", "root"), ("c", "lost")], "run string, root string")
    got = sorted(tuple(r) for r in trees.tree_issues(spark.createDataFrame(rows, schema), roots).collect())
    assert got == sorted([
        ("a", "child-terminal-unavailable", "child-terminal-outcomes"),
        ("b", "root-has-parent", "root"), ("b", "root-role-invalid", "root"), ("b", "detached-node", "y"), ("b", "parent-missing", "z"), ("b", "parent-cycle", "root"),
        ("b", "cross-run-parent", "root"), ("b", "cross-run-parent", "x"), ("b", "child-before-parent", "root"), ("b", "child-after-parent-close", "x"), ("b", "close-before-start", "x"),
        ("c", "duplicate-rollout-id", "twice"), ("c", "node-checks-unavailable", "lost"), ("c", "node-checks-unavailable", "p"),
        ("d", "root-unavailable", "tree-root"), ("d", "child-before-parent", "n"), ("d", "parent-cycle", "m"), ("d", "parent-cycle", "s"),
    ])


@pytest.mark.parametrize("n", [1, 3])
def test_scratch_tables_go(spark, n):
    import os

    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(where))
    trees.tour(frame(spark, [("r", i, i - 1 if i else None, 0, 0) for i in range(n)]), "run", "s", "p", ["o"]).collect()
    assert len(set(os.listdir(where)) - before) == 1


def test_rounds_send_nothing_through_the_driver(spark, monkeypatch):
    plans = []

    def spy(df, name="t"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    written = trees.written
    monkeypatch.setattr(trees, "written", spy)
    nodes = [("r", f"n{i}", f"n{(i + 1) % 6}" if i < 6 else f"n{i - 1}", "worker", "r", i, i + 1, True, True) for i in range(12)]
    schema = "run string, id string, parent string, role string, claimed_run string, start int, close int, completed boolean, terminal boolean"
    got = trees.tree_issues(spark.createDataFrame(nodes, schema), spark.createDataFrame([("r", None)], "run string, root string")).collect()
    assert ("r", "parent-cycle", "n0") in {tuple(r) for r in got}
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
