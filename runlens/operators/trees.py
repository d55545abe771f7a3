"""Trees of spans and of supervised runs, by list ranking instead of recursion.

A tree's tour enters and leaves every node once, so it is a list of two elements a node: entering leads to
the first child or, without one, to leaving; leaving leads to the next sibling or to leaving the parent.
Every element doubles its pointer and adds up what it skips, so after log2 of the tour's length each knows
what lies behind it: places, depths and sums over subtrees at once. An element has one predecessor, hence
no round has a hot key, however wide or deep the tree. Rounds are written tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import drop, scratch, written

#: Joins of tables that both grow with the runs: left to sizes, each would be broadcast through the driver while it is just small enough, round by round.
_GROWS = "merge"
_STATE = ("run", "node", "leave", "to", "to_leave", "last", "last_leave", "n_in", "n_out", "weight")


def _ranked(links: DataFrame, longest: int) -> DataFrame:
    """Elements with pointers (to, to_leave; null at a list's end) and weights -> sums from each element to its list's end.

    `to` stays set where no end is reached: on or before a cycle.
    """
    state = written(links.select(*_STATE), "tour")
    steps = 1
    while steps < longest and not state.where("to is not null").isEmpty():
        ahead = state.select(F.col("run").alias("_run"), *(F.col(c).alias(f"_{c}") for c in _STATE[1:]))
        on = (F.col("run") == F.col("_run")) & (F.col("to") == F.col("_node")) & (F.col("to_leave") == F.col("_leave"))
        met = state.hint(_GROWS).join(ahead, on, "left")
        there = F.col("_node").isNotNull()
        last, last_leave = (F.when(there, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("last", "last_leave"))
        sums = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("n_in", "n_out", "weight")]
        new = written(met.select("run", "node", "leave", F.col("_to").alias("to"), F.col("_to_leave").alias("to_leave"), last, last_leave, *sums), "tour")
        drop(state)
        state, steps = new, 2 * steps
    return state


def _tour(nodes: DataFrame) -> DataFrame:
    """(run, node, parent, weight, ord) with unique nodes -> the two elements of each node, with pointers along the tour."""
    beside = W.partitionBy("run", "parent").orderBy("ord", "node")
    first = nodes.where("parent is not null").groupBy("run", F.col("parent").alias("node")).agg(F.min(F.struct("ord", F.col("node").alias("child")))["child"].alias("child"))
    rows = nodes.withColumn("next", F.lead("node").over(beside)).hint(_GROWS).join(first, ["run", "node"], "left")
    into = F.struct(F.lit(False).alias("leave"), F.coalesce("child", "node").alias("to"), F.col("child").isNull().alias("to_leave"), F.col("weight").alias("weight"))
    out = F.struct(F.lit(True).alias("leave"), F.coalesce("next", "parent").alias("to"), F.col("next").isNull().alias("to_leave"), F.lit(0).cast("long").alias("weight"))
    rows = rows.select("run", "node", F.inline(F.array(into, out)))
    ones = [F.when(F.col("leave") == side, 1).otherwise(0).cast("long").alias(name) for name, side in (("n_in", False), ("n_out", True))]
    return rows.select("run", "node", "leave", "to", F.when(F.col("to").isNotNull(), F.col("to_leave")).alias("to_leave"), F.col("node").alias("last"), F.col("leave").alias("last_leave"), *ones, "weight")


def _on_cycles(nodes: DataFrame, longest: int) -> DataFrame:
    """(run, node): the nodes that are their own ancestors. After more steps up than a run has nodes, the ancestors that are left are just these."""
    up = written(nodes.select("run", "node", F.col("parent").alias("up")), "up")
    steps = 1
    while steps < longest and not up.isEmpty():
        above = up.select(F.col("run").alias("_run"), F.col("node").alias("_node"), F.col("up").alias("_up"))
        met = up.hint(_GROWS).join(above, (F.col("run") == F.col("_run")) & (F.col("up") == F.col("_node")))  # what has no ancestor left falls out
        new = written(met.select("run", "node", F.col("_up").alias("up")), "up")
        drop(up)
        up, steps = new, 2 * steps
    return up.select("run", F.col("up").alias("node")).distinct()


def tour(spans: DataFrame, run: str, span: str, parent: str, order: Sequence[str], weight: Column | None = None) -> DataFrame:
    """run, span, reach, depth, index, below: a written row for each span.

    reach: `root` below a parentless span, `orphan` below one whose parent is missing, `cycle` on a cycle of
    parents, `under_cycle` below one. depth and index (pre-order from 0 over the run, siblings by order, then
    span) are null but for `root`; below is the weight (integers) of all descendants, of a cycle's spans
    without what the cycle adds. Span ids must be unique in a run; spans without an id are left out; a null
    run is no run and left out.
    """
    known = spans.where(F.col(run).isNotNull() & F.col(span).isNotNull())
    w = F.coalesce(weight, F.lit(0)).cast("long") if weight is not None else F.lit(0).cast("long")
    rows = known.select(F.col(run).alias("run"), F.col(span).alias("node"), F.col(parent).alias("parent"), F.struct(*order).alias("ord"), w.alias("weight"))
    with scratch() as kept:
        nodes = written(rows, "nodes")
        longest = nodes.groupBy("run").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        ranked = _ranked(_tour(nodes), 2 * longest)
        stuck = written(nodes.hint(_GROWS).join(ranked.where("to is not null").select("run", "node").distinct(), ["run", "node"], "left_semi"), "stuck")
        reach = F.lit(None).cast("string").alias("reach")
        if not stuck.isEmpty():
            ring = written(_on_cycles(stuck, longest), "ring").withColumn("ring", F.lit(True))
            cut = written(stuck.hint(_GROWS).join(ring, ["run", "node"], "left").withColumn("parent", F.when(F.col("ring").isNull(), F.col("parent"))), "cut")
            again = _ranked(_tour(cut.drop("ring")), 2 * longest).hint(_GROWS).join(cut.select("run", "node", "ring"), ["run", "node"])
            state = F.when(F.col("ring"), "cycle").otherwise("under_cycle")
            ranked = ranked.where("to is null").withColumn("reach", reach).unionByName(again.select(*ranked.columns, state.alias("reach")))
        else:
            ranked = ranked.withColumn("reach", reach)
        one = ranked.groupBy("run", "node").agg(
            F.max("reach").alias("reach"),
            *(F.max(F.when(~F.col("leave"), F.col(c))).alias(f"{c}_in") for c in ("last", "n_in", "n_out", "weight")),
            F.max(F.when(F.col("leave"), F.col("weight"))).alias("weight_out"),
        )
        # a tour that ends with a parentless span's leaving is the run's own; the sums at its first element are those of the run
        roots = nodes.where("parent is null").select("run", F.col("node").alias("last_in"), F.lit("root").alias("ends"))
        done = one.hint(_GROWS).join(nodes.select("run", "node", "weight"), ["run", "node"]).hint(_GROWS).join(roots, ["run", "last_in"], "left")
        done = done.withColumn("reach", F.coalesce("reach", "ends", F.lit("orphan"))).withColumn("ends", F.when(F.col("reach") == "root", F.lit(1)))
        totals = done.where("ends is not null").groupBy("run").agg(F.max("n_in_in").alias("all_in"), F.max("n_out_in").alias("all_out"))
        done = done.hint(_GROWS).join(totals, "run", "left")
        index = F.when(F.col("reach") == "root", F.col("all_in") - F.col("n_in_in"))
        depth = index - (F.col("all_out") - F.col("n_out_in"))
        below = F.col("weight_in") - F.col("weight_out") - F.col("weight")
        kept.append(written(done.select(F.col("run").alias(run), F.col("node").alias(span), "reach", depth.cast("int").alias("depth"), index.cast("int").alias("index"), below.alias("below")), "trees"))
    return kept[0]


def trajectory(spans: DataFrame, run: str, span: str, parent: str, order: Sequence[str]) -> DataFrame:
    """run, span, depth, index: pre-order walk from the roots, siblings in order; spans that no root reaches are left out. No limit on depth."""
    return tour(spans, run, span, parent, order).where("reach = 'root'").select(run, span, "depth", "index")


def propagated_errors(spans: DataFrame, run: str, span: str, parent: str, failed: Column) -> DataFrame:
    """run, span, propagated: failed spans, and whether the failure came up from a failed descendant (on a cycle of parents every span is its own)."""
    bad = F.coalesce(failed, F.lit(False))
    walked = tour(spans, run, span, parent, [span], bad.cast("int"))
    return spans.where(bad).select(run, span).join(walked, [run, span]).select(run, span, ((F.col("below") > 0) | (F.col("reach") == "cycle")).alias("propagated"))


def error_summary(spans: DataFrame, run: str, span: str, parent: str, role: str, failed: Column, process_root: Column) -> DataFrame:
    """run, total, guardrail, evaluation, process, propagated, execution, unclassified: failed spans by the first kind that holds. A run without a failure has no row."""
    told = propagated_errors(spans, run, span, parent, failed)
    rows = spans.join(told, [run, span])
    # fixed values: the roles of spans
    kind = (
        F.when(F.col(role) == "GUARDRAIL", "guardrail").when(F.col(role) == "EVALUATOR", "evaluation").when(process_root, "process").when(F.col("propagated"), "propagated")
        .when(F.col(role).isin("AGENT", "CHAIN", "LLM", "TOOL"), "execution").otherwise("unclassified")
    )
    kinds = ("guardrail", "evaluation", "process", "propagated", "execution", "unclassified")
    return rows.select(run, kind.alias("_kind")).groupBy(run).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("_kind") == k).alias(k) for k in kinds))


def supervised(events: DataFrame) -> DataFrame:
    """Journal events (run, ord, kind, id, parent, label, role, at, status, input, output, usd) -> one row for each run and valid spawned id.

    run, id, parent, label, role, root (the run's first valid parentless spawn), copies (spawns of this id), spawned_at, closed_at, close
    (settled or cancelled), status, input, output, usd: of the first spawn, and of the first close of the id. A spawn needs id, label and,
    if given, the role supervisor or worker; an empty parent is none. The root's tokens and cost are those it metered for itself.
    """
    kind, filled = F.col("kind"), lambda c: F.nullif(F.col(c), F.lit(""))
    role_ok = F.col("role").isNull() | F.col("role").isin("supervisor", "worker")
    spawn = (kind == "spawned") & filled("id").isNotNull() & filled("label").isNotNull() & role_ok
    close = kind.isin("settled", "cancelled")
    first = F.min(F.when(spawn, F.struct("ord", filled("parent").alias("parent"), "label", "role", "at")))
    end = F.min(F.when(close, F.struct("ord", "kind", F.when(kind == "cancelled", kind).otherwise(F.col("status")).alias("status"), "at", "input", "output", "usd")))
    spent = [F.sum(F.when(kind == "metered", F.coalesce(c, F.lit(0)))).alias(f"own_{c}") for c in ("input", "output", "usd")]
    by = events.groupBy("run", "id").agg(first.alias("s"), end.alias("e"), F.min(F.when(spawn & filled("parent").isNull(), F.col("ord"))).alias("root_ord"), F.count_if(spawn).alias("copies"), *spent).where("s is not null")
    roots = by.where("root_ord is not null").groupBy("run").agg(F.min_by("id", "root_ord").alias("root_id"))
    rows = by.join(roots, "run", "left").withColumn("root", F.coalesce(F.col("id") == F.col("root_id"), F.lit(False)))
    costs = [F.when(F.col("root"), F.col(f"own_{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in ("input", "output", "usd")]
    return rows.select("run", "id", "s.parent", "s.label", "s.role", "root", "copies", F.col("s.at").alias("spawned_at"), F.col("e.at").alias("closed_at"), F.col("e.kind").alias("close"), "e.status", *costs)


def tree_issues(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (run, id, parent, role, claimed_run, start, close, completed, terminal), declared roots (run, root) -> run, code, subject: what is wrong with each tree.

    Nodes without id have no issue of their own, but while a run has any, a missing root or parent is `node-checks-unavailable`, since it
    may be one of them. Edges and times are checked for ids that occur once. parent-cycle names the least id of each cycle.
    """
    with scratch() as kept:
        rows = written(nodes, "issues")
        ids = written(rows.where("id is not null").groupBy("run", "id").agg(F.count(F.lit(1)).alias("n")), "ids")
        lost = rows.where("id is null").groupBy("run").agg(F.count(F.lit(1)).alias("lost"))
        once = written(rows.hint(_GROWS).join(ids.where("n = 1").select("run", "id"), ["run", "id"], "left_semi"), "once")
        roots = written(roots, "roots")
        runs = written(rows.select("run").distinct().hint(_GROWS).join(roots, "run", "left"), "runs")

        def found(df: DataFrame, code: str | Column, subject: str | Column) -> DataFrame:
            return df.select("run", (F.lit(code) if isinstance(code, str) else code).alias("code"), (F.col(subject) if isinstance(subject, str) else subject).alias("subject"))

        # fixed values, here and below: the codes of issues and the two subjects that are no ids
        missing = F.when(F.col("lost") > 0, "node-checks-unavailable")
        named = runs.where("root is not null").hint(_GROWS).join(ids.withColumnRenamed("id", "root"), ["run", "root"], "left").hint(_GROWS).join(lost, "run", "left")
        top = written(once.hint(_GROWS).join(roots.withColumnRenamed("root", "id"), ["run", "id"], "left_semi"), "top")
        issues = [
            found(ids.where("n > 1"), "duplicate-rollout-id", "id"),
            found(runs.where("root is null"), "root-unavailable", F.lit("tree-root")),
            found(named.where("n is null"), F.coalesce(missing, F.lit("declared-root-missing")), "root"),
            found(top.where("parent is not null"), "root-has-parent", "id"),
            found(top.where("role <> 'supervisor'"), "root-role-invalid", "id"),
            found(once.where("parent is null").hint(_GROWS).join(roots, "run", "left").where("root is null or id <> root"), "detached-node", "id"),
        ]
        edges = once.where("parent is not null").hint(_GROWS).join(ids.select("run", F.col("id").alias("parent"), "n"), ["run", "parent"], "left").hint(_GROWS).join(lost, "run", "left")
        issues.append(found(edges.where("n is null"), F.coalesce(missing, F.lit("parent-missing")), "id"))
        above = once.select("run", F.col("id").alias("parent"), *(F.col(c).alias(f"p_{c}") for c in ("claimed_run", "start", "close")))
        pairs = written(edges.where("n = 1").hint(_GROWS).join(above, ["run", "parent"]), "edges")
        issues += [
            found(pairs.where("claimed_run <> p_claimed_run"), "cross-run-parent", "id"),
            found(pairs.where("start < p_start"), "child-before-parent", "id"),
            found(pairs.where("start > p_close"), "child-after-parent-close", "id"),
            found(once.where("close < start"), "close-before-start", "id"),
        ]
        # an edge to a repeated id leads nowhere, so it is no part of a cycle
        whole = once.hint(_GROWS).join(pairs.select("run", "id", F.col("parent").alias("up")), ["run", "id"], "left").select("run", "id", "up")
        on_ring = tour(whole, "run", "id", "up", ["id"]).where("reach = 'cycle'").select("run", "id")
        issues.append(found(_least_of_rings(on_ring.hint(_GROWS).join(whole, ["run", "id"])), "parent-cycle", "id"))
        closed = top.where("completed").select("run")
        open_ = once.where("not terminal").hint(_GROWS).join(closed, "run", "left_semi").hint(_GROWS).join(roots, "run").where("id <> root").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
        issues.append(found(open_, "child-terminal-unavailable", F.lit("child-terminal-outcomes")))
        out = issues[0]
        for more in issues[1:]:
            out = out.unionByName(more)
        kept.append(written(out, "found"))
    return kept[0]


def _least_of_rings(ring: DataFrame) -> DataFrame:
    """(run, id, up) where every id is on a cycle -> (run, id): the least id of each cycle, by doubling pointers with the least id they skip."""
    state = written(ring.select("run", "id", "up", F.col("id").alias("least")), "ring")
    longest = state.groupBy("run").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    steps = 1
    while steps < longest:
        ahead = state.select(F.col("run").alias("_run"), F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        met = state.hint(_GROWS).join(ahead, (F.col("run") == F.col("_run")) & (F.col("up") == F.col("_id")))
        new = written(met.select("run", "id", F.col("_up").alias("up"), F.least("least", "_least").alias("least")), "ring")
        drop(state)
        state, steps = new, 2 * steps
    return state.where("id = least").select("run", "id")
