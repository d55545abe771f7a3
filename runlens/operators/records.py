"""Run records and traces: filters, checks, failure classes, scorecards, baselines, canaries, periods."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import moments
from ..functions.distributions import t_p_value
from ..functions.scores import ratio
from .ordered import adjusted_p, ks_distance, recent_and_before
from .paired import poisson_bootstrap
from .quantiles import exact_quantiles
from .statistics import wilcoxon

#: The classes of failures.
FAILURE_CLASSES = [
    "success", "reasoning_error", "tool_selection_error", "tool_argument_error", "tool_recovery_failure", "hallucination",
    "instruction_following", "safety_refusal_miss", "policy_violation", "budget_exceeded", "format_drift", "permission_escalation",
    "pii_leak", "cost_overrun", "timeout", "sandbox_failure", "missing_user_data", "missing_domain_data", "missing_codebase_context",
    "missing_runtime_context", "missing_credentials", "missing_integration_connection", "missing_integration_scope",
    "integration_approval_required", "integration_auth_expired", "integration_provider_failure", "bad_integration_manifest",
    "unsafe_integration_write_denied", "stale_external_data", "bad_retrieval", "insufficient_evidence", "contradictory_evidence",
    "ambiguous_user_intent", "knowledge_readiness_blocked", "unknown",
]
#: Splits, ends of runs and kinds of costs.
SPLITS = ["search", "dev", "holdout"]
OUTCOMES = ["succeeded", "failed", "cancelled", "incomplete", "unknown"]
COSTS = ["observed", "estimated", "uncaptured"]


def matching(rows: DataFrame, time: str | None = None, since: int | None = None, until: int | None = None, tag: tuple[str, str] | None = None, tags: str = "tags", **equal) -> DataFrame:
    """Rows whose columns equal the given values; both ends of the time range count; tag is a key and value of a map column."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None]
    if since is not None:
        tests.append(F.col(time) >= since)
    if until is not None:
        tests.append(F.col(time) <= until)
    if tag:
        tests.append(F.try_element_at(F.col(tags), F.lit(tag[0])) == tag[1])
    return rows.where(reduce(and_, tests, F.lit(True)))


def matching_spans(spans: DataFrame, tool: str | None = None, judge: str | None = None, time: str = "startedAt", **rest) -> DataFrame:
    """matching() for spans: a tool's name asks for tool spans, a judge's id for judge spans."""
    if tool is not None:
        spans = spans.where((F.col("kind") == "tool") & (F.col("toolName") == tool))
    if judge is not None:
        spans = spans.where((F.col("kind") == "judge") & (F.col("judgeId") == judge))
    return matching(spans, time, **rest)


def _text(c: str) -> tuple[str, Column]:
    return c, F.coalesce(F.col(c) == "", F.lit(True))


def _number(c: str, least: float | None = None, needed: bool = True) -> tuple[str, Column]:
    x = F.col(c).cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    bad = bad if least is None else bad | (x < least)
    return c, F.coalesce(bad, F.lit(needed))


def _among(c: str, values: Sequence[str], needed: bool = True) -> tuple[str, Column]:
    return c, F.coalesce(~F.col(c).isin(*values), F.lit(needed))


def problems(runs: DataFrame, snapshot: Column) -> DataFrame:
    """runs with `problem`: the path of the first field that breaks a rule, null for a good record. snapshot: whether the model names one.

    Takes the columns of a run record; nested ones are costProvenance, tokenUsage, judgeMetadata and outcome,
    with outcome.raw and the means of outcome.judgeScores as maps. Checks go in a fixed order: identities
    and numbers, cost with its provenance, model snapshot (unknown will do for a run that did not succeed),
    tokens, judge, outcome, failure, end, scenario, split.
    """
    cost, prov, tokens, judge, out = F.col("costUsd"), F.col("costProvenance"), F.col("tokenUsage"), F.col("judgeMetadata"), F.col("outcome")
    unknown, has = F.coalesce(prov["kind"] == "uncaptured", F.lit(False)), lambda c: F.coalesce(c, F.lit(False))
    rules = [
        *map(_text, ("runId", "experimentId", "candidateId")), _number("seed"), *map(_text, ("model", "promptHash", "configHash", "commitSha")),
        _number("wallMs", 0), _number("queueMs", 0, needed=False), _among("costProvenance.kind", COSTS),
        ("costProvenance.usd", unknown & prov["usd"].isNotNull()), ("costUsd", unknown & cost.isNotNull()),
        ("costUsd", ~unknown & _number("costUsd", 0)[1]), ("costProvenance.usd", ~unknown & (_number("costProvenance.usd", 0)[1] | has(prov["usd"] != cost))),
        ("model", ~(has(snapshot) | has((F.col("model") == "unknown") & (F.col("terminalOutcome") != "succeeded")))),
        ("tokenUsage", tokens.isNull()), _number("tokenUsage.input", 0), _number("tokenUsage.output", 0), ("tokenUsage.tokensKnown", has(tokens["tokensKnown"])),
        ("tokenUsage.reasoning", _number("tokenUsage.reasoning", 0, needed=False)[1] | has(tokens["reasoning"] > tokens["output"])),
        _number("tokenUsage.cached", 0, needed=False), _number("tokenUsage.cacheWrite", 0, needed=False),
        ("judgeMetadata.model", judge.isNotNull() & _text("judgeMetadata.model")[1]), ("judgeMetadata.promptVersion", judge.isNotNull() & _text("judgeMetadata.promptVersion")[1]),
        ("judgeMetadata.confidence", judge.isNotNull() & _number("judgeMetadata.confidence")[1]), ("judgeMetadata.fallback", judge.isNotNull() & judge["fallback"].isNull()),
        ("outcome", out.isNull()), _number("outcome.searchScore", needed=False), _number("outcome.holdoutScore", needed=False), ("outcome.raw", out["raw"].isNull()),
        ("outcome.raw", has(F.exists(F.map_values(out["raw"]), lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True))))),
        ("outcome.realness.score", out["realness"].isNotNull() & _number("outcome.realness.score")[1]), ("outcome.realness.gated", out["realness"].isNotNull() & out["realness"]["gated"].isNull()),
        _among("failureClass", FAILURE_CLASSES, needed=False), ("failureMode", has(F.col("failureMode") == "")),
        ("failureMode", F.col("failureMode").isNotNull() & F.coalesce(F.col("failureClass") == "success", F.lit(True))),
        _among("terminalOutcome", OUTCOMES), ("terminalFailureReason", has(F.col("terminalFailureReason") == "")),
        ("terminalFailureReason", F.col("terminalFailureReason").isNotNull() & ~F.col("terminalOutcome").isin("failed", "cancelled", "incomplete")),
        _text("scenarioId"), _among("splitTag", SPLITS),
    ]
    return runs.withColumn("problem", F.coalesce(*(F.when(bad, F.lit(path)) for path, bad in rules)))


@dataclass(frozen=True)
class Rule:
    """A class given to runs that have an event or span for which `when` holds, and for which the run's own condition does.

    `on` says which rows `when` reads: events, spans, or tools (one that failed at every call) and offered (tools,
    none called). `noted` is a condition on the run that does as well as a row; `named`: the row is given as trigger.
    """

    name: str
    gives: str
    on: str
    when: Column
    run: Column | None = None
    noted: Column | None = None
    named: bool = True


def failure_rules() -> list[Rule]:
    """Ordered rules over events (kind, payload as a JSON string), spans and runs (status, pass, failureClass, notes); the first that holds counts."""
    p = lambda k: F.get_json_object("payload", f"$.{k}")
    of, code = lambda kind: (F.col("kind") == "custom") & (p("kind") == kind), p("code")
    failed, resolved, gap = of("integration_invoke_failed"), of("integration_manifest_resolved"), of("knowledge_gap")
    some = lambda path: F.coalesce(F.get_json_object("payload", path).rlike(r'"'), F.lit(False))
    held = ["scope_denied", "approval_required", "auth_expired", "connection_not_active", "capability_expired", "unsafe_write_denied", "policy_denied", "action_denied", "manifest_invalid"]
    lost = F.coalesce(F.col("pass") == F.lit(False), F.lit(False))
    items = [f"$.{k}[*]" for k in ("missing", "optionalMissing", "ready")]
    timeout = (F.col("kind") == "error") & F.lower(F.coalesce(p("reason"), F.lit(""))).contains("timeout")
    # fixed values: the rules' ids, the classes they give, and the codes and kinds they look for
    return [
        Rule("knowledge-readiness-blocked", "knowledge_readiness_blocked", "events", of("readiness_scored") & (p("passed") == "false")),
        Rule("bad-integration-manifest", "bad_integration_manifest", "events", (of("integration_manifest_validated") & (p("valid") == "false")) | (failed & (code == "manifest_invalid"))),
        Rule("missing-integration-connection", "missing_integration_connection", "events", resolved & (some("$.missingConnections") | reduce(lambda a, b: a | b, (F.coalesce(F.get_json_object("payload", f"{i}.status").contains("missing_connection"), F.lit(False)) for i in items)))),
        Rule("missing-integration-scope", "missing_integration_scope", "events", (resolved & (some("$.missingScopes") | reduce(lambda a, b: a | b, (some(f"{i}.missingScopes") for i in items)))) | (failed & (code == "scope_denied"))),
        Rule("integration-approval-required", "integration_approval_required", "events", (of("integration_invoke") & (p("status") == "approval_required")) | (failed & (code == "approval_required")) | of("integration_approval_required")),
        Rule("integration-auth-expired", "integration_auth_expired", "events", failed & (code.isin("auth_expired", "connection_not_active", "capability_expired") | (p("status") == "expired"))),
        Rule("unsafe-integration-write-denied", "unsafe_integration_write_denied", "events", failed & code.isin("unsafe_write_denied", "policy_denied", "action_denied")),
        Rule("integration-provider-failure", "integration_provider_failure", "events", failed & ~F.coalesce(code.isin(*held), F.lit(False))),
        Rule("missing-credentials", "missing_credentials", "events", gap & (p("category") == "credential_or_secret")),
        Rule("bad-retrieval", "bad_retrieval", "spans", (F.col("kind") == "retrieval") & (F.coalesce(F.col("bestHit"), F.lit(0.0)) <= 0), lost),
        Rule("insufficient-evidence", "insufficient_evidence", "events", gap & (p("reason") == "insufficient_evidence")),
        Rule("contradictory-evidence", "contradictory_evidence", "events", gap & (p("reason") == "contradictory_evidence")),
        Rule("budget-breach", "budget_exceeded", "events", F.col("kind") == "budget_breach"),
        Rule("policy-violation", "policy_violation", "events", F.col("kind") == "policy_violation"),
        Rule("sandbox-failure", "sandbox_failure", "spans", (F.col("kind") == "sandbox") & (F.col("exitCode") != 0)),
        Rule("timeout", "timeout", "events", timeout, F.col("status") == "aborted", F.lower(F.coalesce(F.col("notes"), F.lit(""))).rlike("timeout|deadline"), named=False),
        Rule("tool-recovery-failure", "tool_recovery_failure", "tools", F.lit(True)),
        Rule("tool-selection-error", "tool_selection_error", "offered", F.lit(True), lost),
        Rule("format-drift", "format_drift", "spans", (F.col("kind") == "judge") & (F.col("dimension") == "format") & (F.col("score") < 0.5)),
    ]


def classify_failures(runs: DataFrame, spans: DataFrame, events: DataFrame, rules: Sequence[Rule] | None = None, least: int = 3) -> DataFrame:
    """runId, failure_class, rule, trigger (the first event or span that made the rule hold, by `ord`; null if none did alone).

    runs: runId, status, pass, failureClass, notes. spans: runId, spanId, ord, kind, toolName, status, exitCode,
    dimension, score, bestHit (highest score of a retrieval's hits, null for none), toolsAvailable. events:
    runId, eventId, ord, kind, payload. A completed run that is not marked as failed is a success; a class
    given with the run counts before all rules; tool_recovery_failure: a tool with `least` calls or more
    that all failed, of several the one called first, its last failure being the trigger; tool_selection_error: tools offered, none called. One aggregate for each table and
    one join, whatever the number of rules.
    """
    rules = list(failure_rules() if rules is None else rules)
    first = lambda r, key: F.min(F.when(F.coalesce(r.when, F.lit(False)), F.struct("ord", F.col(key).cast("string").alias("id")))).alias(f"r_{r.name}")
    of = lambda on: [r for r in rules if r.on == on]
    tool = F.when(F.col("kind") == "tool", F.col("toolName"))
    by_tool = spans.where(tool.isNotNull()).groupBy("runId", "toolName").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("bad"), F.min("ord").alias("called"), F.max(F.when(F.col("status") == "error", F.struct("ord", F.col("spanId").cast("string").alias("id")))).alias("last"))
    by_tool = by_tool.groupBy("runId").agg(F.sum("n").alias("_calls"), F.min(F.when((F.col("n") >= least) & (F.col("n") == F.col("bad")), F.struct("called", "last.id"))).alias("_stuck"))
    in_spans = spans.groupBy("runId").agg(F.max(F.when(F.col("kind") == "agent", F.col("toolsAvailable"))).alias("_offered"), *(first(r, "spanId") for r in of("spans")))
    in_events = events.groupBy("runId").agg(F.count(F.lit(1)).alias("_events"), *(first(r, "eventId") for r in of("events")))
    all_of = runs.join(in_spans, "runId", "left").join(in_events, "runId", "left").join(by_tool, "runId", "left")
    done = F.coalesce(F.col("pass"), F.lit(True)) & (F.col("status") == "completed")
    said = F.col("failureClass").isNotNull() & (F.col("failureClass") != "unknown")
    none = F.lit(None).cast("string")
    give = lambda c, name, trigger: F.struct(c.alias("failure_class"), F.lit(name).alias("rule"), trigger.alias("trigger"))
    hits = []
    for r in rules:
        if r.on == "tools":
            holds, trigger = F.col("_stuck").isNotNull(), F.col("_stuck.id")
        elif r.on == "offered":
            holds, trigger = (F.col("_offered") > 0) & (F.coalesce("_calls", F.lit(0)) == 0), none
        else:
            found = F.col(f"r_{r.name}")
            holds, trigger = found.isNotNull(), found["id"] if r.named else none
            holds = holds if r.noted is None else holds | F.coalesce(r.noted, F.lit(False))
        holds = F.coalesce(holds & (F.lit(True) if r.run is None else r.run), F.lit(False))
        hits.append(F.when(holds, give(F.lit(r.gives), r.name, trigger)))
    found = F.coalesce(F.when(done, give(F.lit("success"), "completed", none)), F.when(said, give(F.col("failureClass"), "explicit-outcome", none)), *hits, give(F.lit("unknown"), "none", none))
    return all_of.select("runId", found.alias("f")).select("runId", "f.*")


def summary(x: Column) -> Column:
    """Aggregate of a sample: n, mean and sample variance (null below two)."""
    v = x.cast("double")
    return F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def compared(a: Column, b: Column) -> dict[str, Column]:
    """Difference of means (b less a), Cohen's d, Welch's t and df of two summary() structs; null where not defined."""
    na, nb = a["n"].cast("double"), b["n"].cast("double")
    both, gap = (na >= 2) & (nb >= 2), b["mean"] - a["mean"]
    pooled = F.sqrt(F.try_divide((na - 1) * a["var"] + (nb - 1) * b["var"], na + nb - 2))
    d = F.when(pooled == 0, F.when(gap == 0, 0.0)).otherwise(F.try_divide(gap, pooled))
    va, vb = F.try_divide(a["var"], na), F.try_divide(b["var"], nb)
    df = F.try_divide((va + vb) * (va + vb), va * va / (na - 1) + vb * vb / (nb - 1))
    return {"delta": gap, "d": F.when(both, d), "t": F.when(both, F.try_divide(gap, F.sqrt(va + vb))), "df": F.when(both, df)}


def record_runs(runs: DataFrame, scenario: str, profile: str, commit: str, time: str, score: Column) -> DataFrame:
    """scenario, profile, commit, time, composite (median), sample (summary): a scorecard entry for each cell and commit; runs without a scenario or score have none."""
    scored = runs.where(F.col(scenario).isNotNull() & score.isNotNull())
    return scored.groupBy(scenario, profile, commit).agg(F.max(time).alias(time), F.median(score.cast("double")).alias("composite"), summary(score).alias("sample"))


def scorecard_diff(entries: DataFrame, scenario: str, profile: str, commit: str, time: str, effect: float = 0.5, p: float = 0.05, delta: float = 0.05) -> DataFrame:
    """scenario, profile, current, baseline, delta, d, p, verdict: each cell's latest entry against the one before it.

    With two scores or more on both sides a move counts if |d| reaches `effect` (an unbounded d does) and its
    p is `p` at most; else if |delta| reaches `delta`. Cells of one entry are new.
    """
    last = F.row_number().over(W.partitionBy(scenario, profile).orderBy(F.desc(time), F.desc(commit)))
    two = entries.withColumn("_i", last).where("_i <= 2").groupBy(scenario, profile).agg(
        *(F.max(F.when(F.col("_i") == i, F.struct("composite", "sample"))).alias(n) for i, n in ((1, "_now"), (2, "_then")))
    )
    now, then = F.col("_now"), F.col("_then")
    c = compared(then["sample"], now["sample"])
    gap = now["composite"] - then["composite"]
    rows = two.select(scenario, profile, now["composite"].alias("current"), then["composite"].alias("baseline"), gap.alias("delta"), c["d"].alias("d"), c["t"].alias("_t"), c["df"].alias("_df"), (F.least(now["sample"]["n"], then["sample"]["n"]) >= 2).alias("_stat"))
    rows = rows.withColumn("p", t_p_value("_t", "_df"))
    real = F.when(F.col("_stat"), F.coalesce(F.abs("d") >= effect, F.lit(True)) & F.coalesce(F.col("p") <= p, F.lit(False))).otherwise(F.abs("delta") >= delta)
    verdict = F.when(F.col("baseline").isNull(), "new").when(~real, "flat").when(F.col("delta") > 0, "improved").otherwise("regressed")
    return rows.select(scenario, profile, "current", "baseline", "delta", "d", "p", verdict.alias("verdict"))


def against_baseline(samples: DataFrame, metric: str, candidate: Column, value: Column, better: Column, effect: float = 0.5, alpha: float = 0.05, unstable: float = 0.3) -> DataFrame:
    """metric, n and mean of both sides, delta, d, t, df, p, iqr, verdict: improved, regressed, stable, or unstable if a side's IQR over its |mean| exceeds the limit.

    better: whether higher values are. A metric with under two values on a side is insufficient. IQRs are those of
    interpolated quartiles, exact without a metric's values in one task.
    """
    v = value.cast("double")
    told = samples.where(v.isNotNull()).select(F.col(metric).alias("_m"), F.coalesce(candidate, F.lit(False)).alias("_c"), v.alias("_v"), better.alias("_b"))
    sides = told.groupBy("_m").agg(F.bool_and("_b").alias("_up"), *(summary(F.when(F.col("_c") == on, F.col("_v"))).alias(n) for n, on in (("a", False), ("b", True))))
    quartiles = exact_quantiles(told.select(F.struct("_m", "_c").alias("_of"), "_v"), "_of", "_v", [0.25, 0.75]).groupBy(F.col("_of._m").alias("_m"))
    quartiles = quartiles.agg(*(F.max(F.when(F.col("_of._c") == on, F.col("q"))).alias(n) for n, on in (("_qa", False), ("_qb", True))))
    sides = sides.join(quartiles, "_m").withColumnRenamed("_m", metric)
    a, b = F.col("a"), F.col("b")
    c = compared(a, b)
    spread = lambda q: F.get(q, F.lit(1)) - F.get(q, F.lit(0))
    rows = sides.select(
        metric, "_up", a["n"].alias("n_baseline"), b["n"].alias("n_candidate"), a["mean"].alias("baseline"), b["mean"].alias("candidate"),
        *(c[k].alias(k) for k in ("delta", "d", "t", "df")), spread("_qa").alias("_ia"), spread("_qb").alias("_ib"),
    ).withColumn("p", t_p_value("t", "df"))
    shaky = (ratio(F.col("_ia"), F.greatest(F.abs("baseline"), F.lit(1e-9))) > unstable) | (ratio(F.col("_ib"), F.greatest(F.abs("candidate"), F.lit(1e-9))) > unstable)
    moved = F.coalesce(F.col("p") < alpha, F.lit(False)) & F.coalesce(F.abs("d") >= effect, F.lit(True))
    good = F.when(F.col("_up"), F.col("delta") > 0).otherwise(F.col("delta") < 0)
    verdict = F.when(F.least("n_baseline", "n_candidate") < 2, "insufficient").when(shaky, "unstable").when(moved & good, "improved").when(moved, "regressed").otherwise("stable")
    return rows.withColumn("iqr", F.greatest("_ia", "_ib")).withColumn("verdict", verdict).drop("_up", "_ia", "_ib")


def silent_fallback(runs: DataFrame, lane: str, order: Sequence[str], run: str, confidence: str, fallback: Column, constant: float = 0.3, least: int = 3, near: float = 1e-9) -> DataFrame:
    """lane, first_run, last_run: an alert for each streak of `least` judged runs that fell back or sit at the fallback's constant, as it reaches that length.

    Runs without a confidence were not judged and end a streak.
    """
    w = W.partitionBy(lane).orderBy(*order)
    hit = F.coalesce(F.coalesce(fallback, F.lit(False)) | (F.abs(F.col(confidence) - constant) <= near), F.lit(False))
    rows = runs.select(lane, run, hit.alias("_hit"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.sum((~hit).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_g")).where("_hit")
    place = F.row_number().over(W.partitionBy(lane, "_g").orderBy(*(f"_o{i}" for i in range(len(order)))))
    ends = rows.withColumn("_i", place).where(F.col("_i").isin(1, least)).groupBy(lane, "_g").agg(F.max(F.when(F.col("_i") == 1, F.col(run))).alias("first_run"), F.max(F.when(F.col("_i") == least, F.col(run))).alias("last_run"))
    return ends.where("last_run is not null").drop("_g")


def calibration_drift(runs: DataFrame, lane: str, order: Sequence[str], confidence: str, recent: int = 20, before: int = 50, least: int = 10, alpha: float = 0.05) -> DataFrame:
    """lane, n_recent, n_before, d, critical, alert: the last finite confidences against those before; alert is null where a side has under `least`."""
    finite = F.col(confidence).isNotNull() & ~F.isnan(F.col(confidence).cast("double")) & (F.abs(F.col(confidence)) < float("inf"))
    rows = recent_and_before(runs.where(finite), lane, order, recent, before)
    by = ks_distance(rows, lane, "part", confidence)
    # fixed values: the two-sample test's factors at 0.01, 0.05, 0.1 and above
    scale = 1.63 if alpha <= 0.01 else 1.36 if alpha <= 0.05 else 1.22 if alpha <= 0.1 else 1.0
    a, b = F.col("n_recent").cast("double"), F.col("n_before").cast("double")
    critical = scale * F.sqrt(F.try_divide(a + b, a * b))
    return by.withColumn("critical", critical).withColumn("alert", F.when(F.least(a, b) >= least, F.col("d") > F.col("critical")))


def prior_period(runs: DataFrame, current: Column, metrics: dict[str, tuple[Column, bool]], alpha: float = 0.05) -> DataFrame:
    """metric, n_before, n_now, before, now, delta, d, p, verdict (improved, regressed, flat, inconclusive); metrics give a column and whether more is better.

    A metric without a value in either period is left out; one without a test in both is inconclusive.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("v"), F.lit(up).alias("up")) for n, (c, up) in metrics.items())))
    rows = runs.select(current.alias("_now"), cells.alias("m")).select("_now", "m.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    by = rows.groupBy("metric", "up").agg(summary(F.when(~F.col("_now"), F.col("v"))).alias("a"), summary(F.when(F.col("_now"), F.col("v"))).alias("b")).where("a.n > 0 and b.n > 0")
    c = compared(F.col("a"), F.col("b"))
    out = by.select("metric", "up", F.col("a.n").alias("n_before"), F.col("b.n").alias("n_now"), F.col("a.mean").alias("before"), F.col("b.mean").alias("now"), c["delta"].alias("delta"), c["d"].alias("d"), c["t"].alias("_t"), c["df"].alias("_df")).withColumn("p", t_p_value("_t", "_df"))
    verdict = F.when(F.col("p").isNull(), "inconclusive").when(F.col("p") >= alpha, "flat").when(F.col("up") == (F.col("delta") > 0), "improved").otherwise("regressed")
    return out.withColumn("verdict", verdict).drop("up", "_t", "_df")


def judge_insights(scores: DataFrame, run: str, judge: str, score: Column) -> DataFrame:
    """judge, n (runs), mean: the mean over runs of a judge's mean over dimensions."""
    means = scores.groupBy(run, judge).agg(F.avg(F.when(~F.isnan(score), score)).alias("m")).where("m is not null")
    return means.groupBy(judge).agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean"))


def summary_table(runs: DataFrame, candidate: str, score: Column, key: Sequence[str] = (), comparator: str | None = None, row: Column | None = None, least: int = 6, **bootstrap) -> DataFrame:
    """candidate, n, mean, ci_low, ci_high of finite scores, and against a comparator: paired_n, unpaired, unpaired_comparator, dz, p, q.

    The interval is normal, or with `row`, an integer key of each run, the Poisson bootstrap's. Runs are matched
    by key, repetitions by score order of equal keys; p is Wilcoxon's from `least` pairs on, q its
    Benjamini-Hochberg value among the candidates; the comparator's own row has none of them.
    """
    x = score.cast("double")
    own = runs.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).withColumn("_s", x)
    if row is None:
        by = own.groupBy(candidate).agg(summary(F.col("_s")).alias("_t"))
        half = 1.959963984540054 * F.sqrt(F.coalesce(F.col("_t.var"), F.lit(0.0)) / F.col("_t.n"))
        out = by.select(candidate, F.col("_t.n").alias("n"), F.col("_t.mean").alias("mean"), (F.col("_t.mean") - half).alias("ci_low"), (F.col("_t.mean") + half).alias("ci_high"))
    else:
        out = poisson_bootstrap(own, candidate, row, F.col("_s"), **bootstrap).withColumnsRenamed({"low": "ci_low", "high": "ci_high"})
    if comparator is None:
        return out
    place = F.row_number().over(W.partitionBy(candidate, *key).orderBy("_s"))
    numbered = own.select(candidate, *key, "_s", place.alias("_rep"))
    of = numbered.where(F.col(candidate) == comparator).select(*key, "_rep", F.col("_s").alias("_c"))
    others = numbered.where(F.col(candidate) != comparator)
    pairs = others.join(of, [*key, "_rep"])
    d = F.col("_c") - F.col("_s")
    met = pairs.groupBy(candidate).agg(F.count(F.lit(1)).alias("paired_n"), moments.paired_dz(d).alias("dz"))
    ranked = wilcoxon(pairs, candidate, F.col("_s"), F.col("_c")).select(candidate, "p")
    total = own.where(F.col(candidate) == comparator).agg(F.count(F.lit(1)).alias("_all"))
    out = out.join(met, candidate, "left").join(ranked, candidate, "left").crossJoin(F.broadcast(total))  # one row
    other = F.col(candidate) != comparator
    n = F.when(other, F.coalesce("paired_n", F.lit(0).cast("long")))
    out = out.withColumns({"paired_n": n, "unpaired": F.when(other, F.col("n") - n), "unpaired_comparator": F.when(other, F.col("_all") - n), "p": F.when(n >= least, F.col("p"))})
    tested = adjusted_p(out.where("p is not null").select(F.lit(0).alias("_f"), candidate, "p"), "_f", "p", candidate).select(candidate, F.col("bh").alias("q"))
    return out.join(tested, candidate, "left").select(candidate, "n", "mean", "ci_low", "ci_high", "paired_n", "unpaired", "unpaired_comparator", "dz", "p", "q")
