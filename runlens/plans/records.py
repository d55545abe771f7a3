"""Queries on run records and traces: checks, classes of failure, scorecards, baselines, canaries, periods, power."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import moments
from ..functions.text import has_snapshot
from ..operators import joins as J
from ..operators import records as R
from ..operators import statistics as S
from ..session import table
from .aggregates import rounded
from .registry import normal_p_sql, query, t_p_sql


@query("select * from orders where o_orderstatus = 'F' and epoch_us(o_orderdate) // 1000 between 800000000000 and 850000000000 and o_orderpriority = '5-LOW'")
def run_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").withColumns({"started": F.unix_millis(F.col("o_orderdate").cast("timestamp")), "tags": F.create_map(F.lit("priority"), "o_orderpriority")})
    return R.matching(runs, "started", since=800000000000, until=850000000000, tag=("priority", "5-LOW"), o_orderstatus="F").drop("started", "tags")


@query("select event_id, user_id from events where event_type = 'click' and props like '%7%'")
def span_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "click", "tool").otherwise("llm").alias("kind"), F.when(F.col("props").contains("7"), "seven").alias("toolName"))
    return R.matching_spans(spans, tool="seven").select("event_id", "user_id")


@query("""
select o_orderkey, case when o_custkey % 97 = 0 then 'runId' when o_totalprice > 450000 then 'wallMs' when o_orderkey % 5 = 0 and o_custkey % 2 = 0 then 'costProvenance.usd' when o_orderkey % 7 = 0 and o_orderstatus = 'F' then 'model'
  when o_orderkey % 11 = 0 then 'tokenUsage.reasoning' when o_orderkey % 13 = 0 then 'failureClass' when o_orderkey % 17 = 0 and o_orderkey % 3 > 0 then 'failureMode' when o_orderkey % 19 = 0 and o_orderstatus = 'F' then 'terminalFailureReason' when o_orderpriority = '5-LOW' then 'splitTag' end as problem from orders""")
def record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    lost = (k % 5 == 0)
    runs = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(c % 97 == 0, "").otherwise(k.cast("string")).alias("runId"), F.lit("e").alias("experimentId"), F.lit("c").alias("candidateId"), F.lit(1.0).alias("seed"),
        F.when(k % 7 == 0, "unknown").otherwise("m@2025-01-01").alias("model"), *(F.lit("x").alias(n) for n in ("promptHash", "configHash", "commitSha")),
        F.when(F.col("o_totalprice") > 450000, -1.0).otherwise(F.col("o_totalprice")).alias("wallMs"), F.lit(None).cast("double").alias("queueMs"),
        F.when(~lost, F.lit(2.0)).alias("costUsd"), F.struct(F.when(lost, "uncaptured").otherwise("observed").alias("kind"), F.when(~lost, 2.0).when(c % 2 == 0, 1.0).alias("usd")).alias("costProvenance"),
        F.struct(F.lit(5.0).alias("input"), F.lit(7.0).alias("output"), F.lit(None).cast("boolean").alias("tokensKnown"), F.when(k % 11 == 0, 9.0).alias("reasoning"), *(F.lit(None).cast("double").alias(n) for n in ("cached", "cacheWrite"))).alias("tokenUsage"),
        F.lit(None).cast("struct<model:string,promptVersion:string,confidence:double,fallback:boolean>").alias("judgeMetadata"),
        F.struct(F.lit(0.5).alias("searchScore"), F.lit(None).cast("double").alias("holdoutScore"), F.create_map(F.lit("a"), F.lit(1.0)).alias("raw"), F.lit(None).cast("struct<score:double,gated:boolean>").alias("realness")).alias("outcome"),
        F.when(k % 13 == 0, "no such class").when(k % 3 == 0, "timeout").alias("failureClass"), F.when(k % 17 == 0, "slow").alias("failureMode"),
        F.when(status == "F", "succeeded").when(status == "O", "failed").otherwise("cancelled").alias("terminalOutcome"), F.when(k % 19 == 0, "why").alias("terminalFailureReason"),
        F.lit("s").alias("scenarioId"), F.when(F.col("o_orderpriority") == "5-LOW", "other").otherwise("search").alias("splitTag"),
    )
    return R.problems(runs, has_snapshot(F.col("model"))).select("o_orderkey", "problem")


#: A rule's number -> its id and what an event carries that makes it hold (null: spans do), in the rules' order.
_SIGNALS = [
    ("knowledge-readiness-blocked", "knowledge_readiness_blocked", '{"kind": "readiness_scored", "passed": false}'), ("bad-integration-manifest", "bad_integration_manifest", '{"kind": "integration_manifest_validated", "valid": false}'),
    ("missing-integration-connection", "missing_integration_connection", '{"kind": "integration_manifest_resolved", "missingConnections": ["a"]}'), ("missing-integration-scope", "missing_integration_scope", '{"kind": "integration_invoke_failed", "code": "scope_denied"}'),
    ("integration-approval-required", "integration_approval_required", '{"kind": "integration_approval_required"}'), ("integration-auth-expired", "integration_auth_expired", '{"kind": "integration_invoke_failed", "code": "auth_expired"}'),
    ("unsafe-integration-write-denied", "unsafe_integration_write_denied", '{"kind": "integration_invoke_failed", "code": "policy_denied"}'), ("integration-provider-failure", "integration_provider_failure", '{"kind": "integration_invoke_failed", "code": "http_500"}'),
    ("missing-credentials", "missing_credentials", '{"kind": "knowledge_gap", "category": "credential_or_secret"}'), ("bad-retrieval", "bad_retrieval", None),
    ("insufficient-evidence", "insufficient_evidence", '{"kind": "knowledge_gap", "reason": "insufficient_evidence"}'), ("contradictory-evidence", "contradictory_evidence", '{"kind": "knowledge_gap", "reason": "contradictory_evidence"}'),
    ("budget-breach", "budget_exceeded", "{}"), ("policy-violation", "policy_violation", "{}"), ("sandbox-failure", "sandbox_failure", None), ("timeout", "timeout", '{"reason": "a Timeout"}'),
    ("tool-recovery-failure", "tool_recovery_failure", None), ("tool-selection-error", "tool_selection_error", None), ("format-drift", "format_drift", None),
]


@query(f"""
with r(s, rule, cls) as (values {", ".join(f"({i}, '{rule}', '{cls}')" for i, (rule, cls, _) in enumerate(_SIGNALS))}),
e as (select user_id as u, event_id as i, case event_id % 4 when 0 then user_id % 23 when 1 then user_id // 3 % 23 else 22 end as s from events),
tools as (select u, i % 2 as tool, min(i) as called, max(i) as last, count(*) as n from e where s = 16 group by 1, 2), stuck as (select u, arg_min(last, called) as i from tools where n >= 3 group by 1),
h as (select u, s, min(i) as i from e where s < 15 or s = 18 group by 1, 2 union all select u, s, null from e where s = 15 and u % 2 = 0 group by 1, 2 union all select distinct u, 15, null::bigint from e where u % 2 = 0 and u % 9 = 4
  union all select u, 16, i from stuck union all select u, s, null from e where s = 17 and u not in (select u from tools) group by 1, 2),
f as (select u, min(s) as s, arg_min(coalesce(i, -1), s) as i from h group by 1),
u as (select distinct user_id as u from events)
select u.u as "runId", case when u.u % 31 = 0 then 'success' when u.u % 29 = 1 then 'hallucination' else coalesce(cls, 'unknown') end as failure_class, case when u.u % 31 = 0 then 'completed' when u.u % 29 = 1 then 'explicit-outcome' else coalesce(rule, 'none') end as rule,
  case when u.u % 31 > 0 and u.u % 29 <> 1 and f.i >= 0 then f.i::varchar end as trigger from u left join f on f.u = u.u left join r on r.s = f.s""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u, i = table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id")
    signal = F.when(i % 4 == 0, u % 23).when(i % 4 == 1, F.floor(u / 3) % 23).otherwise(22)
    rows = e.select(u.alias("runId"), i.alias("ord"), i.alias("eventId"), i.alias("spanId"), signal.alias("s"))
    run = F.col("runId")
    runs = rows.select("runId").distinct().select(
        "runId", F.when(run % 31 == 0, "completed").when(run % 2 == 0, "aborted").otherwise("failed").alias("status"), F.when(run % 31 > 0, False).alias("pass"),
        F.when(run % 29 == 1, "hallucination").when(run % 3 == 0, "unknown").alias("failureClass"), F.when(run % 9 == 4, "past its Deadline").alias("notes"),
    )
    payload, s = F.lit("{}"), F.col("s")
    for n, (_, _, said) in enumerate(_SIGNALS):
        payload = F.when(s == n, said).otherwise(payload) if said else payload
    kind = F.when(s == 12, "budget_breach").when(s == 13, "policy_violation").when(s == 15, "error").otherwise("custom")
    events = rows.select("runId", "eventId", "ord", kind.alias("kind"), payload.alias("payload"))
    spans = rows.where(s.isin(9, 14, 16, 17, 18)).select(
        "runId", "spanId", "ord", F.when(s == 9, "retrieval").when(s == 14, "sandbox").when(s == 16, "tool").when(s == 17, "agent").otherwise("judge").alias("kind"),
        F.when(s == 16, F.concat(F.lit("t"), F.col("ord") % 2)).alias("toolName"), F.when(s == 16, "error").alias("status"), F.when(s == 14, 1).alias("exitCode"), F.when(s == 18, "format").alias("dimension"), F.when(s == 18, 0.2).alias("score"),
        F.when(s == 9, 0.0).alias("bestHit"), F.when(s == 17, 4).alias("toolsAvailable"),
    )
    return R.classify_failures(runs, spans, events)


_ENTRIES = """
r as (select o_orderpriority as scenario, o_custkey % 3 as profile, year(o_orderdate) as y, o_totalprice / 500000 as s from orders where o_orderkey % 37 > 0),
c as (select scenario, profile, y, count(s) as n, avg(s) as m, var_samp(s) as v, median(s) as med from r group by all)"""


@query(f"""
with {_ENTRIES}, l as (select *, lead(med) over w as b, lead(n) over w as bn, lead(m) over w as bm, lead(v) over w as bv, row_number() over w as i from c window w as (partition by scenario, profile order by y desc)),
d as (select *, (m - bm) / sqrt(((n - 1) * v + (bn - 1) * bv) / (n + bn - 2)) as d from l where i = 1),
p as (select *, case when least(n, bn) >= 2 then {t_p_sql("(m - bm) / sqrt(v / n + bv / bn)", "((v / n + bv / bn) ** 2 / ((v / n) ** 2 / (n - 1) + (bv / bn) ** 2 / (bn - 1)))")} end as p from d)
select scenario, profile, round(med, 6) as current, round(b, 6) as baseline, round(med - b, 6) as delta, round(d, 6) as d, round(p, 6) as p, case when b is null then 'new' when least(n, bn) < 2 then case when abs(med - b) < 0.05 then 'flat' when med > b then 'improved' else 'regressed' end when abs(d) < 0.02 or p > 0.6 then 'flat' when med > b then 'improved' else 'regressed' end as verdict from p""")
def scorecard_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").where("o_orderkey % 37 > 0").select(F.col("o_orderpriority").alias("scenario"), (F.col("o_custkey") % 3).alias("profile"), F.year("o_orderdate").alias("y"), F.year("o_orderdate").alias("commit"), (F.col("o_totalprice") / 500000).alias("s"))
    entries = R.record_runs(runs, "scenario", "profile", "commit", "y", F.col("s"))
    out = R.scorecard_diff(entries, "scenario", "profile", "commit", "y", effect=0.02, p=0.6)
    return rounded(out, "current", "baseline", "delta", "d", "p")


_BASE_V = "case when l_suppkey % 10 < 4 then l_extendedprice when l_suppkey % 10 < 8 then 1 + l_tax / 10 + case when l_returnflag = 'R' then l_suppkey % 10 - 6 else 0 end / 500 else 50 + l_quantity / 10 - case when l_returnflag = 'R' then l_suppkey % 10 - 8 else 0 end end"


@query(f"""
with s as (select 'm' || l_suppkey % 10 || l_linestatus as metric, l_suppkey % 10 = 9 as up, l_returnflag = 'R' as cand, ({_BASE_V})::double as v from lineitem where l_returnflag in ('A', 'R')),
g as (select metric, any_value(up) as up, count(*) filter (where not cand) as na, count(*) filter (where cand) as nb, avg(v) filter (where not cand) as ma, avg(v) filter (where cand) as mb, var_samp(v) filter (where not cand) as va, var_samp(v) filter (where cand) as vb,
  quantile_cont(v, 0.75) filter (where not cand) - quantile_cont(v, 0.25) filter (where not cand) as ia, quantile_cont(v, 0.75) filter (where cand) - quantile_cont(v, 0.25) filter (where cand) as ib from s group by 1),
t as (select *, (mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) as d, (mb - ma) / sqrt(va / na + vb / nb) as t, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) as df from g),
p as (select *, case when least(na, nb) >= 2 then {t_p_sql("t", "df")} end as p from t)
select metric, na as n_baseline, nb as n_candidate, round(ma, 6) as baseline, round(mb, 6) as candidate, round(mb - ma, 6) as delta, round(d, 6) as d, round(t, 5) as t, round(df, 3) as df, round(greatest(ia, ib), 6) as iqr, round(p, 5) as p,
  case when least(na, nb) < 2 then 'insufficient' when ia / greatest(abs(ma), 1e-9) > 0.3 or ib / greatest(abs(mb), 1e-9) > 0.3 then 'unstable' when p < 0.05 and abs(d) >= 0.1 then case when (mb > ma) = up then 'improved' else 'regressed' end else 'stable' end as verdict from p""")
def baseline_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, late = F.col("l_suppkey") % 10, F.col("l_returnflag") == "R"
    v = F.when(k < 4, F.col("l_extendedprice")).when(k < 8, 1 + F.col("l_tax") / 10 + F.when(late, k - 6).otherwise(0) / 500).otherwise(50 + F.col("l_quantity") / 10 - F.when(late, k - 8).otherwise(0))
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')").select(F.concat(F.lit("m"), k, "l_linestatus").alias("metric"), late.alias("cand"), v.alias("v"), (k == 9).alias("up"))
    out = R.against_baseline(rows, "metric", F.col("cand"), F.col("v"), F.col("up"), effect=0.1)
    return rounded(rounded(rounded(out, "baseline", "candidate", "delta", "d", "iqr"), "t", "p", places=5), "df", places=3)


@query("""
with e as (select user_id, event_id, ts, case when event_type = 'signup' then null when value < 30 then 0.3 else value / 100 end as conf, event_type = 'error' as fell from events),
h as (select *, coalesce(conf is not null and (fell or abs(conf - 0.3) <= 1e-9), false) as hit from e),
g as (select *, sum((not hit)::int) over (partition by user_id order by ts, event_id) as g from h),
n as (select *, row_number() over (partition by user_id, g order by ts, event_id) as i from g where hit)
select user_id, max(event_id) filter (where i = 1) as first_run, max(event_id) filter (where i = 3) as last_run from n group by user_id, g having count(*) >= 3""")
def silent_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    runs = table(spark, sf_dir, "events").withColumn("conf", F.when(kind != "signup", F.when(v < 30, 0.3).otherwise(v / 100))).withColumn("fell", F.when(kind != "signup", kind == "error"))
    return R.silent_fallback(runs, "user_id", ["ts", "event_id"], "event_id", "conf", F.col("fell"))


@query("""
with b as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as b from events where event_type <> 'signup'),
v as (select user_id, value, count(*) filter (where b <= 20) as r, count(*) filter (where b > 20) as o from b where b <= 70 group by all),
c as (select user_id, r, o, abs(sum(r) over w / sum(r) over (partition by user_id) - sum(o) over w / nullif(sum(o) over (partition by user_id), 0)) as gap from v window w as (partition by user_id order by value)),
g as (select user_id, sum(r)::bigint as n_recent, sum(o)::bigint as n_before, max(gap) as d, 1.36 * sqrt((sum(r) + sum(o)) / nullif(sum(r) * sum(o), 0)) as critical from c group by 1)
select user_id, n_recent, n_before, round(d, 6) as d, round(critical, 6) as critical, case when least(n_recent, n_before) >= 10 then d > critical end as alert from g""")
def calibration_canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.calibration_drift(table(spark, sf_dir, "events").where("event_type <> 'signup'"), "user_id", ["ts", "event_id"], "value"), "d", "critical")


@query(f"""
with m as (select o_orderkey % 3 = 0 as now, o_totalprice as price, case when o_orderstatus <> 'P' then (o_orderstatus = 'F')::int end as passed from orders),
x as (select now, 'price' as metric, price::double as v from m union all select now, 'dearer', price + now::int * 20000 from m union all select now, 'cheaper', price - now::int * 20000 from m union all select now, 'passed', passed from m where passed is not null),
g as (select metric, count(*) filter (where not now) as na, count(*) filter (where now) as nb, avg(v) filter (where not now) as ma, avg(v) filter (where now) as mb, var_samp(v) filter (where not now) as va, var_samp(v) filter (where now) as vb from x group by 1),
p as (select *, {t_p_sql("(mb - ma) / sqrt(va / na + vb / nb)", "((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)))")} as p from g)
select metric, na as n_before, nb as n_now, round(ma, 4) as before, round(mb, 4) as now, round(mb - ma, 4) as delta, round((mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) as d, round(p, 5) as p, case when p >= 0.05 then 'flat' when (mb > ma) = (metric = 'passed') then 'improved' else 'regressed' end as verdict from p""")
def prior_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F").cast("double"))
    now, price = F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")
    moved = 20000 * now.cast("int")
    metrics = {"price": (price, False), "dearer": (price + moved, False), "cheaper": (price - moved, False), "passed": (passed, True)}
    out = R.prior_period(table(spark, sf_dir, "orders"), now, metrics)
    return rounded(rounded(rounded(out, "d"), "p", places=5), "before", "now", "delta", places=4)


@query("""
with m as (select l_orderkey, l_returnflag, avg(l_discount) as m from lineitem group by all) select l_returnflag, count(*) as n, round(avg(m), 6) as mean from m group by 1""")
def judge_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.judge_insights(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", F.col("l_discount")), "mean")


@query("""
select o_orderpriority, count(*) as n, round(avg(o_totalprice), 4) as mean, round(avg(o_totalprice) - 1.959963984540054 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) as ci_low, round(avg(o_totalprice) + 1.959963984540054 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) as ci_high from orders group by 1""")
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.summary_table(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_totalprice")), "mean", "ci_low", "ci_high", places=4)


@query("""
with t as (select event_type, least(1, greatest(0, value / 100)) as r, least(value / 40, 2) as w, case when event_id % 3 > 0 then 0.4 end as q, case when event_id % 3 > 0 then least(1, user_id / 1000.0) end as v from events),
c as (select event_type, w, q, case when q is null then w * r else v + w * (r - q) end as c from t)
select event_type, count(*) as n, round(avg(c), 6) as value, round(sqrt(var_samp(c) / count(*)), 6) as error, count(q) as modelled, count(*) - count(q) as fallback, round(sum(w) ** 2 / sum(w * w), 4) as ess, max(w) as max_weight from c group by 1""")
def doubly_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("event_id") % 3 > 0
    parts = moments.doubly_robust(F.col("value") / 100, F.col("value") / 40, F.when(known, 0.4), F.when(known, F.col("user_id") / 1000), cap=2.0)
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(*(c.alias(n) for n, c in parts.items()))
    return rounded(rounded(out, "value", "error"), "ess", places=4)


@query("""
with n as (select *, row_number() over (partition by o_orderpriority, o_custkey order by o_orderdate, o_orderkey) as rep from orders),
d as (select a.o_custkey % 50 as dim, round((b.o_totalprice - a.o_totalprice) / 20000) as d from n a join n b using (o_custkey, rep) where a.o_orderpriority = '1-URGENT' and b.o_orderpriority = '5-LOW'),
r as (select dim, d, rank() over (partition by dim order by abs(d)) + (count(*) over (partition by dim, abs(d)) - 1) / 2.0 as r from d where d <> 0)
select dim, count(r) as n, coalesce(sum(r) filter (where d > 0), 0)::double as w from (select distinct dim from d) left join r using (dim) group by 1""")
def wilcoxon_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = J.pair_arms(table(spark, sf_dir, "orders"), "o_orderpriority", ("1-URGENT", "5-LOW"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").where("side = 'both'")
    gap = F.round((F.col("after") - F.col("before")) / 20000)
    return S.wilcoxon(pairs.withColumn("dim", F.col("o_custkey") % 50), "dim", F.lit(0.0), gap).drop("p")  # p has tests of its own


@query("""
with g as (select o_custkey, count(*)::double as k from orders group by 1), z as (select 1.959963984540054 as a, 0.8416212335729143 as b)
select o_custkey, ceil(2 * ((a + b) / (k / 20)) ** 2)::double as each_arm, ceil(((a + b) / (k / 20)) ** 2)::double as pairs, round((a + b) / sqrt(k), 6) as least_effect,
  case when k = 10 then 'inf'::double else ceil((a * sqrt(k / 50 + 0.2) + b * sqrt(k / 50 + 0.2 - (k / 50 - 0.2) ** 2)) ** 2 / (k / 50 - 0.2) ** 2) end as discordant from g, z""")
def power_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("double")
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    n = F.when(F.col("k") == 10, float("inf")).otherwise(D.mcnemar_n(k / 50, F.lit(0.2)))
    return by.select("o_custkey", D.required_n(k / 20).alias("each_arm"), D.required_n(k / 20, paired=True).alias("pairs"), F.round(D.paired_mde(k), 6).alias("least_effect"), n.alias("discordant"))


@query(f"""
with o as (select o_orderpriority as c, o_custkey % 400 as item, o_totalprice + case when o_orderpriority = '2-HIGH' then 30000 else 0 end as s, row_number() over (partition by o_orderpriority, o_custkey % 400 order by o_totalprice) as rep from orders),
m as (select c, count(*) as n, avg(s) as mean, stddev_samp(s) / sqrt(count(*)) * 1.959963984540054 as half from o group by 1), base as (select * from o where c = '3-MEDIUM'),
d as (select o.c, base.s - o.s as d from o join base using (item, rep) where o.c <> '3-MEDIUM'), k as (select c, count(*) as k, avg(d) / stddev_samp(d) as dz from d group by 1),
r as (select c, d, rank() over (partition by c order by abs(d)) + (count(*) over (partition by c, abs(d)) - 1) / 2.0 as r, count(*) over (partition by c, abs(d)) as ties from d where d <> 0),
w as (select c, count(*)::double as n, sum(r) filter (where d > 0) as w, sum(ties * ties - 1)::double as t from r group by 1),
p as (select c, {normal_p_sql("(greatest(abs(w - n * (n + 1) / 4) - 0.5, 0) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48))")} as p from w),
q as (select c, p, min(p * 4 / i) over (order by i rows between current row and unbounded following) as q from (select *, row_number() over (order by p, c) as i from p))
select m.c as candidate, m.n, round(mean, 4) as mean, round(mean - half, 4) as ci_low, round(mean + half, 4) as ci_high, k as paired_n, m.n - k as unpaired, case when k is not null then (select count(*) from base) - k end as unpaired_comparator, round(dz, 6) as dz, round(q.p, 5) as p, case when q.q is not null then round(least(1, q.q), 5) end as q from m left join k on k.c = m.c left join q on q.c = m.c""")
def summary_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_totalprice") + F.when(F.col("o_orderpriority") == "2-HIGH", 30000).otherwise(0)
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("candidate"), (F.col("o_custkey") % 400).alias("item"), s.alias("s"))
    out = R.summary_table(runs, "candidate", F.col("s"), ["item"], "3-MEDIUM")
    return rounded(rounded(rounded(out, "dz"), "p", "q", places=5), "mean", "ci_low", "ci_high", places=4)
