"""Queries on judges, curricula, frontiers, releases and declarative rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import joins as J
from ..operators import quantiles as Q
from ..operators import rules as R
from ..session import table
from .aggregates import rounded
from .registry import query, uniform_sql


@query("select * from events where (event_type in ('error', 'view') and value >= 90) or not (user_id > 2)")
def predicate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"any": [{"all": [{"op": "in", "path": "event_type", "value": ["error", "view"]}, {"op": "gte", "path": "value", "value": 90.0}]}, {"not": {"op": "gt", "path": "user_id", "value": 2}}]}
    return table(spark, sf_dir, "events").where(R.predicate(rule))


@query("select * from orders where o_orderstatus <> 'P' order by o_totalprice, o_orderkey limit 25")
def selection_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"where": {"op": "ne", "path": "o_orderstatus", "value": "P"}, "order": ["o_totalprice", "o_orderkey"], "take": 25}
    return R.select(table(spark, sf_dir, "orders"), rule)


@query("select count(*) as n, count(*) filter (where o_orderstatus = 'F') as hits, round(avg((o_orderstatus = 'F')::int), 6) as rate from orders")
def estimand_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.estimand(table(spark, sf_dir, "orders"), {"kind": "rate", "hit": {"op": "eq", "path": "o_orderstatus", "value": "F"}}), "rate")


@query("""
with b as (select o_custkey, coalesce(avg(case when o_orderpriority = '1-URGENT' then o_totalprice end), 0) as a, coalesce(avg(case when o_orderpriority = '5-LOW' then o_totalprice end), 0) as b from orders group by 1)
select count(*) as pairs, round(avg(b - a), 4) as difference from b""")
def estimand_paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"kind": "paired_difference", "pair": "o_custkey", "arm": "o_orderpriority", "arms": ["1-URGENT", "5-LOW"], "value": "o_totalprice"}
    return rounded(R.estimand(table(spark, sf_dir, "orders"), spec), "difference", places=4)


@query("""
with a as (select s_suppkey as k, s_nationkey as v from supplier), b as (select s_suppkey + 3 as k, s_nationkey as v from supplier)
select count(*) filter (where a.k is null or b.k is null) as lone, count(*) filter (where a.k is not null and b.k is not null and a.v <> b.v) as differ, count(*) filter (where a.v = b.v) as same from a full join b on a.k = b.k""")
def population_reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    a, b = (s.select((F.col("s_suppkey") + d).alias("k"), F.col("s_nationkey").alias("v")) for d in (0, 3))
    return R.reproducible(a, b, ["k"], ["v"])


@query("""
with i as (select l_partkey, avg(case when l_linenumber = 1 then l_quantity end) as a, avg(case when l_linenumber = 2 then l_quantity end) as b from lineitem group by 1)
select count(*) as items, round(avg(a - b), 6) as bias from i where a is not null and b is not null""")
def positional_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.positional_bias(table(spark, sf_dir, "lineitem"), "l_partkey", F.col("l_linenumber"), F.col("l_quantity")), "bias")


@query("""
with g as (select source, count(*) as n, var_pop(n_chars) as a, var_pop(quality) as b, case when var_pop(n_chars) > 0 and var_pop(quality) > 0 then corr(n_chars, quality) end as r from documents join labels using (doc_id) group by 1)
select source, n, round(case when n < 3 then 'nan'::double when a = 0 and b = 0 then 1 when a = 0 or b = 0 then 0 else r end, 6) as r from g""")
def verbosity_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(E.verbosity_bias(rows, "source", F.col("n_chars"), F.col("quality")), "r")


@query("select round(avg(o_totalprice) filter (where o_orderpriority = '1-URGENT'), 4) as own, round(avg(o_totalprice) filter (where o_orderpriority <> '1-URGENT'), 4) as others, round(avg(o_totalprice) filter (where o_orderpriority = '1-URGENT') - avg(o_totalprice) filter (where o_orderpriority <> '1-URGENT'), 4) as gap from orders")
def self_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.self_preference(table(spark, sf_dir, "orders"), F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")), "own", "others", "gap", places=4)


@query("""
with o as (select user_id % 40 as variant, user_id % 7 * 10 + length(event_type) as scenario, value / 100 as x from events where event_type <> 'error'),
k as (select v as variant, s * 10 + l as scenario from range(40) a(v), range(7) b(s), (values (4), (5), (6), (8)) c(l)),
c as (select k.variant, k.scenario, count(x) as n, sqrt(case when count(x) < 2 then 0.05 else var_samp(x) + 0.05 end) + 1 / sqrt(greatest(1, count(x))) as w from k left join o using (variant, scenario) group by all)
select variant, scenario, n, round(w, 6) as weight, 2 + floor((50000 - 2 * count(*) over ()) * (w / sum(w) over ()) + 0.5)::bigint as share from c""")
def curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").where("event_type <> 'error'").select((F.col("user_id") % 40).alias("variant"), (F.col("user_id") % 7 * 10 + F.length("event_type")).alias("scenario"), (F.col("value") / 100).alias("x"))
    grid = spark.range(40 * 7 * 4).select((F.col("id") % 40).alias("variant"), (F.floor(F.col("id") / 40) % 7 * 10 + F.get(F.array(*map(F.lit, (4, 5, 6, 8))), F.floor(F.col("id") / 280).cast("int"))).alias("scenario"))
    return rounded(E.curriculum(seen, grid, ["variant", "scenario"], F.col("x"), 50000, floor=2), "weight")


@query("""
select s_suppkey, s_acctbal, s_nationkey, round((2 * (max(s_acctbal) over () - s_acctbal) / (max(s_acctbal) over () - min(s_acctbal) over ()) + (s_nationkey - min(s_nationkey) over ())::double / (max(s_nationkey) over () - min(s_nationkey) over ())) / 3, 6) as score from supplier""")
def scalar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return rounded(E.scalar_scores(points, {"s_acctbal": ("min", 2.0), "s_nationkey": ("max", 1.0)}), "score")


@query("""
with v as (select user_id, event_type, count(*) as votes, min(event_id) as o from events group by all)
select user_id, event_type, votes, sum(votes) over (partition by user_id)::bigint as n from v qualify row_number() over (partition by user_id order by votes desc, o) = 1""")
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.self_consistency(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""
with c as (select event_type, props || user_id as argument, count(*) filter (where value >= 30) as passing, count(*) filter (where value < 30) as failing from events group by all) select * from c where passing = 0 or failing = 0""")
def argument_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").withColumn("argument", F.concat("props", F.col("user_id").cast("string")))
    return E.argument_diff(calls, "event_type", "argument", F.col("value") >= 30)


@query("select l_shipmode_, min(v) as min, quantile_disc(v, 0.5) as p50, quantile_disc(v, 0.9) as p90, max(v) as max, round(sum(v), 2) as sum, count(v) as n from (select l_linestatus as l_shipmode_, l_quantity as v from lineitem) group by 1")
def number_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "l_shipmode_")
    return rounded(E.number_series(rows, "l_shipmode_", F.col("l_quantity")), "sum", places=2)


@query("""
with r as (select o_custkey, count(*) as n, count(*) filter (where o_orderstatus <> 'P') as n_known, count(*) filter (where o_orderstatus = 'F') / nullif(count(*) filter (where o_orderstatus <> 'P'), 0)::double as r from orders group by 1)
select o_custkey, n, n_known, round(r, 6) as pass_rate, case when n_known = 0 then 'unknown' when r <= 0.25 then 'gap' else 'saturated' end as headroom from r""")
def capability_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "P", "unknown").otherwise("fail")
    return rounded(E.headroom(table(spark, sf_dir, "orders"), "o_custkey", outcome, keep=0.25), "pass_rate")


@query("""
with x as (select user_id % 100 as lane, ts, event_id, value / 100 as p, case when event_id % 9 > 0 then (100 - value) / 100 * (event_id % 7) / 7 end as t, case when event_id % 2 = 0 then value / 100 + (event_id % 5) / 5 end as s, case when event_id % 3 = 0 then (event_id % 11) / 11 end as c from events),
b as (select *, count(*) over (partition by lane) as n, row_number() over (partition by lane order by ts, event_id) as i, count(c) over (partition by lane) as nc, case when c is not null then count(c) over (partition by lane order by ts, event_id) end as ic from x),
w as (select *, i > n - greatest(1, least(50, n // 2)) as late, ic <= nc // 2 as early from b),
f as (select lane, p, count(*) filter (where late) as a, count(*) filter (where not late) as b from w group by all),
k as (select lane, max(gap) as d from (select lane, abs(sum(a) over o / sum(a) over (partition by lane) - sum(b) over o / sum(b) over (partition by lane)) as gap from f window o as (partition by lane order by p)) group by 1),
g as (select lane, count(*) as n, count(*) filter (where late) as n1, count(*) filter (where not late) as n0, count(t) filter (where late) as m1, count(t) filter (where not late) as m0,
  avg(p) filter (where late) - avg(p) filter (where not late) as pg, avg(t) filter (where late) - avg(t) filter (where not late) as tg, avg(c) filter (where not early) - avg(c) filter (where early) as cg, count(c) as nc, count(s) as ns, corr(p, s) as r from w group by 1),
s as (select g.lane, n, case when n >= 4 and least(n1, n0, m1, m0) >= 2 then greatest(0, least(1, 5 * (pg - tg))) end as divergence, case when n >= 4 and least(n1, n0) >= 4 then greatest(0, least(1, d - 0.2)) end as shift,
  case when n >= 4 and ns >= 4 then greatest(0, least(1, 0.5 - greatest(0, r))) end as disagreement, case when n >= 4 and nc >= 4 then greatest(0, least(1, 5 * (pg - cg))) end as drift from g join k using (lane))
select lane, n, round(divergence, 6) as divergence, round(shift, 6) as shift, round(disagreement, 6) as disagreement, round(drift, 6) as drift,
  case when greatest(divergence, shift, disagreement, drift) is null then 'insufficient_evidence' when greatest(divergence, shift, disagreement, drift) >= 0.6 then 'gaming' when greatest(divergence, shift, disagreement, drift) >= 0.3 then 'suspect' else 'clean' end as verdict from s""")
def reward_hacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 100).alias("lane"), "ts", "event_id", (v / 100).alias("p"), F.when(i % 9 > 0, (100 - v) / 100 * (i % 7) / 7).alias("t"),
        F.when(i % 2 == 0, v / 100 + (i % 5) / 5).alias("s"), F.when(i % 3 == 0, (i % 11) / 11).alias("c"),
    )
    return rounded(E.reward_hacking(rows, "lane", ["ts", "event_id"], "p", "t", "s", "c"), "divergence", "shift", "disagreement", "drift")


@query("""
with n as (select *, row_number() over (partition by o_orderpriority, o_custkey order by o_orderdate, o_orderkey) as rep from orders),
p as (select b.o_totalprice - a.o_totalprice as d from n a join n b using (o_custkey, rep) where a.o_orderpriority = '1-URGENT' and b.o_orderpriority = '5-LOW')
select 'price' as metric, count(d) as n, round(avg(d), 4) as delta, round(avg(d) / stddev_samp(d), 6) as dz, round(avg(d) * sqrt(count(d)) / stddev_samp(d), 6) as t, round(avg((abs(d) < 1e-9)::int), 6) as tied from p""")
def lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = J.pair_arms(table(spark, sf_dir, "orders"), "o_orderpriority", ("1-URGENT", "5-LOW"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").where("side = 'both'")
    out = E.lift(pairs.withColumn("metric", F.lit("price")), "metric", F.col("before"), F.col("after"))
    return rounded(rounded(out, "dz", "t", "tied"), "delta", places=4)


@query("""
with r as (select count(*) as n, count(*) filter (where o_orderpriority <> '5-LOW' and o_orderstatus = 'F')::double / count(*) filter (where o_orderpriority <> '5-LOW') as pass_rate, avg(o_totalprice) as mean_cost,
 quantile_cont(o_totalprice, 0.95) as p95_wall, count(*) filter (where o_orderpriority = '5-LOW') as gated from orders),
i as (select *, list_filter([case when n < 10 then 'too_few_runs' end, case when pass_rate < 0.9 then 'low_pass_rate' end], lambda x: x is not null) as c, list_filter([case when mean_cost > 1e9 then 'cost' end, case when p95_wall > 1e9 then 'slow' end, case when gated > 0 then 'gated_runs' end], lambda x: x is not null) as o from r)
select n, round(pass_rate, 6) as pass_rate, round(mean_cost, 4) as mean_cost, round(p95_wall, 4) as p95_wall, gated, array_to_string(c || o, ',') as issues, case when len(c) > 0 then 'fail' when len(o) > 0 then 'warn' else 'pass' end as verdict from i""")
def release_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"runs": 10, "pass_rate": 0.9, "cost": 1e9, "wall": 1e9}
    out = E.release_confidence(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice"), F.col("o_totalprice"), limits)
    return rounded(rounded(out, "pass_rate"), "mean_cost", "p95_wall", places=4)


@query("""
with r as (select *, lag(event_type) over (partition by user_id order by ts) as b from events)
select user_id, count(*) as n, arg_min(value, ts) as first, arg_max(value, ts) as last, count(*) filter (where b <> event_type) as changes, arg_max(value, ts) - arg_min(value, ts) as trend from r group by 1""")
def judge_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sentinel(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "value")


@query("select (i - 1)::int as i, edge from (select unnest(list_distinct_sorted) as edge, generate_subscripts(list_distinct_sorted, 1) as i from (select list_sort(list_distinct(quantile_cont(value, [0.2, 0.4, 0.6, 0.8]))) as list_distinct_sorted from events))")
def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quantile_edges(table(spark, sf_dir, "events"), "value")


_TERMS = "list_sum(list_transform(range(a::int, (a + b)::int), lambda j: exp(lgamma(a + b) - lgamma(j + 1) - lgamma(a + b - j)) * pow((l + h) / 2, j) * pow(1 - (l + h) / 2, a + b - 1 - j)))"


@query(f"""
with recursive c as (select distinct user_id % 40 as variant, event_type as scenario from events), o as (select user_id % 40 as variant, event_type as scenario, count(*) filter (where value >= 60) as p, count(*) filter (where value < 60) as f from events where event_id % 3 > 0 and user_id % 40 < 30 group by all),
k as (select c.*, coalesce(p, 0) + 1.0 as a, coalesce(f, 0) + 1.0 as b, {uniform_sql("variant * 10 + length(scenario)", "0", 5)} as u from c left join o using (variant, scenario)),
t as (select *, 0 as i, 0.0::double as l, 1.0::double as h from k union all select variant, scenario, a, b, u, i + 1, case when s < u then (l + h) / 2 else l end, case when s < u then h else (l + h) / 2 end from (select *, {_TERMS} as s from t where i < 60)),
w as (select variant, scenario, (a + b - 2)::bigint as n, (l + h) / 2 as sampled, exp(-pow(((l + h) / 2 - 0.5) / greatest(0.05, sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))), 2)) as weight from t where i = 60)
select variant, scenario, n, round(sampled, 6) as sampled, round(weight, 6) as weight, floor(weight / sum(weight) over () * 1000 + 0.5)::bigint as count from w""")
def thompson_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("variant"), F.col("event_type").alias("scenario"), "event_id", "value")
    seen = runs.where("event_id % 3 > 0 and variant < 30")
    key = F.col("variant") * 10 + F.length("scenario")
    out = E.thompson_curriculum(runs.select("variant", "scenario").distinct(), seen, ["variant", "scenario"], key, F.col("value") >= 60, 1000, seed=5)
    return rounded(out, "sampled", "weight")
