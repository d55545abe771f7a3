"""Aggregating queries. Roles: orders are runs, lineitem their spans, events a trace stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..session import table
from .registry import query

_R = 6


def rounded(df: DataFrame, *names: str, places: int = _R) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query("""
with g as (select o_orderpriority as candidate, count(*) as n, count(*) filter (where o_orderstatus = 'F') as passes,
  avg(o_totalprice) as mean_cost from orders group by 1),
r as (select *, passes::double / n as p from g)
select candidate, n, passes, round(mean_cost, 4) as mean_cost, round(p, 6) as pass_rate,
  round(greatest(0, (p + 3.8414588206941236 / (2 * n) - 1.959963984540054 * sqrt(p * (1 - p) / n + 3.8414588206941236 / (4.0 * n * n))) / (1 + 3.8414588206941236 / n)), 6) as ci_low,
  round(least(1, (p + 3.8414588206941236 / (2 * n) + 1.959963984540054 * sqrt(p * (1 - p) / n + 3.8414588206941236 / (4.0 * n * n))) / (1 + 3.8414588206941236 / n)), 6) as ci_high,
  row_number() over (order by p desc, mean_cost, candidate) as rank from r""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders")
    out = A.leaderboard(runs, "o_orderpriority", F.col("o_orderstatus") == "F", F.col("o_totalprice")).drop("mean_wall")
    return rounded(rounded(out, "pass_rate", "ci_low", "ci_high"), "mean_cost", places=4)


@query("""
with c as (select o.*, c_mktsegment, n_name, case when o_orderstatus = 'P' then 0 else least(1, o_totalprice / 400000) end as score,
  o_orderstatus = 'F' as passed from orders o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
x as (select 'o_orderpriority' as axis, o_orderpriority as value, * from c union all select 'c_mktsegment', c_mktsegment, * from c union all select 'n_name', n_name, * from c)
select axis, value, count(*) as cells, round(avg(passed::int), 6) as pass_rate, round(avg(score), 6) as mean, round(quantile_cont(score, 0.5), 6) as p50,
  round(quantile_cont(score, 0.9), 6) as p90, round(sum(o_totalprice), 2) as total_cost, 0::bigint as uncaptured from x group by all""")
def matrix_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    runs = runs.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    score, status = F.least(F.lit(1.0), F.col("o_totalprice") / 400000), F.col("o_orderstatus")
    out = A.axis_summary(runs, ["o_orderpriority", "c_mktsegment", "n_name"], score, status == "F", F.col("o_totalprice"), status == "P")
    return rounded(rounded(out, "pass_rate", "mean", "p50", "p90"), "total_cost", places=2)


@query("""
select l_returnflag, count(*) as n, round(avg(s), 6) as mean, round(quantile_cont(s, 0.5), 6) as p50, round(quantile_cont(s, 0.95), 6) as p95,
  round(stddev_pop(s), 6) as sd, min(s) as min, max(s) as max from (select l_returnflag, 1 - l_discount as s from lineitem) group by 1""")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.distribution(table(spark, sf_dir, "lineitem"), "l_returnflag", 1 - F.col("l_discount")), "mean", "p50", "p95", "sd")


@query("""
with e as (select min(l_extendedprice) as low, max(l_extendedprice) as high, (max(l_extendedprice) - min(l_extendedprice)) / 10 as w from lineitem),
b as (select least(9, floor((l_extendedprice - low) / w))::int as bin, count(*) as n from lineitem, e group by 1)
select r::int as bin, round(low + r * w, 4) as low, round(low + (r + 1) * w, 4) as high, coalesce(n, 0) as n from e, range(10) t(r) left join b on bin = r""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.histogram(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice")), "low", "high", places=4)


@query("""
select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as cost, sum((o_totalprice > 200000)::bigint)::bigint as large from orders group by all""")
def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = {"cost": F.col("o_totalprice"), "large": (F.col("o_totalprice") > 200000).cast("long")}
    return rounded(A.cross_tab(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], measures), "cost", places=2)


@query("""
with k as (select case o_orderstatus when 'F' then 'observed' when 'O' then 'estimated' else 'uncaptured' end as kind,
  case when o_orderstatus in ('F', 'O') then o_totalprice end as usd from orders)
select kind, count(*) as n, round(sum(usd), 2) as usd, round(count(*)::double / (select count(*) from k), 6) as share from k group by 1""")
def cost_provenance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "observed").when(status == "O", "estimated").otherwise("uncaptured")
    out = A.cost_provenance(table(spark, sf_dir, "orders"), kind, F.when(status.isin("F", "O"), F.col("o_totalprice")))
    return rounded(rounded(out, "share"), "usd", places=2)


@query("""
select l_suppkey, count(*) as spans, sum(l_quantity) as units, round(sum(l_extendedprice), 2) as cost from lineitem group by rollup (l_suppkey)""")
def llm_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.usage_rollup(table(spark, sf_dir, "lineitem"), "l_suppkey", {"units": F.col("l_quantity"), "cost": F.col("l_extendedprice")})
    return rounded(out, "cost", places=2)


@query("""
with w as (select user_id, event_type, value < 20 as failed, value as latency, row_number() over (partition by user_id, event_type, props order by ts, event_id) > 1 as again,
  lead(1) over (partition by user_id, event_type order by ts, event_id) is not null as later from events)
select user_id, event_type, count(*) as calls, count(*) filter (where failed) as errors, round(avg(latency), 6) as mean_latency, round(avg(again::int), 6) as duplicate_rate,
  round(coalesce(count(*) filter (where failed and later)::double / nullif(count(*) filter (where failed), 0), 0), 6) as retry_rate from w group by all""")
def tool_use_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.tool_use(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], "props", F.col("value") < 20, F.col("value"))
    return rounded(out, "mean_latency", "duplicate_rate", "retry_rate")


@query("""
with c as (select c_mktsegment, o_orderpriority, o_totalprice as used, case when c_mktsegment = 'BUILDING' then 100000 else 250000 end as lim from orders join customer on o_custkey = c_custkey),
x as (select 'c_mktsegment' as dim, c_mktsegment as key, * from c union all select 'o_orderpriority', o_orderpriority, * from c union all select 'all', 'all', * from c)
select dim, key, count(*) as n, count(*) filter (where used > lim) as breaches, round(max(used / lim), 6) as worst, round(avg((used > lim)::int), 6) as breach_rate from x group by all""")
def budget_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    limit = F.when(F.col("c_mktsegment") == "BUILDING", 100000).otherwise(250000)
    return rounded(A.budget_breach(rows, ["c_mktsegment", "o_orderpriority"], F.col("o_totalprice"), limit), "worst", "breach_rate")


@query("""
with r as (select case when o_orderstatus = 'P' then 'timeout' end as cls, least(1, o_totalprice / 300000) as score from orders)
select coalesce(cls, 'unknown') as class, count(*) as n, round(count(*)::double / (select count(*) from r), 6) as share from r where cls is not null or score < 0.5 group by 1""")
def failure_class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders")
    failure = F.when(F.col("o_orderstatus") == "P", "timeout")
    return rounded(A.failure_shares(runs, failure, F.least(F.lit(1.0), F.col("o_totalprice") / 300000)), "share")


@query("""
with e as (select user_id, regexp_replace(props, '[0-9]+', '#', 'g') as signature from events where event_type = 'error')
select signature, count(*) as spans, count(distinct user_id) as in_traces, round(count(distinct user_id)::double / (select count(distinct user_id) from e), 6) as prevalence from e group by 1""")
def error_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    return rounded(A.error_prevalence(errors, "user_id", F.regexp_replace("props", "[0-9]+", "#")), "prevalence")


@query("""
with f as (select event_type as cls, floor(value / 25)::int as band, user_id, event_id from events where event_type in ('error', 'view'))
select cls, band, count(*) as n, count(distinct user_id) as groups, array_to_string(list_sort(list(event_id))[:5], ',') as examples, round(count(*)::double / (select count(*) from f), 6) as share from f group by all having count(*) >= 3""")
def failure_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type in ('error', 'view')")
    keys = {"cls": F.col("event_type"), "band": F.floor(F.col("value") / 25).cast("int")}
    return rounded(A.clusters(rows, keys, F.col("user_id"), "event_id", least=3), "share")


@query("""
select count(distinct user_id) as traces, count(*) as spans, count(*) filter (where event_type = 'error') as errors, (select string_agg(t, ',' order by t) from (select distinct event_type as t from events)) as kinds,
  min(ts) as first, max(ts) as last from events""")
def trace_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overview(table(spark, sf_dir, "events"), "event_type", "user_id", "ts", F.col("event_type") == "error")


@query("""
with c as (select o_custkey % 50 as scenario, o_orderpriority, avg((o_orderstatus = 'F')::int) as s from orders group by all)
select scenario, count(*) as candidates, round(avg(s), 6) as mean, round(var_pop(s), 6) as variance, var_pop(s) = 0 and min(s) >= 0.999 as saturated from c group by 1""")
def scenario_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").withColumn("scenario", F.col("o_custkey") % 50)
    out = A.discrimination(runs, "scenario", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("double"))
    return rounded(out, "mean", "variance")


@query("""
with d as (select n_name, p.o_orderpriority from nation, (select distinct o_orderpriority from orders) p),
s as (select n_name, o_orderpriority, count(*) as n, avg(o_totalprice) as score from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)
select n_name, o_orderpriority, coalesce(n, 0) as n, round(score, 6) as score from d left join s using (n_name, o_orderpriority)""")
def campaign_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, nation = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    levels = F.broadcast(orders.select("o_orderpriority").distinct())  # a design's levels
    design = nation.select("n_name").join(levels)
    seen = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(A.coverage(design, seen, ["n_name", "o_orderpriority"], F.col("o_totalprice")), "score")


@query("""
with j as (select doc_id, j, s from (select doc_id, 'quality' as j, quality as s from labels union all select doc_id, 'toxic', case when doc_id % 3 > 0 then toxic end from labels))
select doc_id, 'overall' as dim, round(avg(s), 6) as mean, count(s) as answered, count(*) - count(s) as silent, (max(s) - min(s))::double as disagreement from j group by 1""")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("toxic", F.when(F.col("doc_id") % 3 > 0, F.col("toxic")))
    rows = labels.unpivot("doc_id", ["quality", "toxic"], "judge", "score").withColumn("dim", F.lit("overall"))
    return rounded(A.verdicts(rows, "doc_id", "dim", "judge", F.col("score")), "mean")


@query("select event_type, count(*) as n, round(avg((value >= 50)::int), 6) as pass_rate from events group by 1")
def attack_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.pass_rates(table(spark, sf_dir, "events"), "event_type", F.col("value") >= 50), "pass_rate")


@query("""
select count(*) as n, count(*) filter (where l_quantity <= 3) as stubs, count(*) filter (where l_quantity > 3) as real, count(*) filter (where l_discount = 0) as uncosted,
  case when count(*) = 0 then 'empty' when count(*) filter (where l_quantity <= 3) = 0 then 'real' when count(*) filter (where l_quantity > 3) = 0 then 'stub' else 'mixed' end as verdict from lineitem""")
def backend_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.when(F.col("l_quantity") > 3, F.col("l_quantity"))
    return A.integrity(table(spark, sf_dir, "lineitem"), tokens, F.when(F.col("l_discount") != 0, F.col("l_extendedprice")))
