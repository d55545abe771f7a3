"""Joining queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.moments import pearson
from ..operators import joins as J
from ..session import table
from .aggregates import rounded
from .registry import query


@query("""
with n as (select *, row_number() over (partition by o_orderpriority, o_custkey order by o_orderdate, o_orderkey) as rep from orders where o_orderpriority in ('1-URGENT', '5-LOW')),
a as (select o_custkey, rep, o_totalprice as before from n where o_orderpriority = '1-URGENT'), b as (select o_custkey, rep, o_totalprice as after from n where o_orderpriority = '5-LOW')
select o_custkey, rep::int as rep, before, after, case when before is null then 'after' when after is null then 'before' else 'both' end as side from a full join b using (o_custkey, rep)""")
def pair_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pair_arms(table(spark, sf_dir, "orders"), "o_orderpriority", ("1-URGENT", "5-LOW"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")


@query("""
with y as (select l_partkey, l_returnflag, year(l_shipdate) as y, avg(l_quantity) as s from lineitem group by all),
a as (select * from y where y = 1995), b as (select * from y where y = 1996)
select l_partkey, l_returnflag, round(a.s, 6) as before, round(b.s, 6) as after, case when a.s is null then 'added' when b.s is null then 'removed' else 'matched' end as change, round(b.s - a.s, 6) as delta
from a full join b using (l_partkey, l_returnflag)""")
def generation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate"))
    key = ["l_partkey", "l_returnflag"]
    means = rows.where("y in (1995, 1996)").groupBy(*key, "y").agg(F.avg("l_quantity").alias("s"))
    return rounded(J.generation_diff(means.where("y = 1995"), means.where("y = 1996"), key, "s"), "before", "after", "delta")


@query("""
with m as (select o_custkey, max(case when o_orderpriority = '1-URGENT' then o_totalprice end) as a, max(case when o_orderpriority = '2-HIGH' then o_totalprice end) as b from orders where o_orderstatus <> 'P' group by 1)
select count(*) as scenarios, count(*) filter (where b > a) as wins, count(*) filter (where b < a) as losses, count(*) filter (where b = a) as ties, round(avg(a), 4) as mean_a, round(avg(b), 4) as mean_b from m where a is not null and b is not null""")
def compare_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.compare_candidates(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ("1-URGENT", "2-HIGH"), F.col("o_totalprice"), F.col("o_orderstatus") == "P")
    return rounded(out, "mean_a", "mean_b", places=4)


@query("""
with c as (select event_id, user_id, ts from events where event_type = 'purchase'), e as (select user_id, ts as t, value as last_view from events where event_type = 'view')
select event_id, c.user_id, ts, case when t >= ts - interval 6 hours then last_view end as last_view from c asof left join e on c.user_id = e.user_id and c.ts >= e.t""")
def latest_outcome_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("t"), F.col("value").alias("last_view"))
    return J.latest_as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "t", ["last_view"], "6 hours")


@query("""
with s as (select 'quality' as judge_a, 'toxic' as judge_b, quality::double as a, toxic::double as b from labels)
select judge_a, judge_b, count(*) as items, round(avg((a = b)::int), 6) as agreement, round(corr(a, b), 6) as r from s group by all""")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "judge", "score").withColumn("ord", F.lit(0))
    pairs = J.rater_pairs(scores, "doc_id", "judge", "score", ["ord"])
    out = pairs.groupBy("judge_a", "judge_b").agg(
        F.count(F.lit(1)).alias("items"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("agreement"), pearson(F.col("a"), F.col("b")).alias("r")
    )
    return rounded(out, "agreement", "r")


@query("""
with m as (select o_custkey, o_orderpriority as c, avg(o_totalprice) as s from orders group by all)
select a.o_custkey, a.c as chosen, b.c as rejected, round(a.s - b.s, 4) as gap from m a join m b using (o_custkey) where a.s - b.s > 100000""")
def preferences_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.scenario_preferences(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", F.col("o_totalprice"), 100000.0), "gap", places=4)


@query("""
with m as (select o_custkey, o_orderpriority as c, avg(o_totalprice) as s from orders group by all),
r as (select *, row_number() over (partition by o_custkey order by s desc, c) as t, row_number() over (partition by o_custkey order by s, c) as l from m)
select a.o_custkey, a.c as chosen, b.c as rejected, round(a.s - b.s, 4) as gap from r a join r b using (o_custkey) where a.t = 1 and b.l = 1 and a.s - b.s > 0""")
def preferences_best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.preferences(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", F.col("o_totalprice")), "gap", places=4)


@query("""
with m as (select o_custkey, o_orderpriority as c, avg(o_totalprice) as s from orders group by all)
select a.c as a, b.c as b, count(*) filter (where a.s - b.s > 1000) as wins_a, count(*) filter (where a.s - b.s < -1000) as wins_b, count(*) filter (where abs(a.s - b.s) <= 1000) as draws
from m a join m b using (o_custkey) where a.c < b.c group by 1, 2""")
def pairwise_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pairwise_wins(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", F.col("o_totalprice"), 1000.0)


@query("""
with k as (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as r from events),
l as (select user_id, event_id, case event_type when 'purchase' then 2 when 'click' then 1 else 0 end as g from events),
i as (select user_id, count(*) as n, sum(case when i <= 10 then (2 ** g - 1) / log2(i + 1) end) as ideal from (select *, row_number() over (partition by user_id order by g desc, event_id) as i from l where g > 0) group by 1),
h as (select user_id, count(*) as hits, min(r) as first, sum((2 ** g - 1) / log2(r + 1)) as dcg from k join l using (user_id, event_id) where r <= 10 and g > 0 group by 1)
select u.user_id, (coalesce(hits, 0) > 0)::int as hit, round(case when coalesce(n, 0) = 0 then 1 else coalesce(hits, 0) / n::double end, 6) as recall, round(coalesce(hits, 0) / 10.0, 6)::double as precision,
  round(coalesce(1.0 / first, 0), 6)::double as mrr, round(case when coalesce(ideal, 0) = 0 then 1 else coalesce(dcg, 0) / ideal end, 6) as ndcg
from (select distinct user_id from events) u left join i using (user_id) left join h using (user_id)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events")
    ranked = events.select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("r"))
    grade = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    out = J.retrieval_metrics(ranked, events.select("user_id", "event_id", grade.alias("g")), "user_id", "event_id", "r", "g")
    return rounded(out, "recall", "precision", "mrr", "ndcg")


@query("""
with f as (select case when o_orderstatus = 'P' then 0 when not o_totalprice > 100000 then 1 when not o_orderpriority < '4' then 2 else 3 end as i from orders),
s as (select * from (values (0, 'settled'), (1, 'large'), (2, 'urgent')) t(i, stage))
select stage, count(*) filter (where f.i >= s.i) as entered, count(*) filter (where f.i = s.i) as dropped, count(*) filter (where f.i > s.i) as left from s, f group by stage""")
def admission_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = {"settled": F.col("o_orderstatus") != "P", "large": F.col("o_totalprice") > 100000, "urgent": F.col("o_orderpriority") < "4"}
    return J.admission_funnel(table(spark, sf_dir, "orders"), stages)


@query("""
with g as (select user_id, bool_or(event_type = 'error' and value > 99) as x from events group by 1)
select count(*) as groups, count(*) filter (where x) as hits, round(avg(x::int), 6) as rate from g""")
def estimand_rate_at_least_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.col("event_type") == "error") & (F.col("value") > 99)
    return rounded(J.rate_at_least_once(table(spark, sf_dir, "events"), "user_id", hit), "rate")


@query("""
with g as (select o_custkey, bool_or(o_orderpriority = '1-URGENT') as a, bool_or(o_orderpriority = '5-LOW') as b from orders group by 1)
select count(*) filter (where a) as in_a, count(*) filter (where b) as in_b, count(*) filter (where a and b) as in_both, count(*) filter (where a or b) as in_any,
  round(count(*) filter (where a and b)::double / count(*) filter (where a or b), 6) as jaccard from g""")
def arm_set_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return rounded(J.set_ratio(table(spark, sf_dir, "orders"), "o_custkey", p == "1-URGENT", p == "5-LOW"), "jaccard")


@query("""
with o as (select user_id, min(ts) as s, count(*) as x from events group by 1), j as (select o.user_id, x, arg_max(value, ts) as y from o join events e using (user_id) where e.ts - interval 3 days <= s group by all)
select count(*) as n, round(corr(x, y), 6) as r from j""")
def outcome_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    runs = events.groupBy("user_id").agg(F.min("ts").alias("s"), F.count(F.lit(1)).alias("k"))
    pairs = J.outcome_correlation(runs, events, "user_id", "s", "ts", "3 days", F.col("k"), "value")
    return rounded(pairs.agg(F.count(F.lit(1)).alias("n"), pearson(F.col("x"), F.col("y")).alias("r")), "r")


@query("select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def latest_run_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest_by_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""
with c as (select conv_id, turn, length(text) % 5 = 0 as bad, split_part(text, ' ', 1) as result from conversations where role = 'user'), m as (select conv_id, turn, text from conversations where role = 'assistant'),
w as (select *, bad or (result <> '' and not exists (select 1 from m where m.conv_id = c.conv_id and m.turn > c.turn and contains(m.text, left(c.result, 120)))) as wasted from c)
select conv_id, count(w.turn) as calls, count(*) filter (where wasted) as wasted, round(coalesce(count(*) filter (where wasted) / nullif(count(w.turn), 0)::double, 0), 6) as waste_rate from (select distinct conv_id from conversations) left join w using (conv_id) group by 1""")
def tool_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    calls = turns.where("role = 'user'").select("conv_id", "turn", (F.length("text") % 5 == 0).alias("bad"), F.split_part("text", F.lit(" "), F.lit(1)).alias("result"))
    said = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("at"), "text")
    return rounded(J.tool_waste(turns, calls, said, "conv_id", "turn", "at", F.col("bad"), "result", "text"), "waste_rate")
