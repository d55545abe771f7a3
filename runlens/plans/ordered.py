"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frontier as P
from ..operators import ordered as O
from ..session import table
from .aggregates import rounded
from .registry import query


@query("""
with g as (select *, sum((event_type not in ('error', 'view'))::int) over (partition by user_id order by ts, event_id) as g from events)
select user_id, min(ts) as first, max(ts) as last, count(*) as length from g where event_type in ('error', 'view') group by user_id, g having count(*) >= 3""")
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view"))


_HALF_DAY = 43_200_000


@query(f"""
with c as (select user_id, event_type, event_id, epoch_us(ts) // 1000 as s, epoch_us(ts) // 1000 + round(value * 100000)::bigint as e from events),
n as (select *, row_number() over (partition by user_id order by s, event_id) as n from c),
g as (select *, coalesce(s - lag(s) over w > {_HALF_DAY} or n - lag(n) over w - 1 > 1 or not coalesce(lag(e) over w <= s, false), true)::int as new from n window w as (partition by user_id, event_type order by s, event_id)),
p as (select *, sum(new) over (partition by user_id, event_type order by s, event_id) as p from g),
d as (select user_id, event_type, p, s, min(s) over w as first, count(*) over w as calls from p window w as (partition by user_id, event_type, p order by s range between {_HALF_DAY} preceding and current row))
select user_id, event_type, first, s as last, calls from d where calls >= 2 qualify row_number() over (partition by user_id, event_type, p order by calls desc, s, first) = 1""")
def stuck_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return O.stuck_loops(table(spark, sf_dir, "events"), ["user_id"], start, start + F.round(F.col("value") * 100000).cast("long"), "event_id", ["event_type"], window_ms=_HALF_DAY, least=2, between=1)


_SPLIT = """with b as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as b from events),
s as (select *, b <= 20 as recent from b where b <= 70)"""


@query(_SPLIT + """, v as (select user_id, value, count(*) filter (where recent) as r, count(*) filter (where not recent) as b from s group by all),
c as (select user_id, r, b, abs(sum(r) over w / sum(r) over (partition by user_id) - sum(b) over w / sum(b) over (partition by user_id)) as gap from v window w as (partition by user_id order by value))
select user_id, sum(r)::bigint as n_recent, sum(b)::bigint as n_before, round(max(gap), 6) as d from c group by 1""")
def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.recent_and_before(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 20, 50)
    return rounded(O.ks_distance(rows, "user_id", "part", "value"), "d")


@query(_SPLIT + """, v as (select user_id, event_type, count(*) filter (where recent) as r, count(*) filter (where not recent) as b from s group by all),
e as (select *, b * sum(r) over (partition by user_id) / nullif(sum(b) over (partition by user_id), 0) as e from v)
select user_id, round(sum((r - e) ** 2 / e), 6) as chi2, count(*) as cells from e where e >= 1 group by 1""")
def chi2_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.recent_and_before(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 20, 50)
    return rounded(O.chi_square_shift(rows, "user_id", "part", "event_type"), "chi2")


@query("""
with b as (select user_id, value as v, row_number() over (partition by user_id order by ts desc, event_id desc) as b from events),
s as (select *, sign(v - lead(v) over (partition by user_id order by b)) as d from b), d as (select *, first_value(d) over (partition by user_id order by b) as way from s),
g as (select user_id, count(*) as n, avg(v) filter (where b <= 5) as mean, stddev_pop(v) filter (where b <= 5) as sd, min(b) filter (where d is null or d = 0 or d <> way) as stop, max(way) as way from d group by 1),
c as (select user_id, n, n >= 3 as known, mean, sd / case when abs(mean) > 1e-9 then abs(mean) else 1 end as cv, ((stop - 1) * coalesce(way, 0))::bigint as run from g)
select user_id, n, case when known then round(mean, 6) else 0 end as mean, case when known then round(cv, 6) else 0 end as cv, case when known then run else 0 end as tail_run, known and n >= 5 and cv <= 0.05 as stable,
  case when not known then 'insufficient-data' when n >= 5 and cv <= 0.05 then 'stabilized' when run >= 3 then 'drifting-up' when run <= -3 then 'drifting-down' else 'noisy' end as state from c""")
def series_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.series_convergence(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value"), "mean", "cv")


_TESTS = "select user_id, event_type, round(1 - count(*) filter (where value < 50)::double / count(*), 6) as p from events group by all"


@query(f"""
with t as ({_TESTS}), r as (select *, count(*) over (partition by event_type) as m, row_number() over (partition by event_type order by p, user_id) as i from t)
select user_id, event_type, p, round(least(1, min(p * m / i) over (partition by event_type order by p, user_id rows between current row and unbounded following)), 6) as bh from r""")
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_adjusted(spark, sf_dir).drop("holm", "bonferroni"), "bh")


@query(f"""
with t as ({_TESTS}), r as (select *, count(*) over (partition by event_type) as m, row_number() over (partition by event_type order by p, user_id) as i from t)
select user_id, event_type, p, round(least(1, max(p * (m - i + 1)) over (partition by event_type order by p, user_id rows unbounded preceding)), 6) as holm, round(least(1, p * m), 6) as bonferroni from r""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_adjusted(spark, sf_dir).drop("bh"), "holm", "bonferroni")


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = 1 - F.count_if(F.col("value") < 50).cast("double") / F.count(F.lit(1))
    tests = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(share, 6).alias("p"))
    return O.adjusted_p(tests, "event_type", "p", "user_id")


_POINTS = "select s_suppkey, round(s_acctbal, 2) as cost, round(avg(l_quantity), 6) as quality from supplier join lineitem on s_suppkey = l_suppkey group by 1, 2"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("s_suppkey", F.round("s_acctbal", 2).alias("cost")).agg(F.round(F.avg("l_quantity"), 6).alias("quality"))


@query(f"with p as ({_POINTS}) select * from p where not exists (select 1 from p q where q.cost <= p.cost and q.quality >= p.quality and (q.cost < p.cost or q.quality > p.quality))")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.pareto_frontier(_points(spark, sf_dir), "cost", "quality")


@query(f"""
with p as ({_POINTS}), g as (select *, lead(cost) over a - lag(cost) over a as g0, lead(quality) over b - lag(quality) over b as g1, max(cost) over () - min(cost) over () as s0, max(quality) over () - min(quality) over () as s1
 from p window a as (order by cost, s_suppkey), b as (order by quality, s_suppkey))
select s_suppkey, cost, quality, round(coalesce(g0 / s0, 'inf'::double) + coalesce(g1 / s1, 'inf'::double), 6) as crowding from g""")
def crowding_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.crowding(_points(spark, sf_dir), "s_suppkey", ["cost", "quality"]), "crowding")


def _mean(x: Column, places: int) -> Column:
    """The rounded mean, ties away from zero: without the first rounding the last bits of a sum, which follow the order of rows, would decide them."""
    return F.round(F.round(F.avg(x), 9), places)


@query("""
with p as (select l_partkey, case when l_partkey % 7 > 0 then round(avg(l_extendedprice / l_quantity), 1) end as cost, round(avg(l_discount), 2) as quality, sum(l_quantity)::double as volume from lineitem group by 1),
k as (select * from p where cost is not null)
select * from k a where not exists (select 1 from k b where b.cost <= a.cost and b.quality >= a.quality and b.volume >= a.volume and (b.cost < a.cost or b.quality > a.quality or b.volume > a.volume))""")
def skyline_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(_mean(F.col("l_extendedprice") / F.col("l_quantity"), 1).alias("cost"), _mean(F.col("l_discount"), 2).alias("quality"), F.sum("l_quantity").cast("double").alias("volume"))
    points = by.withColumn("cost", F.when(F.col("l_partkey") % 7 > 0, F.col("cost")))
    return P.skyline(points, {"cost": "min", "quality": "max", "volume": "max"})


@query("""
with s as (select user_id, ts as a, ts + to_microseconds((value * 60000000)::bigint) as b from events), e as (select user_id, t, sum(d) as d from (select user_id, a as t, 1 as d from s union all select user_id, b, -1 from s) group by all),
o as (select user_id, t, sum(d) over w as open, lead(t) over w as until from e window w as (partition by user_id order by t))
select user_id, max(open)::bigint as peak, round(coalesce(sum(case when open > 0 then (epoch_us(until) - epoch_us(t)) / 1e6 end), 0), 3) as busy_s, round((epoch_us(max(t)) - epoch_us(min(t))) / 1e6, 3) as wall_s from o group by 1""")
def max_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60000000).cast("long"))
    events = table(spark, sf_dir, "events")
    out = O.max_concurrency(events, "user_id", F.col("ts").cast("timestamp"), end)
    return rounded(out, "busy_s", "wall_s", places=3)


@query("""
with g as (select *, coalesce(bool_or(event_type = 'signup') over w, false) as signed, coalesce(bool_or(event_type = 'view') over w, false) as viewed from events
  window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
select user_id, 'signup_first' as rule, bool_and(event_type <> 'purchase' or signed) as ok from g group by 1 union all
select user_id, 'view_then_click', bool_and(event_type <> 'click' or viewed) from g group by 1 union all
select user_id, 'buys', bool_or(event_type = 'purchase') from g group by 1 union all
select user_id, 'small', bool_and(value < 99.9) from g group by 1 union all
select user_id, 'no_big_error', bool_and(not (event_type = 'error' and value > 99)) from g group by 1""")
def trace_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rules = {
        "signup_first": ("precedes", kind == "signup", kind == "purchase"), "view_then_click": ("never_unless", kind == "click", kind == "view"),
        "buys": ("eventually", kind == "purchase", None), "small": ("always", F.col("value") < 99.9, None),
        "no_big_error": ("never", (kind == "error") & (F.col("value") > 99), None),
    }
    return O.contract(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], rules)


@query("""
with a as (select conv_id as pair, turn, role as x from conversations where conv_id % 2 = 0), b as (select conv_id - 1 as pair, turn, role as y from conversations where conv_id % 2 = 1)
select pair, min(case when x is distinct from y then turn end) as first from a full join b using (pair, turn) group by 1""")
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("conv_id") - F.col("conv_id") % 2).alias("pair"))
    even = F.col("conv_id") % 2 == 0
    return O.first_divergence(turns.where(even), turns.where(~even), "pair", "turn", "role")


@query("""
with s as (select l_suppkey, 1 - l_discount as r, l_quantity as w, (1 - l_discount) - lag(1 - l_discount) over o as d, row_number() over o - 1 as i from lineitem window o as (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey))
select l_suppkey, round(sum(r * w) / sum(w), 6) as mean, round(sum(r * w), 4) as sum, round(avg((r < 0.95)::int), 6) as low_share, round(coalesce(min(d) filter (where round(d, 9) < 0), 0), 6) as worst_drop from s group by 1""")
def step_reward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").select("*", (1 - F.col("l_discount")).alias("reward"))
    out = O.step_rewards(steps, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "reward", "l_quantity").drop("worst_at", "low_share")
    low = steps.groupBy("l_suppkey").agg(F.avg((F.col("reward") < 0.95).cast("int")).alias("low_share"))
    return rounded(rounded(out.join(low, "l_suppkey"), "mean", "low_share", "worst_drop"), "sum", places=4)


@query("select * exclude r, r::int as turn from (select *, row_number() over (partition by event_type order by event_id) as r from events) order by r, event_type limit 12")
def selection_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.round_robin(table(spark, sf_dir, "events"), "event_type", ["event_id"], 12)


@query("select * from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1")
def best_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.best_by_scenario(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", F.col("o_orderkey"))


@query("""
with s as (select conv_id, turn, length(text) as s, length(text) > lag(length(text)) over (partition by conv_id order by turn) as up from conversations),
g as (select conv_id, count(*) as steps, arg_max(s, turn)::double / arg_min(s, turn) as growth, coalesce(bool_and(up), false) as rising from s group by 1)
select conv_id, steps, round(growth, 6) as growth, rising, steps >= 5 and growth <= 0.6 as halved from g""")
def behavioral_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.token_signals(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text")), "growth")


@query("""
with s as (select user_id, event_id, ts as a, ts + to_hours(2) as b from events),
g as (select *, coalesce(a >= max(b) over (partition by user_id order by a, event_id rows between unbounded preceding and 1 preceding), true)::int as new from s),
i as (select user_id, event_id, sum(new) over (partition by user_id order by a, event_id) as island from g)
select user_id, max(island)::bigint as islands, count(*) as spans from i group by 1""")
def execution_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("interval 2 hours")).alias("b"))
    return O.pack_intervals(spans, "user_id", "a", "b", "event_id").groupBy("user_id").agg(F.max("island").alias("islands"), F.count(F.lit(1)).alias("spans"))
