"""Queries of paired evidence: risk differences, bootstraps, promotions, gates, and fidelity of simulated runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import paired as P
from ..operators import quantiles as Q
from ..session import table
from .aggregates import rounded
from .registry import query, uniform_sql

_Z = 1.959963984540054

#: Urgent against low orders of a customer, repetition by repetition.
_PAIRS = """
n as (select *, row_number() over (partition by o_orderpriority, o_custkey order by o_orderdate, o_orderkey) as rep from orders),
p as (select a.o_custkey as cust, a.rep, a.o_custkey * 1000 + a.rep as key, a.o_orderstatus as s, b.o_orderstatus as t, a.o_totalprice as x, b.o_totalprice as y from n a join n b using (o_custkey, rep) where a.o_orderpriority = '1-URGENT' and b.o_orderpriority = '5-LOW')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").withColumn("v", F.struct("o_orderstatus", "o_totalprice"))
    pairs = J.pair_arms(runs, "o_orderpriority", ("1-URGENT", "5-LOW"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "v").where("side = 'both'")
    return pairs.select(F.col("o_custkey").alias("cust"), "rep", (F.col("o_custkey") * 1000 + F.col("rep")).alias("key"), *(F.col(f"{v}.{c}").alias(n) for v, c, n in (("before", "o_orderstatus", "s"), ("after", "o_orderstatus", "t"), ("before", "o_totalprice", "x"), ("after", "o_totalprice", "y"))))


def _nudged(df: DataFrame, *names: str, by: float = 1e-7) -> DataFrame:
    """Means of cents may end in a 5: a hair decides on both sides how they are rounded."""
    return df.withColumns({c: F.col(c) + by for c in names})


def _score_sql(d: str) -> str:
    """The score statistic of risk difference d, given b, c, n."""
    linear = f"({d} * (b + 3 * c + 2 * (n - b - c)) - (b + c))"
    loss = f"least(greatest((sqrt(greatest({linear} ** 2 + 8 * n * c * {d} * (1 - {d}), 0)) - {linear}) / (4 * n), 0, -{d}), greatest(0, (1 - {d}) / 2))"
    var = f"(n * (2 * {loss} + {d} * (1 - {d})))"
    return f"(case when {var} > 0 then (b - c - n * {d}) / sqrt({var}) when b - c - n * {d} = 0 then 0 else sign(b - c - n * {d}) * 'inf'::double end)"


_CHOOSE = "exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1))"
#: Halving both score bounds and both bounds of the chance to win among pairs that differ, for groups g of (b, c, n).
_HALVED = f"""
halved as (select g, b, c, n, 0 as i, -1.0::double as l0, (b - c) / n as l1, (b - c) / n as u0, 1.0::double as u1, 0.0::double as e0, 1.0::double as e1, 0.0::double as f0, 1.0::double as f1 from counts
  union all select g, b, c, n, i + 1, case when {_score_sql("((l0 + l1) / 2)")} > {_Z} then (l0 + l1) / 2 else l0 end, case when {_score_sql("((l0 + l1) / 2)")} > {_Z} then l1 else (l0 + l1) / 2 end,
    case when {_score_sql("((u0 + u1) / 2)")} > -{_Z} then (u0 + u1) / 2 else u0 end, case when {_score_sql("((u0 + u1) / 2)")} > -{_Z} then u1 else (u0 + u1) / 2 end,
    case when low < 0.025 then (e0 + e1) / 2 else e0 end, case when low < 0.025 then e1 else (e0 + e1) / 2 end, case when high > 0.025 then (f0 + f1) / 2 else f0 end, case when high > 0.025 then f1 else (f0 + f1) / 2 end
  from (select *, list_sum(list_transform(range(b, b + c + 1), lambda k: {_CHOOSE} * ((e0 + e1) / 2) ** k * (1 - (e0 + e1) / 2) ** (b + c - k))) as low,
    list_sum(list_transform(range(0, b + 1), lambda k: {_CHOOSE} * ((f0 + f1) / 2) ** k * (1 - (f0 + f1) / 2) ** (b + c - k))) as high from halved where i < 60)),
risk as (select g, n, b, c, (b - c) / n as difference, coalesce((abs(b - c) - 1) ** 2 / nullif(b + c, 0), 0) as statistic,
  case when b + c = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))) end as p,
  case when b + c = 0 then 0 else (2 * case when b = 0 then 0 else e0 end - 1) * (b + c) / n end as exact_low, case when b + c = 0 then 0 else (2 * case when c = 0 then 1 else f0 end - 1) * (b + c) / n end as exact_high,
  (l0 + l1) / 2 as score_low, (u0 + u1) / 2 as score_high from halved where i = 60)"""


@query(f"""
with recursive {_PAIRS},
o as (select cust % 40 as g, case when cust % 40 = 1 then 0 when cust % 40 = 2 then (s = 'F')::int when cust % 40 = 3 then (s <> 'F')::int when cust % 40 = 4 then rep % 2 else (s = 'F')::int * case when cust % 3 = 0 then 100 else 1 end end as x,
  case when cust % 40 = 1 then 0 when cust % 40 = 2 then (s = 'F')::int when cust % 40 = 3 then (s = 'F')::int when cust % 40 = 4 then 1 else (t = 'F')::int * case when cust % 3 = 0 then 100 else 1 end end as y from p),
counts as (select g, count(*) filter (where y > 0 and x = 0) as b, count(*) filter (where x > 0 and y = 0) as c, count(*)::double as n from o group by 1),
scales as (select g, case when min(v) filter (where v > 0) = max(v) then max(v)::double end as scale from (select g, x as v from o union all select g, y from o) group by 1), {_HALVED}
select g::bigint as dim, n::bigint as n, b as won, c as lost, scale, round(difference, 6) as difference, round(statistic, 6) as statistic, round(p, 6) as p, round(exact_low, 6) as exact_low, round(exact_high, 6) as exact_high, round(score_low, 6) as score_low, round(score_high, 6) as score_high from risk join scales using (g)""")
def paired_risk_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, f, t = F.col("cust") % 40, (F.col("s") == "F").cast("int"), (F.col("t") == "F").cast("int")
    unit = F.when(F.col("cust") % 3 == 0, 100).otherwise(1)
    x = F.when(g == 1, 0).when(g == 2, f).when(g == 3, 1 - f).when(g == 4, F.col("rep") % 2).otherwise(f * unit)
    y = F.when(g == 1, 0).when(g == 2, f).when(g == 3, f).when(g == 4, 1).otherwise(t * unit)
    out = P.paired_risk(_pairs(spark, sf_dir).withColumn("dim", g), "dim", x, y)
    return rounded(out, "difference", "statistic", "p", "exact_low", "exact_high", "score_low", "score_high")


def _poisson_sql(key: str, counter: str) -> str:
    """The Poisson draw of a key and a counter: the generator's three rounds, then the distribution's steps."""
    steps = [sum(math.exp(-1) / math.factorial(k) for k in range(j + 1)) for j in range(14)]
    return f"list_transform([{uniform_sql(key, counter)}], lambda u: {' + '.join(f'(u >= {s!r})::int' for s in steps)})[1]"


@query(f"""
with w as (select event_type, b, sum(w * value) / sum(w) as m from (select event_type, value, b, {_poisson_sql("event_id", "b")} as w from events, range(200) t(b)) group by all having sum(w) > 0),
m as (select event_type, list_sort(list(m)) as m from w group by 1), s as (select event_type, count(*) as n, avg(value) as mean from events group by 1)
select event_type, n, round(mean, 6) as mean, round(m[floor(0.025 * len(m))::int + 1] + 1e-9, 6) as low, round(m[ceil(0.975 * len(m))::int] + 1e-9, 6) as high from s join m using (event_type)""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    # (1 - 0.95) / 2 is 0.025 and a hair
    return rounded(_nudged(P.poisson_bootstrap(table(spark, sf_dir, "events"), "event_type", F.col("event_id"), F.col("value")), "low", "high", by=1e-9), "mean", "low", "high")


_ARM = "event_id % 2 = 1"


@query(f"""
with r as (select user_id % 60 as g, event_id as k, {_ARM} as arm, case when user_id % 60 = 1 then 5 when user_id % 60 = 2 then value + 20 * ({_ARM})::int when user_id % 60 = 3 then value - 20 * ({_ARM})::int when user_id % 60 = 4 and {_ARM} then null else value end as v from events),
o as (select * from r where v is not null),
d as (select g, b, sum(w * v) filter (where arm) / nullif(sum(w) filter (where arm), 0) - sum(w * v) filter (where not arm) / nullif(sum(w) filter (where not arm), 0) as d from (select *, {_poisson_sql("k", "b")} as w from o, range(200) t(b)) group by all),
m as (select g, list_sort(list(d) filter (where d is not null)) as m from d group by 1), s as (select g, count(*) as n, avg(v) filter (where not arm) as mean_a, avg(v) filter (where arm) as mean_b from o group by 1),
e as (select *, mean_b - mean_a as delta, round(m[floor(0.025 * len(m))::int + 1], 9) as low, round(m[greatest(1, floor(0.975 * len(m))::int)], 9) as high from s join m using (g)),
x as (select *, n < 6 or delta is null or low is null as o from e)
select g::bigint as dim, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(delta, 6) as delta, case when o then '-inf'::double else round(low + 1e-9, 6) end as low, case when o then 'inf'::double else round(high + 1e-9, 6) end as high,
  case when o or low = high then 'INCONCLUSIVE' when low > 0 then 'ADVANCE' when high < 0 then 'REVERT' when delta >= 0 then 'KEEP' else 'INCONCLUSIVE' end as verdict from x""")
def arm_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, arm, v = F.col("user_id") % 60, F.col("event_id") % 2 == 1, F.col("value")
    up = 20 * arm.cast("int")
    value = F.when(g == 1, 5.0).when(g == 2, v + up).when(g == 3, v - up).when((g == 4) & arm, None).otherwise(v)
    rows = table(spark, sf_dir, "events").withColumn("dim", g)
    # constant arms have equal bounds only up to the last bits of their sums
    out = P.arm_bootstrap(rows, "dim", F.col("event_id"), arm, F.round(value, 6))
    return rounded(_nudged(out, "low", "high", by=1e-9), "mean_a", "mean_b", "delta", "low", "high")


#: Decisions over groups of pairs: statuses and prices, many pairs and few, ties and shifts; o holds (g, key, x, y).
_DECISIONS = f"""
o as (select 's' || cust % 12 as g, key, (s = 'F')::int * 100 as x, case when cust % 12 = 1 then (s = 'F')::int * 100 when cust % 12 = 2 then 100 else (t = 'F')::int * 100 end as y from p
  union all select 'm' || cust % 12, key, x, case cust % 12 when 1 then x when 2 then y + 90000 when 3 then y + 9000 else y end from p
  union all select 'f' || cust % 90, key, x, case when cust % 90 < 40 then x + 500 + rep else y end from p where cust < 360),
counts as (select g, count(*) filter (where y > 0 and x = 0) as b, count(*) filter (where x > 0 and y = 0) as c, count(*)::double as n from o where g like 's%' group by 1), {_HALVED},
w as (select g, b, sum(w * (y - x)) / sum(w) as m from (select g, x, y, b, {_poisson_sql("key", "b")} as w from o, range(200) t(b)) group by all having sum(w) > 0),
m as (select g, list_sort(list(m)) as m from w group by 1),
s as (select g, count(*) as n, avg(y - x) as mean, avg((y = x)::int) as tied, count(*) filter (where y - x > 0) as up, count(*) filter (where y <> x) as of from o group by 1),
j as (select s.*, case when n = 1 then mean else m[floor(0.025 * len(m))::int + 1] end as bl, case when n = 1 then mean else m[ceil(0.975 * len(m))::int] end as bh, case when risk.g is not null then 100.0::double end as scale, difference, risk.p as mp, score_low, score_high,
  case when up = 0 then 1 else least(1, list_sum(list_transform(range(up, of + 1), lambda k: exp(lgamma(of + 1) - lgamma(k + 1) - lgamma(of - k + 1) - of * ln(2))))) end as sp from s join m using (g) left join (select * exclude n from risk) risk using (g)),
k as (select *, case when scale is null then mean else difference * 100 end as delta, case when scale is null then bl else score_low * 100 end as low, case when scale is null then bh else score_high * 100 end as high, case when scale is not null then mp when n < 20 then sp end as pv from j),
q as (select *, n >= 6 as enough, low = high as bare from k),
decided as (select *, case when scale is not null then low > 0 when n < 20 then enough and not bare and delta > 0 and pv <= 0.025 else enough and not bare and low > 0 end as clears, scale is not null and not coalesce(pv < 0.05, false) as vetoed from q)"""


@query(f"""
with recursive {_PAIRS}, {_DECISIONS}
select g, n, scale, round(tied, 6) as tied, case when scale is null then 'mean_bootstrap' else 'paired_risk_difference' end as statistic, case when scale is not null then 'score-interval' when n < 20 then 'exact-sign' else 'bootstrap-ci' end as method,
  round(delta + 1e-7, 4) as delta, round(low + 1e-7, 4) as low, round(high + 1e-7, 4) as high, round(pv, 6) as p, enough as sufficient, bare as indeterminate, vetoed, clears, enough and not bare and clears and not vetoed as promote from decided""")
def promotion_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.decide(_decided(spark, sf_dir), "g", F.col("key"), F.col("x"), F.col("y"))
    return rounded(rounded(_nudged(out, "delta", "low", "high"), "tied", "p"), "delta", "low", "high", places=4)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, cust = _pairs(spark, sf_dir), F.col("cust")
    name = lambda kind, of: F.concat(F.lit(kind), (cust % of).cast("string")).alias("g")
    f, t, x, y = (F.col("s") == "F").cast("double") * 100, (F.col("t") == "F").cast("double") * 100, F.col("x"), F.col("y")
    k = cust % 12
    two = p.select(name("s", 12), "key", f.alias("x"), F.when(k == 1, f).when(k == 2, 100.0).otherwise(t).alias("y"))
    many = p.select(name("m", 12), "key", "x", F.when(k == 1, x).when(k == 2, y + 90000).when(k == 3, y + 9000).otherwise(y).alias("y"))
    few = p.where("cust < 360").select(name("f", 90), "key", "x", F.when(cust % 90 < 40, x + 500 + F.col("rep")).otherwise(y).alias("y"))
    return two.unionByName(many).unionByName(few)


@query(f"""
with n as (select *, row_number() over (partition by o_orderpriority, o_custkey order by o_orderdate, o_orderkey) as rep from orders where o_orderpriority in ('1-URGENT', '5-LOW')),
a as (select * from n where o_orderpriority = '1-URGENT'), b as (select * from n where o_orderpriority = '5-LOW'),
p as (select coalesce(a.o_custkey, b.o_custkey) as cust, coalesce(a.rep, b.rep) as rep, a.o_totalprice as x0, b.o_totalprice as y0, a.o_orderkey is not null as ia, b.o_orderkey is not null as ib from a full join b on a.o_custkey = b.o_custkey and a.rep = b.rep),
q as (select cust % 24 as g, case when cust // 24 % 2 = 0 then 'search' else 'holdout' end as split, cust * 1000 + rep as key, ia, ib, x0 as x, case when cust % 24 = 7 and cust // 24 % 2 = 1 then null when cust % 24 % 4 = 0 then x0 + 100 * (1 + cust // 24 % 2) + rep when cust % 24 % 4 = 1 then x0 + case when cust // 24 % 2 = 0 then 400000 else 700 + rep end else y0 end as y,
  case when cust % 24 = 4 and rep = 1 then null when cust % 24 = 8 then 9 else 2 + rep % 3 end::double as cost from p),
r as (select * from q where (ia and ib) or g >= 20),
m as (select g, count(*) filter (where split = 'holdout' and x is not null and y is not null) as n, avg(y) filter (where split = 'search' and x is not null and y is not null) as search, avg(y) filter (where split = 'holdout' and x is not null and y is not null) as holdout,
  avg(x) filter (where split = 'search' and x is not null and y is not null) as bsearch, avg(x) filter (where split = 'holdout' and x is not null and y is not null) as bholdout,
  count(*) filter (where split = 'search' and x is not null and y is not null) / count(*) filter (where split = 'search') as cs, count(*) filter (where split = 'holdout' and x is not null and y is not null) / count(*) filter (where split = 'holdout') as ch,
  least(count(x) filter (where split = 'search'), count(y) filter (where split = 'search'), count(x) filter (where split = 'holdout'), count(y) filter (where split = 'holdout')) as least,
  case when count(*) filter (where x is not null and y is not null) = count(cost) filter (where x is not null and y is not null) then median(cost) filter (where x is not null and y is not null) end as cost from r group by 1),
o as (select g, key, x, y from r where split = 'holdout' and x is not null and y is not null),
w as (select g, b, sum(w * (y - x)) / sum(w) as m from (select g, x, y, b, {_poisson_sql("key", "b")} as w from o, range(200) t(b)) group by all having sum(w) > 0),
l as (select g, list_sort(list(m)) as m from w group by 1),
s as (select g, avg(y - x) as delta, count(*) filter (where y > x) as up, count(*) filter (where y <> x) as of from o group by 1),
d as (select m.*, delta, case when m.n = 1 then delta else l.m[floor(0.025 * len(l.m))::int + 1] end as low, case when m.n = 1 then delta else l.m[ceil(0.975 * len(l.m))::int] end as high, list_sum(list_transform(range(up, of + 1), lambda k: exp(lgamma(of + 1) - lgamma(k + 1) - lgamma(of - k + 1) - of * ln(2)))) as sp from m left join l using (g) left join s using (g)),
c as (select *, case when least = 0 then 'missing_split_scores' when cs < 1 or ch < 1 then 'incomplete_coverage' when n < 6 then 'few_runs' when low = high then 'indeterminate_delta' when not case when n < 20 then delta > 0 and sp <= 0.025 else low > 0 end then 'negative_delta'
  when search - holdout > bsearch - bholdout + 5000 then 'overfit_gap' when cost is null then 'missing_cost' when cost > 5 then 'cost_ceiling' end as code from d)
select g::bigint as dim, n, round(search + 1e-7, 4) as search, round(holdout + 1e-7, 4) as holdout, round(search - holdout + 1e-7, 4) as gap, round(bsearch - bholdout + 1e-7, 4) as baseline_gap, round(cs, 6) as coverage_search, round(ch, 6) as coverage_holdout, cost, round(delta + 1e-7, 4) as delta, round(low + 1e-7, 4) as low, round(high + 1e-7, 4) as high, code is null as promote, code from c""")
def held_out_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = J.pair_arms(table(spark, sf_dir, "orders"), "o_orderpriority", ("1-URGENT", "5-LOW"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    cust, rep = F.col("o_custkey"), F.col("rep")
    g, late, x0 = cust % 24, F.floor(cust / 24) % 2 == 1, F.col("before")
    y = (
        F.when((g == 7) & late, None).when(g % 4 == 0, x0 + F.when(late, 200).otherwise(100) + rep)
        .when(g % 4 == 1, x0 + F.when(late, 700 + rep).otherwise(400000)).otherwise(F.col("after"))
    )
    cost = F.when((g == 4) & (rep == 1), None).when(g == 8, 9.0).otherwise(2.0 + rep % 3)
    ia, ib = F.col("side") != "after", F.col("side") != "before"
    rows = pairs.select(g.alias("dim"), F.when(late, "holdout").otherwise("search").alias("split"), (cust * 1000 + rep).alias("key"), x0.alias("x"), y.alias("y"), ia.alias("ia"), ib.alias("ib"), cost.alias("cost")).where("(ia and ib) or dim >= 20")
    out = P.held_out_gate(rows, "dim", "split", F.col("key"), F.col("x"), F.col("y"), F.col("ia"), F.col("ib"), F.col("cost"), F.col("cost"), overfit=5000.0, ceiling=5.0)
    out = _nudged(out.drop("baseline_cost"), "search", "holdout", "gap", "baseline_gap", "delta", "low", "high")
    out = rounded(out, "coverage_search", "coverage_holdout")
    return rounded(out, "search", "holdout", "gap", "baseline_gap", "delta", "low", "high", places=4)


_SHARES = "[0.2, 0.4, 0.6, 0.8]"


@query(f"""
with r as (select l_returnflag = 'R' as sim, l_quantity::double as quantity, case when l_returnflag = 'R' and l_linenumber > 4 then null else round(l_extendedprice / 100)::double end as price, case when l_orderkey % 500 = 3 then l_tax end as tax, l_shipmode as mode, case when l_returnflag = 'A' then l_linestatus else l_returnflag end as flag from (select *, (l_orderkey * 7 % 11)::varchar as l_shipmode from lineitem)),
u as (unpivot (select row_number() over () as i, sim, quantity, price, tax from r) on quantity, price, tax into name feature value x),
x as (select sim, f as feature, case f when 'quantity' then quantity when 'price' then price else tax end as x, null as name from r, (values ('quantity'), ('price'), ('tax')) t(f) union all select sim, 'mode', null, mode from r union all select sim, 'flag', null, flag from r),
e as (select feature, list_distinct(quantile_cont(x, {_SHARES})) as e from x where x is not null group by 1), es as (select feature, list_sort(e) as e from e),
c as (select feature, sim, coalesce(case when x is not null then '[' || case when k = 0 then '-inf' else regexp_replace(e[k]::varchar, '\\.0$', '') end || ',' || case when k = len(e) then '+inf' else regexp_replace(e[k + 1]::varchar, '\\.0$', '') end || ')' end, name, '(absent)') as value from (select x.*, e, len(list_filter(e, lambda v: x.x >= v)) as k from x left join es using (feature))),
n as (select feature, value, count(*) filter (where sim) as s, count(*) filter (where not sim) as p from c group by 1, 2),
q as (select *, s / sum(s) over (partition by feature) as ps, p / sum(p) over (partition by feature) as pp from n)
select feature, sum(s) filter (where value <> '(absent)')::bigint as n_sim, sum(p) filter (where value <> '(absent)')::bigint as n_prod, case when least(sum(s) filter (where value <> '(absent)'), sum(p) filter (where value <> '(absent)')) >= 20 then round(sum(case when ps > 0 then ps * log2(2 * ps / (ps + pp)) / 2 else 0 end + case when pp > 0 then pp * log2(2 * pp / (ps + pp)) / 2 else 0 end), 6) end as divergence,
  list(value order by -round(abs(ps - pp), 12), value)[1:5] as shifts, list(round(ps, 6) order by -round(abs(ps - pp), 12), value)[1:5] as p_sim, list(round(pp, 6) order by -round(abs(ps - pp), 12), value)[1:5] as p_prod from q group by 1""")
def sim_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _fidelity(spark, sf_dir)
    each = lambda c: F.transform("top", lambda t: F.round(t[c], 6))
    return rounded(out.select("feature", "n_sim", "n_prod", "divergence", F.col("top.value").alias("shifts"), each("p_sim").alias("p_sim"), each("p_prod").alias("p_prod")), "divergence")


def _fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        (flag == "R").alias("sim"), F.col("l_quantity").alias("quantity"), F.when(~((flag == "R") & (F.col("l_linenumber") > 4)), F.round(F.col("l_extendedprice") / 100)).alias("price"),
        F.when(F.col("l_orderkey") % 500 == 3, F.col("l_tax")).alias("tax"), (F.col("l_orderkey") * 7 % 11).cast("string").alias("mode"), F.when(flag == "A", F.col("l_linestatus")).otherwise(flag).alias("flag"),
    )
    return Q.fidelity(rows, F.col("sim"), ["quantity", "price", "tax"], ["mode", "flag"])


@query("""
select round(avg((o_totalprice >= 200000)::int) filter (where o_orderpriority = '1-URGENT'), 6) as pass_sim, round(avg((o_totalprice >= 200000)::int) filter (where o_orderpriority <> '1-URGENT'), 6) as pass_prod,
  round(avg((o_totalprice >= 200000)::int) filter (where o_orderpriority = '1-URGENT') - avg((o_totalprice >= 200000)::int) filter (where o_orderpriority <> '1-URGENT'), 6) as gap, avg((o_totalprice >= 200000)::int) filter (where o_orderpriority = '1-URGENT') - avg((o_totalprice >= 200000)::int) filter (where o_orderpriority <> '1-URGENT') > 0.1 as inflated from orders""")
def easy_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.easy_mode(table(spark, sf_dir, "orders"), F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") / 400000), "pass_sim", "pass_prod", "gap")
