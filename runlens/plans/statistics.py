"""Statistical queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import moments
from ..functions.scores import pass_at_k as pass_at_k_column
from ..operators import joins as J
from ..operators import statistics as S
from ..session import table
from .aggregates import rounded
from .registry import normal_p_sql, query, t_p_sql


@query("""
with x as (select l_orderkey, case when l_orderkey % 5 = 0 then 1 else l_quantity end as a, case when l_orderkey % 7 = 0 then 2 else l_discount end as b from lineitem),
g as (select l_orderkey, count(*) as n, var_pop(a) as va, var_pop(b) as vb, avg(a * b) - avg(a) * avg(b) as ab from x group by 1)
select l_orderkey, n, round(case when n < 2 then 'nan'::double when va = 0 and vb = 0 then 1 when va = 0 or vb = 0 then 0 else ab / sqrt(va * vb) end, 5) as r from g""")
def pearson_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    a, b = F.when(key % 5 == 0, 1.0).otherwise(F.col("l_quantity")), F.when(key % 7 == 0, 2.0).otherwise(F.col("l_discount"))
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), moments.pearson(a, b).alias("r")), "r", places=5)


@query("""
with r as (select l_suppkey, rank() over a + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2.0 as ra, rank() over b + (count(*) over (partition by l_suppkey, l_discount) - 1) / 2.0 as rb
 from lineitem window a as (partition by l_suppkey order by l_quantity), b as (partition by l_suppkey order by l_discount))
select l_suppkey, count(*) as n, round(corr(ra, rb), 6) as rho from r group by 1""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.spearman(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_discount"), "rho")


_ARMS = "case when l_returnflag = 'A' then l_quantity end as a, case when l_returnflag = 'R' then l_quantity end as b"


@query(f"""
with x as (select l_suppkey, {_ARMS} from lineitem), g as (select l_suppkey, count(a) as na, count(b) as nb, avg(a) as ma, avg(b) as mb, var_samp(a) as va, var_samp(b) as vb from x group by 1)
select l_suppkey, round((mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) as d from g""")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.when(F.col("l_returnflag") == f, F.col("l_quantity")) for f in "AR")
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(moments.cohens_d(a, b).alias("d")), "d")


@query("""
with a as (select l_suppkey, l_quantity as q from lineitem where l_returnflag = 'A'), b as (select l_suppkey, l_quantity as q from lineitem where l_returnflag = 'R'),
p as (select l_suppkey, avg(sign(b.q - a.q)) as delta from a join b using (l_suppkey) group by 1), n as (select l_suppkey, count(*) filter (where l_returnflag = 'A') as n_a, count(*) filter (where l_returnflag = 'R') as n_b from lineitem group by 1)
select l_suppkey, n_a, n_b, round(delta, 6) as delta, case when abs(delta) < 0.147 then 'negligible' when abs(delta) < 0.33 then 'small' when abs(delta) < 0.474 then 'medium' else 'large' end as band from p join n using (l_suppkey)""")
def cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.cliffs_delta(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", ("A", "R"), "l_quantity"), "delta")


@query("""
with w as (select event_type, least(value / 40, 2) as w, least(1, greatest(0, value / 100)) as r from events)
select event_type, count(*) as n, round(sum(w * r) / count(*), 6) as ips, round(sqrt(var_samp(w * r) / count(*)), 6) as ips_se, round(sum(w * r) / sum(w), 6) as snips, round(sum(w) ** 2 / sum(w * w), 4) as ess, max(w) as max_weight from w group by 1""")
def off_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = moments.off_policy(F.col("value") / 100, F.col("value") / 40, cap=2.0)
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(*(c.alias(n) for n, c in parts.items()))
    return rounded(rounded(out, "ips", "ips_se", "snips"), "ess", places=4)


_RATINGS = "select 'all' as dim, doc_id, rater, x from (select doc_id, 'quality' as rater, quality as x from labels union all select doc_id, 'toxic', toxic from labels)"


@query(f"""
with r as ({_RATINGS}), s as (select count(distinct doc_id)::double as n, 2.0::double as k, sum(x)::double as t, sum(x * x)::double as q from r),
a as (select sum(s * s)::double as rq from (select sum(x) as s from r group by doc_id)), b as (select sum(s * s)::double as cq from (select sum(x) as s from r group by rater)),
m as (select n, k, (rq / k - t * t / (n * k)) as r, (cq / n - t * t / (n * k)) as c, q - t * t / (n * k) as tot from s, a, b),
v as (select n, k, r / (n - 1) as msr, c / (k - 1) as msc, (tot - r - c) / ((n - 1) * (k - 1)) as mse from m)
select 'all' as dim, n::bigint as items, k::bigint as raters, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) as icc from v""")
def icc21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.icc21(_ratings(spark, sf_dir), "dim", "doc_id", "rater", F.col("x")), "icc")


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "rater", "x").withColumn("dim", F.lit("all"))


@query("""
select 'all' as dim, count(*) as n, round(1 - avg((quality - toxic) ** 2) / (var_pop(quality) + var_pop(toxic) + (avg(quality) - avg(toxic)) ** 2), 6) as kappa from labels""")
def weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("dim", F.lit("all"))
    return rounded(S.weighted_kappa(rows, "dim", F.col("quality"), F.col("toxic")), "kappa")


@query(f"""
with r as ({_RATINGS}), i as (select doc_id, sum((a.x - b.x) ** 2)::double as d from r a join r b using (doc_id) where a.rater <> b.rater group by 1), n as (select count(*)::double as n, sum(x)::double as s, sum(x * x)::double as q from r)
select 'all' as dim, n::bigint as n, round(1 - (select sum(d) from i) / n / (2 * (n * q - s * s) / (n * (n - 1))), 6) as alpha from n""")
def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.krippendorff(_ratings(spark, sf_dir), "dim", "doc_id", F.col("x")), "alpha")


@query("""
with c as (select user_id, event_type as c, count(*) filter (where ts < timestamp '2024-01-16') as a, count(*) filter (where ts >= timestamp '2024-01-16') as b from events group by all),
p as (select user_id, a / sum(a) over w as p, b / sum(b) over w as q from c window w as (partition by user_id))
select user_id, round(greatest(0, least(1, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)), 6) as jsd from p group by 1""")
def js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("ts") < F.lit("2024-01-16"), "a").otherwise("b")
    return rounded(S.js_divergence(table(spark, sf_dir, "events"), "user_id", side, ("a", "b"), F.col("event_type")), "jsd")


@query("""
with g as (select user_id, count(*)::int as n, count(*) filter (where event_type = 'purchase')::int as c from events group by 1)
select user_id, n, c, round(case when c = 0 then 0 when n - c < 5 then 1 else 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 5.0::double / i)) end, 6) as pass_at_5 from g""")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.col("event_type") == "purchase").cast("int").alias("c"))
    return rounded(by.withColumn("pass_at_5", pass_at_k_column(F.col("n"), F.col("c"), 5)), "pass_at_5")


@query("""
with n as (select *, row_number() over (partition by o_orderpriority, o_custkey order by o_orderdate, o_orderkey) as rep from orders),
p as (select a.o_orderstatus = 'F' as x, b.o_orderstatus = 'F' as y from n a join n b using (o_custkey, rep) where a.o_orderpriority = '1-URGENT' and b.o_orderpriority = '5-LOW'),
c as (select count(*)::double as n, count(*) filter (where x and not y)::double as b, count(*) filter (where not x and y)::double as c from p)
select 'all' as dim, n::bigint as n, b::bigint as b, c::bigint as c, round((c - b) / n, 6) as difference, round(greatest(-1, (c - b) / n - 1.959963984540054 * sqrt((b + c - (c - b) ** 2 / n) / n ** 2)), 6) as low,
 round(least(1, (c - b) / n + 1.959963984540054 * sqrt((b + c - (c - b) ** 2 / n) / n ** 2)), 6) as high from c""")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_mcnemar(spark, sf_dir).drop("p"), "difference", "low", "high")


def _mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders")
    pairs = J.pair_arms(runs, "o_orderpriority", ("1-URGENT", "5-LOW"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus").where("side = 'both'")
    return S.mcnemar(pairs.withColumn("dim", F.lit("all")), "dim", F.col("before") == "F", F.col("after") == "F")


@query("""
with n as (select *, row_number() over (partition by o_orderpriority, o_custkey order by o_orderdate, o_orderkey) as rep from orders),
p as (select a.o_custkey % 20 as dim, a.o_orderstatus = 'F' as x, b.o_orderstatus = 'F' as y from n a join n b using (o_custkey, rep) where a.o_orderpriority = '1-URGENT' and b.o_orderpriority = '5-LOW'),
c as (select dim, count(*) filter (where x and not y) as b, count(*) filter (where not x and y) as c from p group by 1)
select dim, b, c, round(case when b + c = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) end, 6) as p from c""")
def mcnemar_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders")
    pairs = J.pair_arms(runs, "o_orderpriority", ("1-URGENT", "5-LOW"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus").where("side = 'both'")
    return rounded(S.mcnemar(pairs.withColumn("dim", F.col("o_custkey") % 20), "dim", F.col("before") == "F", F.col("after") == "F").select("dim", "b", "c", "p"), "p")


@query(f"""
with x as (select l_suppkey, {_ARMS} from lineitem), g as (select l_suppkey, avg(b) - avg(a) as gap, var_samp(a) / count(a) as va, var_samp(b) / count(b) as vb, count(a) as na, count(b) as nb, sqrt(((count(a) - 1) * var_samp(a) + (count(b) - 1) * var_samp(b)) / (count(a) + count(b) - 2)) as sd from x group by 1),
t as (select *, gap / sqrt(va + vb) as t, (va + vb) ** 2 / (va ** 2 / (na - 1) + vb ** 2 / (nb - 1)) as df from g)
select l_suppkey, round(t, 6) as t, round(df, 4) as df, round(gap / sd, 6) as d, round({t_p_sql("t", "df")}, 5) as p from t""")
def welch_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.when(F.col("l_returnflag") == f, F.col("l_quantity")) for f in "AR")
    return rounded(rounded(rounded(S.welch_test(table(spark, sf_dir, "lineitem"), "l_suppkey", a, b), "t", "d"), "df", places=4), "p", places=5)


@query(f"""
with x as (select l_suppkey, {_ARMS} from lineitem), g as (select l_suppkey, avg(b) - avg(a) as gap, var_samp(a) / count(a) as va, var_samp(b) / count(b) as vb, count(a) as na, count(b) as nb from x group by 1)
select l_suppkey, round(gap / sqrt(va + vb), 6) as t, round((va + vb) ** 2 / (va ** 2 / (na - 1) + vb ** 2 / (nb - 1)), 4) as df from g""")
def welch_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(welch_test(spark, sf_dir).select("l_suppkey", "t", "df"), "t"), "df", places=4)


@query(f"""
with c as (select l_suppkey, l_quantity, count(*) filter (where l_returnflag = 'A') as a, count(*) filter (where l_returnflag = 'R') as b from lineitem where l_returnflag in ('A', 'R') group by 1, 2),
r as (select *, coalesce(sum(a) over (partition by l_suppkey order by l_quantity rows between unbounded preceding and 1 preceding), 0) as below from c),
g as (select l_suppkey, sum(a)::bigint as n_a, sum(b)::bigint as n_b, sum(b * (below + a / 2)) as u, sum((a + b) ** 3 - (a + b))::double as ties from r group by 1),
z as (select *, sign(u - n_a * n_b / 2) * greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(n_a * n_b / 12 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1)))) as z from g)
select l_suppkey, n_a, n_b, u::double as u, round(z, 6) as z, round({normal_p_sql("z")}, 5) as p from z""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every supplier has more than the exact test's cells
    return rounded(rounded(S.mann_whitney(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", ("A", "R"), "l_quantity"), "z"), "p", places=5)


@query()
def bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bradley_terry(J.pairwise_wins(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", F.col("o_totalprice"), 1000.0))


@query("""
with recursive x as (select user_id, least(value / 100, 1) as x, row_number() over (partition by user_id order by ts, event_id) as i from events),
e as (select distinct user_id, 0::bigint as n, 1.0::double as w, 0.0::double as t, 0.0::double as q, null::bigint as d from events
  union all select user_id, n, w, t, q, coalesce(d, case when w >= 20 then n end) from (
    select e.user_id, n + 1 as n, w * (1 + greatest(0, least(0.5, ((t + 0.5) / (n + 1) - 0.5) / ((q + 0.25) / (n + 1) + ((t + 0.5) / (n + 1) - 0.5) ** 2))) * (x - 0.5)) as w, t + x as t, q + (x - (t + x + 0.5) / (n + 2)) ** 2 as q, d from e join x on x.user_id = e.user_id and x.i = e.n + 1))
select user_id, n, round(w, 6) as wealth, d as decided_at from e qualify row_number() over (partition by user_id order by n desc) = 1""")
def eprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.eprocess(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.least(F.col("value") / 100, F.lit(1.0))), "wealth")


@query("""
with recursive x as (select user_id, (least(1, greatest(-1, case user_id % 3 when 0 then value / 50 - 1.2 when 1 then value / 60 - 0.5 else (value - 50) / 100 end))::double + 1) / 2 as x, row_number() over (partition by user_id order by ts, event_id) as i from events where value is not null),
e as (select distinct user_id, 0::bigint as n, 1.0::double as w, 0.0::double as t, 0.0::double as q, 'continue' as d from x
  union all select user_id, n, w, t, q, case when n >= 5 and w >= 20 then 'promote' when n >= 40 then 'undecided-at-maxN' else 'continue' end from (
    select e.user_id, n + 1 as n, w * (1 + greatest(0, least(0.5, ((t + 0.5) / (n + 1) - 0.525) / ((q + 0.25) / (n + 1) + ((t + 0.5) / (n + 1) - 0.525) ** 2))) * (x - 0.525)) as w, t + x as t, q + (x - (t + x + 0.5) / (n + 2)) ** 2 as q from e join x on x.user_id = e.user_id and x.i = e.n + 1 where d = 'continue'))
select user_id, n, round(w, 6) as wealth, d as decision from e qualify row_number() over (partition by user_id order by n desc) = 1""")
def sequential_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, kind = F.col("value"), F.col("user_id") % 3
    delta = F.when(kind == 0, v / 50 - 1.2).when(kind == 1, v / 60 - 0.5).otherwise((v - 50) / 100)
    out = S.sequential_gate(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.least(F.greatest(delta, F.lit(-1.0)), F.lit(1.0)), 40, min_effect=0.05)
    return rounded(out, "wealth")


@query("""
with recursive o as (select o_custkey, o_orderkey, left(o_orderpriority, 1)::int as b, o_totalprice as y, lag(left(o_orderpriority, 1)::int) over w as a, lag(o_totalprice) over w as x from orders window w as (partition by o_custkey order by o_orderkey)),
m as (select o_custkey, a, b, case when x > y then 1.0 when x = y then 0.5 else 0.0 end::double as s, row_number() over (partition by o_custkey order by o_orderkey) as i from o where a <> b),
r as (select distinct o_custkey, 0::bigint as n, [1000.0, 1000, 1000, 1000, 1000]::double[] as v from m
  union all select o_custkey, n, list_transform([1, 2, 3, 4, 5], lambda k: case when k = a then v[k] + d when k = b then v[k] - d else v[k] end) from (
    select r.o_custkey, n + 1 as n, v, a, b, 32 * (s - 1 / (1 + 10 ** ((v[b] - v[a]) / 400))) as d from r join m on m.o_custkey = r.o_custkey and m.i = r.n + 1)),
z as (select o_custkey, v from r qualify row_number() over (partition by o_custkey order by n desc) = 1)
select o_custkey, k::varchar as player, round(v[k], 4) as rating from z, (values (1), (2), (3), (4), (5)) p(k) where exists (select 1 from m where m.o_custkey = z.o_custkey and (m.a = k or m.b = k))""")
def elo_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w, rank = W.partitionBy("o_custkey").orderBy("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    turns = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", rank.alias("b"), F.col("o_totalprice").alias("y"), F.lag(rank).over(w).alias("a"), F.lag("o_totalprice").over(w).alias("x"))
    result = F.when(F.col("x") > F.col("y"), 1.0).when(F.col("x") == F.col("y"), 0.5).otherwise(0.0)
    return rounded(S.elo(turns.where("a <> b"), "o_custkey", ["o_orderkey"], "a", "b", result), "rating", places=4)
