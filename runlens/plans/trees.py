"""Queries over trees of spans and of supervised runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees as T
from ..session import table
from .registry import query


@query("""
with recursive n as (select conv_id, turn, case when turn = 0 then null else turn // 2 end as p from conversations),
t as (select conv_id, turn, 0 as depth, lpad(turn::varchar, 10, '0') as path from n where p is null
  union all select n.conv_id, n.turn, t.depth + 1, t.path || '/' || lpad(n.turn::varchar, 10, '0') from t join n on n.conv_id = t.conv_id and n.p = t.turn and n.turn <> t.turn)
select conv_id, turn, depth, (row_number() over (partition by conv_id order by path) - 1)::int as index from t""")
def trajectory_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") > 0, F.floor(F.col("turn") / 2)).cast("long")
    # turn 1's parent is 0: a binary heap of turns, with 0 as its root
    return T.trajectory(turns.select("conv_id", "turn", parent.alias("parent")), "conv_id", "turn", "parent", ["turn"])


@query("""
with recursive n as (select conv_id, turn as s, case when turn > 0 then turn - 1 end as p, length(text) % 3 = 0 as bad from conversations),
up as (select conv_id, p as a from n where bad union select up.conv_id, n.p from up join n on n.conv_id = up.conv_id and n.s = up.a where up.a is not null)
select n.conv_id, n.s as turn, up.a is not null as propagated from n left join up on up.conv_id = n.conv_id and up.a = n.s where bad""")
def propagated_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("parent", F.when(F.col("turn") > 0, F.col("turn") - 1))
    return T.propagated_errors(turns, "conv_id", "turn", "parent", F.length("text") % 3 == 0)


@query("""
with recursive n as (select conv_id, turn as s, case when turn = 0 then null when turn % 5 = 4 then turn + 100 else turn // 2 end as p, length(text) % 3 > 0 as bad, turn = 0 as top,
  case length(text) % 7 when 0 then 'GUARDRAIL' when 1 then 'EVALUATOR' when 2 then 'SPAN' else 'TOOL' end as role from conversations),
up as (select conv_id, p as a from n where bad union select up.conv_id, n.p from up join n on n.conv_id = up.conv_id and n.s = up.a where up.a is not null),
k as (select n.conv_id, case when role = 'GUARDRAIL' then 'g' when role = 'EVALUATOR' then 'e' when top then 'p' when up.a is not null then 'u' when role = 'TOOL' then 'x' else 'z' end as k from n left join up on up.conv_id = n.conv_id and up.a = n.s where bad)
select conv_id, count(*) as total, count(*) filter (where k = 'g') as guardrail, count(*) filter (where k = 'e') as evaluation, count(*) filter (where k = 'p') as process, count(*) filter (where k = 'u') as propagated, count(*) filter (where k = 'x') as execution, count(*) filter (where k = 'z') as unclassified from k group by 1""")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, size = F.col("turn"), F.length("text")
    parent = F.when(turn % 5 == 4, turn + 100).when(turn > 0, F.floor(turn / 2)).cast("long")
    role = F.when(size % 7 == 0, "GUARDRAIL").when(size % 7 == 1, "EVALUATOR").when(size % 7 == 2, "SPAN").otherwise("TOOL")
    turns = table(spark, sf_dir, "conversations").withColumns({"parent": parent, "kind": role})
    return T.error_summary(turns, "conv_id", "turn", "parent", "kind", size % 3 > 0, turn == 0)


_JOURNAL = """
j as (select user_id as run, event_id as ord, case event_type when 'view' then 'spawned' when 'click' then 'settled' when 'purchase' then 'cancelled' when 'error' then 'metered' else 'steered' end as kind,
  'n' || (event_id % 9) as id, case when event_id % 4 = 0 then '' else 'n' || (event_id // 9 % 10) end as parent, case when event_id % 17 = 0 then null else 'l' || (event_id % 3) end as label,
  case event_id % 5 when 0 then 'supervisor' when 1 then 'worker' when 2 then 'boss' end as role, epoch_us(ts) // 1000 as moment, case when value > 50 then 'done' else 'down' end as status, floor(value)::bigint as input, user_id % 7 as output, round(value / 100, 2) as usd from events),
"""


@query(f"""
with {_JOURNAL}
s as (select *, nullif(parent, '') as p from j where kind = 'spawned' and label is not null and coalesce(role, 'worker') <> 'boss'),
f as (select run, id, count(*) as copies, first(p order by ord) as parent, first(label order by ord) as label, first(role order by ord) as role, first(moment order by ord) as spawned_at from s group by 1, 2),
r as (select run, arg_min(id, ord) as root_id from s where p is null group by 1),
c as (select run, id, first(moment order by ord) as closed_at, first(kind order by ord) as close, first(case when kind = 'cancelled' then kind else status end order by ord) as status, first(input order by ord) as input, first(output order by ord) as output, first(usd order by ord) as usd from j where kind in ('settled', 'cancelled') group by 1, 2),
m as (select run, id, sum(input)::bigint as input, sum(output)::bigint as output, round(sum(usd), 4) as usd from j where kind = 'metered' group by 1, 2)
select f.run, f.id, parent, label, role, coalesce(f.id = root_id, false) as root, copies, spawned_at, closed_at, close, status, case when f.id = root_id then m.input else c.input end as input, case when f.id = root_id then m.output else c.output end as output, case when f.id = root_id then m.usd else c.usd end as usd
from f left join r using (run) left join c on c.run = f.run and c.id = f.id left join m on m.run = f.run and m.id = f.id""")
def supervised_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.supervised(_journal(spark, sf_dir)).withColumn("usd", F.round("usd", 4))


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v, kind = F.col("event_id"), F.col("value"), F.col("event_type")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), i.alias("ord"), F.when(kind == "view", "spawned").when(kind == "click", "settled").when(kind == "purchase", "cancelled").when(kind == "error", "metered").otherwise("steered").alias("kind"),
        name(i % 9).alias("id"), F.when(i % 4 == 0, "").otherwise(name(F.floor(i / 9) % 10)).alias("parent"), F.when(i % 17 > 0, F.concat(F.lit("l"), i % 3)).alias("label"),
        F.when(i % 5 == 0, "supervisor").when(i % 5 == 1, "worker").when(i % 5 == 2, "boss").alias("role"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
        F.when(v > 50, "done").otherwise("down").alias("status"), F.floor(v).cast("long").alias("input"), (F.col("user_id") % 7).alias("output"), F.round(v / 100, 2).alias("usd"),
    )


@query("""
with recursive n as (select user_id as run, case when event_id % 29 > 0 then 'n' || (event_id * 7 % 13) end as id, case when event_id % 6 > 0 then 'n' || (event_id * 5 % 14) end as parent, case event_id % 3 when 0 then 'supervisor' when 1 then 'worker' end as role,
  user_id + (event_id % 23 = 0)::int as claimed, event_id as start, case when event_id % 5 > 0 then event_id + (value - 20)::int end as close, event_id % 2 = 0 as completed, event_id % 3 > 0 as terminal from events where event_type = 'signup'),
d as (select run, case when run % 4 > 0 then 'n' || (run * 7 % 13) end as root from (select distinct run from n)),
ids as (select run, id, count(*) as c from n where id is not null group by all), lost as (select run, count(*) as lost from n where id is null group by 1),
once as (select n.* from n join ids using (run, id) where c = 1), top as (select once.* from once join d on d.run = once.run and d.root = once.id),
e as (select o.*, i.c, coalesce(lost, 0) as lost, p.claimed as pclaimed, p.start as pstart, p.close as pclose from once o left join ids i on i.run = o.run and i.id = o.parent left join lost on lost.run = o.run left join once p on p.run = o.run and p.id = o.parent where o.parent is not null),
up as (select run, id, parent as a from e where c = 1 union select up.run, up.id, e.parent from up join e on e.run = up.run and e.id = up.a where e.c = 1)
select run, 'duplicate-rollout-id' as code, id as subject from ids where c > 1
union all select run, 'root-unavailable', 'tree-root' from d where root is null
union all select d.run, case when lost > 0 then 'node-checks-unavailable' else 'declared-root-missing' end, root from d left join ids on ids.run = d.run and ids.id = d.root left join lost on lost.run = d.run where root is not null and ids.id is null
union all select run, 'root-has-parent', id from top where parent is not null union all select run, 'root-role-invalid', id from top where role <> 'supervisor'
union all select once.run, 'detached-node', id from once join d using (run) where parent is null and id is distinct from root
union all select run, case when lost > 0 then 'node-checks-unavailable' else 'parent-missing' end, id from e where c is null
union all select run, 'cross-run-parent', id from e where c = 1 and claimed <> pclaimed union all select run, 'child-before-parent', id from e where c = 1 and start < pstart
union all select run, 'child-after-parent-close', id from e where c = 1 and start > pclose union all select run, 'close-before-start', id from once where close < start
union all select run, 'parent-cycle', least from (select a.run, a.id, min(b.a) as least from up a join up b on b.run = a.run and b.id = a.id join up c on c.run = a.run and c.id = b.a and c.a = a.id where a.id = a.a group by 1, 2) where id = least
union all select top.run, 'child-terminal-unavailable', 'child-terminal-outcomes' from top where completed and exists (select 1 from once o where o.run = top.run and o.id <> top.id and not o.terminal)""")
def tree_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, run = F.col("event_id"), F.col("user_id")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    nodes = table(spark, sf_dir, "events").where("event_type = 'signup'").select(
        run.alias("run"), F.when(i % 29 > 0, name(i * 7 % 13)).alias("id"), F.when(i % 6 > 0, name(i * 5 % 14)).alias("parent"), F.when(i % 3 == 0, "supervisor").when(i % 3 == 1, "worker").alias("role"),
        (run + (i % 23 == 0).cast("int")).alias("claimed_run"), i.alias("start"), F.when(i % 5 > 0, i + F.rint(F.col("value") - 20).cast("int")).alias("close"), (i % 2 == 0).alias("completed"), (i % 3 > 0).alias("terminal"),
    )
    roots = nodes.select("run").distinct().select("run", F.when(F.col("run") % 4 > 0, name(F.col("run") * 7 % 13)).alias("root"))
    return T.tree_issues(nodes, roots)
