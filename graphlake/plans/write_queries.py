"""Batches of a writer, and a reconcile run after a batch; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing, reconcile
from .queries import query


@query("write_pieces", """with nodes as (select o_custkey % 5 as repo, 'o' || o_orderkey as id, o_orderkey as ord from orders union all select o_custkey % 5, 'l' || l_orderkey || '.' || l_linenumber || '.' || l_partkey, l_orderkey from lineitem join orders on l_orderkey = o_orderkey),
  edges as (select o_custkey % 5 as repo, 'e' || o_orderkey as id, o_orderkey as src, o_orderkey // 2 as dst from orders),
  known as (select o_orderkey as k, o_custkey % 5 as repo from orders),
  placed as (select e.repo, e.id, greatest(e.src, coalesce(d.k, e.src)) as ord from edges e left join known d on d.k = e.dst and d.repo = e.repo),
  rws as (select repo, 'node' as kind, id, ord from nodes union all select repo, 'edge', id, ord from placed), w as (select repo, ord, count(*) as weight from rws group by 1, 2),
  p as (select *, weight > 7 as big, coalesce(sum(case when weight > 7 then 1 else 0 end) over b, 0) as segment, coalesce(sum(case when weight > 7 then 0 else weight end) over b, 0) as filled from w window b as (partition by repo order by ord rows between unbounded preceding and 1 preceding)),
  g as (select *, case when not big then floor((filled - min(filled) over (partition by repo, segment)) / 7) end as part from p),
  n as (select repo, ord, dense_rank() over (partition by repo order by segment, big, part) as batch from g)
  select repo, kind, id, cast(batch as integer) as batch from rws join n using (repo, ord)""")
def write_pieces(t):
    """Flows with their steps, and links between flows, in batches of at most fourteen rows."""
    repo = (F.col("o_custkey") % 5).alias("repo")
    name = lambda c: F.concat(F.lit("o"), c)
    flows = t.orders.select(repo, name("o_orderkey").alias("node"), F.col("o_orderkey").alias("piece"))
    steps = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(repo, F.concat(F.lit("l"), "l_orderkey", F.lit("."), "l_linenumber", F.lit("."), "l_partkey").alias("node"), F.col("l_orderkey").alias("piece"))
    edges = t.orders.select(repo, F.concat(F.lit("e"), "o_orderkey").alias("edge"), name("o_orderkey").alias("src"), name(F.floor(F.col("o_orderkey") / 2)).alias("dst"))
    return packing.packed(flows.unionByName(steps), edges, 14)


def _facts(t, changed: bool) -> reconcile.Facts:
    """An order's customer is a repository; in the later state those of every twentieth customer say something else."""
    repo, new = (F.col("o_custkey") % 200).alias("repo"), F.lit(changed) & (F.col("o_custkey") % 200 < 10)
    shift = F.when(new, 1).otherwise(0)
    channel, app = ((F.col("o_orderkey") % 1500) + shift).alias("channel"), (F.col("o_custkey") % 40).alias("app")
    role = F.when((F.col("o_orderkey") + shift) % 2 == 0, "produces").otherwise("consumes").alias("role")
    name = F.concat(F.lit("svc-"), F.lpad(((F.col("o_orderkey") + shift) % 700).cast("string"), 3, "0"), F.lit("-api"))
    orders = t.orders
    host = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("${env}-"), F.lpad((F.col("o_orderkey") % 900).cast("string"), 3, "0"), F.lit("-${kind}"))).otherwise(F.concat(F.lit("svc-"), F.lpad((F.col("o_orderkey") % 900).cast("string"), 3, "0"), F.lit("-api:80")))
    return reconcile.Facts(
        orders.where("o_orderstatus <> 'P'").select(repo, channel, app, role), orders.where("o_orderstatus <> 'O'").select(repo, channel, app, role),
        orders.where("o_orderkey % 4 = 0").select(repo, name.alias("name"), F.col("o_custkey").alias("id")), orders.where("o_orderkey % 9 = 0").select(repo, name.alias("name")),
        orders.where("o_orderkey % 5 > 0").select(repo, F.col("o_orderkey").cast("string").alias("call"), host.alias("host")),
    )


@query("reconcile_update", """with x as (select o_orderkey as k, o_custkey as c, o_orderstatus as s, case when o_custkey % 200 < 10 then 1 else 0 end as sh from orders),
  u as (select distinct (k % 1500) + sh as channel, c % 40 as app, case when (k + sh) % 2 = 0 then 'produces' else 'consumes' end as role from x where s <> 'P'),
  m as (select distinct (k % 1500) + sh as channel, c % 40 as app, case when (k + sh) % 2 = 0 then 'produces' else 'consumes' end as role from x where s <> 'O'),
  agreement as (select coalesce(u.channel, m.channel) as channel, case when u.channel is null then 'declared_only' when m.channel is null then 'code_only' else 'confirmed' end as state from u full join m on u.channel = m.channel and u.app = m.app and u.role = m.role),
  sided as (select channel, count(*) filter (role = 'produces') as p, count(*) filter (role = 'consumes') as q from (select (k % 1500) + sh as channel, case when (k + sh) % 2 = 0 then 'produces' else 'consumes' end as role from x where s <> 'P' union all select (k % 1500) + sh, case when (k + sh) % 2 = 0 then 'produces' else 'consumes' end from x where s <> 'O') group by 1),
  nm as (select distinct 'svc-' || lpad(cast((k + sh) % 700 as varchar), 3, '0') || '-api' as name, c as id from x where k % 4 = 0),
  dc as (select distinct 'svc-' || lpad(cast((k + sh) % 700 as varchar), 3, '0') || '-api' as name from x where k % 9 = 0),
  one as (select name, min(id) as id from nm group by name having count(distinct id) = 1),
  calls as (select k, k % 3 = 0 as loose, lpad(cast(k % 900 as varchar), 3, '0') as no from x where k % 5 > 0)
  select 'agreement' as kind, state as what, count(*) as n, cast(sum(channel) as bigint) as total from agreement where channel in (select channel from m) group by 2
  union all select 'one_sided', case when p > 0 then 'produced' else 'consumed' end, count(*), cast(sum(channel) as bigint) from sided where (p > 0) <> (q > 0) group by 2
  union all select 'stubs', cast(name not in (select name from nm) as varchar), count(*), cast(sum(length(coalesce((select min(cast(id as varchar)) from nm where nm.name = dc.name), 'stub:' || lower(name)))) as bigint) from dc group by 2
  union all select 'links', case when loose then 'inferred' else 'confirmed' end, count(*), cast(sum(id) as bigint) from calls join one on one.name = 'svc-' || no || '-api' group by 2""")
def reconcile_update(t):
    """Results of a state, then of the next one, in which the repositories of every twentieth customer differ."""
    before, after = _facts(t, False), _facts(t, True)
    repos = t.customer.select((F.col("c_custkey") % 200).alias("repo")).where("repo < 10").distinct()
    out = reconcile.update(before, after, reconcile.derive(before), repos)
    told = lambda df, kind, what, total: df.groupBy(F.lit(kind).alias("kind"), what.alias("what")).agg(F.count("*").alias("n"), F.sum(total).cast("bigint").alias("total"))
    side = F.when(F.col("produced") > 0, "produced").otherwise("consumed")
    return (
        told(out.agreement, "agreement", F.col("agreement"), F.col("channel")).unionByName(told(out.one_sided, "one_sided", side, F.col("channel")))
        .unionByName(told(out.stubs, "stubs", F.col("stub").cast("string"), F.length("id"))).unionByName(told(out.links, "links", F.col("certainty"), F.col("id")))
    )
