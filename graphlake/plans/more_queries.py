"""Queries of assembly, identity and coverage signals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import assembly, coverage, graph, identity, joins, signals, state
from . import model
from .queries import CHANNELS, QUERIES, SQL, USES, query


def literal(t, rows: list[tuple], *names: str):
    return t.spark.range(1).select(F.inline(F.array(*[F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(n) for n, v in zip(names, r)]) for r in rows])))


_RELATIONS = [("e0", "a", "e1", ["ALL"]), ("e1", "b", "e2", ["PERSIST"]), ("e2", "c", "e0", ["MERGE", "PERSIST"]), ("e3", "d", "e4", ["REMOVE"]), ("e1", "x", "e3", ["ALL", "REMOVE"])]


@query("cascades", """with recursive rel as (select * from (values ('e0', 'a', 'e1', ['ALL']), ('e1', 'b', 'e2', ['PERSIST']), ('e2', 'c', 'e0', ['MERGE', 'PERSIST']), ('e3', 'd', 'e4', ['REMOVE']), ('e1', 'x', 'e3', ['ALL', 'REMOVE'])) v(entity, field, target, kinds)),
  w as (select o_orderkey as flow, 'e' || (o_custkey % 5) as entity, case o_orderstatus when 'F' then 'insert' when 'O' then 'update' else 'delete' end as operation from orders),
  c as (select flow, entity, operation, cast(null as varchar) as chain, 0 as n from w union all select c.flow, rel.target, c.operation, case when c.chain is null then '' else c.chain || ' > ' end || c.entity || '.' || rel.field, n + 1 from c join rel on c.entity = rel.entity and n < 4
    and list_has_any(kinds, case c.operation when 'insert' then ['ALL', 'PERSIST'] when 'update' then ['ALL', 'MERGE'] else ['ALL', 'REMOVE'] end))
  select flow, entity, operation, chain from c""")
def cascades(t):
    op = F.when(F.col("o_orderstatus") == "F", "insert").when(F.col("o_orderstatus") == "O", "update").otherwise("delete")
    writes = t.orders.select(F.col("o_orderkey").alias("flow"), F.concat(F.lit("e"), F.col("o_custkey") % 5).alias("entity"), op.alias("operation"))
    return assembly.cascades(writes, literal(t, _RELATIONS, "entity", "field", "target", "kinds"))


@query("query_tables", """with q as (select p_partkey as symbol, p_size % 3 as k, 't' || p_size as tab from part), r as (
  select symbol, case k when 0 then [tab, 'b'] when 1 then [tab, 'c'] else [tab] end as tabs, case k when 0 then 'update' when 1 then null else 'insert' end as verb from q), u as (select symbol, verb, unnest(tabs) as tab, tabs[1] as lead from r)
  select symbol, tab as "table", case when verb is not null and tab = lead then 'WRITES_TO' else 'READS_FROM' end as type, case when verb is not null and tab = lead then verb else 'select' end as operation from u""")
def query_tables(t):
    k, tab = F.col("p_size") % 3, F.concat(F.lit("s.t"), F.col("p_size"))
    sql = F.when(k == 0, F.concat(F.lit("UPDATE "), tab, F.lit(" SET x = (SELECT y FROM b)"))).when(k == 1, F.concat(F.lit("select * from "), tab, F.lit(" a join x.c on a.i = c.i"))).otherwise(F.concat(F.lit("  insert into "), tab, F.lit(" values (1)")))
    return assembly.query_tables(t.part.select(F.col("p_partkey").alias("symbol"), sql.alias("query")))


@query("bound_calls", "with impl as (select l_partkey % 300 as abstract, l_suppkey as concrete, from lineitem where l_quantity > 48 group by 1, 2), g as (select abstract, count(*) as n from impl group by 1) select o_orderkey as caller, coalesce(concrete, o_custkey % 300) as callee, coalesce(n, 0) > 1 as candidate from orders left join impl on o_custkey % 300 = impl.abstract left join g on o_custkey % 300 = g.abstract")
def bound_calls(t):
    calls = t.orders.select(F.col("o_orderkey").alias("caller"), (F.col("o_custkey") % 300).alias("callee"))
    impl = t.lineitem.where("l_quantity > 48").select((F.col("l_partkey") % 300).alias("abstract"), F.col("l_suppkey").alias("concrete"))
    return assembly.bound_calls(calls, impl)


@query("access_rule", "select p_partkey as endpoint, case when p_size % 2 = 0 and p_partkey % 3 = 0 then 'admin' when p_partkey % 3 = 0 then 'user' else 'public' end as access from part")
def access_rule(t):
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/api/users/{id}/"), F.col("p_partkey"))).otherwise(F.concat(F.lit("/open/"), F.col("p_partkey")))
    endpoints = t.part.select(F.col("p_partkey").alias("endpoint"), F.when(F.col("p_size") % 2 == 0, "POST").otherwise("GET").alias("method"), path.alias("path"))
    return assembly.access(endpoints, [(None, "/**", "public"), (None, "/api/users/**", "user"), ("POST", "/api/**", "admin")]).select("endpoint", "access")


@query("service_links", """with names as (select 'svc' || s_suppkey as name, s_suppkey as id from supplier union all select 'dup', s_suppkey from supplier where s_suppkey < 3)
  select o_orderkey as call, o_custkey % 400 as id, 'confirmed' as certainty from orders where o_orderkey % 3 = 0 and o_custkey % 400 in (select s_suppkey from supplier)""")
def service_links(t):
    names = t.supplier.select(F.concat(F.lit("svc"), F.col("s_suppkey")).alias("name"), F.col("s_suppkey").alias("id")).unionByName(t.supplier.where("s_suppkey < 3").select(F.lit("dup").alias("name"), F.col("s_suppkey").alias("id")))
    k = F.col("o_orderkey") % 3
    host = F.when(k == 0, F.concat(F.lit("svc"), F.col("o_custkey") % 400, F.lit(".shop.svc.cluster.local:8080"))).when(k == 1, F.lit("dup")).otherwise(F.lit("svc${ENV}"))
    return assembly.service_links(t.orders.select(F.col("o_orderkey").alias("call"), host.alias("host")), names)


@query("library_rule", "select p_partkey as call, case when p_size % 4 = 0 then 'io' when p_size % 2 = 0 then 'harmless' when p_size % 3 = 0 then 'io' end as verdict from part")
def library_rule(t):
    s = F.col("p_size")
    lib = F.when(s % 4 == 0, "org.acme.net.http").when(s % 2 == 0, "org.acme.text").when(s % 3 == 0, "net.io.x").otherwise("misc")
    rules = literal(t, [("org.acme", "harmless"), ("org.acme.net", "io"), ("net.io", "io")], "prefix", "verdict")
    return assembly.longest_rule(t.part.select(F.col("p_partkey").alias("call"), lib.alias("library")), rules).select("call", "verdict")


@query("name_closure", """with recursive n as (select c_custkey as deployable, 'n' || (c_custkey % 50) as name from customer), l as (select 'n' || n_nationkey as a, 'n' || (n_nationkey + 100) as b from nation union all select 'n' || (n_nationkey + 100), 'n' || (n_nationkey + 200) from nation),
  both_ways as (select a as x, b as y from l union select b, a from l), c as (select deployable, name, 0 as r from n union select deployable, y, r + 1 from c join both_ways on name = x where r < 4) select distinct deployable, name from c""")
def name_closure(t):
    names = t.customer.select(F.col("c_custkey").alias("deployable"), F.concat(F.lit("n"), F.col("c_custkey") % 50).alias("name"))
    n = lambda k: F.concat(F.lit("n"), F.col("n_nationkey") + k)
    links = t.nation.select(n(0).alias("a"), n(100).alias("b")).unionByName(t.nation.select(n(100).alias("a"), n(200).alias("b")))
    return identity.closure(names, links)


@query("name_ladder", "with n as (select p_size as deployable, p_name || p_partkey as name, case p_partkey % 3 when 0 then 1 when 1 then 0 else 9 end as s, case p_partkey % 2 when 0 then 0 else 2 end as w from part) select deployable, name from (select *, row_number() over (partition by deployable order by s, w, name) as r from n) where r = 1")
def name_ladder(t):
    k = F.col("p_partkey") % 3
    slot = F.when(k == 0, "build_artifact").when(k == 1, "manifest").otherwise("unheard")
    return identity.canonical(t.part.select(F.col("p_size").alias("deployable"), F.concat("p_name", "p_partkey").alias("name"), slot.alias("slot"), F.when(F.col("p_partkey") % 2 == 0, "declared").otherwise("code").alias("witness")))


@query("identity_match", """with k as (select s_suppkey as id, 'l' || s_suppkey as location, 'n' || s_nationkey || ':' || cast(floor(s_acctbal / 10) as bigint) as name, s_suppkey % 4 = 0 as gone from supplier), d as (select c_custkey as deployable, 'l' || (c_custkey * 3) as location, 'n' || c_nationkey || ':' || cast(floor(c_acctbal / 10) as bigint) as name from customer),
  p as (select deployable, min(id) as id from d join k on d.location = k.location and not gone group by 1), fr as (select * from k where id not in (select id from p)),
  m as (select deployable, count(distinct case when not gone then id end) as here, min(case when not gone then id end) as x, count(distinct case when gone then id end) as away, min(case when gone then id end) as y from d join fr on d.name = fr.name where deployable not in (select deployable from p) group by 1)
  select deployable, id, 'location' as how from p union all select deployable, case when here = 1 then x when here = 0 and away = 1 then y end, case when here = 1 then 'name' when here > 1 then 'conflict' when away = 1 then 'returned' else 'conflict' end from m
  union all select deployable, null, 'new' from d where deployable not in (select deployable from p) and deployable not in (select deployable from m)""")
def identity_match(t):
    c = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    name = lambda x: F.concat(F.lit("n"), F.col(f"{x}_nationkey").cast("string"), F.lit(":"), F.floor(F.col(f"{x}_acctbal") / 10).cast("string"))
    known = t.supplier.select(F.col("s_suppkey").alias("id"), c("l", F.col("s_suppkey")).alias("location"), name("s").alias("name"), (F.col("s_suppkey") % 4 == 0).alias("gone"))
    return identity.match(t.customer.select(F.col("c_custkey").alias("deployable"), c("l", F.col("c_custkey") * 3).alias("location"), name("c").alias("name")), known)


@query("silent_repository", "select cast(n_nationkey as varchar) as target from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 8000) and n_nationkey not in (select c_nationkey from customer where c_acctbal > 9900) and n_nationkey % 3 <> 0")
def silent_repository(t):
    repos = t.nation.select(F.col("n_nationkey").alias("repo"))
    return signals.silent_repository(repos, t.supplier.where("s_acctbal > 8000").select(F.col("s_nationkey").alias("repo")), t.customer.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("repo")), repos.where("repo % 3 = 0")).select("target")


@query("signal_ranking", f"""with {CHANNELS}, k as (select channel, count(*) filter (role = 'produces') as p, count(*) filter (role = 'consumes') as c from ch group by 1), s as (
  select 'one_sided' as signal, cast(channel as varchar) as target, cast(null as varchar) as app, [] as ev from k where (p > 0) <> (c > 0)
  union all select 'unknown_hook', p_type || case when p_size % 2 = 0 then 'Handler' else 'Thing' end, p_brand, case when p_size % 2 = 0 then ['can_start_work'] else [] end from part where p_size > 25
  union all select 'unmatched_name', p_name, null, [] from part where p_size < 3
  union all select 'no_trigger_application', p_brand, p_brand, [] from part where p_size = 7)
  select signal, target, count(*) as occurrences, count(distinct app) as applications, round(case signal when 'one_sided' then 3.5 when 'unknown_hook' then 3.0 when 'unmatched_name' then 1.5 else 2.0 end * (100 + 10 * count(distinct app) + ln(1 + count(*))) * (1 + 4 * max(len(ev))), 2) as score from s group by 1, 2""")
def signal_ranking(t):
    hook = F.concat("p_type", F.when(F.col("p_size") % 2 == 0, "Handler").otherwise("Thing"))
    return signals.gathered(
        signals.one_sided(joins.one_sided(model.channel_uses(t))),
        signals.unknown_hook(t.part.select(hook.alias("type"), F.col("p_brand").alias("app"), "p_size").where("p_size > 25"), literal(t, [("none",)], "type")),
        signals.unmatched_name(t.part.where("p_size < 3").select(F.col("p_name").alias("name"), F.lit(None).cast("string").alias("id"))),
        signals.no_trigger_application(t.part.where("p_size = 7").select(F.col("p_brand").alias("app"), F.lit(None).cast("string").alias("kind"))),
    ).select("signal", "target", "occurrences", "applications", "score")


@query("unreachable_effect", f"with {USES} select cast(p_partkey as varchar) as target from part where p_partkey not in (select part from uses where type = 'CONSUMES' and quantity > 45)")
def unreachable_effect(t):
    reached = model.uses(t).where("type = 'CONSUMES' and quantity > 45").select(F.col("part").alias("node"))
    return signals.unreachable_effect(t.part.select(F.col("p_partkey").alias("symbol"), F.lit("a").alias("app")), reached).select("target")


@query("config_unset", "select distinct 'k.' || p_size as target from part where p_size % 4 <> 0")
def config_unset(t):
    needed = t.part.select(F.concat(F.lit("http://${k."), F.col("p_size"), F.lit(":9}/x")).alias("text"), F.lit("a").alias("app"))
    have = t.part.where("p_size % 4 = 0").select(F.concat(F.lit("k."), F.col("p_size")).alias("key"))
    return signals.config_unset(needed, have).select("target").distinct()


@query("version_signals", "select case when p_size % 10 = 0 then 'version_unknown' else 'version_untested' end as signal, case when p_size % 10 = 0 then 'lib' else 'lib ' || p_size || '.1' end as target, count(*) as n from part where p_size % 10 = 0 or p_size >= 20 group by 1, 2")
def version_signals(t):
    v = F.when(F.col("p_size") % 10 != 0, F.concat(F.col("p_size").cast("string"), F.lit(".1")))
    rows = signals.version_signals(t.part.select(F.lit("lib").alias("library"), v.alias("version"), F.col("p_brand").alias("app")), [("lib", ">=0, <20")])
    return rows.groupBy("signal", "target").agg(F.count("*").alias("n"))


@query("owner_kept", "select p_partkey as id, case when p_size % 2 = 0 and p_retailprice < 1000 then 'first' else 'now' end as repo from part")
def owner_kept(t):
    plan = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("shared"), F.lit("now").alias("repo"))
    return state.owner_kept(plan, t.part.where("p_retailprice < 1000").select(F.col("p_partkey").alias("id"), F.lit("first").alias("repo"))).select("id", "repo")


@query("scope_coverage", "select r_name as scope, count(*) as whole, count(*) filter (c_acctbal > 0) as reachable, round(100.0 * count(*) filter (c_acctbal > 0) / count(*), 1) as pct from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def scope_coverage(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("scope"))
    rows = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("scope", (F.col("c_acctbal") > 0).alias("reachable"), F.lit(False).alias("explained"))
    return coverage.completeness(rows, "scope").select("scope", "whole", "reachable", F.col("reachable_pct").alias("pct"))


@query("page_resources", "with s as (select page_id, list_filter(string_split(split_part(split_part(split_part(url, '://', 2), '#', 1), '?', 1), '/'), lambda x: x <> '') as seg from pages) select page_id, '/' || array_to_string(seg[2:3], '/') as resource from s")
def page_resources(t):
    path = F.substring_index(urls.host_and_path(F.col("url"))["path"], "#", 1)
    return t.pages.select("page_id", urls.resource(path).alias("resource"))


@query("sibling_reach", "with recursive e as (select n_nationkey as src, (n_nationkey * 7 + 3) % 25 as dst from nation), r as (select 0 as node, 0 as hops union select dst, hops + 1 from r join e on src = node where hops < 30) select cast(node as integer) as node, min(hops) as hops from r group by 1")
def sibling_reach(t):
    edges = t.nation.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return graph.reach(edges, t.nation.where("n_nationkey = 0").select(F.col("n_nationkey").alias("node")))


@query("meaningful_words", "select p_partkey as part, array_to_string(list_filter(list_distinct_keep, lambda w: w <> 'new'), ' ') as words from (select p_partkey, string_split(p_name, ' ') as list_distinct_keep from part)")
def meaningful_words(t):
    words = text.meaningful(text.words_of(F.concat(F.lit("the how can "), F.col("p_name"))))
    return t.part.select(F.col("p_partkey").alias("part"), F.array_join(words, " ").alias("words"))


# names of earlier queries over all rows, which the queries themselves read now
for _name in ("mounted_paths", "name_closure", "identity_match", "subset_unique", "orphans", "set_diff", "stale_labels"):
    QUERIES[f"{_name}_whole"], SQL[f"{_name}_whole"] = QUERIES[_name], SQL[_name]
