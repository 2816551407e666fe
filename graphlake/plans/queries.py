"""One query per operator over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text, urls, versions
from ..operators import coverage, graph, joins, ranking, search, state, traces
from . import model
from .model import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The model in SQL, for the oracle.
USES = """uses as (select l_orderkey as flow, l_partkey as part, l_suppkey as supplier, l_linenumber as line, l_quantity as quantity,
  case when l_returnflag = 'R' then 'READS_FROM' when l_returnflag = 'A' then 'WRITES_TO' when l_linestatus = 'O' then 'PRODUCES' else 'CONSUMES' end as type from lineitem)"""
STEPS = USES + """, steps as (select flow, part, type, cast(row_number() over (partition by flow order by line, part, supplier, type, quantity) as integer) as ord from uses)"""
CHANNELS = USES + """, ch as (select part as channel, case type when 'PRODUCES' then 'produces' else 'consumes' end as role, flow from uses where type in ('PRODUCES', 'CONSUMES'))"""
FLOWS = CHANNELS + """, flow_edges as (select distinct a.flow as src, b.flow as dst from ch a join ch b on a.channel = b.channel and a.role = 'produces' and b.role = 'consumes' and a.flow <> b.flow)"""
TREE = """tree as (select 'space:r' || r_regionkey as node, 'org:1' as parent from region
  union all select 'space:n' || n_nationkey, 'space:r' || n_regionkey from nation
  union all select 'app:s' || s_suppkey, 'space:n' || s_nationkey from supplier
  union all select 'app:c' || c_custkey, 'space:n' || c_nationkey from customer)"""
CLOSURE = TREE + """, closure as (select node, parent as ancestor, 1 as depth from tree union all select c.node, t.parent, c.depth + 1 from closure c join tree t on t.node = c.ancestor)"""


def query(name: str, sql: str | None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add


# ------------------------------------------------------------ filters, projections, joins


@query("kind_count", """with n as (select unnest(['Space', 'Region']) as label from region union all select unnest(['Space', 'Nation']) from nation
  union all select unnest(['Application', 'Provider']) from supplier union all select unnest(['Application', 'Consumer']) from customer
  union all select unnest(['Interface', 'Topic']) from part) select label, count(*) as n from n group by label""")
def kind_count(t):
    return model.nodes(t).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("node_kind", """select 'topic:' || p_partkey as id, 'topic' as kind from part union all select 'app:s' || s_suppkey, 'application' from supplier union all select 'space:r' || r_regionkey, 'space' from region
  union all select 'space:n' || n_nationkey, 'space' from nation union all select 'app:c' || c_custkey, 'application' from customer""")
def node_kind(t):
    has = lambda label: F.array_contains("labels", label)
    return model.nodes(t).select("id", F.when(has("Topic"), "topic").when(has("Interface"), "interface").when(has("Application"), "application").when(has("Space"), "space").alias("kind"))


@query("label_overlap", "select 'app:s' || s_suppkey as id, s_name as name from supplier union all select 'topic:' || p_partkey, p_name from part")
def label_overlap(t):
    return model.nodes(t).where(F.arrays_overlap("labels", F.array(F.lit("Provider"), F.lit("Topic")))).select("id", "name")


@query("exposed_interfaces", f"with {USES}, p as (select part, min(supplier) as app from uses group by part) select distinct u.supplier as caller, p.app as provider from uses u join p on u.part = p.part where u.type = 'CONSUMES' and u.supplier <> p.app")
def exposed_interfaces(t):
    u = model.uses(t).where("type = 'CONSUMES'").select("part", F.col("supplier").alias("caller"))
    return u.join(model.providers(t).withColumnRenamed("app", "provider"), "part").where("caller <> provider").select("caller", "provider").distinct()


@query("left_parent", "select c_custkey as app, n_name as space, r_name as top from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def left_parent(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("app"), F.col("n_name").alias("space"), F.col("r_name").alias("top"))


@query("uncalled_parts", f"with {USES} select p_partkey as part from part where p_partkey not in (select part from uses where type = 'CONSUMES' and quantity > 30) and p_partkey not in (select part from uses where type = 'WRITES_TO' and quantity > 40)")
def uncalled_parts(t):
    u = model.uses(t)
    parts = t.part.select(F.col("p_partkey").alias("part"))
    return parts.join(u.where("type = 'CONSUMES' and quantity > 30").select("part"), "part", "left_anti").join(u.where("type = 'WRITES_TO' and quantity > 40").select("part"), "part", "left_anti")


@query("semi_flows", "select o_orderkey as flow, o_totalprice as price from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_flows(t):
    some = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(some, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("flow"), F.col("o_totalprice").alias("price"))


_BEFORE, _AFTER = "o_orderdate < timestamp '1997-01-01'", "o_orderdate >= timestamp '1993-01-01'"


@query("diff_orders", f"""with x as (select o_orderkey, o_orderstatus as s, o_orderpriority as p from orders where {_BEFORE}),
  y as (select o_orderkey, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end as s, o_orderpriority as p from orders where {_AFTER})
  select coalesce(x.o_orderkey, y.o_orderkey) as flow, case when x.o_orderkey is null then 'add' when y.o_orderkey is null then 'remove' else 'modify' end as change
  from x full join y on x.o_orderkey = y.o_orderkey where x.o_orderkey is null or y.o_orderkey is null or x.s <> y.s or x.p <> y.p""")
def diff_orders(t):
    pick = lambda where: t.orders.where(where).select(F.col("o_orderkey").alias("flow"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    after = pick(_AFTER).withColumn("status", F.when(F.col("flow") % 10 == 0, "X").otherwise(F.col("status")))
    return state.diff(pick(_BEFORE), after, "flow").select("flow", "change")


@query("agreement", """with c as (select doc_id as channel, case when n_chars > 1500 then 'produces' else 'consumes' end as role from documents where n_chars > 300),
  l as (select doc_id as channel, case when quality = 1 then 'produces' else 'consumes' end as role from labels), x as (select distinct channel, 'app' || (channel % 7) as app, role from c), y as (select distinct channel, 'app' || (channel % 7) as app, role from l)
  select coalesce(x.channel, y.channel) as channel, coalesce(x.app, y.app) as app, coalesce(x.role, y.role) as role,
  case when x.role is not null and y.role is not null then 'confirmed' when x.role is not null then 'code_only' else 'declared_only' end as agreement
  from x full join y on x.channel = y.channel and x.app = y.app and x.role = y.role where coalesce(x.channel, y.channel) in (select channel from l)""")
def agreement(t):
    app = F.concat(F.lit("app"), F.col("channel") % 7).alias("app")
    code = t.documents.where("n_chars > 300").select(F.col("doc_id").alias("channel"), F.when(F.col("n_chars") > 1500, "produces").otherwise("consumes").alias("role")).select("channel", app, "role")
    claimed = t.labels.select(F.col("doc_id").alias("channel"), F.when(F.col("quality") == 1, "produces").otherwise("consumes").alias("role")).select("channel", app, "role")
    return joins.agreement(code, claimed, claimed)


@query("one_sided", f"with {CHANNELS}, k as (select channel, count(*) filter (role = 'produces') as produced, count(*) filter (role = 'consumes') as consumed from ch group by channel) select * from k where (produced > 0) <> (consumed > 0)")
def one_sided(t):
    return joins.one_sided(model.channel_uses(t))


_TEMPLATES = [("GET", "/{a}"), ("GET", "/{a}/{b}"), ("GET", "/p/{id}"), ("GET", "/page/{id}"), ("GET", "/docs/{a}/{b}")]


def _templates(t):
    return t.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("endpoint"), F.lit(m).alias("method"), F.lit(p).alias("template")) for i, (m, p) in enumerate(_TEMPLATES)])))


def _calls(t):
    return t.pages.select(F.col("page_id").alias("call"), F.lit("GET").alias("method"), F.substring_index(urls.host_and_path(F.col("url"))["path"], "#", 1).alias("path"))


_CALLS_SQL = """calls as (select page_id as call, split_part('/' || case when contains(substr(url, strpos(url, '://') + 3), '/') then substr(substr(url, strpos(url, '://') + 3), strpos(substr(url, strpos(url, '://') + 3), '/') + 1) else '' end, '#', 1) as path from pages),
  shaped as (select call, rtrim(split_part(path, '?', 1), '/') as shape from calls),
  te as (select * from (values """ + ", ".join(f"({i}, '^{'/'.join('[^/]+' if s.startswith('{') else s for s in p.split('/'))}$', '{p}')" for i, (_, p) in enumerate(_TEMPLATES)) + """) v(endpoint, re, template))"""


@query("path_match", f"with {_CALLS_SQL} select call, cast(endpoint as integer) as endpoint from shaped join te on regexp_matches(shape, re)")
def path_match(t):
    return joins.template_join(_calls(t), _templates(t)).select("call", "endpoint")


@query("unique_best", f"with {_CALLS_SQL}, f as (select call, endpoint from shaped join te on regexp_matches(shape, re)) select call, cast(min(endpoint) as integer) as endpoint from f group by call having count(*) = 1")
def unique_best(t):
    return joins.unique_best(_calls(t), _templates(t))


_ROUTES = ["/**", "/p/**", "/page/*", "/*/x", "/{a}/{b}"]


@query("route_match", f"with {_CALLS_SQL} select call, route from (select call, split_part(path, '?', 1) as path from calls) c join (values " + ", ".join(f"('{r}', '{urls.gateway_regex(r)}')" for r in _ROUTES) + ") v(route, re) on regexp_matches(path, re)")
def route_match(t):
    # patterns are few and given: one filter each, no product of calls and routes
    calls = _calls(t).select("call", F.substring_index("path", "?", 1).alias("path"))
    hits = F.filter(F.array(*[F.when(F.col("path").rlike(urls.gateway_regex(r)), F.lit(r)) for r in _ROUTES]), lambda r: r.isNotNull())
    return calls.select("call", F.explode(hits).alias("route"))


@query("split_url", """select page_id, split_part(split_part(url, '://', 2), '/', 1) as host, case when contains(split_part(url, '://', 2), '/') then substr(substr(url, strpos(url, '://') + 3), strpos(substr(url, strpos(url, '://') + 3), '/')) else '/' end as path from pages""")
def split_url(t):
    return t.pages.select("page_id", urls.host_and_path(F.col("url")).alias("u")).select("page_id", "u.host", "u.path")


@query("nearest_ancestor", f"""with {STEPS}, e as (select flow, ord, case when ord % 3 = 1 then cast(ord as varchar) when ord % 3 = 2 then (ord - 1) || '.1' else (ord - 2) || '.1.1' end as path, ord % 3 <> 2 as shown from steps)
  select flow, path, case when ord % 3 = 0 then cast(ord - 2 as varchar) end as parent from e where shown""")
def nearest_ancestor(t):
    o = F.col("ord")
    path = F.when(o % 3 == 1, o.cast("string")).when(o % 3 == 2, F.concat((o - 1).cast("string"), F.lit(".1"))).otherwise(F.concat((o - 2).cast("string"), F.lit(".1.1")))
    return traces.nearest_shown(model.steps(t).select("flow", path.alias("path"), (o % 3 != 2).alias("shown")))


@query("longest_prefix", """with i as (select p_partkey, lower(replace(p_type, ' ', '/')) as item from part), pre as (select distinct unnest([split_part(item, '/', 1), split_part(item, '/', 1) || '/' || split_part(item, '/', 2)]) as prefix from i),
  m as (select i.item, arg_max(prefix, length(prefix)) as prefix from (select distinct item from i) i join pre on i.item = prefix or starts_with(i.item, prefix || '/') group by i.item) select * from m""")
def longest_prefix(t):
    items = t.part.select("p_partkey", F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))).alias("item"))
    parts = F.split("item", "/")
    some = items.select(F.explode(F.array(parts[0], F.array_join(F.slice(parts, 1, 2), "/"))).alias("prefix"))
    return joins.longest_prefix(items.select("item").distinct(), some)


@query("range_containment", """with p as (select o_custkey % 50 as file, cast(o_orderkey % 1000 as integer) as line from orders), r as (select c_custkey % 50 as file, c_custkey as scope, cast(c_custkey % 900 as integer) as first, cast(c_custkey % 900 + c_nationkey * 4 as integer) as last from customer)
  select p.file, line, arg_min(scope, (last - first) * 1000000000::bigint + scope) as scope from (select distinct file, line from p) p join r on p.file = r.file and line between first and last group by p.file, line""")
def range_containment(t):
    points = t.orders.select((F.col("o_custkey") % 50).alias("file"), (F.col("o_orderkey") % 1000).cast("int").alias("line")).distinct()
    first = (F.col("c_custkey") % 900).cast("int")
    ranges = t.customer.select((F.col("c_custkey") % 50).alias("file"), F.col("c_custkey").alias("scope"), first.alias("first"), (first + F.col("c_nationkey") * 4).alias("last"))
    return joins.innermost_range(points, ranges, 64)


@query("file_pairs", f"with {STEPS} select a.part % 40 as src, b.part % 40 as dst, count(*) as n from steps a join steps b on a.flow = b.flow and b.ord = a.ord + 1 where a.part % 40 <> b.part % 40 group by 1, 2")
def file_pairs(t):
    return joins.colocated(model.steps(t).select("flow", "ord", (F.col("ord") - 1).alias("parent"), (F.col("part") % 40).alias("file")))


@query("subset_unique", """with w as (select distinct p_brand as brand, case when p_partkey % 2 = 0 then p_size end as size from part), ref as (select brand || ':' || coalesce(cast(size as varchar), '*') as ref, brand, size from w),
  f as (select ref, count(distinct p_partkey) as n, min(p_partkey) as one from ref join part on p_brand = brand and (size is null or size = p_size) group by ref)
  select ref.ref, case when n = 1 then one end as id, case when n = 1 then 'found' when n > 1 then 'ambiguous' else 'missing' end as state from ref left join f on ref.ref = f.ref""")
def subset_unique(t):
    size = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))
    w = t.part.select(F.col("p_brand").alias("label"), size.alias("size")).distinct()
    w = w.select(F.concat_ws(":", "label", F.coalesce(F.col("size").cast("string"), F.lit("*"))).alias("ref"), "label", "size")
    n = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.col("p_size").alias("size"))
    return joins.subset_unique(w, n, ["size"])


@query("overlap_subjects", """select event_id as claim from events where ('u' || user_id) in ('u1', 'u7', 'u42') or event_type in ('error')""")
def overlap_subjects(t):
    claims = t.events.select(F.col("event_id").alias("claim"), F.array_sort(F.array_distinct(F.array(F.concat(F.lit("u"), F.col("user_id")), "event_type"))).alias("subjects"))
    keys = t.spark.range(1).select(F.explode(F.array(*map(F.lit, ["u1", "u7", "u42", "error"]))).alias("key"))
    return joins.overlapping(claims, keys).select("claim")


@query("latest_run", "select user_id, event_id as run, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1")
def latest_run(t):
    return joins.latest(t.events.select("user_id", F.col("event_id").alias("run"), "event_type"), "user_id", "run")


@query("resolve_name", """with names as (select distinct p_brand || p_size as name from part), c as (select p_brand || p_size as name, count(distinct p_partkey) as n, min(p_partkey) as id from part where p_partkey % 4 = 0 group by 1), a as (select p_brand || p_size as name, count(distinct p_partkey) as n, min(p_partkey) as id from part where p_partkey % 4 = 1 group by 1)
  select names.name, case when c.name is null then case when a.n = 1 then a.id end else case when c.n = 1 then c.id end end as id from names left join c on names.name = c.name left join a on names.name = a.name""")
def resolve_name(t):
    p = t.part.select("p_partkey", F.concat("p_brand", "p_size").alias("name"))
    pick = lambda r: p.where(f"p_partkey % 4 = {r}").select("name", F.col("p_partkey").alias("id"))
    return joins.resolve_name(p, pick(0), pick(1))


# ------------------------------------------------------------ aggregations


@query("distinct_reach", f"with {USES} select type, count(*) as occurrences, count(distinct flow) as flows, count(distinct case when supplier > 10 then supplier end) as applications from uses group by type")
def distinct_reach(t):
    return model.uses(t).groupBy("type").agg(F.count("*").alias("occurrences"), F.count_distinct("flow").alias("flows"), F.count_distinct(F.when(F.col("supplier") > 10, F.col("supplier"))).alias("applications"))


@query("edge_merge", f"""with {STEPS} select type, part % 500 as src, part as dst, bool_or(ord % 2 = 0) as async, array_to_string(list_sort(list_distinct(list('op' || (ord % 3)))), ', ') as operation, array_to_string(list_sort(list_distinct(list(cast(ord as varchar)))), '|') as sites, min(ord) as first from steps group by type, part""")
def edge_merge(t):
    e = model.steps(t).select("type", (F.col("part") % 500).alias("src"), F.col("part").alias("dst"), (F.col("ord") % 2 == 0).alias("async"), F.concat(F.lit("op"), F.col("ord") % 3).alias("operation"), F.col("ord").cast("string").alias("site"), "ord")
    return state.merge_edges(e).select("type", "src", "dst", "async", "operation", F.array_join("call_sites", "|").alias("sites"), "first")


@query("node_merge", "select user_id as id, array_to_string(list_sort(list_distinct(list(event_type))), ',') as labels, arg_max(event_type, event_id) filter (event_type <> 'view') as name from events group by user_id")
def node_merge(t):
    n = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("name"), F.col("event_id").alias("ord"))
    return state.merge_nodes(n).select("id", F.array_join("labels", ",").alias("labels"), "name")


@query("tree_rollup", f"with recursive {CLOSURE}, full_closure as (select * from closure union all select distinct node, node, 0 from (select node from tree union select parent from tree)), m as (select 'app:c' || o_custkey as node, count(*) as flows from orders group by 1) select ancestor as node, cast(sum(flows) as bigint) as flows from full_closure c join m on c.node = m.node group by ancestor")
def tree_rollup(t):
    measures = t.orders.groupBy(ids.application(F.concat(F.lit("c"), F.col("o_custkey"))).alias("node")).agg(F.count("*").alias("flows"))
    return graph.rollup(graph.ancestors(model.containment(t)), measures, "flows")


@query("level_links", f"""with {USES}, l as (select o_custkey as src, supplier as dst, count(*) as n from uses join orders on flow = o_orderkey group by 1, 2)
  select 'space:r' || a.n_regionkey as src, 'space:r' || b.n_regionkey as dst, cast(sum(n) as bigint) as n, a.n_regionkey = b.n_regionkey as internal from l join customer on src = c_custkey join nation a on c_nationkey = a.n_nationkey join supplier on dst = s_suppkey join nation b on s_nationkey = b.n_nationkey group by a.n_regionkey, b.n_regionkey""")
def level_links(t):
    flows = t.orders.select(F.col("o_orderkey").alias("flow"), ids.application(F.concat(F.lit("c"), F.col("o_custkey"))).alias("src"))
    links = model.uses(t).join(flows, "flow").groupBy("src", ids.application(F.concat(F.lit("s"), F.col("supplier"))).alias("dst")).agg(F.count("*").alias("n"))
    closure = graph.ancestors(model.containment(t))
    top = t.spark.range(1).select(F.lit("org:1").alias("node"))
    return graph.level_links(links, graph.representative(closure, top))


@query("coverage_pct", "select o_orderpriority as app, count(*) as whole, count(*) filter (o_orderstatus <> 'P') as reachable, count(*) filter (o_orderstatus = 'F' and o_totalprice > 100000) as explained, round(100.0 * count(*) filter (o_orderstatus <> 'P') / count(*), 1) as reachable_pct, round(100.0 * count(*) filter (o_orderstatus = 'F' and o_totalprice > 100000) / nullif(count(*) filter (o_orderstatus <> 'P'), 0), 1) as explained_pct from orders group by 1")
def coverage_pct(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("app"), (F.col("o_orderstatus") != "P").alias("reachable"), ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).alias("explained"))
    return coverage.completeness(rows, "app")


@query("item_group", f"with {USES} select type as kind, part % 100 as target, count(*) as occurrences, count(distinct flow % 5) as repositories, count(distinct supplier) as applications, array_to_string(list_sort(list_distinct(list(line)))[1:8], ',') as samples, case when bool_or(quantity > 45) then 'unexplained' else 'explained' end as status from uses group by 1, 2")
def item_group(t):
    rows = model.uses(t).select(F.col("type").alias("kind"), (F.col("part") % 100).alias("target"), (F.col("flow") % 5).alias("repo"), F.col("supplier").alias("app"), F.col("line").alias("sample"), (F.col("quantity") > 45).alias("open"))
    return coverage.items(rows).withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query("framework_group", "select coalesce(owner, fingerprint) as unit, max(owner) as owner, round(sum(score), 2) as score, count(*) as patterns from (select 'part:' || p_partkey as fingerprint, case when p_size > 10 then p_brand end as owner, cast(p_size as double) as score from part) group by 1")
def framework_group(t):
    return coverage.frameworks(t.part.select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("fingerprint"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("owner"), F.col("p_size").cast("double").alias("score")))


@query("where_summary", "select r_name as space, n_name as app, count(*) as hits from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_acctbal > 0 group by 1, 2")
def where_summary(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("space"), F.col("n_name").alias("app"))
    return t.customer.where("c_acctbal > 0").join(places, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("space", "app").agg(F.count("*").alias("hits"))


@query("share", "with c as (select c_mktsegment as app, count(*) as n from customer group by 1) select app, n, round(n / (select cast(sum(n) as double) from c), 6) as of_all, round(n / (select cast(max(n) as double) from c), 6) as of_top from c")
def share(t):
    return ranking.share(t.customer.select(F.col("c_mktsegment").alias("app")), "app")


@query("best_of", "select o_custkey as app, max(o_totalprice) as score, arg_max(o_orderkey, o_totalprice * 1e9 + o_orderkey) as flow from orders group by 1")
def best_of(t):
    return t.orders.groupBy(F.col("o_custkey").alias("app")).agg(F.max("o_totalprice").alias("score"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("flow"))


@query("fan_in", f"with {USES} select part as callee, count(distinct supplier) as callers from uses group by 1 having count(distinct supplier) >= 12")
def fan_in(t):
    return traces.fan_in(model.uses(t).select(F.col("part").alias("callee"), F.col("supplier").alias("caller")), 12)


@query("unique_items", f"with {USES}, a as (select o_custkey as app, flow, part from uses join orders on flow = o_orderkey), k as (select app from a group by app having count(distinct flow) >= 2) select app, part, min(flow) as flow from a where app in (select app from k) group by app, part having count(distinct flow) = 1")
def unique_items(t):
    parts = t.parts("lineitem")
    a = model.uses(t).select("flow", "part").repartition(parts, "flow").join(t.orders.select(F.col("o_orderkey").alias("flow"), F.col("o_custkey").alias("app")), "flow")
    # all flows are the same if the least is the largest
    ends = a.repartition(parts, "app", "part").groupBy("app", "part").agg(F.min("flow").alias("flow"), F.max("flow").alias("last"))
    several = ends.groupBy("app").agg(F.min("flow").alias("flow"), F.max("last").alias("last")).where("flow < last").select("app")
    return ends.where("flow = last").join(several, "app", "left_semi").select("app", "part", "flow")


@query("stats_diff", "with x as (select event_type as kind, count(*) as n from events where hour(ts) < 12 group by 1), y as (select event_type as kind, count(*) as n from events where hour(ts) >= 8 group by 1) select coalesce(x.kind, y.kind) as kind, coalesce(x.n, 0) as before, coalesce(y.n, 0) as after from x full join y on x.kind = y.kind where coalesce(x.n, 0) <> coalesce(y.n, 0)")
def stats_diff(t):
    count = lambda where, name: t.events.where(where).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias(name))
    both = count("hour(ts) < 12", "before").join(count("hour(ts) >= 8", "after"), "kind", "full_outer").select("kind", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.where("before <> after")


# ------------------------------------------------------------ order


@query("occurrence_number", f"with {STEPS} select flow, ord, part % 10 as symbol, cast(row_number() over (partition by flow, part % 10 order by ord) as integer) as occurrence from steps")
def occurrence_number(t):
    return ranking.occurrence(model.steps(t).select("flow", "ord", (F.col("part") % 10).alias("symbol")), "flow", "symbol", order="ord")


@query("step_ids", f"with {STEPS}, o as (select *, row_number() over (partition by flow, part % 10 order by ord) as n from steps) select flow, ord, 'step:flow:' || flow || ':' || (part % 10) || case when ord % 4 = 0 then '@b' else '' end || case when n > 1 then '#' || n else '' end as id from o")
def step_ids(t):
    rows = ranking.occurrence(model.steps(t).select("flow", "ord", (F.col("part") % 10).alias("symbol")), "flow", "symbol", order="ord")
    return rows.select("flow", "ord", ids.step(F.concat(F.lit("flow:"), F.col("flow")), F.col("symbol"), F.when(F.col("ord") % 4 == 0, "b"), F.col("occurrence")).alias("id"))


@query("interleave", "with h as (select n_regionkey as grp, c_custkey as ord from customer join nation on c_nationkey = n_nationkey), r as (select *, row_number() over (partition by grp order by ord) as turn, min(ord) over (partition by grp) as f from h) select grp, ord, cast(turn as integer) as turn from r order by turn, f, ord limit 40")
def interleave(t):
    h = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("grp"), F.col("c_custkey").alias("ord"))
    return ranking.interleave(h, "grp", "ord", 40)


@query("sibling_chain", f"with {STEPS}, c as (select flow, 'f' || flow as f, ord, case when ord % 3 <> 1 then flow || '.' || (ord - (ord - 1) % 3) end as parent, flow || '.' || ord as step from steps), d as (select *, lag(step) over (partition by flow, parent order by ord) as b from c) select f as flow, case when b is not null then 'NEXT' when parent is null then 'FIRST_STEP' else 'SUBSTEP' end as type, coalesce(b, parent, f) as src, step as dst from d")
def sibling_chain(t):
    o, flow = F.col("ord"), F.col("flow").cast("string")
    rows = model.steps(t).select(F.concat(F.lit("f"), flow).alias("flow"), "ord", F.when(o % 3 != 1, F.concat(flow, F.lit("."), o - (o - 1) % 3)).alias("parent"), F.concat(flow, F.lit("."), o).alias("step"))
    return ranking.sibling_chain(rows)


@query("first_use", f"with {STEPS} select flow, part, min(ord) as first from steps group by 1, 2")
def first_use(t):
    return model.steps(t).groupBy("flow", "part").agg(F.min("ord").alias("first"))


@query("rank_sort", "select row_number() over (order by p_size, p_retailprice desc, p_partkey) as place, p_partkey as part from part qualify place <= 50")
def rank_sort(t):
    top = t.part.orderBy(F.asc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(50).select(F.col("p_partkey").alias("part"), "p_size", "p_retailprice")
    w = Window.orderBy(F.asc("p_size"), F.desc("p_retailprice"), "part")  # fifty rows, after the limit
    return top.select(F.row_number().over(w).cast("bigint").alias("place"), "part")


@query("nulls_last_sort", "select grp, pct from (select p_brand as grp, case when avg(p_size) > 25 then round(avg(p_size), 4) end as pct from part group by 1) order by pct asc nulls last, grp limit 10")
def nulls_last_sort(t):
    avg = F.avg("p_size")
    return t.part.groupBy(F.col("p_brand").alias("grp")).agg(F.when(avg > 25, F.round(avg, 4)).alias("pct")).orderBy(F.asc_nulls_last("pct"), "grp").limit(10)


@query("keep_close", "with s as (select p_partkey as id, p_size / 50.0 as confidence from part) select id, cast(confidence as double) as confidence from s where confidence > 0 and (confidence >= 0.5 or (select max(confidence) from s) - confidence <= 0.15)")
def keep_close(t):
    return ranking.keep_close(t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).cast("double").alias("confidence")), "confidence")


@query("budget", "with r as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as spent, row_number() over (partition by conv_id order by turn) as n from (select conv_id, turn, min(text) as text from conversations group by 1, 2)) select conv_id, turn from r where spent <= 400 or n <= 1")
def budget(t):
    rows = t.conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return ranking.within_budget(rows, "conv_id", "turn", F.length("text"), 400).select("conv_id", "turn")


# ------------------------------------------------------------ sets


@query("union_links", f"with {USES} select 'in' as direction, flow as node, count(*) as n from uses where type in ('READS_FROM', 'CONSUMES') group by 2 union all select 'out', flow, count(*) from uses where type in ('WRITES_TO', 'PRODUCES') group by 2")
def union_links(t):
    side = lambda name, kinds: model.uses(t).where(F.col("type").isin(*kinds)).groupBy(F.col("flow").alias("node")).agg(F.count("*").alias("n")).select(F.lit(name).alias("direction"), "node", "n")
    return side("in", ["READS_FROM", "CONSUMES"]).unionByName(side("out", ["WRITES_TO", "PRODUCES"]))


@query("union_distinct", f"with {USES} select part as channel, supplier as app from uses where type = 'PRODUCES' union select part, supplier from uses where type = 'CONSUMES'")
def union_distinct(t):
    return model.uses(t).where("type in ('PRODUCES', 'CONSUMES')").select(F.col("part").alias("channel"), F.col("supplier").alias("app")).distinct()


@query("set_diff", "select user_id, event_type from events where value > 95 except select user_id, event_type from events where value <= 95 and hour(ts) < 6")
def set_diff(t):
    pick = lambda where: t.events.where(where).select("user_id", "event_type")
    return pick("value > 95").subtract(pick("value <= 95 and hour(ts) < 6"))


@query("trace_changes", """with x as (select user_id as flow, event_type as item, max(event_id % 5) as b from events where hour(ts) < 12 group by 1, 2), y as (select user_id as flow, event_type as item, max(event_id % 5) as b from events where hour(ts) >= 8 group by 1, 2),
  z as (select coalesce(x.flow, y.flow) as flow, coalesce(x.item, y.item) as item, x.b as xb, y.b as yb from x full join y on x.flow = y.flow and x.item = y.item)
  select flow, coalesce(array_to_string(list_sort(list(item) filter (xb is null)), ','), '') as added, coalesce(array_to_string(list_sort(list(item) filter (yb is null)), ','), '') as removed, coalesce(array_to_string(list_sort(list(item) filter (xb <> yb)), ','), '') as modified from z group by flow having count(*) filter (xb is null or yb is null or xb <> yb) > 0""")
def trace_changes(t):
    pick = lambda where: t.events.where(where).select(F.col("user_id").alias("flow"), F.col("event_type").alias("item"), (F.col("event_id") % 5).alias("body"))
    out = state.trace_changes(pick("hour(ts) < 12"), pick("hour(ts) >= 8"))
    return out.select("flow", *[F.array_join(c, ",").alias(c) for c in ("added", "removed", "modified")])


@query("orphans", f"with {CHANNELS} select p_partkey as id from part where p_partkey not in (select channel from ch where role = 'produces') and p_partkey not in (select channel from ch where role = 'consumes')")
def orphans(t):
    u = model.channel_uses(t)
    edges = u.select(F.when(F.col("role") == "produces", F.col("channel")).alias("src"), F.when(F.col("role") == "consumes", F.col("channel")).alias("dst"))
    return state.orphans(t.part.select(F.col("p_partkey").alias("id")), edges)


@query("stale_labels", "with x as (select user_id, list_distinct(list(event_type)) as a from events where hour(ts) < 12 group by 1), y as (select user_id, list_distinct(list(event_type)) as b from events where hour(ts) >= 12 group by 1) select x.user_id as id, array_to_string(list_sort(list_filter(a, lambda e: not list_contains(b, e))), ',') as stale from x join y on x.user_id = y.user_id")
def stale_labels(t):
    pick = lambda where, name: t.events.where(where).groupBy(F.col("user_id").alias("id")).agg(F.collect_set("event_type").alias(name))
    return pick("hour(ts) < 12", "a").join(pick("hour(ts) >= 12", "b"), "id").select("id", F.array_join(state.stale_labels(F.col("a"), F.col("b")), ",").alias("stale"))


# ------------------------------------------------------------ functions

_WORDS_SQL = "list_filter(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')"


@query("tokens", f"with w as (select p_partkey as part, unnest({_WORDS_SQL}) as word from part), s as (select part, word, case " + " ".join(f"when ends_with(word, '{x}') and length(word) - {len(x)} >= 4 then substr(word, 1, length(word) - {len(x)})" for x in text.SUFFIXES) + " else word end as stem from w) select part, word, stem from s")
def tokens(t):
    w = t.part.select(F.col("p_partkey").alias("part"), F.explode(text.words_of(F.col("p_name"))).alias("word"))
    return w.select("part", "word", text.stem(F.col("word")).alias("stem"))


@query("abbrev", "with v as (select distinct unnest(" + _WORDS_SQL + ") as word from part), p as (select distinct left(word, 1) || substr(word, 3, 1) || right(word, 1) as part from v where length(word) > 4) select part, word from p join v on length(part) >= 3 and length(part) < length(word) and left(part, 1) = left(word, 1) and regexp_matches(substr(word, 2), substr(part, 2, 1) || '.*' || substr(part, 3, 1))")
def abbrev(t):
    v = t.part.select(F.explode(text.words_of(F.col("p_name"))).alias("word")).distinct()
    w = F.col("word")
    p = v.where(F.length("word") > 4).select(F.concat(w.substr(1, 1), w.substr(3, 1), F.right(w, F.lit(1))).alias("part")).distinct()
    return p.join(v, p["part"].substr(1, 1) == v["word"].substr(1, 1)).where(text.is_abbreviation(F.col("part"), F.col("word"))).select("part", "word")


@query("short_symbol", "select p_partkey as part, replace(p_brand, '#', '') || '.' || lower(split_part(p_type, ' ', 1)) as symbol from part")
def short_symbol(t):
    s = F.concat(F.lit("com.x."), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("#"), F.lower(F.split("p_type", " ")[0]), F.lit("(int)"))
    return t.part.select(F.col("p_partkey").alias("part"), text.short_symbol(s).alias("symbol"))


@query("score", "with c as (select l_suppkey as target, count(distinct l_orderkey % 5) as r, count(distinct l_partkey % 20) as a, count(*) as o from lineitem group by 1) select target, round(3.0 * (100 * r + 10 * a + ln(1 + o)) * (1 + 4 * (target % 3)), 2) as score from c")
def score(t):
    c = t.lineitem.groupBy(F.col("l_suppkey").alias("target")).agg(F.count_distinct(F.col("l_orderkey") % 5).alias("r"), F.count_distinct(F.col("l_partkey") % 20).alias("a"), F.count("*").alias("o"))
    return c.select("target", versions.score(F.lit("unknown_hook"), F.col("r"), F.col("a"), F.col("o"), F.col("target") % 3).alias("score"))


@query("version_range", "select p_partkey as part, case when p_size % 7 = 2 then p_size >= 20 when p_size % 7 > 2 then true else false end and p_size % 7 < 4 as ok from part")
def version_range(t):
    v = F.concat((F.col("p_size") % 7).cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit(".0.RELEASE"))
    return t.part.select(F.col("p_partkey").alias("part"), versions.in_range(v, ">=2.20, <4").alias("ok"))


@query("sites", f"with {STEPS} select flow, ord, case when ord % 3 <> 0 then ord end as line, case when ord % 2 = 0 then 'upsert' end as operation from steps")
def sites(t):
    o = F.col("ord")
    site = F.concat(F.when(o % 3 != 0, o.cast("string")).otherwise(F.lit("x")), F.when(o % 2 == 0, F.lit(" upsert")).otherwise(F.lit("")))
    return model.steps(t).select("flow", "ord", F.element_at(text.call_sites(F.array(site)), 1).alias("s")).select("flow", "ord", "s.line", "s.operation")


@query("bands", "select event_id, case when value > 90 then 'high' when value >= 50 then 'medium' else 'low' end as band from events")
def bands(t):
    return t.events.select("event_id", versions.band(F.when(F.col("value") > 90, 1.0).when(F.col("value") >= 50, 0.6).otherwise(0.1)).alias("band"))


@query("source_hash", "select p_partkey as part, left(sha256(p_brand || '|' || p_type), 40) as key from part")
def source_hash(t):
    return t.part.select(F.col("p_partkey").alias("part"), F.left(F.sha2(F.concat_ws("|", "p_brand", "p_type"), 256), F.lit(40)).alias("key"))


@query("cosine_topk", "with q as (select embedding as e from embeddings order by vec_id limit 1) select vec_id, round(list_cosine_similarity(embedding::double[], e::double[]), 6) as score from embeddings, q order by list_cosine_similarity(embedding::double[], e::double[]) desc, vec_id limit 10")
def cosine_topk(t):
    q = t.embeddings.orderBy("vec_id").select("embedding").first()
    return search.nearest(t.embeddings, list(q[0]) if q else [0.0], 10).withColumn("score", F.round("score", 6))


# ------------------------------------------------------------ graph


_ROOT_SQL = "(select min(src) from flow_edges)"


@query("reach_down", f"with recursive {FLOWS}, r as (select {_ROOT_SQL} as node, 0 as hops union select dst, hops + 1 from r join flow_edges on src = node where hops < 4) select node, min(hops) as hops from r group by node")
def reach_down(t):
    edges = model.flow_edges(t)
    return graph.reach(edges, edges.agg(F.min("src").alias("node")), 4)


@query("reach_up", f"with recursive {FLOWS}, r as (select (select max(dst) from flow_edges) as node, 0 as hops union select src, hops + 1 from r join flow_edges on dst = node where hops < 3) select node, min(hops) as hops from r group by node")
def reach_up(t):
    edges = model.flow_edges(t)
    return graph.reach(edges, edges.agg(F.max("dst").alias("node")), 3, reverse=True)


@query("dependents", f"with {USES}, hit as (select distinct flow from uses where part = (select min(p_partkey) from part)) select r_name as space, n_name as nation, count(distinct o_custkey) as apps, count(*) as flows from hit join orders on flow = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def dependents(t):
    first = t.part.agg(F.min("p_partkey").alias("part"))
    hit = model.uses(t).join(F.broadcast(first), "part", "left_semi").select("flow").distinct()
    who = hit.join(t.orders, F.col("flow") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return who.groupBy(F.col("r_name").alias("space"), F.col("n_name").alias("nation")).agg(F.count_distinct("o_custkey").alias("apps"), F.count("*").alias("flows"))


@query("ancestors", f"with recursive {CLOSURE} select * from closure union all select node, node, 0 from (select node from tree union select parent from tree)")
def ancestors(t):
    return graph.ancestors(model.containment(t))


@query("descendants", f"with recursive {CLOSURE} select ancestor as node, count(*) as descendants from closure group by 1")
def descendants(t):
    return graph.ancestors(model.containment(t)).where("depth > 0").groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"))


@query("lca", f"with recursive {CLOSURE}, f as (select * from closure union all select distinct node, node, 0 from tree), pairs as (select 'app:s' || s_suppkey as a, 'app:c' || c_custkey as b from supplier join customer on s_suppkey = c_custkey) select p.a, p.b, arg_min(x.ancestor, x.depth) as ancestor from pairs p join f x on x.node = p.a join f y on y.node = p.b and y.ancestor = x.ancestor group by 1, 2")
def lca(t):
    pairs = t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey")).select(ids.application(F.concat(F.lit("s"), F.col("s_suppkey"))).alias("a"), ids.application(F.concat(F.lit("c"), F.col("c_custkey"))).alias("b"))
    return graph.common_ancestor(graph.ancestors(model.containment(t)), pairs)


def _mounted(t):
    # part n is in the last module of chain n % 4; chain k goes from module k, the outermost, to module 3
    k, j = F.col("k"), F.col("j")
    module = lambda k, j: -(1 + 4 * k + j)
    starts = t.part.select(F.col("p_partkey").alias("node"), F.concat(F.lit("/p"), F.col("p_partkey")).alias("path"))
    own = starts.select("node", module(F.col("node") % 4, F.lit(3)).cast("bigint").alias("parent"), F.lit("/m3").alias("prefix"))
    chains = t.spark.range(16).select(F.floor(F.col("id") / 4).alias("k"), (F.col("id") % 4).alias("j")).where("j > k")
    chain = chains.select(module(k, j).cast("bigint").alias("node"), module(k, j - 1).cast("bigint").alias("parent"), F.concat(F.lit("/m"), (j - 1).cast("string")).alias("prefix"))
    return graph.prefix_chain(own.unionByName(chain), starts)


@query("mounted_paths", "select p_partkey as node, case p_partkey % 4 when 0 then '/m0/m1/m2/m3' when 1 then '/m1/m2/m3' when 2 then '/m2/m3' else '/m3' end || '/p' || p_partkey as path from part")
def mounted_paths(t):
    return _mounted(t)


# ------------------------------------------------------------ search, coverage, traces


@query("search_tier", f"""with tok as (select distinct p_partkey as id, unnest({_WORDS_SQL}) as token from part), m as (select id, max(case when token = 'ring' then 4 when starts_with(token, 'ring') then 1 end) as w0, max(case when token = 'small' then 4 when starts_with(token, 'small') then 1 end) as w1 from tok group by id),
  s as (select id, (w0 is not null)::int + (w1 is not null)::int as k, coalesce(w0, 0) + coalesce(w1, 0) as score from m) select id, cast(2 - k as integer) as tier, cast(score as integer) as score from s where k = (select max(k) from s) and k >= 1""")
def search_tier(t):
    return search.tiered(search.index(t.part, "p_partkey", "p_name"), ["ring", "small"])


@query("function_search", "with g as (select p_brand as id, list_distinct(list('com.x.' || p_type || '#run' || p_size)) as symbols from part group by 1), f as (select id, list_filter(symbols, lambda s: contains(lower(s), 'small') and contains(lower(s), 'run1')) as found from g) select id, len(found) as n from f where len(found) > 0")
def function_search(t):
    g = t.part.groupBy(F.col("p_brand").alias("id")).agg(F.collect_set(F.concat(F.lit("com.x."), "p_type", F.lit("#run"), "p_size")).alias("symbols"))
    return search.functions_named(g, "symbols", ["small", "run1"]).select("id", F.size("found").cast("bigint").alias("n"))


@query("vocabulary", f"select distinct part from (select unnest({_WORDS_SQL}) as part from part) where not regexp_matches(part, '[0-9]')")
def vocabulary(t):
    return search.vocabulary(t.part, "p_name")


@query("digest", f"with {USES}, d as (select flow, type, list_sort(list_distinct(list(part))) as parts from uses group by 1, 2) select flow, type || ': ' || array_to_string(parts[1:3], ', ') || case when len(parts) > 3 then ' (+' || (len(parts) - 3) || ' more)' else '' end as line from d")
def digest(t):
    d = model.uses(t).groupBy("flow", "type").agg(F.array_sort(F.collect_set("part")).cast("array<string>").alias("parts"))
    return d.select("flow", F.concat("type", F.lit(": "), text.cut(F.col("parts"), 3)).alias("line"))


@query("pattern_state", """with old as (select p_partkey as target, case when p_partkey % 5 = 0 then 'covered' when p_partkey % 5 = 1 then 'ignored' else 'open' end as state from part where p_size > 25),
  seen as (select l_partkey as target, count(distinct l_suppkey % 7) as r, count(distinct l_suppkey) as a, count(*) as o from lineitem where l_returnflag = 'R' group by 1), b as (select coalesce(old.target, seen.target) as target, coalesce(state, 'open') as state, coalesce(r, 0) as r, coalesce(a, 0) as a, coalesce(o, 0) as o from old full join seen on old.target = seen.target)
  select target, case when o = 0 and state not in ('covered', 'ignored', 'expected') then 'covered' when o > 0 and state = 'covered' then 'open' else state end as state, r as repositories, a as applications, o as occurrences from b""")
def pattern_state(t):
    old = t.part.where("p_size > 25").select(F.lit("library").alias("signal"), F.col("p_partkey").alias("target"), F.when(F.col("p_partkey") % 5 == 0, "covered").when(F.col("p_partkey") % 5 == 1, "ignored").otherwise("open").alias("state"))
    seen = t.lineitem.where("l_returnflag = 'R'").groupBy(F.lit("library").alias("signal"), F.col("l_partkey").alias("target")).agg(F.count_distinct(F.col("l_suppkey") % 7).alias("repositories"), F.count_distinct("l_suppkey").alias("applications"), F.count("*").alias("occurrences"), F.lit(0).alias("evidence"))
    return coverage.record(old, seen).select("target", "state", "repositories", "applications", "occurrences")


@query("triage", "select p_partkey as fingerprint, case when p_size < 17 then 'ignored' else 'open' end as state from part")
def triage(t):
    p = t.part.select(F.col("p_partkey").alias("fingerprint"), F.lit("open").alias("state"))
    return coverage.triage(p, t.part.where("p_size < 17").select(F.col("p_partkey").alias("fingerprint"), F.lit("ignored").alias("state")))


@query("fold", f"with {STEPS}, e as (select flow, (ord % 2 + 1) || '.' || ord || case when ord % 3 = 0 then '.1' else '' end as path, type as does from steps) select flow, split_part(path, '.', 1) as path, array_to_string(list_sort(list_distinct(list(does))), ',') as does, count(*) as entries from e group by 1, 2")
def fold(t):
    o = F.col("ord")
    e = model.steps(t).select("flow", F.concat(o % 2 + 1, F.lit("."), o, F.when(o % 3 == 0, ".1").otherwise("")).alias("path"), F.col("type").alias("does"))
    return traces.folded(e, 1).withColumn("does", F.array_join("does", ","))
