"""Queries of the answers: dependents, gateways, links, groups, views and what is still to do."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import urls
from ..operators import answers, dependents, graph, labels, routes
from ..sources import builds
from . import model
from .queries import CHANNELS, SQL, USES, query

# ------------------------------------------------------------ dependents

_EFFECTS = ["READS_FROM", "WRITES_TO", "PRODUCES"]
_DEP = USES + """, eff as (select distinct flow, type, part as target from uses where type in ('READS_FROM', 'WRITES_TO', 'PRODUCES')), starts as (select distinct part as target, flow from uses where type = 'CONSUMES')"""


def _touches(t):
    return model.uses(t).where(F.col("type").isin(_EFFECTS)).select("flow", "type", F.col("part").alias("target"))


def _starts(t):
    return model.uses(t).where("type = 'CONSUMES'").select(F.col("part").alias("target"), "flow").distinct()


def _up_sql(types: str) -> str:
    return f"""{_DEP}, e as (select * from eff where type in ({types})), l1 as (select min(p_partkey) as target from part), f1 as (select distinct flow from e where target in (select target from l1)),
  l2 as (select distinct s.target from starts s join f1 on s.flow = f1.flow), f2 as (select distinct flow from e where target in (select target from l2) and flow not in (select flow from f1)),
  up as (select e.flow, 1 as hops, type, target from e join f1 on e.flow = f1.flow where target in (select target from l1) union all select e.flow, 2, type, target from e join f2 on e.flow = f2.flow where target in (select target from l2))"""


def _up(t, types=None):
    return dependents.upstream(_touches(t), _starts(t), t.part.agg(F.min("p_partkey").alias("target")), 2, types)


@query("dependents_upstream", f"with {_up_sql(', '.join(map(repr, _EFFECTS)))} select * from up")
def dependents_upstream(t):
    return _up(t)


@query("dependents_via", f"with {_up_sql(repr('WRITES_TO'))} select * from up")
def dependents_via(t):
    return _up(t, ["WRITES_TO"])


@query("dependents_grouped", f"with {_up_sql(', '.join(map(repr, _EFFECTS)))}, f as (select flow, min(hops) as hops from up group by flow) select coalesce(c_name, '?') as application, coalesce(n_name, 'no space') as space, min(hops) as hops, count(*) as flows from f left join orders on flow = o_orderkey left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey group by 1, 2")
def dependents_grouped(t):
    places = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return dependents.grouped(_up(t), places.select(F.col("o_orderkey").alias("flow"), F.col("c_name").alias("application"), F.col("n_name").alias("space")))


@query("dependents_downstream", f"""with recursive {_DEP}, r as (select o_orderkey as flow, 0 as hops from orders where o_custkey = (select min(c_custkey) from customer) union select s.flow, r.hops + 1 from r join eff on eff.flow = r.flow join starts s on s.target = eff.target where r.hops < 2),
  m as (select flow, min(hops) as hops from r group by flow) select 'touch' as kind, type || ' ' || target as name, min(hops) as hops from m join eff using (flow) group by type, target union all select 'flow', cast(flow as varchar), hops from m where hops > 0""")
def dependents_downstream(t):
    mine = t.orders.join(F.broadcast(t.customer.agg(F.min("c_custkey").alias("o_custkey"))), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("flow"))
    touched, reached = dependents.downstream(_touches(t), _starts(t), mine, 2)
    named = touched.select(F.lit("touch").alias("kind"), F.concat_ws(" ", "type", "target").alias("name"), "hops")
    return named.unionByName(reached.select(F.lit("flow").alias("kind"), F.col("flow").cast("string").alias("name"), "hops"))


@query("neighbours", f"with {USES}, e as (select distinct part as node, 'in' as direction, type, flow as other from uses), k as (select *, row_number() over (partition by node, direction, type order by other) as n from e) select node, direction, type, count(*) as n, array_to_string(list(other order by other) filter (n <= 40), ',') as others from k group by 1, 2, 3")
def neighbours(t):
    edges = model.uses(t).select("type", F.col("flow").alias("src"), F.col("part").alias("dst"))
    found = dependents.neighbours(edges.where("src is not null"), t.part.select(F.col("p_partkey").alias("node")), parts=t.parts("lineitem")).where("direction = 'in'")
    return found.withColumn("others", F.array_join(F.col("others").cast("array<string>"), ","))


_CALL_SHAPES = """u as (select l_orderkey * 10 + l_linenumber as call, case when l_returnflag = 'N' then 'GET' else 'POST' end as method, case l_linenumber % 3 when 0 then '' when 1 then '/v1' else '/v1/api' end || '/p/' || (l_partkey % 40) as shape from lineitem),
  e as (select p_partkey as endpoint, case when p_size % 2 = 0 then 'GET' else 'POST' end as method, case when p_partkey % 3 = 0 then '/' || (p_partkey % 40) when p_partkey % 3 = 1 then '/p/' || (p_partkey % 400) when p_size = 47 then '/' else '/api/p/' || (p_partkey % 40) end as shape from part where p_size > 46)"""


@query("possible_callers", f"with {_CALL_SHAPES} select call, endpoint, bool_or(u.shape = e.shape) as exact from u join e on u.method = e.method and (u.shape = e.shape or (length(e.shape) > 1 and ends_with(u.shape, e.shape))) group by call, endpoint")
def possible_callers(t):
    line, k, size = F.col("l_linenumber") % 3, F.col("p_partkey"), F.col("p_size")
    shape = F.concat(F.when(line == 0, "").when(line == 1, "/v1").otherwise("/v1/api"), F.lit("/p/"), F.col("l_partkey") % 40)
    calls = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call"), F.when(F.col("l_returnflag") == "N", "get").otherwise("POST").alias("method"), shape.alias("shape"))
    path = F.when(k % 3 == 0, F.concat(F.lit("/"), k % 40)).when(k % 3 == 1, F.concat(F.lit("/p/"), k % 400)).when(size == 47, "/").otherwise(F.concat(F.lit("/api/p/"), k % 40))
    return dependents.possible_callers(calls, t.part.where("p_size > 46").select(k.alias("endpoint"), F.when(size % 2 == 0, "GET").otherwise("POST").alias("method"), path.alias("shape")))


@query("dependents_sites", f"""with {_up_sql(', '.join(map(repr, _EFFECTS)))}, fx as (select distinct flow, type, part as target, line from uses) select up.flow, hops, up.type, up.target, case when x.line % 3 = 0 then null when s.n = 2 then 'upsert' else 'op' || x.line end as operation, 'f' || x.line as file, cast(case when x.line % 3 = 0 then x.line else x.line * 10 + s.n end as integer) as line
  from up join fx x using (flow, type, target) join (values (1), (2)) s(n) on x.line % 3 > 0 or s.n = 1""")
def dependents_sites(t):
    """Who touches the first part, a row for each call site."""
    line = F.col("line")
    sites = F.when(line % 3 > 0, F.array(F.concat((line * 10 + 1).cast("string")), F.concat((line * 10 + 2).cast("string"), F.lit(" upsert"))))
    effects = model.uses(t).select("flow", "type", F.col("part").alias("target"), F.when(line % 3 > 0, F.concat(F.lit("op"), line)).alias("operation"), F.concat(F.lit("f"), line).alias("file"), "line", sites.alias("sites")).distinct()
    return dependents.by_call_site(_up(t), effects)


@query("targets_of", """with r as (select 'a' || s_suppkey as ref, 'application' as kind from supplier union all select 'f' || o_orderkey, 'flow' from orders union all select 'p' || p_partkey, null from part),
  x as (select distinct 'a' || l_suppkey as ref, 'p' || l_partkey as target from lineitem where l_quantity > 40 union select 'f' || o_orderkey, 't' || o_custkey from orders where o_orderkey % 3 > 0) select ref, target from x join r using (ref) union select ref, ref from r where kind is null""")
def targets_of(t):
    name = lambda lead, c: F.concat(F.lit(lead), c)
    refs = t.supplier.select(name("a", "s_suppkey").alias("ref"), F.lit("application").alias("kind")).unionByName(t.orders.select(name("f", "o_orderkey").alias("ref"), F.lit("flow").alias("kind"))).unionByName(t.part.select(name("p", "p_partkey").alias("ref"), F.lit(None).cast("string").alias("kind")))
    exposes = t.lineitem.where("l_quantity > 40").select(name("a", "l_suppkey").alias("application"), name("p", "l_partkey").alias("interface"))
    return dependents.targets_of(refs, exposes, t.orders.where("o_orderkey % 3 > 0").select(name("t", "o_custkey").alias("target"), name("f", "o_orderkey").alias("flow")))


@query("target_place", "select p_partkey as part, coalesce(case when p_size % 5 = 0 then 'app' || p_size end, case when p_size % 3 = 0 then 'db' || p_size end, case when p_size % 2 = 0 then 'store' end, 'external') as place from part")
def target_place(t):
    size = F.col("p_size")
    pick = lambda n, value: F.when(size % n == 0, value)
    return dependents.target_place(t.part.select(F.col("p_partkey").alias("part"), pick(5, F.concat(F.lit("app"), size)).alias("owner"), pick(3, F.concat(F.lit("db"), size)).alias("datastore"), pick(2, F.lit("store")).alias("store"))).select("part", "place")


# ------------------------------------------------------------ trees of any depth


@query("deep_ancestors", "select cast(a.p_partkey as bigint) as node, cast(b.p_partkey as bigint) as ancestor, cast(a.p_partkey % 50 - b.p_partkey % 50 as integer) as depth from part a join part b on a.p_partkey // 50 = b.p_partkey // 50 and b.p_partkey <= a.p_partkey")
def deep_ancestors(t):
    # chains of fifty parts
    key = F.col("p_partkey")
    return graph.ancestors(t.part.select(key.alias("node"), F.when(key % 50 > 0, key - 1).alias("parent")))


@query("deep_mounts", "select a.p_partkey as node, string_agg('/m' || b.p_partkey, '' order by b.p_partkey) || '/p' || a.p_partkey as path from part a join part b on a.p_partkey // 25 = b.p_partkey // 25 and b.p_partkey <= a.p_partkey group by a.p_partkey")
def deep_mounts(t):
    # part n is mounted in module -n - 1; the modules of 25 parts are mounted in one another
    key = F.col("p_partkey")
    starts = t.part.select(key.alias("node"), F.concat(F.lit("/p"), key).alias("path"))
    own = t.part.select(key.alias("node"), (-key - 1).alias("parent"), F.concat(F.lit("/m"), key).alias("prefix"))
    chain = t.part.where(key % 25 > 0).select((-key - 1).alias("node"), (-key).alias("parent"), F.concat(F.lit("/m"), key - 1).alias("prefix"))
    return graph.prefix_chain(own.unionByName(chain), starts)


# ------------------------------------------------------------ gateways and links

_PATH = "'/' || n_regionkey || '/items/' || p_partkey || case when p_size % 2 = 0 then '/detail' else '' end"
_REQUESTS_SQL = f"requests as (select p_partkey as request, 'g' || (p_partkey % 3) as gateway, case p_size % 3 when 0 then 'get' when 1 then 'POST' end as method, {_PATH} as path from part join nation on n_nationkey = p_partkey % 25)"
_ROUTES = [
    # route, gateway, pattern, regular expression of the pattern, methods, strip, rewrite, prefix
    (1, "g0", "/{r}/items/**", "^/[^/]+/items(?:/.*)?$", "GET, PUT", 1, None, "/inner/"),
    (2, "g0", "/**", "^(?:/.*)?$", None, 0, None, None),
    (3, "g1", "/*/items/*", "^/[^/]+/items/[^/]+$", None, 0, r"/(?<r>[0-9]+)/items/(?<i>[0-9]+), /i/${i}/of/${r}", None),
    (4, "g1", "/0/items/{x}/detail", "^/0/items/[^/]+/detail$", "POST", 3, None, None),
    (5, "g2", "/items.v1/*", r"^/items\.v1/[^/]+$", None, 0, None, "x"),
]


def _routes(t):
    rows = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(c) for c, v, kind in zip(("route", "gateway", "pattern", "methods", "strip", "rewrite", "prefix"), (r[:3] + r[4:]), ("int", "string", "string", "string", "int", "string", "string"))]) for r in _ROUTES])
    return t.spark.range(1).select(F.inline(rows))


@query("gateway_routes", f"""with {_REQUESTS_SQL}, s as (select *, string_split(trim(path, '/'), '/') as seg from requests) select request, cast(1 as integer) as route, '/inner/' || array_to_string(seg[2:], '/') as inside from s where gateway = 'g0' and (method is null or upper(method) = 'GET')
  union all select request, 2, path from s where gateway = 'g0'
  union all select request, 3, '/i/' || seg[3] || '/of/' || seg[1] from s where gateway = 'g1' and len(seg) = 3
  union all select request, 4, '/detail' from s where gateway = 'g1' and len(seg) = 4 and seg[1] = '0' and (method is null or upper(method) = 'POST')""")
def gateway_routes(t):
    path = F.concat(F.lit("/"), F.col("n_regionkey"), F.lit("/items/"), F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, "/detail").otherwise(""))
    method = F.when(F.col("p_size") % 3 == 0, "get").when(F.col("p_size") % 3 == 1, "POST")
    requests = t.part.join(t.nation, F.col("n_nationkey") == F.col("p_partkey") % 25).select(F.col("p_partkey").alias("request"), F.concat(F.lit("g"), F.col("p_partkey") % 3).alias("gateway"), method.alias("method"), path.alias("path"))
    return routes.through_gateway(requests, _routes(t))


@query("outside_paths", """with e as (select p_partkey as endpoint, p_partkey % 3 as app, case when p_size % 2 = 0 then '/inner/items/' || p_partkey else '/' || p_type end as path from part)
  select endpoint, cast(2 as integer) as route, path as outside from e where app = 0 union all select endpoint, cast(6 as integer), '/shop' || substr(path, 7) from e where app = 1 and starts_with(path, '/inner/')""")
def outside_paths(t):
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/inner/items/"), "p_partkey")).otherwise(F.concat(F.lit("/"), "p_type"))
    endpoints = t.part.select(F.col("p_partkey").alias("endpoint"), (F.col("p_partkey") % 3).cast("int").alias("application"), path.alias("path"))
    known = _routes(t).withColumn("application", F.substring("gateway", 2, 1).cast("int"))
    shop = t.spark.range(1).select(F.lit(6).alias("route"), F.lit("g1").alias("gateway"), F.lit("/shop/**").alias("pattern"), F.lit(None).cast("string").alias("methods"), F.lit(1).alias("strip"), F.lit(None).cast("string").alias("rewrite"), F.lit("inner").alias("prefix"), F.lit(1).alias("application"))
    return routes.outside_paths(endpoints, known.unionByName(shop))


_LINK_SQL = """calls as (select o_orderkey as call, 's' || (o_orderkey % 200) as system, case when o_orderkey % 2 = 0 then 'get' else 'POST' end as method, o_custkey % 400 as app, o_orderkey % 5 as style, o_orderkey % 7 as path from orders),
  named as (select *, case when style = 4 then null when app in (select s_suppkey from supplier) then app end as application from calls),
  served as (select call, system, application, case when style = 3 then 'inferred' else 'confirmed' end as certainty, case when path in (1, 2) and method = 'get' and style <> 4 then application * 10 + path end as endpoint from named where application is not null)"""


@query("link_plan", f"with {_LINK_SQL} select call, system, application, certainty, endpoint from served")
def link_plan(t):
    # hosts are names of suppliers, exactly, in a cluster, or with a part set elsewhere; others name nobody
    style, app = F.col("o_orderkey") % 5, F.col("o_custkey") % 400
    name = F.concat(F.lit("shop-"), F.lpad(app.cast("string"), 5, "0"), F.lit("-api"))
    host = F.when(style == 0, name).when(style == 1, F.concat(name, F.lit(":8080"))).when(style == 2, F.concat(name, F.lit(".ns.svc.cluster.local"))).when(style == 3, F.concat(F.lit("${env}-"), F.lpad(app.cast("string"), 5, "0"), F.lit("-${kind}.svc"))).otherwise("nobody")
    path = F.when(F.col("o_orderkey") % 7 == 1, F.lit("/orders/17")).when(F.col("o_orderkey") % 7 == 2, F.lit("/orders/{id}/lines/")).otherwise(F.concat(F.lit("/none/"), F.col("o_orderkey") % 7))
    calls = t.orders.select(F.col("o_orderkey").alias("call"), F.concat(F.lit("s"), F.col("o_orderkey") % 200).alias("system"), F.when(F.col("o_orderkey") % 2 == 0, "get").otherwise("POST").alias("method"), F.concat(F.lit("http://"), host, path).alias("url"))
    names = t.supplier.select(F.concat(F.lit("shop-"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit("-api")).alias("name"), F.col("s_suppkey").alias("id"))
    ends = t.supplier.select(F.col("s_suppkey").alias("application"), F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("/orders/{order}").alias("path")), F.struct(F.lit(2).alias("n"), F.lit("/orders/{order}/lines").alias("path")))).alias("e"))
    endpoints = ends.select((F.col("application") * 10 + F.col("e.n")).alias("endpoint"), "application", F.lit("GET").alias("method"), "e.path")
    return routes.link_plan(calls, names, endpoints)


@query("routes_replaced", "select c_custkey as route, c_nationkey as gateway, 'old' as path from customer where c_nationkey >= 9 union all select s_suppkey, s_nationkey, 'new' from supplier where s_nationkey < 9 union all select c_custkey, c_nationkey, 'old' from customer where c_nationkey < 9 and c_nationkey not in (select s_nationkey from supplier)")
def routes_replaced(t):
    stored = t.customer.select(F.col("c_custkey").alias("route"), F.col("c_nationkey").alias("gateway"), F.lit("old").alias("path"))
    fresh = t.supplier.where("s_nationkey < 9").select(F.col("s_suppkey").alias("route"), F.col("s_nationkey").alias("gateway"), F.lit("new").alias("path"))
    return routes.replaced(stored, fresh, "gateway")


@query("stub_applications", "with d as (select distinct p_type || (p_size % 4) as name from part), a as (select p_type || '1' as name, min('app:' || p_partkey) as id from part group by 1) select d.name, coalesce(a.id, 'stub:' || lower(d.name)) as id, a.id is null as stub from d left join a on d.name = a.name")
def stub_applications(t):
    declared = t.part.select(F.concat("p_type", F.col("p_size") % 4).alias("name"))
    return routes.stubs(declared, t.part.select(F.concat("p_type", F.lit("1")).alias("name"), F.concat(F.lit("app:"), "p_partkey").alias("id")))


@query("dead_stubs", f"with {USES}, s as (select p_partkey as id, p_type as name from part), e as (select part from uses where quantity > 45), k as (select id, 'no edges' as reason from s where id not in (select part from e) union all select id, 'resolved' from s where name in (select p_type from part where p_size = 1)) select id, max(reason) as reason from k group by id")
def dead_stubs(t):
    stubs = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    edges = model.uses(t).where("quantity > 45").select((-F.col("flow") - 1).alias("src"), F.col("part").alias("dst"))
    return routes.dead_stubs(stubs, edges, t.part.where("p_size = 1").select(F.col("p_type").alias("name")))


# ------------------------------------------------------------ groups


@query("agreement_counts", f"select agreement, count(*) as n from ({SQL['agreement']}) group by 1")
def agreement_counts(t):
    from . import queries

    return queries.QUERIES["agreement"](t.spark, t.folder).groupBy("agreement").agg(F.count("*").alias("n"))


@query("signal_counts", "with k as (select user_id % 50 as app, event_type as signal, count(*) as n from events group by 1, 2) select app, string_agg(signal || '=' || n, ',' order by signal) as counts from k group by 1")
def signal_counts(t):
    counted = answers.names_counted(t.events.select((F.col("user_id") % 50).alias("app"), F.col("event_type").alias("signal")), "app", "signal")
    return counted.select("app", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


_CITED_SQL = """cited as (select split_part(url, '/', 3) as repo, 'c' || (page_id % 3) as commit, split_part(split_part(substr(url, strpos(url, '://') + 3), '?', 1), '#', 1) as rest, page_id as ord from pages),
  c as (select repo, commit, substr(rest, length(repo) + 2) as file, 'claim ' || (ord % 5) as claim, ord from cited)"""


def _cited(t):
    rest = F.substring_index(F.substring_index(F.split("url", "://", 2)[1], "?", 1), "#", 1)
    repo = F.substring_index(rest, "/", 1)
    return t.pages.select(repo.alias("repo"), F.concat(F.lit("c"), F.col("page_id") % 3).alias("commit"), rest.substr(F.length(repo) + 2, F.length(rest)).alias("file"), F.concat(F.lit("claim "), F.col("page_id") % 5).alias("claim"), F.col("page_id").alias("ord"))


@query("source_groups", f"""with {_CITED_SQL}, f as (select distinct repo, case when contains(file, '/') then regexp_replace(file, '/[^/]*$', '') || '/' else file end as folder from c where file <> ''),
  top as (select repo, folder, row_number() over (partition by repo order by folder) as n from f a where not exists (select 1 from f b where b.repo = a.repo and b.folder <> a.folder and starts_with(a.folder, b.folder) and ends_with(b.folder, '/'))),
  cl as (select repo, claim, row_number() over (partition by repo order by min(ord), claim) as n from c group by repo, claim)
  select r.repo, (select string_agg(distinct commit, ',' order by commit) from c where c.repo = r.repo) as commits, coalesce((select string_agg(folder, ',' order by folder) from top where top.repo = r.repo and n <= 8), '') as folders,
  greatest((select count(*) from top where top.repo = r.repo) - 8, 0) as more, (select string_agg(claim, ',' order by n) from cl where cl.repo = r.repo and n <= 3) as reasons from (select distinct repo from c) r""")
def source_groups(t):
    out = answers.source_groups(_cited(t))
    return out.select("repo", *[F.array_join(c, ",").alias(c) for c in ("commits", "folders")], F.col("more").cast("bigint").alias("more"), F.array_join("reasons", ",").alias("reasons"))


@query("unique_citations", f"with {_CITED_SQL} select distinct claim, repo || '/' || file as file, commit as lines from c")
def unique_citations(t):
    c = _cited(t).select("claim", F.concat_ws("/", "repo", "file").alias("file"), F.col("commit").alias("lines"))
    return answers.unique_citations(c)


@query("functions_by_file", """with e as (select l_suppkey as file, 'f' || l_partkey as symbol, cast(l_quantity as integer) as a, cast(l_quantity as integer) + l_linenumber as b, l_orderkey * 1000 + l_linenumber * 50 + cast(l_quantity as integer) as ord from lineitem),
  f as (select file, symbol, arg_min(a, (ord, a, b)) as a, arg_min(b, (ord, a, b)) as b from e group by 1, 2) select file, cast(row_number() over (partition by file order by a, b, symbol) as integer) as ord, symbol, a || '-' || b as lines from f""")
def functions_by_file(t):
    start = F.col("l_quantity").cast("int")
    end = start + F.col("l_linenumber")
    order = F.struct((F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 50 + start).alias("at"), start.alias("a"), end.alias("b"))
    return answers.functions_by_file(t.lineitem.select(F.col("l_suppkey").alias("file"), F.concat(F.lit("f"), "l_partkey").alias("symbol"), start.alias("start"), end.alias("end"), order.alias("ord")))


@query("version_usage", "with d as (select p_partkey % 60 as app, p_type as library, case when p_size % 4 > 0 then p_size % 4 || '.0' end as version from part), e as (select library, coalesce(version, 'unknown') as version, count(distinct app) as n from d group by 1, 2), a as (select library, count(distinct app) as applications from d group by 1) select a.library, applications, string_agg(version || ' (' || n || ')', ', ' order by n desc, version) as versions from a join e using (library) group by 1, 2")
def version_usage(t):
    d = t.part.select((F.col("p_partkey") % 60).alias("app"), F.col("p_type").alias("library"), F.when(F.col("p_size") % 4 > 0, F.concat((F.col("p_size") % 4).cast("string"), F.lit(".0"))).alias("version"))
    return answers.version_usage(d).withColumn("versions", F.array_join("versions", ", "))


@query("keyword_rank", "select p_type as query, p_partkey as id, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) - 1 as rank, 1.0::double / row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as signal from part")
def keyword_rank(t):
    return answers.keyword_rank(t.part.select(F.col("p_type").alias("query"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))).select("query", "id", F.col("rank").cast("bigint").alias("rank"), "signal")


@query("scope_first", "with h as (select p_brand as query, p_partkey as id, p_size < 10 as scoped, p_retailprice as score from part), k as (select *, row_number() over (partition by query, scoped order by score desc, id) as n from h) select query, id, cast(row_number() over (partition by query order by scoped desc, n) as integer) as place from k where scoped or n <= 3")
def scope_first(t):
    return answers.scope_first(t.part.select(F.col("p_brand").alias("query"), F.col("p_partkey").alias("id"), (F.col("p_size") < 10).alias("scoped"), F.col("p_retailprice").alias("score")))


@query("call_order", "with r as (select distinct l_suppkey as app, l_linenumber % 3 as depth, case when l_quantity < 40 then cast(l_quantity as integer) end as line, case when l_partkey % 4 = 0 then 'x' || l_partkey else l_partkey || ' call' end as site from lineitem) select *, cast(row_number() over (partition by app order by depth, line nulls last, try_cast(split_part(site, ' ', 1) as bigint) nulls last, site) as integer) as place from r")
def call_order(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("app"), (F.col("l_linenumber") % 3).alias("depth"), F.when(F.col("l_quantity") < 40, F.col("l_quantity").cast("int")).alias("line"), F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("x"), "l_partkey")).otherwise(F.concat(F.col("l_partkey").cast("string"), F.lit(" call"))).alias("site"))
    return answers.call_order(rows.distinct(), "app")


@query("queue_heads", "with j as (select o_custkey as repo, o_orderkey as id, o_orderdate as queued, o_orderstatus as s, o_totalprice as price from orders) select repo, arg_min(id, (queued, id)) as id from j where s = 'O' and repo not in (select repo from j where s = 'P' and price > 300000) group by repo")
def queue_heads(t):
    running = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000)
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(running, "running").otherwise("done")
    return answers.queue_heads(t.orders.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("queued_at"), status.alias("status")))


@query("combinations", "with f as (select p_partkey as fact, list_transform(range(p_size % 3 + 1), lambda i: 't' || i) as topics, list_transform(range(p_size % 2), lambda i: 'g' || i) as groups from part), x as (select fact, unnest(topics) as topic, groups from f) select fact, topic, unnest(groups) as grp from x")
def combinations(t):
    named = lambda n, letter: F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.concat(F.lit(letter), i.cast("string")))
    facts = t.part.select(F.col("p_partkey").alias("fact"), named(F.col("p_size") % 3 + 1, "t").alias("topic"), named(F.col("p_size") % 2, "g").alias("grp"))
    return answers.combinations(facts, "topic", "grp")


@query("share_of_uses", f"with {CHANNELS} select role, count(distinct channel) as channels, count(*) as uses from ch group by 1")
def share_of_uses(t):
    return model.channel_uses(t).groupBy("role").agg(F.count_distinct("channel").alias("channels"), F.count("*").alias("uses"))


# ------------------------------------------------------------ search


@query("abbreviations", """with v as (select distinct unnest(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9_]+')) as part from part union select distinct substr(lower(r_name), 1, 1) || substr(lower(r_name), 3, 2) from region),
  f as (select w as word, part from v, (values ('america'), ('economy'), ('europe')) x(w) where length(part) >= 3 and length(part) < length(w) and part[1] = w[1] and regexp_matches(w, '^' || array_to_string(list_transform(string_split(part, ''), lambda c: c), '.*') || '.*$'))
  select word, part, cast(row_number() over (partition by word order by length(part) desc, part) as integer) as n from f qualify n <= 8""")
def abbreviations(t):
    parts = t.part.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), "[^a-z0-9_]+")).alias("part")).distinct()
    short = t.region.select(F.concat(F.substring(F.lower("r_name"), 1, 1), F.substring(F.lower("r_name"), 3, 2)).alias("part"))
    return answers.abbreviations(parts.unionByName(short), ["america", "economy", "europe"])


@query("why_matched", "with d as (select p_partkey as id, p_name || '; ' || p_type || ' ; ' || p_brand as digest from part), m as (select id, list_filter(list_transform(string_split(digest, ';'), lambda x: trim(x)), lambda x: contains(lower(x), 'ring') or contains(lower(x), 'economy') or contains(lower(x), 'econom'))[:3] as items from d) select id, array_to_string(items, ' | ') as matched from m where len(items) > 0")
def why_matched(t):
    digests = t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("; "), "p_type", F.lit(" ; "), "p_brand").alias("digest"))
    return answers.why_matched(digests, ["ring", "economy"]).withColumn("matched", F.array_join("matched", " | "))


@query("entity_cards", f"with {USES}, r as (select distinct part as id, cast(supplier as varchar) as value from uses where type = 'READS_FROM'), w as (select distinct part as id, cast(supplier as varchar) as value from uses where type = 'WRITES_TO' and quantity > 48), rr as (select id, string_agg(value, ',' order by value) as v from (select *, row_number() over (partition by id order by value) as n from r) where n <= 4 group by id), ww as (select id, string_agg(value, ',' order by value) as v from (select *, row_number() over (partition by id order by value) as n from w) where n <= 4 group by id) select p_partkey as id, coalesce(rr.v, '') as readers, coalesce(ww.v, '') as writers from part left join rr on rr.id = p_partkey left join ww on ww.id = p_partkey")
def entity_cards(t):
    u = model.uses(t).select(F.col("part").alias("id"), F.col("supplier").cast("string").alias("value"), "type", "quantity")
    cards = answers.entity_cards(t.part.select(F.col("p_partkey").alias("id")), ("readers", u.where("type = 'READS_FROM'").select("id", "value")), ("writers", u.where("type = 'WRITES_TO' and quantity > 48").select("id", "value")))
    return cards.select("id", F.array_join("readers", ",").alias("readers"), F.array_join("writers", ",").alias("writers"))


# ------------------------------------------------------------ what is still to do


@query("to_generate", "select p_partkey as id, sha256(p_name || p_type) as hash from part where p_size >= 20 or p_size % 2 = 0")
def to_generate(t):
    text = F.concat("p_name", "p_type")
    cache = t.part.where("p_size < 20").select(F.col("p_partkey").alias("id"), F.sha2(F.when(F.col("p_size") % 2 == 0, F.concat(text, F.lit("old"))).otherwise(text), 256).alias("hash"))
    return answers.to_generate(t.part.select(F.col("p_partkey").alias("id"), text.alias("input")), cache)


@query("stale_embeddings", "select p_partkey as id, sha256('model-1' || p_name) as mark from part where p_size >= 10")
def stale_embeddings(t):
    marks = t.part.where("p_size < 40").select(F.col("p_partkey").alias("id"), F.sha2(F.concat(F.when(F.col("p_size") < 10, "model-1").otherwise("model-0"), "p_name"), 256).alias("mark"))
    return answers.stale_embeddings(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("digest")), marks, "model-1")


@query("refreshed", "select p_partkey as pattern, case when o_orderkey is null then 'proposed' when o_orderstatus = 'F' then 'covered' when o_orderstatus = 'O' then 'ignored' else 'proposed' end as state from part left join orders on o_orderkey = p_partkey * 10")
def refreshed(t):
    state = F.when(F.col("o_orderstatus") == "F", "merged").when(F.col("o_orderstatus") == "O", "closed").otherwise("open")
    return answers.refreshed(t.part.select(F.col("p_partkey").alias("pattern"), (F.col("p_partkey") * 10).alias("request")), t.orders.select(F.col("o_orderkey").alias("request"), state.alias("state")))


@query("occurrences", "with p as (select distinct l_partkey as pattern, l_suppkey as file, l_linenumber as line from lineitem), k as (select *, cast(row_number() over (partition by pattern order by file, line) as integer) as n from p where pattern in (select p_partkey from part where p_size > 40)) select pattern, n, file, line from k where n <= 5")
def occurrences(t):
    places = t.lineitem.select(F.col("l_partkey").alias("pattern"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line")).distinct()
    return answers.occurrences(places, t.part.where("p_size > 40").select(F.col("p_partkey").alias("pattern")), 5)


@query("trace_entry", "select distinct cast(l_orderkey as varchar) as flow, cast(l_linenumber as varchar) as path from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_custkey % 7 + 1 = l_linenumber)")
def trace_entry(t):
    entries = t.lineitem.select(F.col("l_orderkey").cast("string").alias("flow"), F.col("l_linenumber").cast("string").alias("path")).distinct()
    return answers.trace_entry(entries, t.orders.select(F.concat(F.lit("trace:"), F.col("o_orderkey"), F.lit("#"), F.col("o_custkey") % 7 + 1).alias("ref")))


@query("disagreements", f"select * from ({SQL['agreement']}) where agreement <> 'confirmed' and app in ('app1', 'app3')")
def disagreements(t):
    from . import queries

    some = t.spark.range(1).select(F.explode(F.array(F.lit("app1"), F.lit("app3"))).alias("app"))
    return answers.disagreements(queries.QUERIES["agreement"](t.spark, t.folder), some)


@query("witnesses", "select user_id as app, event_type as channel, 'confirmed' as agreement, 'code' as kind, 'f' || event_id as file from events union all select user_id, event_type, 'confirmed', 'acl', cast(null as varchar) from events where event_id % 2 = 0")
def witnesses(t):
    one = F.concat(F.lit('{"kind":"code","file":"f'), "event_id", F.lit('"}'))
    sources = F.concat(F.lit("["), one, F.when(F.col("event_id") % 2 == 0, ',{"kind":"acl"}').otherwise(""), F.lit("]"))
    return answers.witnesses(t.events.select(F.col("user_id").alias("app"), F.col("event_type").alias("channel"), F.lit("confirmed").alias("agreement"), sources.alias("sources")))


@query("due_repositories", "select c_custkey as repo, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') then 'busy' when c_nationkey = 0 then 'failed' when c_nationkey % 4 = 1 then 'unchanged' else 'due' end as state from customer")
def due_repositories(t):
    head = F.when(F.col("c_nationkey") > 0, F.concat(F.lit("h"), "c_nationkey"))
    ingested = F.when(F.col("c_nationkey") % 4 == 1, F.concat(F.lit("h"), "c_nationkey")).otherwise("old")
    return answers.due_repositories(t.customer.select(F.col("c_custkey").alias("repo"), head.alias("head"), ingested.alias("ingested")), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("repo")))


# ------------------------------------------------------------ assembly and views


@query("application_kinds", "with k as (select user_id as app, case event_type when 'click' then 'Service' when 'view' then 'Consumer' end as kind from events union all select distinct user_id, 'Gateway' from events where value > 60) select app, string_agg(distinct kind, ',' order by kind) as kinds from k where kind is not null group by app")
def application_kinds(t):
    trigger = F.when(F.col("event_type") == "click", "http").when(F.col("event_type") == "view", "topic").otherwise(F.col("event_type"))
    out = answers.application_kinds(t.events.select(F.col("user_id").alias("app"), trigger.alias("trigger")), t.events.where("value > 60").select(F.col("user_id").alias("app")))
    return out.withColumn("kinds", F.array_join("kinds", ","))


@query("flows_assembled", "with e as (select o_orderkey as flow, o_orderstatus as trigger from orders where o_orderstatus <> 'P'), r as (select flow, trigger, false as inferred from e union all select distinct l_orderkey, 'unknown', true from lineitem where l_orderkey not in (select flow from e)), s as (select l_orderkey as flow, count(*) as steps, count(*) filter (l_returnflag <> 'N') as effects, bool_or(l_quantity > 49) as incomplete from lineitem group by 1) select flow, trigger, coalesce(steps, 0) as steps, coalesce(effects, 0) as effects, coalesce(incomplete, false) as incomplete, inferred from r left join s using (flow)")
def flows_assembled(t):
    steps = t.lineitem.select(F.col("l_orderkey").alias("flow"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("type"), (F.col("l_quantity") > 49).alias("gap"))
    entries = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("flow"), F.col("o_orderstatus").alias("trigger"))
    return answers.flows_assembled(entries, steps, t.lineitem.select(F.col("l_orderkey").alias("flow")).distinct())


@query("resource_view", f"with {USES} select o_custkey as app, o_orderpriority as resource, count(distinct o_orderkey) as flows, count(distinct part) filter (type = 'READS_FROM') as reads, count(distinct part) filter (type = 'WRITES_TO') as writes from orders left join uses on flow = o_orderkey group by 1, 2")
def resource_view(t):
    flows = t.orders.select(F.col("o_orderkey").alias("flow"), F.col("o_custkey").alias("app"), F.col("o_orderpriority").alias("resource"))
    return answers.resource_view(flows, model.uses(t).select("flow", "type", F.col("part").alias("target")), t.parts("lineitem"))


@query("file_nodes", "select lower(p_type) || '/src/' || p_brand as file, count(distinct p_name || p_partkey) as functions, count(*) filter (p_size > 25) as significant, lower(p_type) || '/src' as module from part group by 1, 4")
def file_nodes(t):
    return answers.file_nodes(t.part.select(F.concat("p_name", "p_partkey").alias("symbol"), F.concat(F.lower("p_type"), F.lit("/src/"), "p_brand").alias("file"), (F.col("p_size") > 25).alias("significant")))


@query("unknown_hooks", "with h as (select distinct p_size % 10 as app, p_type as target, p_name as name from part), k as (select app, target, name, row_number() over (partition by app, target order by name) as i from h), g as (select app, target, count(*) as n, string_agg(name, ', ' order by name) filter (i <= 4) as names from k group by 1, 2) select app, string_agg(target || ': ' || names || case when n > 4 then ' (+' || (n - 4) || ' more)' else '' end, '; ' order by n, target) as text from g group by app")
def unknown_hooks(t):
    return answers.unknown_hooks(t.part.select((F.col("p_size") % 10).alias("app"), F.col("p_type").alias("target"), F.col("p_name").alias("name")))


@query("display_names", "with n as (select p_size as app, p_name as name, p_type as witness from part) select app, arg_min(name, (case witness when 'ECONOMY' then 1 when 'STANDARD' then 2 else 3 end, name)) as name from n group by app")
def display_names(t):
    return answers.display_names(t.part.select(F.col("p_size").alias("app"), F.col("p_name").alias("name"), F.col("p_type").alias("witness")), ["ECONOMY", "STANDARD"])


@query("removal_plan", f"with {USES}, stored as (select p_partkey as id, p_size % 2 = 0 as shared, p_partkey % 7 as repo from part), planned as (select p_partkey as id, p_partkey % 7 as repo from part where p_partkey % 7 in (1, 2) and p_size > 15), e as (select distinct part from uses where supplier % 7 not in (1, 2) and quantity > 40) select id, case when shared and id in (select part from e) then 'keep' else 'remove' end as action from stored where repo in (select repo from planned) and id not in (select id from planned)")
def removal_plan(t):
    stored = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("shared"), (F.col("p_partkey") % 7).alias("repo"))
    edges = model.uses(t).where("quantity > 40").select((-F.col("flow") - 1).alias("src"), F.col("part").alias("dst"), (F.col("supplier") % 7).alias("repo"))
    planned = t.part.where("p_size > 15").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).alias("repo")).where("repo in (1, 2)")
    return answers.removal_plan(stored, planned, edges)


@query("write_batches", "select p_partkey as id, p_brand as repo, cast(floor(coalesce(sum(p_size) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0) / 500.0) as bigint) as batch from part")
def write_batches(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repo"), F.col("p_size").alias("size"))
    return answers.batches(rows, "size", 500, "id", group="repo").select("id", "repo", "batch")


@query("alias_history", "with o as (select distinct p_size as app, p_name as name from part where p_brand <> 'Brand#1'), n as (select distinct p_size as app, p_name as name from part where p_brand <> 'Brand#2') select coalesce(o.app, n.app) as app, coalesce(o.name, n.name) as name, case when o.app is null then 'new' when n.app is null then 'alias' else 'current' end as state from o full join n on o.app = n.app and o.name = n.name")
def alias_history(t):
    names = lambda where: t.part.where(where).select(F.col("p_size").alias("app"), F.col("p_name").alias("name")).distinct()
    return answers.alias_history(names("p_brand <> 'Brand#1'"), names("p_brand <> 'Brand#2'"))


@query("expected_missing", "select distinct p_type as kind, p_brand as key from part where p_size < 25 and (p_type, p_brand, p_size % 5) not in (select p_type, p_brand, p_size % 5 from part where p_size >= 25) except select p_type, p_brand from part a where p_size < 25 and (p_type, p_brand, p_size % 5) in (select p_type, p_brand, p_size % 5 from part where p_size >= 25)")
def expected_missing(t):
    props = F.create_map(F.lit("size"), (F.col("p_size") % 5).cast("string"))
    facts = lambda where, *more: t.part.where(where).select(F.col("p_type").alias("kind"), F.col("p_brand").alias("key"), F.map_concat(props, *more).alias("props"))
    return answers.expected_missing(facts("p_size < 25"), facts("p_size >= 25", F.create_map(F.lit("name"), F.col("p_name")))).distinct()


@query("completeness", "with f as (select o_custkey as app, o_orderstatus = 'P' as incomplete, o_orderpriority = '5-LOW' as inferred from orders) select app, count(*) as flows, count(*) filter (incomplete) as incomplete, count(*) filter (inferred) as inferred, round(100.0::double * (count(*) - count(*) filter (incomplete)) / count(*), 1) as share from f group by app")
def completeness(t):
    return answers.completeness(t.orders.select(F.col("o_custkey").alias("app"), (F.col("o_orderstatus") == "P").alias("incomplete"), (F.col("o_orderpriority") == "5-LOW").alias("inferred")))


@query("invocations", "with o as (select 't' || n_nationkey as type, 'm' || (n_nationkey % 5) as name, 'b' || n_regionkey as owner from nation), c as (select distinct l_orderkey as caller, 't' || (l_suppkey % 30) as type, 'm' || (l_partkey % 5) as name, l_linenumber as line, l_partkey as col from lineitem) select caller, coalesce(owner, c.type) || '#' || c.name as callee, cast(row_number() over (partition by caller order by line, col, c.name, c.type) as integer) as place from c left join o on o.type = c.type and o.name = c.name")
def invocations(t):
    owners = t.nation.select(F.concat(F.lit("t"), "n_nationkey").alias("type"), F.concat(F.lit("m"), F.col("n_nationkey") % 5).alias("name"), F.concat(F.lit("b"), "n_regionkey").alias("owner"))
    calls = t.lineitem.select(F.col("l_orderkey").alias("caller"), F.concat(F.lit("t"), F.col("l_suppkey") % 30).alias("type"), F.concat(F.lit("m"), F.col("l_partkey") % 5).alias("name"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("col")).distinct()
    return answers.invocations(calls, owners)


# ------------------------------------------------------------ small functions


@query("source_url", """with x as (select o_orderkey as item, o_custkey as c, o_orderkey % 7 as k from orders) select item, case when k in (0, 1) or c % 11 = 0 then null
  else 'https://' || case when c % 3 = 0 then 'gitlab.c' || c || '.org/x' || item || '/-/blob/' else 'code' || c || '.org/y' || item || '/blob/' end || md5(cast(item as varchar)) || '/src/' || o_orderpriority || '/f' || item || '.py' || case when item % 5 > 0 then '#L' || item % 5 else '' end end as url
  from x join (select o_orderkey, o_orderpriority from orders) o on o.o_orderkey = x.item""")
def source_url(t):
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    host = F.when(c % 3 == 0, F.concat(F.lit("gitlab.c"), c, F.lit(".org/x"), key)).otherwise(F.concat(F.lit("code"), c, F.lit(".org/y"), key))
    clone = F.concat(F.when(key % 7 == 0, "ssh://").otherwise("https://"), host, F.when(key % 2 == 0, ".git").otherwise(""))
    commit = F.when(key % 7 == 1, "").when(c % 11 > 0, F.md5(key.cast("string")))
    path = F.concat(F.lit("src/"), "o_orderpriority", F.lit("/f"), key, F.lit(".py"))
    return t.orders.select(key.alias("item"), labels.source_url(clone, commit, path, key % 5).alias("url"))


@query("containers", """with x as (select o_orderkey as item, o_orderkey as n, o_custkey as c, o_orderkey % 6 as k from orders) select item,
  case k when 0 then 'com.c' || c || '.app.sub.Order' || n when 1 then 'app.c' || c || '.M' || n when 2 then 'tool' || n when 3 then 'Order' || n when 4 then 'org.c' || c else 'io.c' || c || '.m' || n || '.deep' end as container,
  case k when 0 then 'com.c' || c || '.app' when 1 then 'app.c' || c when 2 then 'tool' || n when 3 then 'Order' || n when 4 then 'org.c' || c else 'io.c' || c || '.m' || n end as library from x""")
def containers(t):
    n, c, k = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 6
    shapes = [("com.c%d.app.sub.Order%d#run(int)", c, n), ("app.c%d.M%d#go", c, n), ("tool%2$d", c, n), ("Order%2$d", c, n), ("org.c%d.Thing%d", c, n), ("io.c%d.m%d.deep.call", c, n)]
    symbol = F.coalesce(*[F.when(k == i, F.format_string(f, *args)) for i, (f, *args) in enumerate(shapes)])
    return t.orders.select(n.alias("item"), labels.container(symbol).alias("container"), labels.library_of(symbol).alias("library"))


_SIGNALS = ("one_sided", "external_call", "library", "config_unset", "unknown_hook", "version_unknown", "unread_config", "unparsed", "disagreement")


@query("pattern_owners", """with x as (select o_orderkey as item, o_custkey as c, o_orderkey as n from orders) select item, case n % 9 when 1 then case when c % 2 = 0 then 'lib' || c else 'org.c' || c || '.deep' end when 2 then 'lib' || c when 5 then 'lib' || c
  when 3 then 'config:a' || c || '.b' || n when 6 then 'config:a' || c || '.b' || n when 4 then 'org.c' || c || '.deep' when 8 then 'org.c' || c || '.deep' end as owner from x""")
def pattern_owners(t):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    signal = F.element_at(F.array(*map(F.lit, _SIGNALS)), (n % 9 + 1).cast("int"))
    target = F.when((n % 9).isin(2, 5), F.format_string("lib%d 1.%d", c, n)).when((n % 9).isin(3, 6), F.format_string("a%d.b%d.c.d", c, n)).otherwise(F.format_string("org.c%d.deep.er.Thing%d#run", c, n))
    patterns = t.orders.select(n.alias("item"), signal.alias("signal"), target.alias("target"), F.when(c % 2 == 0, F.format_string("lib%d", c)).alias("library"))
    return labels.owners(patterns).select("item", "owner")


@query("access_texts", """with x as (select o_orderkey as item, o_custkey as c, o_orderkey as n from orders) select item, case n % 9 when 0 then 'public' when 1 then 'role:A' || c || ',B' || n when 2 then 'role:R' || n when 3 then 'authenticated' when 4 then 'expression:x > ' || c
  when 5 then 'denied' when 6 then 'role' when 7 then 'role:A' || c || ',B' when 8 then case when c % 2 = 0 then 'public' end end as access from x""")
def access_texts(t):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    rules = ["permitAll", "hasAnyRole", "expression", "expression", "expression", "denyAll", "hasAuthority", "expression"]
    rule = F.coalesce(*[F.when(n % 9 == i, r) for i, r in enumerate(rules)], F.when(c % 2 == 0, "expression").otherwise("other"))
    texts = {1: F.format_string("\"A%d\", ,'B%d'", c, n), 2: F.format_string("isAuthenticated() and hasRole('R%d')", n), 3: F.lit("isAuthenticated() or x"), 4: F.format_string('"x > %d"', c), 7: F.format_string("hasAnyAuthority('A%d', 'B')", c), 8: F.lit("permitAll")}
    value = F.coalesce(*[F.when(n % 9 == i, v) for i, v in texts.items()])
    return t.orders.select(n.alias("item"), labels.access_text(rule, value).alias("access"))


@query("build_dependencies", """with x as (select p_brand as repo, p_partkey as k, p_size as v, p_name as n from part) select repo, 'm' || k || '/pom.xml' as path, 'org.acme:' || replace(n, ' ', '-') as name, case when k % 3 = 0 then null else cast(v as varchar) || '.0' end as version from x where k % 2 = 0
  union select repo, 'm' || k || '/build.gradle', 'org.acme:' || replace(n, ' ', '-'), case when k % 5 = 0 then null else '1.' || k end from x where k % 2 = 1
  union select repo, 'm' || k || '/libs.versions.toml', 'org.acme:cat' || k, case k % 3 when 0 then '2.' || v when 1 then '3.' || v else '4.' || v end from x where k % 7 = 0""")
def build_dependencies(t):
    """Build files made of parts: projects, scripts and catalogs with versions named in the same file or repository."""
    k, v, name = F.col("p_partkey"), F.col("p_size"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    pom = F.format_string(
        "<project><properties><x.version>%d.0</x.version></properties><dependencies><dependency><groupId>org.acme</groupId><artifactId>%s</artifactId><version>${%s}</version></dependency></dependencies></project>",
        v, name, F.when(k % 3 == 0, "y.version").otherwise("x.version"),
    )
    script = F.format_string("ext.v%d = '1.%d'\nimplementation \"org.acme:%s:$%s\"\n", k, k, name, F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit("v"), k)))
    rich = F.when(k % 3 == 0, F.format_string('version.ref = "v"', v)).when(k % 3 == 1, F.format_string('version = { strictly = "3.%d" }', v)).otherwise(F.format_string('version = { require = "4.%d" }', v))
    catalog = F.format_string('[versions]\nv = "2.%d"\n[libraries]\nc = { module = "org.acme:cat%d", %s }\n', v, k, rich)
    files = F.array(F.when(k % 2 == 0, F.struct(F.lit("pom.xml").alias("file"), pom.alias("text"))).otherwise(F.struct(F.lit("build.gradle").alias("file"), script.alias("text"))), F.when(k % 7 == 0, F.struct(F.lit("libs.versions.toml").alias("file"), catalog.alias("text"))))
    made = t.part.select(F.col("p_brand").alias("repo"), k.alias("k"), F.explode(F.filter(files, lambda f: f.isNotNull())).alias("f"))
    return builds.dependencies(made.select("repo", F.concat(F.lit("m"), "k", F.lit("/"), "f.file").alias("path"), F.col("f.file").alias("file"), F.col("f.text").cast("binary").alias("content")))
