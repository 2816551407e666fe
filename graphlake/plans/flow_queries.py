"""Flows: traces of calls, what runs before a handler, gaps, outlines and the flows assembled, each with its SQL.

Parts are functions: part k calls 2k + 1, 2k + 2, k + 1 if k is divisible by 5, and
k / 2 if it is divisible by 7, so that calls share functions and close cycles.  An order is a flow
that starts at the part of its first line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traces
from . import model
from .queries import STEPS, query

IO_WORDS = ("read", "write", "send", "load", "save")

#: All simple paths of each flow; a function's place is the smallest.
_PATHS = """p as (select flow, symbol, [n] as path, [symbol] as stack from roots
    union all select p.flow, e.callee, list_append(p.path, e.n), list_append(p.stack, e.callee) from p join edges e on e.key = p.{key} and e.caller = p.symbol where not list_contains(p.stack, e.callee)),
  best as (select flow, symbol, min(path) as path, arg_min(stack, path) as stack from p group by flow, symbol),
  listed as (select flow, [n] as path, symbol, false as recursive, interceptor from roots
    union all select b.flow, list_append(b.path, e.n), e.callee, list_contains(b.stack, e.callee), null from best b join edges e on e.key = b.{key} and e.caller = b.symbol),
  entries as (select l.flow, array_to_string(l.path, '.') as path, cast(len(l.path) as integer) as depth, l.path as place, l.symbol, l.recursive, l.path = b.path as first, l.interceptor,
    not l.recursive and l.path <> b.path and exists (select 1 from edges e where e.key = l.{key} and e.caller = l.symbol) as repeat from listed l join best b using (flow, symbol))"""


@query("trace_dfs", f"""with recursive {STEPS}, edges as (select flow as key, 'f' || (part % 7) as caller, 'f' || ((part + ord) % 7) as callee, row_number() over (partition by flow, part % 7 order by ord, 'f' || ((part + ord) % 7)) as n from steps),
  roots as (select flow, 'f' || (part % 7) as symbol, row_number() over (partition by flow order by part % 7) as n, null as interceptor from steps where ord = 1), {_PATHS.format(key="flow")}
  select flow, path, depth, symbol, repeat, recursive from entries""")
def trace_dfs(t):
    s = model.steps(t)
    calls = s.select("flow", F.concat(F.lit("f"), F.col("part") % 7).alias("caller"), F.concat(F.lit("f"), (F.col("part") + F.col("ord")) % 7).alias("callee"), "ord")
    roots = s.where("ord = 1").select("flow", F.concat(F.lit("f"), F.col("part") % 7).alias("symbol"))
    return traces.depth_first(calls, roots).select("flow", "path", "depth", "symbol", "repeat", "recursive")


_FLOW_SQL = f"""{STEPS}, made as (select p_partkey as a, unnest([2 * p_partkey + 1, 2 * p_partkey + 2, case when p_partkey % 5 = 0 then p_partkey + 1 end, case when p_partkey % 7 = 0 then p_partkey // 2 end]) as b, unnest([1, 2, 3, 4]) as ord from part),
  calls as (select cast(a as varchar) as caller, cast(b as varchar) as callee, ord from made where b in (select p_partkey from part)),
  significant as (select cast(p_partkey as varchar) as symbol from part where p_size % 3 <> 0),
  utilities as (select callee as symbol from calls where callee not in (select symbol from significant) group by callee having count(distinct caller) >= 2),
  edges as (select true as key, caller, callee, row_number() over (partition by caller order by ord, callee) as n from calls where caller not in (select symbol from utilities)),
  entry as (select s.flow, o_custkey % 1000 as application, cast(s.part as varchar) as handler, o_orderstatus = 'F' as http, p_brand as validated from steps s join orders on s.flow = o_orderkey join part on s.part = p_partkey where s.ord = 1),
  before as (select e.flow, cast(p_partkey as varchar) as symbol, case when p_partkey % 2 = 0 then 'filter' else 'aspect' end as interceptor from entry e join part on p_partkey % 1000 = e.application and e.http and (p_size = 1 or p_size = 2 and p_brand = e.validated)),
  started as (select flow, symbol, case when interceptor = 'filter' then 0 else 1 end as ord, interceptor from before union all select flow, handler, 2, null from entry),
  roots as (select true as yes, flow, symbol, interceptor, row_number() over (partition by flow order by ord, symbol) as n from started)"""
_FLOW_PATHS = _PATHS.replace("p.{key}", "true").replace("b.{key}", "true").replace("l.{key}", "true")
_GAPS_SQL = """lost as (select cast(p_partkey as varchar) as symbol, p_size as line, case p_partkey % 4 when 0 then 'readFile' when 1 then 'helper' || p_size when 2 then 'mapAll' else 'rowWrite' end as method, case when p_partkey % 6 = 0 then 'library type' else 'unknown receiver' end as reason from part),
  gaps as (select symbol, list(method || ' (' || reason || ')' order by line) as gaps from lost where reason = 'library type' or method in ('readFile', 'rowWrite') or method in (select 'helper' || p_size from part where p_size < 10) group by symbol),
  dressed as (select e.*, u.symbol is not null as utility, case when s.symbol is not null then cast(row_number() over (partition by e.flow, e.symbol order by e.place) as integer) end as step, case when not e.recursive and (e.first or u.symbol is not null) then g.gaps end as gaps
    from entries e left join utilities u on u.symbol = e.symbol left join significant s on s.symbol = e.symbol left join gaps g on g.symbol = e.symbol)"""


def _flows(t):
    k = F.col("p_partkey")
    symbol = lambda c: c.cast("string")
    made = t.part.select(symbol(k).alias("caller"), F.posexplode(F.array(2 * k + 1, 2 * k + 2, F.when(k % 5 == 0, k + 1), F.when(k % 7 == 0, F.floor(k / 2)))).alias("ord", "b")).where("b is not null")
    calls = made.join(t.part.select(k.alias("b")), "b", "left_semi").select("caller", symbol(F.col("b")).alias("callee"), "ord")
    significant = t.part.where("p_size % 3 <> 0").select(symbol(k).alias("symbol"))
    utilities = traces.utilities(calls, significant, 2)
    entries = model.steps(t).where("ord = 1").join(t.orders, F.col("flow") == F.col("o_orderkey")).join(t.part, F.col("part") == k).select(
        "flow", (F.col("o_custkey") % 1000).alias("application"), symbol(F.col("part")).alias("handler"), F.array(F.when(F.col("o_orderstatus") == "F", "HttpEndpoint").otherwise("Topic")).alias("labels"), F.array("p_brand").alias("validated")
    )
    interceptors = t.part.where("p_size <= 2").select(
        symbol(k).alias("symbol"), (k % 1000).alias("application"), F.when(k % 2 == 0, "filter").otherwise("aspect").alias("kind"), (F.col("p_size") == 1).alias("http"), F.when(F.col("p_size") == 2, F.col("p_brand")).alias("validates")
    )
    return traces.shared(calls, traces.with_interceptors(entries, interceptors), utilities), significant, utilities


def _dressed(t):
    """Entries of parts of flows, dressed, and the parts that flows have."""
    (heads, tails, members), significant, utilities = _flows(t)
    k = F.col("p_partkey")
    method = F.when(k % 4 == 0, "readFile").when(k % 4 == 1, F.concat(F.lit("helper"), "p_size")).when(k % 4 == 2, "mapAll").otherwise("rowWrite")
    unresolved = t.part.select(k.cast("string").alias("symbol"), F.col("p_size").alias("line"), method.alias("method"), F.when(k % 6 == 0, "library type").otherwise("unknown receiver").alias("reason"))
    own = t.part.where("p_size < 10").select(F.concat(F.lit("helper"), "p_size").alias("name"))
    return traces.dressed(heads.unionByName(tails), significant, traces.kept_gaps(unresolved, own, IO_WORDS), utilities), members


@query("flow_traces", f"with recursive {_FLOW_SQL}, {_FLOW_PATHS}, {_GAPS_SQL} select flow, path, depth, symbol, repeat, recursive, interceptor, utility, step, array_to_string(gaps, '; ') as gaps from dressed")
def flow_traces(t):
    """Interceptors, then the handler's calls; utilities closed, steps numbered, gaps kept."""
    return traces.of_flows(*_dressed(t)).select("flow", "path", "depth", "symbol", "repeat", "recursive", "interceptor", "utility", "step", F.array_join("gaps", "; ").alias("gaps"))


@query("flow_assembly", f"""with recursive {_FLOW_SQL}, {_FLOW_PATHS}, {_GAPS_SQL} select flow, count(distinct symbol) as functions, count(step) as steps, count(*) as entries, count(interceptor) as interceptors, cast(sum(coalesce(len(gaps), 0)) as bigint) as unresolved,
  sum(coalesce(len(gaps), 0)) > 0 as incomplete, array_to_string(list_sort(list_distinct(list(symbol))), ',') as symbols from dressed group by flow""")
def flow_assembly(t):
    return traces.assembled_parts(*_dressed(t)).withColumn("symbols", F.array_join("symbols", ","))


@query("flow_outline", f"""with recursive {_FLOW_SQL}, {_FLOW_PATHS}, shown as (select flow, path, place from entries where symbol in (select symbol from significant)),
  up as (select s.flow, s.path, s.place, max_by(a.path, len(a.place)) as parent from shown s left join shown a on a.flow = s.flow and len(a.place) < len(s.place) and a.place = s.place[1:len(a.place)] group by s.flow, s.path, s.place),
  numbered as (select *, cast(row_number() over (partition by flow, parent order by place) as varchar) as no from up),
  tree as (select flow, path, parent, no as number from numbered where parent is null union all select n.flow, n.path, n.parent, t.number || '.' || n.no from numbered n join tree t on t.flow = n.flow and t.path = n.parent)
  select flow, path, parent, number from tree""")
def flow_outline(t):
    """The significant entries under their nearest significant ancestors, numbered."""
    (heads, tails, members), significant, _ = _flows(t)
    shown = lambda entries: entries.join(significant, "symbol", "left_semi").withColumn("shown", F.lit(True)).select("flow", "path", "chunk", "shown")
    return traces.of_flows(traces.outlined_parts(shown(heads), shown(tails), members), members).select("flow", "path", "parent", "number")
